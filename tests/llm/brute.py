"""Plain Python statements of what the operators must return, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the personal data that the fixed patterns find."""
    kinds = ("email", "ip", "card", "phone")
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for rank, (kind, pattern) in enumerate(zip(kinds, patterns, strict=True)):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1]), 1))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base_spans(text)).encode()).hexdigest()


def words_of(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def smallest_reachable(ids, links) -> dict:
    low = {i: i for i in ids}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    return {i: top(i) for i in ids}


def near_duplicates(rows, width: int) -> dict:
    """doc_id to (set size, component) by comparing every pair."""
    sets = {}
    for doc_id, text in rows:
        w = words_of(text)
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    component = smallest_reachable(ids, links)
    return {i: (len(sets[i]), component[i]) for i in ids}


def language_model(train):
    """score(text) = (language, share) by words first and n-grams of 4 to 1 characters, from (text, lang) pairs."""
    n, totals = defaultdict(Counter), Counter()
    for text, lang in train:
        for word in letter_runs(text):
            for kind in (0, 4, 3, 2, 1):
                for part in [word] if kind == 0 else [word[i : i + kind] for i in range(len(word) - kind + 1)]:
                    n[kind, part][lang] += 1
                    totals[kind, lang] += 1
    langs = sorted({lang for _, lang in totals})
    entries = Counter(kind for kind, _ in n)

    def logs(kind, part):
        return [math.log((n[kind, part][x] + 0.5) / (totals[kind, x] + 0.5 * entries[kind] + 1)) for x in langs]

    def word_score(word):
        if (0, word) in n:
            return logs(0, word)
        for kind in (4, 3, 2, 1):
            known = [logs(kind, g) for g in (word[i : i + kind] for i in range(len(word) - kind + 1)) if (kind, g) in n]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    def score(text):
        words = letter_runs(text)
        if not words or not langs:
            return "und", 0.0
        total = [sum(x) for x in zip(*map(word_score, words), strict=True)]
        share = 1 / sum(math.exp(x - max(total)) for x in total)
        return langs[total.index(max(total))], share

    return score


def letter_runs(text):
    return [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ") if w]


def katz(train, k=5):
    """A Katz model of order three of texts, plainly: probability(word, history), its words, and counts by order."""
    counts = [Counter(), Counter(), Counter()]
    for text in train:
        tokens = [*words_of(text), "</s>"]
        before = ["<s>", *tokens]
        for i, w in enumerate(tokens):
            counts[0][(w,)] += 1
            counts[1][before[i], w] += 1
            if i:
                counts[2][before[i - 1], before[i], w] += 1
    total = sum(counts[0].values())

    def factors(c):
        n = Counter(c.values())
        a = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        d = {}
        for r in range(1, k + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
            d[r] = x if 0 < x < 1 else (r - 0.5) / r
        return d

    d = [factors(c) for c in counts]
    size = Counter()  # of every history
    after = defaultdict(list)
    for c in counts:
        for gram, n in c.items():
            size[gram[:-1]] += n
            after[gram[:-1]].append((gram[-1], n))

    def kept(h, n):
        return d[len(h)].get(n, 1.0) * n / size[h] * (1.0 if any(x <= k for _, x in after[h]) else size[h] / (size[h] + 1))

    weights = {}

    def weight(h):
        if h not in weights:
            left, room = 1 - sum(kept(h, n) for _, n in after[h]), 1 - sum(probability(w, h[1:]) for w, _ in after[h])
            weights[h] = max(left, 1e-12) / room if room > 1e-12 else 1e-12
        return weights[h]

    def probability(w, h):
        n = counts[len(h)].get((*h, w), 0)
        if n:
            return kept(h, n)
        if not h:
            return 1 - sum(kept((), n) for _, n in after[()]) if total else 1.0
        return (weight(h) if size[h] else 1.0) * probability(w, h[1:])

    return probability, counts, total


def katz_score(model, text):
    probability, _, _ = model
    tokens = [*words_of(text), "</s>"]
    before = ["<s>", *tokens]
    return sum(math.log10(probability(w, tuple(before[max(0, i - 1) : i + 1]))) for i, w in enumerate(tokens))


def quality_features(text):
    """The features of a text, one by one, in the operator's order."""
    raw, words = (text or "").encode(), [w.encode() for w in words_of(text)]
    kept = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return [0.0] * 22
    n = len(words)

    def share(chars):
        return sum(b in chars for b in raw) / len(raw)

    def among(test):
        return sum(map(test, range(n))) / n

    upper, lower, symbol = (range(65, 91), range(97, 123), b"#$%&*@^~<>{}[]\\_=+`/")
    lines = [line for line in (words_of(x) for x in re.split("\n", text)) if line]
    bags = [tuple(sorted(line)) for line in lines]
    pairs = list(zip(words, words[1:], strict=False))
    return [
        math.log1p(n), sum(map(len, words)) / n / 10, share(upper), share(b"0123456789"), share(symbol), share(b"|"), share(b"!?"), share(b"."), share(b","), share(b"-:;'\"()"),
        sum(b > 127 for b in raw) / len(raw), len(set(words)) / n, len(set(pairs)) / max(1, n - 1), sum(a == b for a, b in pairs) / n,
        (len(bags) - len(set(bags))) / max(1, len(bags)), math.log1p(len(lines)), among(lambda i: len(words[i]) > 12), among(lambda i: len(words[i]) < 4),
        among(lambda i: sum(b in upper for b in kept[i]) > 1 and not any(b in lower for b in kept[i])), among(lambda i: any(b in symbol for b in kept[i])),
        among(lambda i: not any(b in lower for b in kept[i])), max(Counter(words).values()) / n]


def template(text, units):
    """(word as a template has it, the word itself, whether it is a slot) of a text's words that hold letters or digits."""
    raw, out, last = (text or "").encode(), [], None
    for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw):
        body = re.search(rb"[0-9A-Za-z\x80-\xff](?:.*[0-9A-Za-z\x80-\xff])?", m[0], re.DOTALL)
        if not body:
            continue
        start, end = m.start() + body.start(), m.start() + body.end()
        word = body[0].lower()
        number = re.fullmatch(rb"[0-9][0-9.,]*", word) is not None
        unit = not number and word.decode(errors="replace") in units
        opens = last is None or any(b in b".!?:\n" for b in raw[last:start])
        name = not number and not unit and not opens and 65 <= raw[start] <= 90
        out.append(("<number>" if number else "<unit>" if unit else "<name>" if name else word, word, number or unit or name))
        last = end
    return out


def leaks(docs, items, units, width=8, least=3):
    """{(doc, item): (windows, item windows)} by comparing every window of every text with every window of every item."""
    def windows(text, own, opened):
        t = template(text, units)
        for i in range(len(t) - own + 1):
            part = t[i : i + own]
            tokens, values, slots = ([x[k] for x in part] for k in range(3))
            yield i, ("t", *tokens), [v for v, s in zip(values, slots, strict=True) if s]
            if any(slots):
                yield i, ("w", *values), []
            if opened and tokens[0] == "<name>":
                yield i, ("t", values[0], *tokens[1:]), [v for v, s in zip(values[1:], slots[1:], strict=True) if s]

    wins = defaultdict(list)
    sizes, crowded = defaultdict(set), defaultdict(set)
    own_width = {}
    for item, text in items:
        if own := min(width, len(template(text, units))):
            own_width[item] = own
            for pos, key, slots in windows(text, own, False):
                wins[key].append((item, pos, slots))
                sizes[item].add(pos)
                if 2 * len(slots) > own:
                    crowded[item].add(pos)
    found = defaultdict(list)
    for doc, text in docs:
        for own in set(own_width.values()):
            for at, key, filled in windows(text, own, True):
                for item, pos, slots in wins.get(key, ()):
                    if own_width[item] == own and len(slots) == len(filled):
                        found[doc, item, at - pos].append((pos, own, slots, filled))

    def consistent(pairs):
        return len({a for a, _ in pairs}) == len(pairs)

    best = {}
    for (doc, item, _), rows in found.items():
        pairs = {p for _, _, a, b in rows for p in zip(a, b, strict=True)}
        few = {p for _, own, a, b in rows if 2 * len(a) <= own for p in zip(a, b, strict=True)}
        sparse = len({pos for pos, own, a, _ in rows if 2 * len(a) <= own})
        exact = len({pos for pos, _, a, _ in rows if not a})
        telling = 4 * sum(own - len(a) for _, own, a, _ in rows) >= sum(own for _, own, _, _ in rows)
        n = len({r[0] for r in rows}) if consistent(pairs) and telling else sparse if consistent(few) and sparse > exact else exact
        if n:
            was = best.get((doc, item), (0, 0))
            best[doc, item] = max(was[0], n), max(was[1], sparse if consistent(few) else 0)
    out = {}
    for (doc, item), (n, sparse) in best.items():
        size, others = len(sizes[item]), len(sizes[item]) - len(crowded[item])
        if n >= min(size, least) or (others and sparse >= min(others, least)):
            out[doc, item] = n, size
    return out
