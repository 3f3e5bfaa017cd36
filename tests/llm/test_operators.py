"""The corpus operators against brute force, libraries and held-out accuracy, and on edge cases."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from edges import EDGES
from pyspark.sql import functions as F

from harrow.llm import bpe, decontam, embed_dedup, langid, lm, minhash, pii, quality, token_counts, token_ids
from harrow.llm import queries as registered

EDGE_ROWS = [(i, t) for i, t, _ in EDGES]


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def found(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1 near duplicates


def test_near_duplicates(spark, docs, rows):
    got = found(minhash.near_duplicates(spark, docs, width=4))
    want = brute.near_duplicates(rows, 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_repeated_ids(spark):
    """Two texts under one id: what is near either of them is reached, whatever the partitions."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(5, a), (5, b), (11, a + " end"), (13, a + " fin"), (12, b + " end"), (20, c), (21, c + " end"), (20, b + " fin"), (30, None), (30, "alone here")]
    want = {5: 5, 11: 5, 12: 5, 13: 5, 20: 5, 21: 5, 30: 30}
    for parts in (1, 7):
        got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), width=4).collect()
        assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_near_duplicates_edges(spark, edges, empty):
    out = minhash.near_duplicates(spark, edges, width=4)
    want = brute.near_duplicates([r for r in EDGE_ROWS if r[0]], 4)
    got = found(out)
    assert out.count() == len(EDGES) + 1
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i} == want
    assert want[900005][1] == 900004 and want[900010][1] == 900008 and want[900009][1] == 900008
    assert minhash.near_duplicates(spark, empty).count() == 0
    kept = minhash.drop_duplicates(spark, edges, width=4)
    assert kept.columns == edges.columns and kept.where("doc_id = 900008").count() == 1


def test_group_of_copies_and_chain(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [(k, " ".join(words[k : k + 57])) for k in range(4)]
    group = [(100 + k, " ".join(f"g{i}" for i in range(80)) + f" tail{k}") for k in range(150)]
    df = spark.createDataFrame([*chain, *group], "doc_id long, text string")
    got = found(minhash.near_duplicates(spark, df, width=4))
    want = brute.near_duplicates([*chain, *group], 4)
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in want.items()}


# ---- 2 personal data


def test_base_spans(spark, docs, rows, edges):
    for df, given in ((docs, rows), (edges, EDGE_ROWS)):
        text = dict(given)
        for i, r in found(pii.digest(spark, df)).items():
            spans = brute.base_spans(text[i])
            kinds = Counter(s[3] for s in spans)
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
            assert r["base_sha256"] == brute.base_digest(text[i])
            written = [s for s in r["spans"].split(",") if s]
            assert {f"{k}:{s}:{e}" for s, _, e, k in spans} <= set(written)


def test_context_discovers_and_redacts(spark, empty):
    seeds = [(i, f"hello there contact: user{i + 100}x@mail.example.org thanks") for i in range(40)]
    hidden = [(100, "hello there contact: handle_77831 thanks")]
    df = spark.createDataFrame([*seeds, *hidden, (101, "nothing to see 2024-ish here")], "doc_id long, text string")
    got = found(pii.digest(spark, df))
    start = hidden[0][1].index("handle_77831")
    assert got[100]["spans"] == f"context:{start}:{start + 12}" and got[101]["spans"] == ""
    out = found(pii.redact(spark, df))
    assert out[100]["text"] == "hello there contact: <context> thanks"
    assert out[0]["text"] == "hello there contact: <email> thanks"
    assert pii.digest(spark, empty).count() == 0
    # The two ways of applying the patterns agree: as a table in the tasks, and by a join.
    joined = found(pii.digest(spark, df, limit=0))
    assert {i: r["spans"] for i, r in joined.items()} == {i: r["spans"] for i, r in got.items()}


SECRET = re.compile(r'token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|(AKIA[0-9A-Z]{16})')


def test_context_finds_planted_secrets(spark):
    """Over a whole table: every secret, and nothing else but runs of 16 digits, which cards have as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    planted = {(i, *m.span(m.lastindex)) for i, t in texts.items() for m in SECRET.finditer(t)}
    contexts = {(i, *map(int, s.split(":")[1:])) for i, r in found(pii.digest(spark, docs)).items() for s in r["spans"].split(",") if s.startswith("context")}
    assert len(planted) > 10 and planted <= contexts
    assert all(re.fullmatch("[0-9]{16}", texts[i][a:b]) for i, a, b in contexts - planted)


def test_shapes_of_seeds_are_found_without_a_cue(spark):
    """Seeds teach the shape of their values: one that no word announces is found, another shape is not."""
    digits = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(14)]
    rows = [(i, f'settings{i} token = "{d}" more{i} words') for i, d in enumerate(digits[:12])]
    rows += [(50, f"plainly {digits[12]} here"), (51, f"plainly {digits[13][:30]} here")]
    got = found(pii.digest(spark, spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[50]["spans"] == "context:8:48" and got[51]["spans"] == ""


def redacted(text, spans):
    out, at = "", 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return out + text[at:]


def test_redact(spark, edges):
    """Texts of every kind, one with thousands of hits, and columns of any name."""
    many = " ".join(f"é{i} u{i}@mail.example.org and 10.0.{i % 256}.7 or +44 20 7946 {i:04d}" for i in range(3000))
    df = edges.unionByName(spark.createDataFrame([(910000, many, "en")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    df = df.withColumn("n_chars", F.lit(-1))
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(spark, df).collect()}
    assert spans[910000].count(",") == 8999
    out = pii.redact(spark, df)
    assert out.columns == df.columns and out.count() == df.count()
    after = found(out)
    for r in df.collect():
        want = r["text"] if not spans[r["doc_id"]] else redacted(r["text"], spans[r["doc_id"]])
        assert after[r["doc_id"]]["text"] == want
        assert after[r["doc_id"]]["n_chars"] == (len(want) if spans[r["doc_id"]] else -1)


# ---- 3, 4, 7 tokens


def test_token_counts(spark, docs, rows, edges, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df, given in ((docs, rows), (edges, EDGE_ROWS)):
        got = found(token_counts.count_tokens(spark, df, path))
        for i, t in given:
            n = len(model.encode(t or "", num_threads=1))
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(spark, edges, path).count() == len(EDGES) + 1
    assert token_counts.count_tokens(spark, empty, path).count() == 0


def test_token_ids(spark, docs, rows, edges, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df, given in ((docs, rows), (edges.where("doc_id is not null").dropDuplicates(["doc_id"]), [r for r in EDGE_ROWS if r[0]])):
        got, start = found(token_ids.write_and_read(spark, df, path)), 0
        for i, t in sorted(given):
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert token_ids.write_and_read(spark, edges, path).count() == len(EDGES) + 1
    assert token_ids.write_and_read(spark, empty, path).count() == 0
    token_ids.write_ids(spark, docs, path, f"file://{tmp_path}/ids")
    one = token_ids.read_ids(spark, f"file://{tmp_path}/ids").where(F.col("doc_id") == rows[0][0])
    assert one.count() == 1


def test_token_id_files(spark, docs, tmp_path):
    """ORC as promised: integers in run-length encoding, row indexes and Bloom filters on ids, and a filter that skips stripes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    token_ids.write_ids(spark, docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/ids")
    orc = jvm.org.apache.orc.OrcFile
    seen = 0
    for file in (tmp_path / "ids").glob("*.orc"):
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), orc.readerOptions(conf))
        rows = reader.rows()
        assert reader.getRowIndexStride() == token_ids.INDEX_STRIDE
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            streams = {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            assert {(1, "ROW_INDEX"), (1, "DATA"), (2, "ROW_INDEX"), (2, "LENGTH"), (3, "DATA")} <= streams
            assert any(c == 1 and kind.startswith("BLOOM_FILTER") for c, kind in streams)
            assert {str(footer.getColumns(c).getKind()) for c in (1, 2, 3)} == {"DIRECT_V2"}  # run-length encoding, second version
            seen += 1
        rows.close()
    assert seen
    some = token_ids.read_ids(spark, f"file://{tmp_path}/ids").where(F.col("doc_id") == docs.first()["doc_id"])
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 1


def test_byte_bpe(spark, docs, rows, edges, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, given in ((docs, rows), (edges, EDGE_ROWS)):
        got = found(bpe.encode(df, path, ("n_tokens", "ids_sha256", "decoded_sha256")))
        for i, t in given:
            ids = library.encode_ordinary(t or "")
            assert got[i]["n_tokens"] == len(ids)
            assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = found(bpe.decode(bpe.encode(docs, path), path))
    assert all(bytes(back[i]["decoded"]) == (t or "").encode() for i, t in rows)
    assert bpe.encode(empty, path).count() == 0


def test_byte_bpe_of_long_runs():
    """Pre-tokens of 10,000 characters of many kinds, one by one and together, as the library has them and in about a second."""
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(7)
    draw = lambda parts, n=10_000: "".join(r.choice(parts) for _ in range(n))
    runs = [
        draw("abcdefghijklmnopqrstuvwxyz"), draw("abcXYZtheTHE"), draw("0123456789"), draw("!?#=-*./\\"), draw("漢字語文", 3000), draw(["the", "ing", "tion", "er"], 4000),
        draw("aab"), "x" * 10_000, "ab" * 5000, "-" * 9_999, "=" * 401, " " * 5000, "\n" * 5000, "é" * 3000, "😀😃" * 1000, draw("aA", 450)]
    bpe_ = bpe.Bpe(path, bpe.REMEMBERED)
    for words in (*([x] for x in runs), runs):
        began = time.perf_counter()
        ids = bpe_._query_long([x.encode() for x in words])["ids"].to_pylist()
        assert time.perf_counter() - began < 10 * len(words)
        assert ids == [list(library._encode_single_piece(x.encode())) for x in words]
    short = [x[:300] for x in runs]
    assert bpe_._query([x.encode() for x in short])["ids"].to_pylist() == [list(library._encode_single_piece(x.encode())) for x in short]


def test_byte_bpe_has_a_row_for_a_word_and_step():
    """The recursion has one row for each word and contraction, however long the words; ids and bytes are the library's."""
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe_ = bpe.Bpe(path, 100)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    words = [b"a", b" ", b"ab", b"aaaa", "é".encode(), b"unbelievable", *(rng.choice(list(b"etaoin shr"), n).astype(np.uint8).tobytes() for n in range(1, 400, 7))]
    ids = [list(library._encode_single_piece(x)) for x in words]
    coded = bpe_._query(words)["ids"]
    assert coded.to_pylist() == ids and bpe_.decode(coded.combine_chunks()) == words
    assert bpe_.decode(pa.array([[], ids[5], [], ids[3]], pa.list_(pa.int32()))) == [b"", words[5], b"", words[3]]
    bpe_.db.register("start", bpe_._lists(words))
    rows = bpe_.db.sql(bpe._ENCODE[: bpe._ENCODE.rindex("select")] + "select count(*) from s").fetchall()[0][0]
    assert rows == sum(len(x) - len(i) + 1 for x, i in zip(words, ids, strict=True))


def test_byte_bpe_windows(monkeypatch):
    """Windows so small that most seams need another try, and some none can be found."""
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe_ = bpe.Bpe(path, 100)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_.ranks, special_tokens={})
    r = random.Random(11)
    for window, overlap in ((40, 1), (150, 8), (1000, 64)):
        monkeypatch.setattr(bpe, "WINDOW", window)
        monkeypatch.setattr(bpe, "OVERLAP", overlap)
        for parts in ("ab", "abcdefgh", "the quick brown".split(), ["x"], "=-", "漢字仮", ["tion", "ing", "a"], "0123456789"):
            text = "".join(r.choice(parts) for _ in range(700)).encode()
            assert bpe_._long(text).tolist() == library._encode_single_piece(text)


def test_byte_bpe_of_runs_beyond_memory(spark):
    """Runs of 1 and 5 MB through the operator, each alone far beyond what one query may hold."""
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(13)
    texts = ["short", base64.b64encode(r.randbytes(3_750_000)).decode().translate(str.maketrans("+/=0123456789", "abcdefghijklm")), "y" * 1_000_000 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in bpe.encode(df, path, ("ids_sha256", "decoded_sha256")).collect():
        text = texts[row["doc_id"]]
        ids = library.encode_ordinary(text)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# ---- 5 language model


@pytest.mark.parametrize("bounds", [{}, {"common_words": 40, "bucket_tokens": 700, "passes": 3}])
def test_katz(spark, docs, rows, edges, bounds):
    """Scores by the formulas, held-out texts with unknown words and repeated rows included; the bounds change nothing."""
    table = docs.select("doc_id", "text").unionByName(edges.where("doc_id is not null and length(text) < 5000 or text is null").select("doc_id", "text")).where("length(text) < 2000 or text is null")
    rows = [tuple(r) for r in table.collect()]
    model = brute.katz([t for i, t in rows if crc(i, 7) != 2])
    _, counts, total = model
    got = found(lm.score(spark, table, **bounds))
    new = 0
    for i, t in rows:
        tokens = [(w,) for w in [*brute.words_of(t), "</s>"]]
        r = got[i]
        assert r["held_out"] == (crc(i, 7) == 2) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(w in counts[0] for w in tokens))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[0][w] + 1) / (total + len(counts[0]) + 1)) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(brute.katz_score(model, t), rel=1e-8)
        new += len(tokens) - r["n_known"]
    assert new > 100


def test_katz_histories_sum_to_one(rows):
    train = [t for i, t in rows if crc(i, 7) != 2 and t is not None and len(t) < 1000]
    probability, counts, _ = brute.katz(train)
    words = [w for w, in counts[0]]
    for h in [(), ("<s>",), *sorted(counts[1])[::997], *((h[1],) for h in sorted(counts[1])[::991])]:
        if h[-1:] != ("</s>",):
            assert sum(probability(w, h) for w in [*words, "<a new word>"]) == pytest.approx(1, abs=1e-9)


def test_discounts():
    """Good-Turing with the common factor where the counts of counts allow it, a half off elsewhere."""
    n = np.array([0, 1000, 300, 140, 80, 50, 30])
    a = 6 * 30 / 1000
    want = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, 6)]
    np.testing.assert_allclose(lm.discounts(n)[1:], [*want, 1])
    np.testing.assert_allclose(lm.discounts(np.zeros(7, int))[1:], [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9, 1])


@pytest.mark.parametrize("n", [0, 1, 7, 20_000])
def test_katz_places_and_groups(n):
    """The open table finds what a binary search finds, keys that share low bits included; groups are those of equal keys, high bits shared or not."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), np.arange(min(n, 300)) << 20]))
    x = np.concatenate([keys, rng.integers(-(2**63), 2**63 - 1, n + 5), np.arange(600) << 20])
    at, there = lm.Places(keys)(x)
    place, known = lm._find(keys, x)
    assert (there == known).all() and (at[there] == place[known]).all()
    key = np.concatenate([x, x[::-1], rng.integers(0, 50, n)])
    rows, back = lm._grouped(key)
    assert len(rows) == len(np.unique(key)) and (key[rows][back] == key).all()


def test_katz_edges(spark, edges, empty):
    got = lm.score(spark, edges)
    assert got.count() == len(EDGES) + 1
    assert found(got)[900001]["n_tokens"] == 1
    assert lm.score(spark, empty).count() == 0


# ---- 6 quality, 8 language


def test_quality_ranks_held_out(spark, docs, sf_dir, edges, empty):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = found(quality.classify(spark, docs, labels))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    held = [(got[i]["predicted"], q) for i, q in truth.items() if i in got and crc(i, 5) == 0]
    assert held and sum(p == q for p, q in held) >= 0.85 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert quality.classify(spark, edges, labels).count() == len(EDGES) + 1
    assert quality.classify(spark, empty, labels).count() == 0
    assert quality.classify(spark, edges, labels.limit(0)).where("predicted = 0").count() == 0


def test_quality_against_plain_features(spark, docs, rows, edges, sf_dir):
    """Features one by one, weights where the logistic loss of the pairs is least, and the scores that follow."""
    given = [*rows, *EDGE_ROWS]
    plain = {i: np.array(brute.quality_features(t)) for i, t in given if i is not None}
    for df in (docs, edges.where("doc_id is not null").dropDuplicates(["doc_id"])):
        for i, r in found(quality.feature_table(df)).items():
            np.testing.assert_allclose(r["features"], plain[i], rtol=1e-9, atol=1e-12)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and crc(r["doc_id"], 5) and r["doc_id"] in dict(rows)}
    ids = sorted(y)
    ranker = quality.Ranker(np.stack([plain[i] for i in ids]), np.array([y[i] for i in ids]))
    for i, r in found(quality.classify(spark, docs, labels)).items():
        assert r["score"] == pytest.approx(ranker.score(plain[i][None])[0], rel=1e-6, abs=1e-9)
    d = np.random.default_rng(1).normal(size=(300, 5)) + 0.3
    w = quality._logistic(d, 1e-3)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 5e-4 * w @ w
    assert all(loss(w) <= loss(w + step) for step in 1e-3 * np.vstack([np.eye(5), -np.eye(5)]))


def test_quality_learns_from_all_labels(spark):
    """Labels beyond any number of rows count: those of largest hash change the scores too."""
    n = 21_000
    texts = [(i, " ".join(["word", "Other.", "x1"][: i % 3 + 1] * (1 + i % 5)), int(i % 7 > 1)) for i in range(n)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int").repartition(8).cache()
    taught = df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    df = df.unionByName(taught.withColumn("doc_id", F.col("doc_id") + 10**6)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    assert df.count() > 20_500
    last = [r["doc_id"] for r in df.orderBy(F.xxhash64("doc_id").desc()).limit(500).collect()]
    probe = df.limit(50)
    flipped = df.withColumn("quality", F.when(F.col("doc_id").isin(last), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({r["doc_id"]: r["score"] for r in quality.classify(spark, df, x).join(probe.select("doc_id"), "doc_id").collect()} for x in (df, flipped))
    assert any(abs(one[i] - two[i]) > 1e-6 for i in one)


@pytest.mark.parametrize(("good", "bad"), [(400, 90), (30, 300), (5, 300)])
def test_quality_blocks(spark, monkeypatch, good, bad):
    """Every text of both labels is in a block, and the fit is that of the blocks' pairs one by one."""
    monkeypatch.setattr(quality, "COMMONER", 32)
    monkeypatch.setattr(quality, "RARER", 4)
    rng = np.random.default_rng(5)
    x = rng.random((good + bad, len(quality.NAMES)))
    x[:good, :3] += 0.2
    y = np.arange(good + bad) < good
    rows = spark.createDataFrame([(i, int(q), v.tolist()) for i, (q, v) in enumerate(zip(y, x, strict=True))], "doc_id long, quality int, features array<double>").repartition(3)
    ranker = quality.fit(spark, rows)
    dealt = [[np.array(r[k]) for k in ("good", "bad")] for r in quality.blocks(rows, good, bad).collect()]
    assert len(dealt) > 1
    for side, given in ((0, x[y]), (1, x[~y])):
        assert {tuple(v) for block in dealt for v in block[side]} == set(map(tuple, given))
        commoner = len(given) == max(good, bad)
        assert not commoner or sum(len(block[side]) for block in dealt) == len(given)
    z = quality._expand(x)
    np.testing.assert_allclose(ranker.mean, z.mean(axis=0))
    np.testing.assert_allclose(ranker.scale, z.std(axis=0) + 1e-6)
    d = [ranker.standard(g[None]) - ranker.standard(b[None]) for goods, bads in dealt for g in goods for b in bads]
    np.testing.assert_allclose(ranker.weights, quality._logistic(np.concatenate(d), 1e-3), rtol=1e-6, atol=1e-9)
    scores = ranker.raw(x)
    right = lambda cut: (scores[y] >= cut).sum() + (scores[~y] < cut).sum()
    assert right(ranker.threshold) >= max(map(right, np.quantile(scores, np.linspace(0.001, 0.999, 999)))) - 1


def test_language_held_out(spark, docs, edges, empty):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = found(langid.identify(spark, docs))
    held = [(got[i]["lang_pred"], x) for i, x in lang.items() if x is not None and crc(i, 3) == 1 and got[i]["lang_pred"] != "und"]
    assert held and sum(p == q for p, q in held) >= 0.9 * len(held)
    some = found(langid.identify(spark, edges))
    assert {some[i]["lang_pred"] for i in (900001, 900002, 900003, 900013)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in some.values())
    assert langid.identify(spark, empty).count() == 0


@pytest.mark.parametrize("entries", [40, langid.CACHE_ENTRIES])
def test_language_against_brute_force(spark, docs, edges, entries):
    """However little the tasks hold, every word and n-gram of the training texts counts."""
    table = docs.select("doc_id", "text", "lang").unionByName(edges.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang"))
    rows = [tuple(r) for r in table.collect()]
    score = brute.language_model([(t, x) for i, t, x in rows if x is not None and crc(i, 3) != 1])
    got = found(langid.identify(spark, table, entries))
    for i, t, _ in rows:
        lang, share = score(t)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(share, abs=1e-3)


def test_language_backs_off_to_shorter_grams(spark):
    rows = [(i, "zapzapzap" if i % 2 else "bolobolo", "xx" if i % 2 else "yy") for i in range(60)]
    df = spark.createDataFrame([*rows, (1000, "bolzap zapzap", None), (1001, "olobol", None)], "doc_id long, text string, lang string")
    got = found(langid.identify(spark, df))
    assert (got[1000]["lang_pred"], got[1001]["lang_pred"]) == ("xx", "yy")


# ---- 9 vectors


def vector_links(rows):
    x = {i: np.asarray(v, float) for i, v, lab in rows if lab is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = sorted(x)
    return [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt(x[a] @ x[a]) / np.sqrt(x[b] @ x[b]) >= 0.93]


def test_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    rng = np.random.default_rng(3)
    top = max(r[0] for r in rows)
    for k in range(60):  # near copies of stored vectors
        v = np.asarray(rows[k][1]) + rng.normal(0, 0.02, len(rows[k][1]))
        rows.append((top + 1 + k, v.tolist(), rows[k][2]))
    e = rows[0][1]
    rows += [(top + 100, None, 1), (top + 101, [0.0] * len(e), 1), (top + 102, [None, *e[1:]], 1), (top + 103, [math.inf, *e[1:]], 1), (top + 104, e, None), (top + 105, e, rows[0][2]), (top + 106, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("key", "rep", "k", "a", "b", "size")})
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    links = vector_links(rows)
    n = Counter(i for pair in links for i in pair)
    low = brute.smallest_reachable([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(spark, df).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (n[i], low[i]) for i in low}
    assert embed_dedup.near_duplicate_vectors(spark, df.limit(0)).count() == 0


# ---- 10 benchmark


def test_templates(spark, edges, empty):
    item = "a train that leaves Boston at 9 travels 240 miles in 4 hours so how fast does it go on average"
    other = "a train that leaves Denver at 7 travels 135 miles in 3 hours so how fast does it go on average"
    clash = "a train that leaves Denver at 7 travels 135 miles in 3 hours and 7 people asked 8 times how fast"
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short but sweet passage"), (None, item)], "item_id long, text string")
    filler = "some words before the passage that nobody would ever ask about and "
    df = spark.createDataFrame(
        [(1, filler + item), (2, filler + other), (3, filler), (4, "it was a short but sweet passage of time"), (5, None), (6, clash)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(spark, df, benchmark).collect()}
    assert {(1, 1), (2, 1), (4, 4)} <= set(got) and not {i for i, _ in got} & {3, 5}
    assert got[2, 1]["n_slots"] > 0
    assert decontam.find_leaks(spark, empty, benchmark).count() == 0
    assert decontam.find_leaks(spark, df, benchmark.limit(0)).count() == 0
    kept = decontam.drop_leaks(spark, edges, benchmark)
    assert kept.columns == edges.columns and kept.count() == len(EDGES) + 1


def test_leaks_against_brute_force(spark, docs, rows, edges, sf_dir):
    """Every document against every item, window by window; also items and texts full of numbers, units and names."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(9001, "Convert 5 km to 12 miles"), (9002, "Alice ran 12 km Monday, Bob ran 9 km Tuesday, Carol ran 7 km Friday; total km?"), (9003, ""), (9004, "x" * 300), (9005, "Long text of words. Long text of words.")]
    more = [(950001, "he said: Convert 7 km to 30 miles now"), (950002, items[0][1].replace(" ", "  ") + " and " + items[1][1]), (950003, "So, Alice ran 3 km Monday, Dan ran 9 km Tuesday, Carol ran 8 km Friday; total km?")]
    table = docs.select("doc_id", "text").unionByName(edges.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks([*rows, *((i, t) for i, t in EDGE_ROWS if i), *more], items, set(decontam.UNITS))
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"]) for r in decontam.find_leaks(spark, table, benchmark).collect()}
    assert got == want and len(want) > 3 and (950001, 9001) in want


def test_planted_passages(spark, docs, rows, sf_dir):
    """A document that holds an item's words whole is found."""
    items = [(r["item_id"], " ".join(brute.words_of(r["text"]))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {i: " ".join(brute.words_of(t)) for i, t in rows}
    whole = {(d, i) for d, t in texts.items() for i, q in items if len(q.split()) > 12 and q in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert whole <= got


def test_registered():
    assert len(registered.queries()) == 10 and set(registered.oracle_sql()) <= set(registered.queries())
