"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Spark deals out the documents; a task splits each text by the pattern and encodes the
distinct pre-tokens that it has not met yet. Those are loaded as rows of their tokens,
at first one a byte, and the ranks of their neighbouring pairs; each step of the recursive
query contracts every word's leftmost pair of minimum rank and joins the merge table for
the pairs on both sides of the new token, until no word has a pair left. Pre-tokens of
hundreds of bytes and more have a row for each token; there a step also contracts the
pairs that are so in their own neighbourhood, which gives the same in few steps. A join to
the vocabulary decodes the ids.

Pre-tokens beyond a window go window by window, so the memory of a query is bounded. The
next window begins at a border of the last one and the two are joined at a token that
both have there. That is exact: a row of tokens is what BPE makes of its bytes if every
two neighbours are what it makes of theirs, because the first pair to be contracted over
a border would be contracted in these two alone; and the neighbours at the seam stand
side by side in the first window.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import held, rows_of_lists, slices

#: White space as the pattern's engine has it: Unicode White_Space (Python adds U+001C to U+001F).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The public pattern with that white space; for texts of _PLAIN characters the second form says the same and is faster.
_PATTERN = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]*")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

#: Pre-tokens a worker remembers, twice over (a full generation becomes the old one).
REMEMBERED = 200_000
#: Bytes that one recursive query starts from; pre-tokens longer than the second go by _ENCODE_LONG.
QUERY_BYTES, LONG_BYTES = 200_000, 400
#: Longer pre-tokens go by windows of so many bytes, which share so many at first; tokens decoded at once.
WINDOW, OVERLAP, DECODED = 65_536, 2048, 200_000

#: The rank of a pair that is no token.
_NO_PAIR = 2147483647
#: w, the tokens t and the ranks r of their pairs; a word's last row has no pair left.
_ENCODE = f"""
with recursive s(w, t, r) as (
  select w, t, r from start
  union all
  select w, t[:i - 1] || [m] || t[i + 2:],
    r[:greatest(i - 2, 0)] || case when i > 1 then [coalesce(a.rank, {_NO_PAIR})] else [] end
      || case when i < len(r) then [coalesce(b.rank, {_NO_PAIR})] else [] end || r[i + 2:]
  from (select w, t, r, m, list_position(r, m) as i from (select *, list_min(r) as m from s) where m < {_NO_PAIR}) x
  left join merges a on a.pair = t[i - 1]::bigint * 1048576 + m
  left join merges b on b.pair = m::bigint * 1048576 + t[i + 2])
select w, t as ids from s where coalesce(list_min(r), {_NO_PAIR}) = {_NO_PAIR} order by w
"""
#: Where tokens of two bytes or more lie in long pre-tokens: every start is extended byte by byte while a token begins so.
_PLACES = """
insert into places
with recursive o(w, s, e, node, id) as (
  select w, p, p + 1, node, null::int from start join roots using (t) where p between {lo} and {hi}
  union all
  select o.w, o.s, o.e + 1, n.child, n.id from o join start b on b.w = o.w and b.p = o.e join nodes n on n.node = o.node and n.t = b.t)
select w, s, e, id as rank from o where id is not null
"""
#: Long pre-tokens: besides the leftmost pair of minimum rank, a step contracts every pair that is so among all that could
#: ever touch its tokens. What a later pair would make out of its first token and something before it, or out of its second
#: one and something after it, is itself a token that lies there on the borders of present tokens (a place); as long as no
#: place that ends or begins at the middle of the pair has a lower rank, nothing comes before the pair. Of equal ones that
#: overlap every other one goes, from the left. So the result is that of one pair after the other, in far fewer steps.
#: Only changed rows come out of a step; a token that was taken into the one before it has t = -1.
_ENCODE_LONG = """
with recursive s(w, p, q, t) using key (w, p) as (
  select w, p, p + 1, t from start
  union
  (with x as materialized (
     select *, lead(q) over win as e, lead(t) over win as next, row_number() over win as i
     from recurring.s where t >= 0 window win as (partition by w order by p)),
   pairs as materialized (
     select x.*, m.rank, min(m.rank) over (partition by w) as low from x left join merges m on m.pair = x.t::bigint * 1048576 + x.next),
   alive as materialized (
     select o.w, o.s, o.e, o.rank from places o
     join pairs a on a.w = o.w and a.p = o.s join x b on b.w = o.w and b.q = o.e
     where o.e >= a.e),
   kinds as materialized (
     select y.*, coalesce(rank <= least(ending, beginning), false) as able, coalesce(rank < ending, false) as clear from (
       select pairs.*, coalesce(l.rank, 2147483647) as ending, coalesce(r.rank, 2147483647) as beginning from pairs
       left join (select w, e, min(rank) as rank from alive group by w, e) l on l.w = pairs.w and l.e = pairs.q
       left join (select w, s, min(rank) as rank from alive group by w, s) r on r.w = pairs.w and r.s = pairs.q) y),
   chains as (
     select *, able and not clear and lag(able and rank is not null, 1, false) over win and lag(rank) over win = rank as chained
     from kinds window win as (partition by w order by p)),
   chosen as (
     select w, p, e, next_p, rank from (
       select w, p, e, q as next_p, rank, i, able and clear as first, coalesce(chained, false) as chained,
         rank is not null and p = min(case when rank = low then p end) over (partition by w) as least,
         max(case when able and clear then i end) over win as last_first,
         max(case when not coalesce(chained, false) and not (able and clear) then i end) over win as last_other
       from chains window win as (partition by w order by p))
     where least or first or (chained and last_first > coalesce(last_other, 0) and (i - last_first) % 2 = 0))
   select w, p, e, rank from chosen
   union all
   select w, next_p, e, -1 from chosen))
select w, list(t order by p) as ids from s where t >= 0 group by w order by w
"""
_DECODE = "select i.w, v.bytes from coded i join vocabulary v using (id) order by i.k"


class Bpe:
    """Ranks, merge table and what has been encoded so far, of one worker process."""

    def __init__(self, path: str, remembered: int):
        import duckdb

        self.remembered = remembered

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.has_nodes = ranks, False
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [
            (ranks[t[:k]] * 1048576 + ranks[t[k:]], r)
            for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self._keep("merges", {"pair": pa.array([p for p, _ in pairs], pa.int64()), "rank": pa.array([r for _, r in pairs], pa.int32())})
        self._keep("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        self.first_ranks = np.array([ranks.get(bytes([i, j]), _NO_PAIR) for i in range(256) for j in range(256)], np.int32)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _keep(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create table {name} as select * from given")
        self.db.unregister("given")

    def _rows(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(b) for b in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        w, p = np.repeat(np.arange(len(words)), n), np.arange(len(flat))
        return pa.table({"w": pa.array(w.astype(np.int32)), "p": pa.array(p.astype(np.int32)), "t": pa.array(self.byte_id[flat])})

    def _lists(self, words: list[bytes]) -> pa.Table:
        n = np.array([len(b) for b in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(n)])
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[first[1:-1] - 1] = False
        ranks = self.first_ranks[flat[:-1].astype(np.int64) * 256 + flat[1:]][inside]
        return pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "t": rows_of_lists(self.byte_id[flat], first), "r": rows_of_lists(ranks, np.concatenate([[0], np.cumsum(n - 1)]))})

    def _query(self, words: list[bytes]) -> pa.Table:
        self.db.register("start", self._lists(words))
        out = self.db.sql(_ENCODE).to_arrow_table()
        self.db.unregister("start")
        return out

    def _nodes(self) -> None:
        """Tables of the beginnings of all tokens, made when the first long pre-token comes."""
        at: dict[bytes, int] = {b"": 0}
        rows = []
        for token in sorted(self.ranks):
            for k in range(1, len(token) + 1):
                if token[:k] not in at:
                    at[token[:k]] = len(at)
                    rows.append((at[token[: k - 1]], self.byte_id[token[k - 1]], at[token[:k]], self.ranks.get(token[:k]) if k > 1 else None))
        node, t, child, ranks = zip(*rows, strict=True)
        self._keep("nodes", {"node": pa.array(node, pa.int32()), "t": pa.array(t, pa.int32()), "child": pa.array(child, pa.int32()), "id": pa.array(ranks, pa.int32())})
        self.db.execute("create table roots as select t, child as node from nodes where node = 0")
        self.has_nodes = True

    def _query_long(self, words: list[bytes]) -> pa.Table:
        if not self.has_nodes:
            self._nodes()
        start = self._rows(words)
        self.db.register("given", start)
        self.db.execute("create or replace table start as select * from given")
        self.db.unregister("given")
        self.db.execute("create or replace table places (w int, s int, e int, rank int)")
        for lo in range(0, start.num_rows, QUERY_BYTES):
            self.db.execute(_PLACES.format(lo=lo, hi=lo + QUERY_BYTES - 1))
        out = self.db.sql(_ENCODE_LONG).to_arrow_table()
        self.db.execute("drop table start")
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        """The ids of one long pre-token, by windows that are joined at a token which both have."""

        def window(at: int) -> tuple[np.ndarray, np.ndarray]:
            ids = np.asarray(self._query_long([raw[at : at + WINDOW]])["ids"].combine_chunks().flatten(), np.int64)
            return ids, at + np.concatenate([[0], np.cumsum(self.size[ids])])

        ids, edges = window(0)
        out, shared = [], OVERLAP
        while edges[-1] < len(raw):
            first = max(0, int(np.searchsorted(edges, edges[-1] - shared, "right")) - 1)
            nxt, borders = window(int(edges[first]))
            here, there = edges[first:-1] * len(raw) + edges[first + 1 :], borders[:-1] * len(raw) + borders[1:]
            _, i, j = np.intersect1d(here, there, assume_unique=True, return_indices=True)
            if not len(i):
                if first == 0:  # no seam in a whole window
                    return np.asarray(self._query_long([raw])["ids"].combine_chunks().flatten(), np.int64)
                shared *= 2
                continue
            out.append(ids[: first + i[0]])
            ids, edges, shared = nxt[j[0] :], borders[j[0] :], OVERLAP
        return np.concatenate([*out, ids])

    def learn(self, words: list[str]) -> None:
        """Encode and decode new pre-tokens."""
        short: list[str] = []
        size = 0
        for word in words:
            if len(raw := word.encode()) > LONG_BYTES:
                ids = self._long(raw)
                self._store([word], pa.table({"ids": pa.array([ids], pa.list_(pa.int32()))}))
                continue
            short.append(word)
            size += len(raw)
            if size >= QUERY_BYTES:
                self._store(short, self._query([x.encode() for x in short]))
                short, size = [], 0
        if short:
            self._store(short, self._query([x.encode() for x in short]))

    def _store(self, words: list[str], coded: pa.Table) -> None:
        ids = coded["ids"].combine_chunks()
        flat = np.asarray(ids.flatten(), np.uint32).tobytes()
        at = (np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))]) * 4).tolist()
        for word, lo, hi, text in zip(words, at[:-1], at[1:], self.decode(ids), strict=True):
            self.known[word] = (flat[lo:hi], text)

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids: joined to the vocabulary, in order, a bounded number at once."""
        flat = np.asarray(ids.flatten())
        owner = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(ids)))
        out = [b""] * len(ids)
        for lo in range(0, len(flat), DECODED):
            part = slice(lo, lo + DECODED)
            self.db.register("coded", pa.table({"w": pa.array(owner[part]), "k": pa.array(np.arange(len(owner[part]))), "id": pa.array(flat[part])}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("coded")
            if not found.num_rows:
                continue
            pieces = found["bytes"].combine_chunks().cast(pa.large_binary())
            edges = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
            data = pieces.buffers()[2].to_pybytes()[edges[0] : edges[-1]]
            size = np.bincount(np.asarray(found["w"]), np.diff(edges), len(ids)).astype(np.int64)
            some, ends = np.flatnonzero(size), np.cumsum(size)
            for w, lo, hi in zip(some.tolist(), (ends - size)[some].tolist(), ends[some].tolist(), strict=True):
                out[w] += data[lo:hi]
        return out

    def pieces(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """For each text its pre-tokens as (ids as little-endian 32-bit integers, decoded bytes)."""
        cut = [(_FAST if _PLAIN.fullmatch(t) else _PATTERN).findall(t) for t in texts]
        if len(self.known) > self.remembered:
            self.known, self.old = {}, self.known
        new = []
        for word in set().union(*cut) - self.known.keys():
            if (had := self.old.get(word)) is not None:
                self.known[word] = had
            else:
                new.append(word)
        self.learn(new)
        found = [list(map(self.known.__getitem__, c)) for c in cut]
        for word in new:
            if len(word) > LONG_BYTES:
                del self.known[word]
        return found


def loaded(path: str, remembered: int = REMEMBERED) -> Bpe:
    return held(("bpe", path, remembered), lambda: Bpe(path, remembered))


#: What encode() can return besides doc_id.
OUTPUTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "binary"}


def encode(docs: DataFrame, ranks_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), remembered: int = REMEMBERED) -> DataFrame:
    """doc_id and the chosen OUTPUTS for every row of docs(doc_id, text, ...).

    n_tokens and ids (token ids in order), ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded (the bytes that decoding the ids gives back) and
    decoded_sha256. Strings that look like special tokens are ordinary text.

    Workers remember remembered pre-tokens, twice over: it bounds their memory and changes
    no result. A null text is an empty one: no ids. Texts and their pre-tokens may be of any
    length. Rows may repeat and doc_id may be null; every row is answered. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        bpe = loaded(ranks_path, remembered)
        for b in slices(batches):
            pieces = bpe.pieces([t or "" for t in b.column("text").to_pylist()])
            ids = [b"".join([p[0] for p in c]) for c in pieces]
            out = {"n_tokens": lambda: pa.array([len(i) // 4 for i in ids], pa.int64())}
            out["ids_sha256"] = lambda: pa.array([hashlib.sha256(i).hexdigest() for i in ids])
            out["decoded_sha256"] = lambda: pa.array([hashlib.sha256(b"".join([p[1] for p in c])).hexdigest() for c in pieces])
            out["decoded"] = lambda: pa.array([b"".join([p[1] for p in c]) for c in pieces], pa.binary())
            out["ids"] = lambda: rows_of_lists(np.frombuffer(b"".join(ids), np.int32), np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(out[o]() for o in outputs)], names=["doc_id", *outputs])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{o} {OUTPUTS[o]}" for o in outputs)]))


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, decoded) for every row of coded(doc_id, ids, ...): the bytes of the ids in order.

    Null and empty id lists give empty bytes; ids outside the vocabulary are an error.
    """

    def run(batches):
        bpe = loaded(ranks_path)
        size = bpe.db.sql("select max(id) + 1 from vocabulary").fetchall()[0][0]
        for b in batches:
            ids = b.column("ids")
            flat = np.asarray(ids.flatten())
            if len(flat) and (flat.min() < 0 or flat.max() >= size):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bpe.decode(ids), pa.binary())], names=["doc_id", "decoded"])

    return coded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
