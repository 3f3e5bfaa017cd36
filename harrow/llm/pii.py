"""Personal data: fixed patterns, and contexts learned from what they find. DataFrame functions only.

Base spans come from regular expressions. Every run of at least six characters of
A-Z a-z 0-9 @ . _ % + - with three digits in it is a candidate: other identifiers are
not looked for. A candidate's patterns are the one to three chunks of text to its left
(figures alike), its shape (digits by number, letters by class; long codes by class and
length), and its shape with the chunk on either side.

Seeds are the candidates inside base spans, those that a word like "token" or "password"
assigns, and those of a public key format. Patterns and instances form a graph: a
pattern is as good as its distinct instances (smoothed mean), an instance that is no
seed as good as its patterns together (noisy or), in turns. Candidates that have a
pattern of high confidence, and the seeds outside base spans, become spans of kind
context. A left context of words alone must be surer and better attested than one with
a mark like : or = in it.

The documents are read twice, each time map-only: for the candidates, and to write the
result. The patterns travel to the second pass as one bounded table, or beyond that
bound by a join on the keys of the documents that have an open candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import materialize, small

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
#: A pattern needs so many distinct instances with a score, and this confidence, to discover.
MIN_INSTANCES, CONFIDENCE = 5, 0.8
#: The same for left contexts of words alone.
PLAIN_INSTANCES, PLAIN_CONFIDENCE = 20, 0.95
#: Up to so many patterns go to the tasks as a table (8 bytes each, and their buckets), more by a join.
TABLE_PATTERNS = 1 << 19

#: Marks that announce a value.
CUE = r"[:=#\"'(<\[+]"
#: Seeds besides the base spans: what these words assign, and values of public key formats.
SEED_CUE = r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\"'`]?\s?[:=]\s?[\"'`]?$"
SEED_FORMAT = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36})$"

#: The base patterns as possessive forms: same matches, no backtracking over long runs.
#: A card is a maximal run of 14 to 19 digits; the other checks follow the match.
_REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "candidate": r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z@._%+-]*+[0-9])[A-Za-z0-9@._%+-]{6,}+",
}
#: What a text must contain for the pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "candidate": None}
#: Long texts are cut by pieces of so many characters, arrays walked through in blocks of so many entries.
_PIECE, _BLOCK = 1024, 256

_SPAN = "struct<start:int,rank:int,end:int>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walk(items: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(at, item) = (next at, array<kind>) gives out over all items, at running from 0. Linear but for block copies."""
    none = F.array().cast(f"array<{kind}>")

    def one(state: Column, item: Column) -> Column:
        at, made = step(state["at"], item)
        return F.struct(at.cast("int").alias("at"), F.concat(state["out"], made).alias("out"))

    def all_of(held: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            return F.aggregate(
                F.slice(held, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(state["at"].alias("at"), none.alias("out")), one,
                lambda done: F.struct(done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), ((F.size(held) - 1) / _BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(held) > 0, F.aggregate(blocks, start, block, lambda done: F.flatten(done["out"]))).otherwise(none)

    return _let(items, all_of)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters start to end (exclusive) of a text in pieces; touches the pieces in between only."""
    first = (start / _PIECE).cast("int")
    some = F.array_join(F.slice(pieces, first + 1, ((end - 1) / _PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * _PIECE + 1, end - start)).otherwise("")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)

    def term(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), term) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        # Numbers may have leading zeros and any length; without them at most 255.
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    if kind == "candidate":
        return F.length(_digits(hit)) >= 3
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """array<struct<start, end, hit>> of a pattern's matches that pass its check."""
    tried = text.contains(_NEEDS[kind]) if _NEEDS[kind] else F.lit(True)
    tried = tried if kind == "email" else tried & text.rlike("[0-9]")
    fields = "struct<start:int,end:int,hit:string>"

    def placed(hits: Column) -> Column:
        sized = F.zip_with(hits, F.slice(F.split(text, _REGEX[kind], -1), F.lit(1), F.size(hits)), lambda hit, gap: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start, end = at + x["gap"], at + x["gap"] + F.length(x["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
            return end, F.when(_valid(kind, x["hit"]), F.array(span)).otherwise(F.array().cast(f"array<{fields}>"))

        return F.when(F.size(hits) > 0, _walk(sized, step, fields)).otherwise(F.array().cast(f"array<{fields}>"))

    none = F.array().cast(f"array<{fields}>")
    return F.when(tried, _let(F.regexp_extract_all(text, F.lit(_REGEX[kind]), F.lit(0)), placed)).otherwise(none)


def _base(text: Column) -> Column:
    """The base spans, by start, then kind."""
    def ranked(kind: str) -> Column:
        return F.transform(_matches(kind, text), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))

    return F.sort_array(F.concat(*map(ranked, KINDS[:4])))


def _shape(hit: Column) -> Column:
    figures = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    return (
        F.when(hit.rlike("^[0-9a-f]{12,}$") & hit.rlike("[a-f]"), F.concat(F.lit("h"), F.length(hit).cast("string")))
        .when(hit.rlike("^[0-9A-Z]{12,}$") & hit.rlike("[A-Z]"), F.concat(F.lit("u"), F.length(hit).cast("string"), F.lit(" "), F.regexp_extract(hit, "^[A-Z]{0,4}", 0)))
        .otherwise(F.substring(figures, 1, 64)))


def _patterns(hit: Column, left: Column, right: Column) -> Column:
    """Hashes of a candidate's patterns; the lowest bit tells a left context of words alone."""

    def key(name: Column, plain: Column, *parts: Column) -> Column:
        return F.shiftleft(F.xxhash64(name, *parts), 1).bitwiseOR(plain.cast("long"))

    def context(n: int) -> Column:
        return F.regexp_extract(F.regexp_replace(F.lower(left), "[0-9]", "0"), rf"(?:^|\s)((?:\S+\s+){{{n - 1}}}\S+\s*|(?:\S+\s+){{{n}}})$", 1)

    no = F.lit(False)
    lefts = F.filter(F.array(*(F.struct(F.lit(f"left{n}").alias("name"), context(n).alias("of")) for n in (1, 2, 3))), lambda c: c["of"] != "")
    return _let(_shape(hit), lambda shape: _let(lefts, lambda found: F.concat(
        F.array(key(F.lit("shape"), no, shape), key(F.lit("after"), no, shape, F.regexp_extract(right, r"^(\s*\S+)", 1))),
        F.transform(found, lambda c: key(c["name"], ~c["of"].rlike(CUE), c["of"])),
        F.transform(F.filter(found, lambda c: c["name"] == "left1"), lambda c: key(F.lit("before"), no, shape, c["of"])))))


_CANDIDATE = "struct<start:int,end:int,value:bigint,base:boolean,seed:boolean,patterns:array<bigint>>"


def _candidates(text: Column, base: Column) -> Column:
    """The candidates of a text: place, hash of the value, whether in a base span, whether another seed, patterns."""
    found = F.transform(_matches("candidate", text), lambda m: _let(F.length(F.regexp_replace(m["hit"], "[@._%+-]+$", "")), lambda n: F.struct(
        (m["start"] + n).alias("at"), F.lit(0).alias("order"), m["start"].alias("start"), F.substring(m["hit"], F.lit(1), n).alias("hit"))))
    opened = F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("order"), s["end"].alias("start"), F.lit("").alias("hit")))

    def placed(pieces: Column) -> Column:
        # In order of the base spans' starts and the candidates' ends, with the furthest end of a base span so far.
        def step(reach: Column, x: Column) -> tuple[Column, Column]:
            right = F.substring(F.array_join(F.slice(pieces, (x["at"] / _PIECE).cast("int") + 1, F.lit(2)), ""), x["at"] % _PIECE + 1, F.lit(32))
            made = _let(_cut(pieces, F.greatest(F.lit(0), x["start"] - 96), x["start"]), lambda left: F.struct(
                x["start"].alias("start"), x["at"].alias("end"), F.xxhash64(x["hit"]).alias("value"), (reach > x["start"]).alias("base"),
                (left.rlike(SEED_CUE) | x["hit"].rlike(SEED_FORMAT)).alias("seed"), _patterns(x["hit"], left, right).alias("patterns")))
            none = F.array().cast(f"array<{_CANDIDATE}>")
            return F.when(x["order"] == 1, F.greatest(reach, x["start"])).otherwise(reach), F.when(x["order"] == 0, F.array(made)).otherwise(none)

        return _walk(F.sort_array(F.concat(found, opened)), step, _CANDIDATE)

    return F.when(text.rlike("[0-9]"), _let(_pieces(text), placed)).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))


def _best_patterns(spark: SparkSession, rows: DataFrame, rounds: int, min_instances: int, confidence: float) -> DataFrame:
    """(pattern) of high confidence, from the texts of rows(row, text, base, candidates). Written."""
    each = rows.select(F.explode("candidates").alias("c"))
    edges = each.select(F.explode("c.patterns").alias("pattern"), F.col("c.value").alias("value"), (F.col("c.base") | F.col("c.seed")).alias("seed"))
    edges = materialize(spark, edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    # A pattern of fewer instances can never be good.
    often = materialize(spark, edges.groupBy("pattern").count().where(F.col("count") >= min_instances).select("pattern"), "pii-often")
    # Few patterns go to the edges, so that a pattern of many edges does not bring them to one place.
    edges = materialize(spark, edges.join(small(often, 16), "pattern", "left_semi"), "pii-graph")
    seeds = edges.where("seed").select("value").distinct().select("value", F.lit(1_000_000).cast("long").alias("score"))
    scores = seeds = materialize(spark, seeds, "pii-seeds")
    plain = F.col("pattern").bitwiseAND(F.lit(1)) == 1
    good = None
    for _ in range(rounds):
        # Scores are summed in millionths, so any order gives the same.
        known = edges.join(scores, "value", "left").groupBy("pattern").agg(
            F.sum(F.coalesce("score", F.lit(0))).alias("mass"), F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))
        good = known.where(F.col("scored") >= min_instances).select("pattern", "scored", (F.col("mass") / 1e6 / (F.col("n") + 1)).alias("confidence"))
        good = materialize(spark, good, "pii-patterns")
        doubt = F.round(F.log(F.lit(1.000001) - F.col("confidence")) * 1e6).cast("long")
        heard = edges.where("not seed").join(small(good, 32), "pattern").groupBy("value").agg(F.sum(doubt).alias("doubt"))
        heard = heard.select("value", F.round((1 - F.exp(F.col("doubt") / 1e6)) * 1e6).cast("long").alias("score")).where("score >= 500000")
        scores = materialize(spark, seeds.union(heard).groupBy("value").agg(F.max("score").alias("score")), "pii-scores")
    bar = (F.col("confidence") >= confidence) & (~plain | ((F.col("confidence") >= PLAIN_CONFIDENCE) & (F.col("scored") >= max(min_instances, PLAIN_INSTANCES))))
    return materialize(spark, good.where(bar).select("pattern"), "pii-best")


def _spanned(candidates: Column, chosen: Callable[[Column], Column]) -> Column:
    kept = F.filter(candidates, lambda c: ~c["base"] & (c["seed"] | chosen(c)))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("context")).alias("rank"), c["end"].alias("end")))


def _with_contexts(spark: SparkSession, rows: DataFrame, best: DataFrame, limit: int) -> DataFrame:
    """rows with context, the discovered spans: those of seeds outside base spans and of candidates with a pattern in best."""
    n = best.count()
    if n <= limit:
        size = 1 << max(4, n.bit_length())  # buckets of about one pattern; looking one up touches one bucket
        buckets = best.groupBy(F.pmod("pattern", F.lit(size)).alias("id")).agg(F.collect_list("pattern").alias("of"))
        entry = F.struct("id", F.coalesce("of", F.array().cast("array<bigint>")).alias("of"))
        table = spark.range(size).join(buckets, "id", "left").agg(F.sort_array(F.collect_list(entry)).alias("all")).select(F.transform("all", lambda e: e["of"])).scalar()
        return rows.withColumn("table", table).withColumn("context", _spanned(
            F.col("candidates"), lambda c: F.exists(c["patterns"], lambda p: F.array_contains(F.element_at("table", (F.pmod(p, F.lit(size)) + 1).cast("int")), p)))).drop("table")
    open_ = F.exists("candidates", lambda c: ~c["base"] & ~c["seed"] & (F.size(c["patterns"]) > 0))
    keyed = rows.where(open_).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64("text", F.lit(7))})
    each = keyed.select("k1", "k2", F.explode("candidates").alias("c")).where("not c.base and not c.seed")
    met = each.select("k1", "k2", "c.start", F.explode("c.patterns").alias("pattern")).join(best, "pattern").select("k1", "k2", "start").distinct()
    met = materialize(spark, met.groupBy("k1", "k2").agg(F.collect_list("start").alias("met")), "pii-found")
    joined = keyed.join(met, ["k1", "k2"], "left").withColumn("context", _spanned(F.col("candidates"), lambda c: F.coalesce(F.array_contains("met", c["start"]), F.lit(False))))
    return rows.where(~open_).withColumn("context", _spanned(F.col("candidates"), lambda c: F.lit(False))).unionByName(joined.select(*rows.columns, "context"))


def find(
    spark: SparkSession, docs: DataFrame, rounds: int = ROUNDS, min_instances: int = MIN_INSTANCES, confidence: float = CONFIDENCE, limit: int = TABLE_PATTERNS,
) -> DataFrame:
    """row (a struct of the columns of docs), text, base and all: the sorted spans (start, rank in KINDS, end) of every row of docs(text, ...).

    base holds the spans of the fixed patterns, all those and the discovered ones.
    Positions count code points, end is exclusive. A null text is an empty one and has
    no spans. Rows may repeat and lack an id; every row is answered, and patterns count
    distinct values, so repeated rows teach nothing more. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"))
    rows = rows.withColumn("base", _base(F.col("text"))).withColumn("candidates", _candidates(F.col("text"), F.col("base")))
    best = _best_patterns(spark, rows, rounds, min_instances, confidence)
    rows = _with_contexts(spark, rows, best, limit)
    return rows.select("row", "text", "base", F.sort_array(F.concat("base", "context")).alias("all"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts per kind, the hash of the base spans and all spans in writing, for every row of docs(doc_id, text, ...)."""
    spans = find(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return spans.select(
        "row.doc_id", *map(count, KINDS[:4]), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"),
        count("context"), F.size("all").cast("long").alias("n_spans"))


def redact(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; other columns as they are.

    Of overlapping spans the first names the whole stretch. A text without spans stays
    as it is (a null one null); n_chars, if there, is counted anew where a text changes.
    """
    spans = find(spark, docs, **options)
    names = F.array(*map(F.lit, KINDS))
    end = F.lit(2**31 - 1)

    def parts(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            new = F.array(_cut(pieces, at, s["start"]), F.concat(F.lit("<"), F.element_at(names, s["rank"] + 1), F.lit(">")))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(new)

        after = F.array_max(F.transform("all", lambda s: s["end"]))
        rest = F.array_join(F.slice(pieces, (after / _PIECE).cast("int") + 1, end), "")
        return F.concat(F.array_join(_walk(F.col("all"), step, "string"), ""), F.substring(rest, after % _PIECE + 1, end))

    out = spans.withColumn("new", F.when(F.size("all") > 0, _let(_pieces(F.col("text")), parts)))
    columns = {c: F.col("row")[c] for c in docs.columns}
    columns["text"] = F.coalesce("new", columns["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast("long")).otherwise(columns["n_chars"])
    return out.select(*(x.alias(c) for c, x in columns.items()))
