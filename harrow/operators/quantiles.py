"""Exact medians of columns of any size: selection by narrowing ranges.

A sketch proposes a range about the middle, a count proves how many values lie below and
inside it; that goes on within the range until few values are left, which are sorted.
Each round leaves about a five-thousandth, so three or four passes do for any table, and
no task ever holds more than LIMIT values of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a column that are sorted in one place at most.
LIMIT = 100_000
_ACCURACY, _MARGIN = 10_000, 3e-4


def medians(df: DataFrame, cols: tuple[str, ...] | list[str], limit: int = LIMIT) -> dict[str, float | None]:
    """The median of each numeric column, the mean of the two middle values where there is an even number; null without values.

    Nulls don't count; NaN is larger than anything. df is read several times: a stored table.
    """
    if not cols:
        return {}
    values = df.select(*(F.col(c).cast("double").alias(f"v{n}") for n, c in enumerate(cols)))
    first = values.agg(*(f(f"v{n}").alias(f"{name}{n}") for n in range(len(cols)) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    open_, ranges = [], {}
    for n in range(len(cols)):
        if count := first[f"n{n}"]:
            # lo, hi, how many values lie below and inside, the two middle ranks, and how wide the next range is.
            ranges[n] = {"lo": first[f"lo{n}"], "hi": first[f"hi{n}"], "below": 0, "inside": count, "ranks": ((count - 1) // 2, count // 2), "margin": _MARGIN}
            open_.append(n)
    while open_ := [n for n in open_ if ranges[n]["inside"] > limit and not _same(ranges[n]["lo"], ranges[n]["hi"])]:
        _narrow(values, {n: ranges[n] for n in open_})
    out: dict[str, float | None] = dict.fromkeys(cols)
    sort = [n for n in ranges if not _same(ranges[n]["lo"], ranges[n]["hi"])]
    picked = {n: [ranges[n]["lo"]] * 2 for n in ranges}
    if sort:
        lists = [F.sort_array(F.collect_list(F.when(_inside(n, ranges[n]), F.col(f"v{n}")))).alias(f"l{n}") for n in sort]
        ends = [F.array(*(F.element_at(f"l{n}", r - ranges[n]["below"] + 1) for r in ranges[n]["ranks"])).alias(f"m{n}") for n in sort]
        found = values.agg(*lists).select(*ends).first()
        picked |= {n: found[f"m{n}"] for n in sort}
    return out | {cols[n]: (a + b) / 2 if not _same(a, b) else a for n, (a, b) in picked.items()}


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _inside(n: int, at: dict):
    return (F.col(f"v{n}") >= F.lit(at["lo"])) & (F.col(f"v{n}") <= F.lit(at["hi"]))


def _narrow(values: DataFrame, ranges: dict[int, dict]) -> None:
    """Replace each range by a smaller one that holds both middle ranks, in two passes for all columns."""
    sketches = []
    for n, at in ranges.items():
        low, high = ((r - at["below"]) / at["inside"] for r in at["ranks"])
        shares = [max(0.0, low - at["margin"]), min(1.0, high + at["margin"])]
        sketches.append(F.percentile_approx(F.when(_inside(n, at), F.col(f"v{n}")), shares, _ACCURACY).alias(f"s{n}"))
    found = values.agg(*sketches).first()
    counts = []
    for n in ranges:
        a, b = found[f"s{n}"]
        v = F.col(f"v{n}")
        counts += [F.count(F.when(v < F.lit(a), 1)).alias(f"below{n}"), F.count(F.when((v >= F.lit(a)) & (v <= F.lit(b)), 1)).alias(f"inside{n}")]
    proved = values.agg(*counts).first()
    for n, at in ranges.items():
        a, b = found[f"s{n}"]
        below, inside = proved[f"below{n}"], proved[f"inside{n}"]
        if below <= at["ranks"][0] and at["ranks"][1] < below + inside and inside < at["inside"]:
            at |= {"lo": a, "hi": b, "below": below, "inside": inside}
        elif at["margin"] < 1:
            at["margin"] *= 10  # the sketch was off
        else:  # many equal values: what lies below, at and above the sketch's middle
            _split(values, n, at)


def _split(values: DataFrame, n: int, at: dict) -> None:
    """Leave one side of a value inside the range, or the value alone."""
    v, inside = F.col(f"v{n}"), _inside(n, at)
    middle = values.agg(F.percentile_approx(F.when(inside, v), (at["ranks"][0] - at["below"]) / at["inside"], _ACCURACY)).first()[0]
    is_, less = v == F.lit(middle), v < F.lit(middle)
    s = values.agg(
        F.count(F.when(inside & less, 1)).alias("less"), F.count(F.when(inside & is_, 1)).alias("same"),
        F.max(F.when(inside & less, v)).alias("before"), F.min(F.when(inside & (v > F.lit(middle)), v)).alias("behind")).first()
    a, b = (r - at["below"] for r in at["ranks"])
    if b < s["less"]:
        at |= {"hi": s["before"], "inside": s["less"], "margin": _MARGIN}
    elif a >= s["less"] + s["same"]:
        at |= {"lo": s["behind"], "below": at["below"] + s["less"] + s["same"], "inside": at["inside"] - s["less"] - s["same"], "margin": _MARGIN}
    elif a >= s["less"] and b < s["less"] + s["same"]:
        at |= {"lo": middle, "hi": middle, "below": at["below"] + s["less"], "inside": s["same"]}
    else:  # the middle values lie on two sides of a border: they are what the border has there
        pair = (s["before"], middle) if a < s["less"] else (middle, s["behind"])
        at |= {"lo": sum(pair) / 2, "hi": sum(pair) / 2}
