"""The same results in SQL for another engine, put together from shared table expressions."""

from __future__ import annotations

CUT = "1997-01-01"
EARLY = "1995-03-01"
_ORDER = "o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"

PURCHASES = f"""p as (
  select o_custkey as usr, l_partkey as item, l_quantity as label, o_orderdate as ts,
    row_number() over (order by {_ORDER}) as ord,
    l_orderkey, l_linenumber, l_suppkey
  from orders join lineitem on l_orderkey = o_orderkey)"""
CLICKS = """p as (
  select user_id as usr, cast(json_extract_string(props, '$.k') as bigint) as item, value as label, ts,
    row_number() over (order by ts, event_id) as ord, event_type, event_id
  from events)"""


def _vocab(src: str = "p") -> str:
    return f"""uv as (select usr, (row_number() over (order by usr))::int as u from (select distinct usr from {src})),
iv as (select item, (row_number() over (order by item))::int as i from (select distinct item from {src}))"""


ENC = f"""{_vocab()},
enc as (select p.*, u, i from p join uv using (usr) join iv using (item))"""
R = "r as (select u, i, arg_max(label, ord)::double as r from enc group by u, i)"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


ALL = (PURCHASES, ENC, R)


def _world(last: int = 1) -> tuple[str, ...]:
    """Purchases split by the last rows per user; vocabulary and R of train."""
    return (
        PURCHASES,
        "n as (select *, row_number() over (partition by usr order by ord) as k, count(*) over (partition by usr) as n from p)",
        f"tagged as (select *, k > n - (case when n < 3 then 0 when n <= {last} then 1 else {last} end) as is_test from n)",
        "train as (select * from tagged where not is_test)",
        "test as (select * from tagged where is_test and usr in (select usr from train) and item in (select item from train))",
        _vocab("train"),
        "enc as (select t.*, u, i from train t join uv using (usr) join iv using (item))", R,
        "tenc as (select t.*, u, i from test t join uv using (usr) join iv using (item))",
    )


def _stats(x: str, pivot: str, r: str = "r", pre: str = "") -> str:
    return f"""{pre}ss as (select {x} as x, sum(r * r) as ss from {r} group by 1),
{pre}st as (select a.{x} as x1, b.{x} as x2, sum(a.r * b.r) as dot, count(*) as cnt from {r} a join {r} b on a.{pivot} = b.{pivot} and a.{x} < b.{x} group by 1, 2)"""


def _cos(ss: str = "ss", st: str = "st", name: str = "cos", min_common: int = 1) -> str:
    return f"""{name} as (select x1, x2, case when dot = 0 or a.ss = 0 or b.ss = 0 then 0 else dot / (sqrt(a.ss) * sqrt(b.ss)) end as sim
  from {st} join {ss} a on a.x = x1 join {ss} b on b.x = x2 where cnt >= {min_common})"""


def _near(pairs: str = "cos", k: int = 20) -> str:
    return f"""near as (select * from (select x, nb, sim, row_number() over (partition by x order by round(sim, 9) desc, nb) as rk
  from (select x1 as x, x2 as nb, sim from {pairs} union all select x2, x1, sim from {pairs})) where rk <= {k})"""


def _swing(r: str = "r", pre: str = "") -> str:
    return f"""{pre}w as (select u, 1 / sqrt(count(*)) as w from {r} group by u),
{pre}common as (select a.u as u, b.u as v, count(*) as c from {r} a join {r} b on a.i = b.i and a.u < b.u group by 1, 2 having count(*) > 1),
{pre}scored as (select c.u, c.v, x.w * y.w / (0.1 + c - 1) as s from {pre}common c join {pre}w x on x.u = c.u join {pre}w y on y.u = c.v),
{pre}cells as (select s.u, s.v, s.s, a.i from {pre}scored s join {r} a on a.u = s.u join {r} b on b.u = s.v and b.i = a.i),
{pre}swing as (select a.i as x1, b.i as x2, sum(a.s) as sim from {pre}cells a join {pre}cells b on a.u = b.u and a.v = b.v and a.i < b.i group by 1, 2 having abs(sum(a.s)) > 1e-8)"""


_ITEM = (_stats("i", "u"), _cos(), _near())
_USER = (_stats("u", "i"), _cos(), _near())
_SWING = (_swing(), _near("swing"))


def _predict(target: str, task: str, digits: int = 6) -> str:
    other = "u" if target == "i" else "i"
    value = "s / n" if task == "ranking" else "case when s = 0 then 0 else sr / s end"
    return f"""pred as (select t.u, t.i, round(coalesce({value}, 0), {digits}) as pred from (select distinct u, i from tenc) t left join (
  select q.u, q.i, sum(sim) as s, sum(sim * r.r) as sr, count(*) as n from (select distinct u, i from tenc) q
  join near on near.x = q.{target} join r on r.{target} = near.nb and r.{other} = q.{other} group by 1, 2) m using (u, i))"""


def _recommend(target: str, n: int = 10) -> str:
    if target == "i":
        raw = "select r.u, near.nb as i, sum(r.r * sim) as score from r join near on near.x = r.i group by 1, 2"
    else:
        raw = "select near.x as u, r.i, sum(sim * r.r) as score from near join r on r.u = near.nb group by 1, 2"
    return f"""raw as ({raw}),
rec as (select * from (select u, i, round(score, 6) as score, (row_number() over (partition by u order by round(score, 6) desc, i))::int as rk
  from raw where not exists (select 1 from r where r.u = raw.u and r.i = raw.i)) where rk <= {n})"""


_DECODED = 'select usr as "user", item, score, rk from rec join uv using (u) join iv using (i)'


def _list(value: str = "i", order: str = "ord", name: str = "items") -> str:
    return f"array_to_string(list({value} order by {order}), ',') as {name}"


def _consumed(src: str = "enc", key: str = "u", value: str = "i", name: str = "c") -> str:
    return f"{name} as (select * from (select *, lag({value}) over (partition by {key} order by ord) as b from {src}) where b is null or b <> {value})"


def _uniform(*parts: str) -> str:
    joined = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5({joined}), 1, 8))::bigint / 4294967296.0)"


def _by_user(src: str, part: str, keep_known: bool) -> str:
    parts = [
        src, "n as (select *, row_number() over (partition by usr order by ts, ord) as k, count(*) over (partition by usr) as n from p)",
        f"parts as (select usr, item, label, ({part})::int as part from n)"]
    if not keep_known:
        return _with(*parts) + 'select part, usr as "user", item, label from parts'
    # Later parts by joins with the users and items of train, train as it is.
    parts += ["ku as (select distinct usr from parts where part = 0)", "ki as (select distinct item from parts where part = 0)"]
    later = "select p.part, p.usr, p.item, p.label from parts p join ku on ku.usr = p.usr join ki on ki.item = p.item where p.part > 0"
    return _with(*parts) + f'select part, usr as "user", item, label from (select part, usr, item, label from parts where part = 0 union all {later})'


def _ratio_part(cuts: list[float]) -> str:
    whens = " ".join(f"when k > round_even(n * {c!r}::double, 0) then {len(cuts) - j}" for j, c in enumerate(reversed(cuts)))
    return f"case when n < 3 then 0 {whens} else 0 end"


def _num_part(last: int) -> str:
    return f"(k > n - (case when n < 3 then 0 when n <= {last} then 1 else {last} end))::int"


_UNKNOWN = (PURCHASES, f"tr as (select * from p where ts < '{EARLY}')", f"te as (select * from p where ts >= '{EARLY}')")
_AUC = """by_score as (select {keys} pred, sum((label = 1)::int) as p, sum((label <> 1)::int) as n from pl group by all),
won as (select *, coalesce(sum(n) over ({part} order by pred rows between unbounded preceding and 1 preceding), 0) as below from by_score)"""
_TEST = (*_world(5), *_ITEM)
_PL = "pl as (select u, i, (l > 25)::int::double as label, pred from pred join (select u, i, arg_max(label, ord) as l from tenc group by 1, 2) using (u, i))"
_RATED = "pl as (select u, i, l::double as label, pred from pred join (select u, i, arg_max(label, ord) as l from tenc group by 1, 2) using (u, i))"
_PREDS = (*_TEST, _predict("i", "ranking", 9), _PL)

_ITEMS = """feat as (select p_partkey as item, p_brand, p_type, p_size, p_retailprice, split_part(p_name, ' ', 1) as tag1,
  case when p_partkey % 3 = 0 then 'missing' else split_part(p_name, ' ', 2) end as tag2 from part)"""
_BATCH = (PURCHASES, ENC, f"o as (select u, i, arg_max(label, ord)::double as r from enc where ts < '{CUT}' group by u, i)", f"b as (select u, i, arg_max(label, ord)::double as r from enc where ts >= '{CUT}' group by u, i)")


def _index(col: str, src: str = "feat") -> str:
    return f"ix_{col} as (select {col} as v, (row_number() over (order by {col}))::int as idx from (select distinct {col} from {src} where {col} is not null))"


def _incremental(x: str, pivot: str) -> str:
    return _with(
        *_BATCH, _stats(x, pivot, "o", "o"), _stats(x, pivot, "b", "b"), _cos("oss", "ost", "old"),
        "nss as (select x, sum(ss) as ss from (select * from oss union all select * from bss) group by x)",
        "nst as (select x1, x2, sum(dot) as dot, sum(cnt) as cnt from (select * from ost union all select * from bst) group by 1, 2)",
        "touched as (select nst.* from nst join bst using (x1, x2))", _cos("nss", "touched", "fresh"),
    ) + "select x1, x2, round(coalesce(f.sim, o.sim), 9) as sim from old o full join fresh f using (x1, x2)"


_PROBE = f"""cast(floor({_uniform('42', 'row', 'k', 'attempt')} * (select count(*) from iv)) as int) + 1"""


def _probes(num: int, attempts: int) -> str:
    return f"""rw as (select u::bigint * 4294967296 + i as row, u, i from r),
pb as (select *, {_PROBE} as neg from rw, (select unnest(generate_series(1, {num}))::int as k), (select unnest(generate_series(1, {attempts}))::int as attempt))"""


_FIRST = "select row, u, i, k, arg_min(neg, case when {bad} then 1000 - attempt else attempt end) as neg from {src} group by row, u, i, k"


def _mixed(value: str, key: str) -> str:
    return f"((({value} + {key}) * 1640531527 % 4294967296) // 64 * 1540483477 % 4294967296) // 256"


def _distinct(num: int, batch: int) -> str:
    """Draws of a batch are places in a permutation: three rounds over a grid, again for results beyond the items."""
    halves = ["x // b as l0", "x % b as r0"]
    for j in range(3):
        halves += [f"(l{j} + {_mixed(f'r{j}', f'a{j}')}) % a as l{j + 1}", f"(r{j} + {_mixed(f'l{j + 1}', f'b{j}')}) % b as r{j + 1}"]
    keys = ", ".join(f"""floor({_uniform('42', "'order'", 'batch', f"'{j}{side}'")} * 1073741824)::bigint as {side}{j}""" for j in range(3) for side in "ab")
    carried = "row, u, i, batch, k, tries, n, a, b, " + ", ".join(f"{side}{j}" for j in range(3) for side in "ab")
    parts = (
        *ALL, "sz as (select count(*) as n from iv)", "grid as (select n, ceil(sqrt(n))::bigint as a, ceil(n / ceil(sqrt(n)))::bigint as b from sz)",
        "rw as (select u::bigint * 4294967296 + i as row, u, i from r)", "nr as (select *, row_number() over (order by row) - 1 as pos from rw)",
        f"dr as (select row, u, i, pos // {batch} as batch, pos % {batch} as place, k from nr, (select unnest(generate_series(1, {num})) as k))",
        f"pl as (select *, (place * {num} + k - 1) % n as x1, (place * {num} + k - 1 + {batch * num}) % n as x2 from dr, grid)",
        f"ky as (select distinct batch, {keys} from dr)",
        "xs as (select row, u, i, batch, k, n, a, b, 1 as tries, x1 as x from pl union all select row, u, i, batch, k, n, a, b, 2, case when x1 = x2 then (x2 + 1) % n else x2 end from pl)",
        f"wk as (select {carried}, x, 0 as step from xs join ky using (batch) union all select {carried}, l3 * b + r3 as x, step + 1 from (select *, {', '.join(halves)} from wk where step = 0 or x >= n))",
        "ends as (select row, u, i, batch, k, tries, (x + 1)::int as neg from wk where step > 0 and x < n)")
    return "with recursive " + ",\n".join(parts) + """
select o.row, o.u, o.i, o.batch, o.k::int as k, case when o.neg = o.i then s.neg else o.neg end as neg from ends o join ends s on s.row = o.row and s.k = o.k and s.tries = 2 where o.tries = 1"""


_VECTORS = """us as (select vec_id as id, embedding::double[] as vec from embeddings where vec_id % 2 = 0),
vs as (select vec_id as id, embedding::double[] as vec from embeddings where vec_id % 2 = 1)"""
_TOP = """top as (select * from (select us.id as u, vs.id as i, list_dot_product(us.vec, vs.vec) as s,
  (row_number() over (partition by us.id order by round(list_dot_product(us.vec, vs.vec), 6) desc, vs.id))::int as rk from us, vs) where rk <= {n})"""
_SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"

_UNCONSUMED = (
    "good as (select pb.* from pb left join r e on e.u = pb.u and e.i = pb.neg where pb.neg <> pb.i and (attempt > 10 or e.i is null))",
    "f as (select row, u, i, neg, min(attempt * 10 + k) as place from good group by 1, 2, 3, 4)", "k as (select *, (row_number() over (partition by row order by place))::int as k from f)")
_STRANGERS = (
    *_UNKNOWN, _vocab("tr"), "pop as (select i, (row_number() over (order by n desc, item))::int as rk from (select item, count(distinct usr) as n from tr group by item) join iv using (item))",
    "st as (select c_custkey from customer where c_custkey not in (select usr from tr))")
_SCORED = (
    _VECTORS, _TOP.format(n=40), "sc as (select u, i, round(s, 6) as score, rk from top)", "had as (select u, i from sc where rk <= 5 or (rk <= 8 and u % 4 = 0))",
    "gone as (select * from had where u in (select u from had group by u having count(*) + 10 <= 17))", "left_ as (select u, i, score from sc where not exists (select 1 from gone g where g.u = sc.u and g.i = sc.i))")
_BRAND = ("half as (select * from feat where item % 5 <> 0)", _index("p_brand", "half"), "fi as (select i, coalesce(b.idx, 0) as p_brand from iv left join half using (item) left join ix_p_brand b on b.v = p_brand)")
_TRAIN = (
    *ALL, _ITEMS, *_BRAND, "cu as (select c_custkey as usr, c_mktsegment from customer)", _index("c_mktsegment", "cu"),
    "fu as (select u, coalesce(b.idx, 0) as c_mktsegment from uv left join cu using (usr) left join ix_c_mktsegment b on b.v = c_mktsegment)",
    _consumed(), "g as (select u, list(i order by ord) as l from c group by u)", "q as (select r.u, r.i, l, list_position(l, r.i) as place from r join g on g.u = r.u)",
    "sq as (select u::bigint * 4294967296 + i as row, array_to_string(list_slice(l, greatest(1, place - 3), place - 1) || list_transform(generate_series(1, 3 - len(list_slice(l, greatest(1, place - 3), place - 1))), lambda x: 0), ',') as seq from q)")

ORACLE: dict[str, str] = {
    "interactions_encode": _with(PURCHASES, ENC) + 'select usr as "user", item, u, i, label from enc',
    "vocab_users": _with(PURCHASES, _vocab()) + 'select usr as "user", u from uv',
    "vocab_items": _with(PURCHASES, _vocab()) + "select item, i from iv",
    "vocab_extend": _with(
        PURCHASES, f"a as (select distinct item from p where ts < '{CUT}')", f"b as (select distinct item from p where ts >= '{CUT}' and item not in (select item from a))",
    ) + "select item, (row_number() over (order by item))::int as i from a union all select item, (row_number() over (order by item) + (select count(*) from a))::int from b",
    "consumed_consecutive": _with(CLICKS, ENC, _consumed()) + f"select u, {_list()} from c group by u",
    "consumed_global": _with(CLICKS, ENC, "c as (select u, i, min(ord) as ord from enc group by u, i)") + f"select u, {_list()} from c group by u",
    "consumed_by_item": _with(CLICKS, ENC, _consumed(key="i", value="u")) + f"select i, {_list('u', name='users')} from c group by i",
    "consumed_merge": _with(
        CLICKS, ENC, "e1 as (select * from enc where event_type = 'click')", "e2 as (select * from enc where event_type <> 'click')", _consumed("e1"), _consumed("e2", name="d"),
    ) + "select u, array_to_string(list(i order by part, ord), ',') as items from (select u, i, ord, 1 as part from c union all select u, i, ord, 2 from d) group by u",
    "popular_items": _with(PURCHASES) + "select item, n_users, (row_number() over (order by n_users desc, item))::int as rank from (select item, count(distinct usr) as n_users from p group by item) order by n_users desc, item limit 100",
    "density": _with(PURCHASES) + "select 100.0 * count(*) / (count(distinct usr) * count(distinct item)) as density from p",
    "positive_consumed": _with(CLICKS, ENC) + "select u, array_to_string(list(distinct i order by i), ',') as items from enc where event_type = 'purchase' group by u",
    "multi_labels": 'select user_id as "user", event_id, (event_type in (\'click\', \'purchase\', \'signup\'))::int::double as label from events',
    "seq_recent": _with(CLICKS, ENC, _consumed(), "t as (select u, i, ord, row_number() over (partition by u order by ord desc) as k from c)", "g as (select u, list(i order by ord) as l from t where k <= 10 group by u)")
    + "select u, array_to_string(l || list_transform(generate_series(1, 10 - len(l)), lambda x: 0), ',') as seq from g union all select 0, '0,0,0,0,0,0,0,0,0,0'",
    "seq_interacted": _with(CLICKS, ENC, _consumed(), "g as (select u, list(i order by ord) as l from c group by u)", "q as (select e.u, e.i, l, list_position(l, e.i) as place from (select distinct u, i from enc) e join g on g.u = e.u)", "s as (select u, i, list_slice(l, greatest(1, place - 10), place - 1) as s from q)")
    + "select u, i, array_to_string(s || list_transform(generate_series(1, 10 - len(s)), lambda x: 0), ',') as seq from s",
    "split_random": _with(
        PURCHASES, "key as (select *, l_orderkey || '-' || l_linenumber || '-' || item || '-' || l_suppkey || '-' || label as key from p)",
        f"k as (select *, row_number() over (order by {_uniform('42', chr(39) + '{' + chr(34) + 'ord' + chr(34) + ':' + chr(34) + chr(39) + ' || key || ' + chr(39) + chr(34) + '}' + chr(39))}, key) as k, count(*) over () as n from key)",
    ) + 'select (k > n - ceil(0.2 * n - 1e-9))::int as part, usr as "user", item, label from k',
    "split_ratio": _by_user(PURCHASES, _ratio_part([0.8]), True),
    "split_ratio_multi": _by_user(PURCHASES, _ratio_part([0.7, 0.7 + 0.2]), False),
    "split_num": _by_user(PURCHASES, _num_part(3), True),
    "split_ratio_chrono": _by_user(CLICKS, _ratio_part([0.7]), True),
    "split_num_chrono": _by_user(CLICKS, _num_part(4), True),
    "filter_unknown": _with(*_UNKNOWN) + 'select 0 as part, usr as "user", item, label from tr union all select 1, usr, item, label from te where usr in (select usr from tr) and item in (select item from tr)',
    "pad_unknown": _with(*_UNKNOWN) + 'select 0 as part, usr as "user", item, label from tr union all select 1, case when usr in (select usr from tr) then usr else -1 end, case when item in (select item from tr) then item else -2 end, label from te',
    "interactions_last": _with(*ALL) + "select u, i, r from r",
    "sum_squares": _with(*ALL, _stats("i", "u")) + "select x, ss from ss",
    "pair_stats": _with(*ALL, _stats("i", "u")) + "select x1, x2, dot, cnt from st",
    "itemcf_sims": _with(*ALL, _stats("i", "u"), _cos(min_common=2)) + "select x1, x2, round(sim, 9) as sim from cos",
    "usercf_sims": _with(*ALL, _stats("u", "i"), _cos()) + "select x1, x2, round(sim, 9) as sim from cos",
    "swing_sims": _with(*ALL, _swing()) + "select x1, x2, round(sim, 6) as sim from swing",
    "neighbors_topk": _with(*ALL, *_ITEM) + "select x, nb, round(sim, 9) as sim, rk::int as rk from near",
    "sim_density": _with(*ALL, _stats("i", "u")) + "select 2 * count(*) as n, 100.0 * 2 * count(*) / ((select max(i) + 1 from r) ** 2) as density from st",
    "itemcf_predict_ranking": _with(*_world(), *_ITEM, _predict("i", "ranking")) + "select * from pred",
    "itemcf_predict_rating": _with(*_world(), *_ITEM, _predict("i", "rating")) + "select * from pred",
    "usercf_predict": _with(*_world(), *_USER, _predict("u", "rating")) + "select * from pred",
    "swing_predict": _with(*_world(), *_SWING, _predict("i", "ranking")) + "select * from pred",
    "itemcf_recommend": _with(*_world(), *_ITEM, _recommend("i")) + _DECODED,
    "usercf_recommend": _with(*_world(), *_USER, _recommend("u")) + _DECODED,
    "swing_recommend": _with(*_world(), *_SWING, _recommend("i")) + _DECODED,
    "cold_start_popular": _with(*_STRANGERS) + 'select c_custkey as "user", i, rk from st, pop where rk <= 10',
    "cold_start_sample": _with(*_STRANGERS, "n as (select count(*) as n from pop where rk <= 100)", "k as (select unnest(generate_series(1, 10))::int as k)")
    + f"""select c_custkey as "user", i, k as rk from (select c_custkey, k, floor({_uniform('42', 'c_custkey', 'k')} * n)::int + 1 as rank from st, k, n) join pop on pop.rk = rank""",
    "cold_start_average": _with(
        _VECTORS, "e as (select unnest(vec) as x, generate_subscripts(vec, 1) as pos from us where id <> 0)", "m as (select list(x order by pos) as vec from (select pos, avg(x) as x from e group by pos))",
        "b as (select vs.id as i, (row_number() over (order by round(list_dot_product(m.vec, vs.vec), 6) desc, vs.id))::int as rk from m, vs)",
    ) + 'select c_custkey as "user", i, rk from customer, b where rk <= 10 and c_custkey not in (select id from us)',
    "rank_top_items": _with(*_SCORED) + "select u, i, score, (row_number() over (partition by u order by score desc, i))::int as rk from left_ qualify rk <= 10",
    "rank_random_items": _with(
        *_SCORED, "w as (select *, pow(exp(score - max(score) over (partition by u)), 0.75) as w from left_)",
        f"d as (select *, ln({_uniform('42', 'u', 'i')} + 1e-12) / (w / sum(w) over (partition by u) + 1e-8) as d from w)",
        "c as (select * from d qualify row_number() over (partition by u order by d desc, i) <= 10)",
    ) + "select u, i, score, (row_number() over (partition by u order by score desc, i))::int as rk from c",
    "normalize_scores": _with(*_SCORED, "z as (select case when u % 10 = 0 then 0 else u end as u, i, score from sc)") + "select u, i, round(case when u = 0 or i = 0 then 0 else 1 / (1 + exp(-score)) end, 6) as pred from z",
    "sample_users": _with(PURCHASES, ENC) + f"select u from (select distinct u from enc) order by {_uniform('42', 'u')}, u limit 50",
    "vocab_update": _with(*_UNKNOWN, "a as (select item, (row_number() over (order by item))::int as i from (select distinct item from tr))", "b as (select item, (row_number() over (order by item))::int as i from (select distinct item from te where label > 45))")
    + "select item, coalesce(b.i, a.i) as i from a full join b using (item)",
    "unknown_pairs": _with(*_UNKNOWN, _vocab("tr")) + 'select usr as "user", item, coalesce(u, 0) as u, coalesce(i, 0) as i, label from te left join uv using (usr) left join iv using (item) where u is null or i is null',
    "seq_build": _with(
        *_UNKNOWN, _vocab("tr"), "q as (select usr, item, row_number() over (partition by usr order by ord) as k from p)", "l as (select * from q where k <= 7)", "t as (select *, row_number() over (partition by usr order by k desc) as back from l)",
        "g as (select usr, list(coalesce(i, 0) order by k) as l from t left join iv using (item) where back <= 5 group by usr)",
    ) + "select usr as key, array_to_string(l || list_transform(generate_series(1, 5 - len(l)), lambda x: 0), ',') as seq from g",
    "feat_inputs": _with(PURCHASES, _vocab(), _ITEMS, *_BRAND) + "select l_orderkey, l_linenumber, l_partkey::int as i, coalesce(p_brand, 0) as p_brand from lineitem left join fi on fi.i = l_partkey",
    "feat_override": _with(PURCHASES, _vocab(), _ITEMS, *_BRAND) + "select i, coalesce((select idx from ix_p_brand where v = 'Brand#13'), p_brand) as known, p_brand as unknown from fi union all select 0, coalesce((select idx from ix_p_brand where v = 'Brand#13'), 0), 0",
    "multi_label_sampling": _with(
        CLICKS, ENC, "rw as (select event_id as row, u, i, event_type from enc)", "pb as (select *, 1 as k, " + _PROBE.replace("'k'", "1") + " as neg from rw, (select unnest(generate_series(1, 10))::int as attempt))",
        f"ng as ({_FIRST.format(bad='neg = i', src='pb')})",
    ) + "select row, 0 as k, u, i, (event_type = 'click')::int::double || ',' || (event_type = 'purchase')::int::double || ',' || (event_type = 'signup')::int::double as labels from rw union all select row, k, u, neg, '0.0,0.0,0.0' from ng",
    "train_rows_pointwise": _with(*_TRAIN, _probes(1, 10), f"ng as ({_FIRST.format(bad='neg = i', src='pb')})", "tr as (select row, 0 as k, u, i, 1.0::double as label from rw union all select row, k, u, neg, 0.0 from ng)")
    + "select tr.row, k, tr.u, tr.i, label, coalesce(c_mktsegment, 0) as c_mktsegment, coalesce(p_brand, 0) as p_brand, seq from tr left join fu on fu.u = tr.u left join fi on fi.i = tr.i join sq on sq.row = tr.row",
    "train_rows_pairwise": _with(
        *_TRAIN, _probes(2, 20), *_UNCONSUMED, "ng as (select * from k where k <= 2)",
    ) + "select ng.row, k, ng.u, ng.i as pos, ng.neg, coalesce(c_mktsegment, 0) as c_mktsegment, coalesce(a.p_brand, 0) as pos_p_brand, coalesce(b.p_brand, 0) as neg_p_brand, seq from ng left join fu on fu.u = ng.u left join fi a on a.i = ng.i left join fi b on b.i = ng.neg join sq on sq.row = ng.row",
    "embed_oov_predict": _with(
        _VECTORS, "e as (select unnest(vec) as x, generate_subscripts(vec, 1) as pos from us where id <> 0)", "m as (select list(x order by pos) as vec from (select pos, avg(x) as x from e group by pos))",
        "q as (select id as i, case when id % 3 = 0 then -1 else id - 1 end as u, vec from vs)",
    ) + "select q.u, q.i, round(list_dot_product(case when us.id is null or us.id = 0 then (select vec from m) else us.vec end, q.vec), 6) as score from q left join us on us.id = q.u",
    "pair_inputs": _with(_VECTORS, "q as (select id as u, vec, id + 1 as pos, unnest([id + 3, id + 5]) as neg from us)")
    + "select u, pos, neg, round(list_dot_product(q.vec, a.vec), 6) as pos_score, round(list_dot_product(q.vec, b.vec), 6) as neg_score from q join vs a on a.id = pos join vs b on b.id = neg",
    "list_inputs": _with(
        _VECTORS, "q as (select us.id as u, us.vec as a, vs.vec as b, us.id // 32 as batch, (vs.id % 7 + 1) / 1000 as share from us join vs on vs.id = us.id + 1)",
        "l as (select x.u, y.u as other, list_dot_product(x.a, y.b) / 0.5 - ln(y.share) as logit from q x join q y using (batch))",
    ) + "select u, count(*)::int as n, sum((other < u)::int)::int as target, round(sum(logit), 4) as total from l group by u",
    "list_inputs_masked": _with(
        _VECTORS, "q as (select us.id as u, us.vec as a, vs.id as i, vs.vec as b, us.id // 32 as batch, (vs.id % 7 + 1) / 1000 as share from us join vs on vs.id = us.id // 4 * 4 + 1)",
        "l as (select x.u, x.i = y.i and x.u <> y.u as gone, list_dot_product(x.a, y.b) / 0.5 - ln(y.share) as logit from q x join q y using (batch))",
    ) + "select u, count(*)::int as n, count(*) filter (where not gone)::int as open, round(sum(logit) filter (where not gone), 4) as total from l group by u",
    "feat_index_sizes": _with(_ITEMS, "v as (select 'p_brand' as col, p_brand as v from feat union select 'p_type', p_type from feat union select 'tag1', tag1 from feat union select 'tag1', tag2 from feat)")
    + "select col, count(*) + 1 as size from v where v is not null and not (col = 'tag1' and v = 'missing') group by col",
    "backfill": _with(
        *_world(), _swing(), _near("swing", 2), _recommend("i"), "pop as (select i, row_number() over (order by n desc, item) as rank from (select item, count(distinct usr) as n from train group by item) join iv using (item))",
        "short as (select uv.u, 10 - count(rec.i) as missing from uv left join rec on rec.u = uv.u group by uv.u having count(rec.i) < 10)",
        "cand as (select s.u, s.missing, pop.i, row_number() over (partition by s.u order by rank) as k from short s, pop where rank <= 20 and not exists (select 1 from rec where rec.u = s.u and rec.i = pop.i))",
    ) + "select u, i, rk from rec union all select u, i, (10 - missing + k)::int from cand where k <= missing",
    "metric_rating": _with(*_TEST, _predict("i", "rating", 9), _RATED)
    + "select round(sqrt(avg((label - pred) ** 2)), 6) as rmse, round(avg(abs(label - pred)), 6) as mae, round(1 - sum((label - pred) ** 2) / (var_pop(label) * count(label)), 6) as r2 from pl",
    "metric_log_loss": _with(*_PREDS, "q as (select label, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, pred)) as p from pl)") + "select round(-avg(case when label = 1 then ln(p) else ln(1 - p) end), 6) as log_loss from q",
    "metric_balanced_accuracy": _with(*_PREDS) + "select round((avg(case when label = 1 then (pred >= 0.5)::int end) + avg(case when label = 0 then (pred < 0.5)::int end)) / 2, 6) as balanced_accuracy from pl",
    "metric_roc_auc": _with(*_PREDS, _AUC.format(keys="", part="")) + "select round(sum(p * (below + n / 2)) / sum(p) / sum(n), 6) as roc_auc from won",
    "metric_gauc": _with(*_PREDS, _AUC.format(keys="u,", part="partition by u"), "g as (select u, sum(p * (below + n / 2)) as w, sum(p) as p, sum(n) as n from won group by u)")
    + "select round(sum(case when p > 0 and n > 0 then w / p / n else 0 end * (p + n)) / sum(p + n), 6) as roc_gauc from g",
    "metric_pr_auc": _with(
        *_PREDS, "s as (select pred, sum((label = 1)::int) as p, count(*) as n from pl group by pred)",
        "c as (select pred, sum(p) over (order by pred desc) / sum(n) over (order by pred desc) as pr, sum(p) over (order by pred desc) / (select sum(p) from s) as re from s)",
        "d as (select (re - coalesce(lag(re) over (order by pred desc), 0)) * (pr + coalesce(lag(pr) over (order by pred desc), 1)) / 2 as a from c)",
    ) + "select round(sum(a), 6) as pr_auc from d",
    "metric_listwise": _with(
        *_TEST, _recommend("i"), "t as (select distinct u, i from tenc)", "nt as (select u, count(*) as n from t group by u)",
        "h as (select rec.u, rk, row_number() over (partition by rec.u order by rk) as j from rec join t using (u, i))",
        "m as (select u, count(*) as hits, avg(j / rk) as ap, sum(1 / log2(rk + 1)) / sum(1 / log2(j + 1)) as ndcg from h group by u)",
        "e as (select distinct rec.u, nt.n from rec join nt using (u))",
    ) + "select round(avg(coalesce(hits, 0) / 10), 6) as precision, round(avg(coalesce(hits, 0) / n), 6) as recall, round(avg(coalesce(ap, 0)), 6) as map, round(avg(coalesce(ndcg, 0)), 6) as ndcg from e left join m using (u)",
    "metric_coverage": _with(*_world(), *_ITEM, _recommend("i")) + "select round(100.0 * count(distinct i) / (select count(*) from iv), 6) as coverage from rec",
    "feat_sparse": _with(PURCHASES, _vocab(), _ITEMS, _index("p_brand"), _index("p_type"))
    + "select i, coalesce(b.idx, 0) as p_brand, coalesce(t.idx, 0) as p_type from iv left join feat using (item) left join ix_p_brand b on b.v = p_brand left join ix_p_type t on t.v = p_type union all select 0, 0, 0",
    "feat_value_index": _with(_ITEMS, _index("p_brand"), _index("p_type")) + "select 'p_brand' as col, v as value, idx from ix_p_brand union all select 'p_type', v, idx from ix_p_type",
    "feat_dense_median": _with(PURCHASES, _vocab(), _ITEMS, "m as (select i, p_size, p_retailprice from feat join iv using (item) where item % 5 <> 0)")
    + "select e.i, coalesce(m.p_size::double, (select median(p_size) from m)) as p_size, coalesce(m.p_retailprice, (select median(p_retailprice) from m)) as p_retailprice from (select i from iv union all select 0) e left join m on m.i = e.i",
    "feat_multi_sparse": _with(PURCHASES, _vocab(), _ITEMS, "ix as (select v, (row_number() over (order by v))::int as idx from (select tag1 as v from feat union select tag2 from feat) where v <> 'missing')")
    + "select i, coalesce(a.idx, 0) || ',' || coalesce(b.idx, 0) as tag1 from iv left join feat using (item) left join ix a on a.v = tag1 left join ix b on b.v = tag2 union all select 0, '0,0'",
    "feat_oov_rows": _with(PURCHASES, _vocab(), _ITEMS, "half as (select * from feat where item % 5 <> 0)", _index("p_brand", "half"))
    + "select i, coalesce(b.idx, 0) as p_brand from iv left join half using (item) left join ix_p_brand b on b.v = p_brand union all select 0, 0",
    "seq_item_features": _with(
        CLICKS, ENC, _ITEMS, _index("p_brand"), _consumed(), "t as (select u, i, item, ord, row_number() over (partition by u order by ord desc) as k from c)",
        "g as (select u, list(coalesce(idx, 0) order by ord) as l from t left join feat using (item) left join ix_p_brand on v = p_brand where k <= 10 group by u)",
    ) + "select u, array_to_string(l || list_transform(generate_series(1, 10 - len(l)), lambda x: 0), ',') as seq_p_brand from g union all select 0, '0,0,0,0,0,0,0,0,0,0'",
    "matrix_merge": _with(*_BATCH) + "select u, i, coalesce(b.r, o.r) as r from o full join b using (u, i)",
    "itemcf_incremental": _incremental("i", "u"),
    "usercf_incremental": _incremental("u", "i"),
    "swing_incremental": _with(*_BATCH, _swing("o", "o"), _swing("b", "b")) + "select x1, x2, round(sum(sim), 6) as sim from (select * from oswing union all select * from bswing) group by 1, 2 having abs(sum(sim)) > 1e-8",
    "neg_random": _with(*ALL, _probes(2, 10)) + _FIRST.format(bad="neg = i", src="pb"),
    "neg_distinct": _distinct(2, 64),
    "neg_popular": _with(
        *ALL, "pr as (select i, count(*)::double as w from r group by i)",
        "cdf as (select i as neg, (sum(w) over (order by i) - w) / (select sum(w) from pr) as lo, sum(w) over (order by i) / (select sum(w) from pr) as hi from pr)",
        f"d as (select u::bigint * 4294967296 + i as row, u, i, 1 as k, a::int as attempt from r, (select unnest([1, 2]) as a))",
        f"x as (select *, {_uniform('42', 'row', 'k', 'attempt')} as x from d)", "m as (select x.*, cdf.neg from x asof join cdf on x.x >= cdf.lo)",
    ) + _FIRST.format(bad="neg = i", src="m"),
    "neg_unconsumed": _with(*ALL, _probes(2, 20), *_UNCONSUMED) + "select row, u, i, k, neg from k where k <= 2",
    "pop_probs": _with(*ALL, "pr as (select i, count(*) ** 0.75 as w from r group by i)")
    + "select i, round(w / (select sum(w) from pr), 9) as p, round(sum(w) over (order by i) / (select sum(w) from pr), 9) as hi from pr",
    "keep_probs": _with(*ALL, "f as (select i, count(*) / (select count(distinct u) from r) as f from r group by i)") + "select i, round((sqrt(f / 0.001) + 1) * 0.001 / f, 6) as keep from f",
    "item_corrections": _with(PURCHASES, ENC) + "select i, round(count(*) / (select count(*) from enc), 9) as share from enc group by i",
    "label_sampling": _with(*ALL, _probes(1, 10), f"ng as ({_FIRST.format(bad='neg = i', src='pb')})") + "select row, 0 as k, u, i, 1.0::double as label from rw union all select row, k, u, neg, 0.0 from ng",
    "embed_dot_predict": _with(_VECTORS) + "select us.id as u, vs.id as i, round(list_dot_product(us.vec, vs.vec), 6) as score from us join vs on vs.id = us.id + 1",
    "embed_topn": _with(_VECTORS, _TOP.format(n=10)) + "select u, i, round(s, 6) as score, rk from top",
    "dense_topn": _with(
        _VECTORS, "us2 as (select id, vec, list_sum(vec) as s from us)", "vs2 as (select id, vec, list_dot_product(vec[1:8], vec[1:8]) as s from vs)",
        "sc as (select us2.id as u, vs2.id as i, list_dot_product(us2.vec, vs2.vec) + 0.1::double * us2.s - 0.2::double * vs2.s as s from us2, vs2)",
    ) + "select u, i, round(s, 6) as score, (row_number() over (partition by u order by round(s, 6) desc, i))::int as rk from sc qualify rk <= 10",
    "embed_oov_mean": _with(_VECTORS, "e as (select unnest(vec) as x, generate_subscripts(vec, 1) - 1 as pos from us where id <> 0)") + "select pos::int as pos, round(avg(x), 6) as x from e group by pos",
    "embed_normalize": _with(_VECTORS, "e as (select id, unnest(vec) / sqrt(list_dot_product(vec, vec)) as x, generate_subscripts(vec, 1) - 1 as pos from vs)") + "select id, pos::int as pos, round(x, 6) as x from e",
    "dpp_kernel": _with(
        _VECTORS, "sc as (select us.id as u, vs.id as i, list_dot_product(us.vec, vs.vec) as s from us, vs)",
        "c as (select u, i, s from (select *, row_number() over (partition by u order by round(s, 6) desc, i) as rk from sc) where rk <= 20)",
        "nv as (select id, vec, sqrt(list_dot_product(vec, vec)) as n from vs)",
        "co as (select a.id as a, b.id as b, list_dot_product(a.vec, b.vec) / a.n / b.n as cosine from nv a join nv b on a.id <= b.id)",
    ) + """select a.u, a.i as a, b.i as b, round(a.s * b.s * (co.cosine + 1) / 2, 6) as value from c a join c b on a.u = b.u
join co on co.a = least(a.i, b.i) and co.b = greatest(a.i, b.i)""",
    "fm_pairwise": _with(_VECTORS, "e as (select us.id, unnest(us.vec) as a, unnest(vs.vec) as b, generate_subscripts(us.vec, 1) - 1 as pos from us join vs on vs.id = us.id + 1)")
    + "select id, pos::int as pos, round(((2 * a + b) ** 2 - (2 * a * a + b * b)) / 2, 6) + 0.0 as x from e",
    "losses": _with("q as (select l_quantity / 10 - 2 as x, (l_returnflag = 'R')::int::double as y, l_tax * 10 as o from lineitem)", "s as (select *, 1 / (1 + exp(-x)) as p from q)")
    + f"""select round(avg((x - y) ** 2), 6) as mse, round(avg({_SOFTPLUS.format(x='x')} - x * y), 6) as bce,
  round(avg((0.25 * y + 0.75 * (1 - y)) * (1 - (p * y + (1 - p) * (1 - y))) ** 2 * ({_SOFTPLUS.format(x='x')} - x * y)), 6) as focal,
  round(avg({_SOFTPLUS.format(x='(o - x)')}), 6) as bpr, round(avg(greatest(0, 1 - (x - o))), 6) as max_margin,
  round(avg(ln(exp(x) + exp(o) + exp(0.5)) - case when y = 1 then o else x end), 6) as softmax from s""",
}
ORACLE["metric_accumulated"] = " union all ".join(
    f"select '{m}' as metric, {m} as value from ({ORACLE[q]}) t"
    for m, q in (("balanced_accuracy", "metric_balanced_accuracy"), ("log_loss", "metric_log_loss"), ("pr_auc", "metric_pr_auc"), ("roc_auc", "metric_roc_auc"), ("roc_gauc", "metric_gauc")))
