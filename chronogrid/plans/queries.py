"""The registered queries of the panel operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fourier, knn, mice, missing, network, pointwise, runs, spatial, temporal, temporal_tree
from ..panel import Panel
from ..sources import derived
from .registry import apply_transforms

Query = Callable[[SparkSession, str], DataFrame]

EVENT, HIGH, LARGE = 60.0, 120.0, 250.0

_D0 = """d0 as (select datediff('day', date '2024-01-01', ts::date)::int as time, user_id as unit, sum(round(value * 100)::bigint)::double / 100 as v, count(*)::double as n from events group by 1, 2)"""
_P = _D0 + """, p as (select t.time, u.unit, d0.v, d0.n from (select distinct time from d0) t cross join (select distinct unit from d0) u left join d0 on d0.time = t.time and d0.unit = u.unit)"""
_E = _P + f", e as (select time, unit, case when v > {EVENT} then 1.0::double when v is not null then 0.0::double end as e from p)"
_G = _P + ", gp as (select time, unit, case when unit % 50 <> 7 then v end as v, case when unit % 50 <> 7 then n end as n from p)"
_C = _P + f", c as (select time, ((unit // {derived.GRID_WIDTH}) * 720 + unit % {derived.GRID_WIDTH})::bigint as unit, unit % {derived.GRID_WIDTH} as x, unit // {derived.GRID_WIDTH} as y, coalesce(v, 0.0)::double as v from p)"
_K = """k0 as (select ((year(o_orderdate::date) - 1992) * 12 + month(o_orderdate::date) - 1)::int as time, c_nationkey::bigint as unit, sum(round(o_totalprice * 100)::bigint)::double / 100 as v from orders join customer on o_custkey = c_custkey group by 1, 2),
k as (select t.time, u.unit, coalesce(k0.v, 0.0)::double as v from (select distinct time from k0) t cross join (select distinct unit from k0) u left join k0 on k0.time = t.time and k0.unit = u.unit)"""
_UNIT = "over (partition by unit order by time)"


#: Sums of doubles differ in their last bits by order.  Added before rounding to 4 digits, this moves the
#: rounding's boundaries off the values that short decimals and whole distances give exactly.
_OFF_TIES = 0.0000283


def _rounded(p: Panel, digits: int = 6, plus: float = 0.0) -> DataFrame:
    """Keys and features, doubles rounded and without a negative zero."""
    kinds = dict(p.df.dtypes)
    return p.df.select("time", "unit", *((F.round(F.col(f) + plus, digits) + 0.0).alias(f) if kinds[f] == "double" else F.col(f) for f in p.features))


def _sql(ctes: str, table: str, *columns: str, digits: int = 6, where: str = "") -> str:
    """SQL that selects `expression as name` columns, doubles (all but those marked #) rounded."""
    out = []
    for c in columns:
        whole, (value, name) = c.startswith("#"), c.lstrip("#").rsplit(" as ", 1)
        out.append(f"({value})::bigint as {name}" if whole else f"round(({value})::double, {digits}) + 0.0 as {name}")
    return f"with {ctes} select time, unit, {', '.join(out)} from {table} {where}"


def _frame(n: int) -> str:
    return f"over (partition by unit order by time rows between {n - 1} preceding and current row)"


_BACK = "over (partition by unit order by time rows between unbounded preceding and current row)"
_AHEAD = "over (partition by unit order by time rows between current row and unbounded following)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's average of yesterday's values, a chain in one shuffle."""
    return _rounded(apply_transforms(derived.daily(spark, sf_dir), [{"type": "tlag", "args": [1]}, {"type": "moving_average", "args": [7]}]))


def _daily(fn: Callable[[Panel], Panel], *features: str) -> Query:
    return lambda spark, d: _rounded(fn(derived.daily(spark, d, *features)))


def _tick(spark: SparkSession, d: str) -> DataFrame:
    """The step to the table's last time."""
    p = derived.daily(spark, d, "v", "n").filled()
    p = p.with_df(p.df.where(F.col("time").isin(p.times()[-2:])).select("time", "unit", F.when(F.col("v") > EVENT, 1.0).otherwise(0.0).alias("e"), F.col("n").alias("s")), ["e", "s"])
    out = runs.tick_time_since(p, "e", "s")
    return out.df.select("time", "unit", "s")


def _country(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(network.country_lag(derived.countries(spark, d), derived.neighbours(spark, d), derived.centroids(spark, d), 1, 1, 1.0, True), 4)


def _country_two(spark: SparkSession, d: str) -> DataFrame:
    """Nations two and three steps away along a chain of their numbers."""
    return _rounded(network.country_lag(derived.countries(spark, d), derived.chained(spark, d), derived.centroids(spark, d), 2, 2, 1.0, True), 4, _OFF_TIES)


def _grid_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The adaptive grids themselves."""
    _, nodes = spatial.adaptive_grid_lag(derived.cells(spark, d), 2000.0, keep_grids=True)
    return nodes.select("time", "feature", F.col("level").cast("int").alias("level"), "nx", "ny", F.round("value", 2).alias("value"))


def _mice_draws(spark: SparkSession, d: str) -> DataFrame:
    """Two imputations drawn from the posterior, numbered by imp."""
    p = derived.gappy(spark, d)
    p = p.with_df(p.df.withColumn("t", F.col("time").cast("double")), ["v", "n", "t"])
    stacked = mice.impute_stacked(p, 2, sample_posterior=True)
    return stacked.select("time", "unit", "imp", *(F.round(f, 3).alias(f) for f in ("v", "n", "t")))


def _mice(spark: SparkSession, d: str) -> DataFrame:
    p = derived.gappy(spark, d)
    p = p.with_df(p.df.withColumn("t", F.col("time").cast("double")), ["v", "n", "t"])
    p = p.map(lambda c: c).with_df(p.df.withColumn("v", F.when(F.col("time") % 3 != 0, F.col("v"))), ["v", "n", "t"])
    return _rounded(mice.impute(p), 3)


def _missing_names(spark: SparkSession, d: str) -> DataFrame:
    p = derived.daily(spark, d, "v", "n")
    return missing.list_totally_missing(p.with_df(p.df.withColumns({"n": F.when(F.col("n") < 0, F.col("n")), "w": F.lit(None).cast("double")}), ["v", "n", "w"]))


def _chain(spark: SparkSession, d: str) -> DataFrame:
    steps = [{"type": "fill", "kwargs": {"limit_direction": "forward"}}, {"type": "replace_na"}, {"type": "delta", "args": [1]}, {"type": "rollmax", "args": [3]}]
    return _rounded(apply_transforms(derived.daily(spark, d), steps))


def queries() -> dict[str, Query]:
    cells = lambda fn, above=None, digits=6, plus=0.0: lambda s, d: _rounded(fn(derived.cells(s, d, above)), digits, plus)
    events = lambda fn: lambda s, d: _rounded(fn(derived.flagged(s, d, EVENT)))
    gappy = lambda fn: lambda s, d: _rounded(fn(derived.gappy(s, d)))
    return {
        "flagship": flagship,
        "identity": _daily(pointwise.identity),
        "greater_or_equal": _daily(lambda p: pointwise.greater_or_equal(p, HIGH)),
        "smaller_or_equal": _daily(lambda p: pointwise.smaller_or_equal(p, HIGH)),
        "in_range": _daily(lambda p: pointwise.in_range(p, EVENT, HIGH)),
        "ln": _daily(pointwise.ln),
        "decay": _daily(lambda p: pointwise.decay(p, 50.0)),
        "add_column": _daily(pointwise.add_column, "v", "n"),
        "subtract_column": _daily(pointwise.subtract_column, "v", "n"),
        "multiply_column": _daily(pointwise.multiply_column, "v", "n"),
        "divide_column": _daily(pointwise.divide_column, "v", "n"),
        "tlag": _daily(lambda p: temporal.tlag(p, 2)),
        "tlead": _daily(lambda p: temporal.tlead(p, 2)),
        "delta": _daily(lambda p: temporal.delta(p, 1)),
        "moving_average": _daily(lambda p: temporal.moving_average(p, 5)),
        "moving_sum": _daily(lambda p: temporal.moving_sum(p, 5)),
        "rollmax": _daily(lambda p: temporal.rollmax(p, 5)),
        "mean": _daily(temporal.mean),
        "demean": _daily(temporal.demean),
        "tlags": _daily(lambda p: temporal.tlags(p, [1, 2, 7]), "v", "n"),
        "temporal_entropy": _daily(lambda p: temporal.temporal_entropy(p, 5, 1.0)),
        "cweq": events(lambda p: runs.cweq(p, 0)),
        "cweq_seeded": events(lambda p: runs.cweq(p, 0, 3)),
        "time_since": events(lambda p: runs.time_since(p, 0)),
        "tick_time_since": _tick,
        "onset_possible": events(lambda p: temporal.onset_possible(p, 3)),
        "onset": events(lambda p: temporal.onset(p, 3)),
        "replace_na": _daily(lambda p: missing.replace_na(p, -1)),
        "list_totally_missing": _missing_names,
        "fill_groups_with_time_means": gappy(missing.fill_groups_with_time_means),
        "fill_with_group_and_global_means": gappy(missing.fill_with_group_and_global_means),
        "extrapolate": gappy(missing.extrapolate),
        "extrapolate_forward_inside": gappy(lambda p: missing.extrapolate(p, "forward", "inside")),
        "extrapolate_backward_outside": gappy(lambda p: missing.extrapolate(p, "backward", "outside")),
        "fill": gappy(missing.fill),
        "fill_forward": gappy(lambda p: missing.fill(p, "forward")),
        "fill_inside": gappy(lambda p: missing.fill(p, "backward", "inside")),
        "fill_outside": gappy(lambda p: missing.fill(p, "both", "outside")),
        "impute_mice": _mice,
        "impute_posterior": _mice_draws,
        "grid_convolution": cells(lambda p: spatial.grid_convolution(p, 1, 1, 1.0)),
        "grid_convolution_wide": cells(lambda p: spatial.grid_convolution(p, 0, 3, 0, True)),
        "country_lag": _country,
        "country_lag_two_hops": _country_two,
        "quadtree_lag": cells(lambda p: spatial.quadtree_lag(p, 0.7, 1), digits=4, plus=_OFF_TIES),
        "quadtree_direct": cells(lambda p: spatial.quadtree_lag(p, 0.001, 1), digits=4),
        "adaptive_grid_lag": cells(lambda p: spatial.adaptive_grid_lag(p, 2000.0), digits=4, plus=_OFF_TIES),
        "adaptive_grid_nodes": _grid_nodes,
        "adaptive_grid_direct": cells(lambda p: spatial.adaptive_grid_lag(p, 0.0), digits=4, plus=_OFF_TIES),
        "temporal_tree_lag": cells(lambda p: temporal_tree.temporal_tree_lag(p, 0.5, "expon", 5.0), digits=4, plus=_OFF_TIES),
        "temporal_tree_uniform": cells(lambda p: temporal_tree.temporal_tree_lag(p, 0.5, "uniform")),
        "spacetime_distances": cells(lambda p: knn.spacetime_distances(p, "distances", 1, 0.5), LARGE),
        "spacetime_distances_k3": cells(lambda p: knn.spacetime_distances(p, "distances", 3, 1.0), LARGE),
        "spacetime_weights": cells(lambda p: knn.spacetime_distances(p, "weights", 1, 0.37, 2.0), LARGE),
        "fourier_lag_2d": cells(lambda p: fourier.fourier_lag(p, 2), digits=4, plus=_OFF_TIES),
        "fourier_lag_3d": cells(lambda p: fourier.fourier_lag(p, 3), digits=3),
        "transform_chain": _chain,
    }


def _interpolated(name: str, inner: bool, head: bool, tail: bool) -> str:
    before, after, p0, p1 = (f"{name}_{x}" for x in ("b", "a", "p0", "p1"))
    whens = f"when {name} is not null then {name}"
    if inner:
        whens += f" when {before} is not null and {after} is not null then {before} + ({after} - {before}) * (pos - {p0}) / ({p1} - {p0})"
    if tail:
        whens += f" when {after} is null then {before}"
    if head:
        whens += f" when {before} is null then {after}"
    return f"case {whens} end as {name}"


def _nearest_sql(k: int, nu: float, weights: bool = False) -> str:
    order = "d, et desc, eu"
    value = "case when d = 0 then v else v / (d * d) end" if weights else "d"
    missing_value = "0.0" if weights else "'inf'::double"
    return f"""with {_C}, s as (select time, unit, x, y, case when v > {LARGE} then v else 0.0 end as v, dense_rank() over (order by time) as ti from c),
    j as (select a.time, a.unit, b.v, b.ti as et, b.unit as eu, sqrt(pow((a.x - b.x) / 2.0, 2) + pow((a.y - b.y) / 2.0, 2) + pow({nu} * (a.ti - b.ti), 2)) as d from s a join s b on b.v > 0 and b.ti <= a.ti),
    r as (select *, row_number() over (partition by time, unit order by {order}) as rn from j),
    n as (select time, unit, case when count(*) < {k} then {missing_value} else avg({value}) end as v from r where rn <= {k} group by 1, 2)
    select s.time, s.unit, round(coalesce(n.v, 999.0), 6) + 0.0 as v from s left join n on n.time = s.time and n.unit = s.unit"""


#: The grid's square: origin, power of two and number of cells; each cell's place and each time's node sums.
_TREE = _C + """, g0 as (select min(x) as xl, min(y) as yl, max(x) - min(x) as wide, max(y) - min(y) as high from c),
g1 as (select *, (1 + floor(log2(greatest(wide, high))))::int as power from g0),
g as (select power, xl - ((1 << power) - wide) // 2 as x0, yl - ((1 << power) - high) // 2 as y0 from g1),
cell as (select distinct unit, (x - x0)::int as x, (y - y0)::int as y from c, g),
s as (select time, level, cell.x >> (power - level) as nx, cell.y >> (power - level) as ny, sum(c.v) as v from c join cell using (unit), g, unnest(range(0, power + 1)) l(level) group by 1, 2, 3, 4)"""


def _far_sql(cell: str, node: str, off: str = "") -> str:
    """The distance of a cell from a node's centre."""
    h = f"pow(2.0, power - {node}.level)"
    return "sqrt(" + " + ".join(f"pow({cell}.{c} + 0.5 - ({node}.n{c} + 0.5) * {h}{off}, 2)" for c in ("x", "y")) + ")"


def _quadtree_sql(theta: float) -> str:
    split = f"pow(2.0, power - o.level) / o.d > {theta}"
    return f"""with recursive {_TREE}, node as (select distinct level, nx, ny from s),
    o as (select cell.unit, cell.x, cell.y, node.level, node.nx, node.ny, {_far_sql("cell", "node", " + 0.01")} as d from cell, node, g where node.level = 0
      union all select o.unit, o.x, o.y, node.level, node.nx, node.ny, {_far_sql("o", "node", " + 0.01")} from o join node on node.level = o.level + 1 and node.nx >> 1 = o.nx and node.ny >> 1 = o.ny, g where {split}),
    taken as (select o.* from o, g where not ({split}) or (o.level = power and (o.x <> o.nx or o.y <> o.ny))),
    r as (select s.time, taken.unit, sum(s.v / taken.d) as v from taken join s using (level, nx, ny) group by 1, 2)
    select c.time, c.unit, round(coalesce(r.v, 0.0) + {_OFF_TIES}, 4) + 0.0 as v from c left join r using (time, unit)"""


def _adaptive_ctes(threshold: float) -> str:
    return f"""{_TREE}, a as (select * from s where level = 0 union all select s.* from a join s on s.time = a.time and s.level = a.level + 1 and s.nx >> 1 = a.nx and s.ny >> 1 = a.ny where a.v > {threshold}),
    leaf as (select a.* from a, g where a.v <= {threshold} or a.level = power)"""


def _adaptive_sql(threshold: float) -> str:
    return f"""with recursive {_adaptive_ctes(threshold)},
    r as (select leaf.time, cell.unit, sum(leaf.v / {_far_sql("cell", "leaf")}) as v from cell, leaf, g where leaf.v <> 0 and not (leaf.level = power and leaf.nx = cell.x and leaf.ny = cell.y) group by 1, 2)
    select c.time, c.unit, round(coalesce(r.v, 0.0) + {_OFF_TIES}, 4) + 0.0 as v from c left join r using (time, unit)"""


def _temporal_tree_sql(theta: float, sigma: float) -> str:
    """Of the dyadic blocks that end by now, the widest acceptable one around each past time."""
    fine = f"(w = 1 or w / (now - s - w / 2.0) < {theta})"
    age = lambda at: f"exp(-(now - ({at})) / {sigma}::double)"
    return f"""with {_C}, t as (select min(time) as f, max(time) as l, max(time) - (2 ** (1 + floor(log2(max(time) - min(time))))::int)::int as base from c),
    b as (select now, (1 << k) as w, base + (1 << k) * i as s from t, unnest(range(f, l)) n(now), unnest(range(0, 12)) u(k), unnest(range(0, 4096)) v(i) where base + (1 << k) * (i + 1) <= now),
    ok as (select * from b where {fine}),
    top as (select * from ok a where not exists (select 1 from ok p where p.now = a.now and p.w > a.w and p.s <= a.s and p.s + p.w >= a.s + a.w) union all select now, 1, now from t, unnest(range(f, l)) n(now)),
    weighed as (select *, (8 * {age("s")} + 6 * {age("s + w / 2.0")} - {age("s + w")}) / 13 as weight from top),
    r as (select weighed.now as time, c.unit, sum(weighed.weight * c.v) as v from weighed join c on c.time >= weighed.s and c.time < weighed.s + weighed.w group by 1, 2)
    select c.time, c.unit, round(coalesce(r.v, 0.0) + {_OFF_TIES}, 4) + 0.0 as v from c left join r using (time, unit)"""


def _fourier_sql() -> str:
    """The discrete transform along x, along y, the Green function, and back, as sums over a table of angles."""
    turn = lambda sign, t: f"sum(re * {t}.c - ({sign}) * im * {t}.s) as re, sum(im * {t}.c + ({sign}) * re * {t}.s) as im"
    step = lambda name, source, sign, keep, old, new: f"{name} as (select {keep}, k.k as {new}, {turn(sign, 'w')} from {source} q, k, w, g where w.m = (q.{old} * k.k) % n group by all)"
    low = "case when abs(f) < 0.001 then 0.001 else f end"
    return f"""with {_TREE}, gn as (select (1 << power) as n from g), k as (select unnest(range(0, n)) as k from gn),
    w as (select k as m, cos(2 * pi() * k / n) as c, sin(2 * pi() * k / n) as s from k, gn),
    f0 as (select k, 2 * pi() * (case when k < n / 2 then k else k - n end)::double / n as f from k, gn), f as (select k, {low} as f from f0),
    q0 as (select c.time, cell.x, cell.y, c.v::double as re, 0.0::double as im from c join cell using (unit) where c.v <> 0),
    {step("q1", "q0", -1, "q.time, q.y", "x", "kx").replace(", g where", ", gn where")},
    {step("q2", "q1", -1, "q.time, q.kx", "y", "ky").replace(", g where", ", gn where")},
    q3 as (select time, kx, ky, re / (fx.f * fx.f + fy.f * fy.f) / n / n as re, im / (fx.f * fx.f + fy.f * fy.f) / n / n as im from q2 join f fx on fx.k = kx join f fy on fy.k = ky, gn),
    {step("q4", "q3", 1, "q.time, q.ky", "kx", "x").replace(", g where", ", gn where")},
    {step("q5", "q4", 1, "q.time, q.x", "ky", "y").replace(", g where", ", gn where")},
    ph as (select *, re - min(re) over (partition by time) as phi from q5),
    z as (select time, greatest(max(phi), 1.0) as top from ph group by 1), m as (select time, max(v) as peak from c group by 1)
    select c.time, c.unit, round(coalesce(ph.phi * m.peak / z.top, 0.0) + {_OFF_TIES}, 4) + 0.0 as flag_v
    from c join cell using (unit) join m using (time) left join ph on ph.time = c.time and ph.x = cell.x and ph.y = cell.y left join z on z.time = c.time"""


def oracle_sql() -> dict[str, str]:
    prev = f"coalesce(lag(e) {_UNIT}, 0.0)"
    cweq = lambda e, first: f"""with {_E}, {e}, s as (select *, sum(1 - m) {_BACK} as b from w), r as (select time, unit, trunc(sum({first}) over (partition by unit, b order by time rows between unbounded preceding and current row))::bigint as e from s) select time, unit, e from r"""
    plain = "w as (select time, unit, (e = 0)::bigint as m from e where e is not null)"
    lagged = f"l as (select time, unit, lag(e) {_UNIT} as e from e), w as (select time, unit, (e = 0)::bigint as m from l where e is not null)"
    around = _G + ", q as (select *, row_number() over (partition by unit order by time)::double as pos from gp), i as (select *, " + ", ".join(
        f"last_value({f} ignore nulls) {_BACK} as {f}_b, first_value({f} ignore nulls) {_AHEAD} as {f}_a, last_value(case when {f} is not null then pos end ignore nulls) {_BACK} as {f}_p0, first_value(case when {f} is not null then pos end ignore nulls) {_AHEAD} as {f}_p1" for f in ("v", "n")
    ) + " from q)"
    both = lambda *a: [_interpolated(f, *a) for f in ("v", "n")]
    fills = lambda text: [text.replace("$", f) + f" as {f}" for f in ("v", "n")]
    group = _G + ", g1 as (select time, unit, coalesce(v, avg(v) over (partition by unit)) as v, coalesce(n, avg(n) over (partition by unit)) as n from gp)"
    direct = lambda off, plus: f"""with {_C} select a.time, a.unit, round(coalesce(sum(case when a.unit <> b.unit then b.v / sqrt(pow(a.x - b.x + {off}, 2) + pow(a.y - b.y + {off}, 2)) end), 0.0) + {plus}, 4) + 0.0 as v from c a join c b on a.time = b.time group by 1, 2"""
    near = lambda reach, weight: f"""with {_C} select a.time, a.unit, round(coalesce(sum(b.v * ({weight})), 0.0), 6) + 0.0 as v from c a left join c b on a.time = b.time and abs(a.x - b.x) <= {reach} and abs(a.y - b.y) <= {reach} group by 1, 2"""
    region = "(a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey)"
    far = "sqrt(pow(a.n_nationkey % 5 - b.n_nationkey % 5, 2) + pow(a.n_nationkey // 5 - b.n_nationkey // 5, 2))"
    return {
        "flagship": f"with {_P}, l as (select time, unit, lag(v) {_UNIT} as v from p) select time, unit, round(avg(v) {_frame(7)}, 6) + 0.0 as v from l",
        "identity": _sql(_P, "p", "v as v"),
        "greater_or_equal": _sql(_P, "p", f"#coalesce(v >= {HIGH}, false)::int as v"),
        "smaller_or_equal": _sql(_P, "p", f"#coalesce(v <= {HIGH}, false)::int as v"),
        "in_range": _sql(_P, "p", f"#coalesce(v >= {EVENT}, false)::int + coalesce(v <= {HIGH}, false)::int - 1 as v"),
        "ln": _sql(_P, "p", "case when v > -1 then ln(v + 1) when v = -1 then '-inf'::double end as v"),
        "decay": _sql(_P, "p", "pow(2.0, -v / 50.0) as v"),
        "add_column": _sql(_P, "p", "v + n as v"),
        "subtract_column": _sql(_P, "p", "v - n as v"),
        "multiply_column": _sql(_P, "p", "v * n as v"),
        "divide_column": _sql(_P, "p", "v / nullif(n, 0) as v"),
        "tlag": _sql(_P, "p", f"lag(v, 2) {_UNIT} as v"),
        "tlead": _sql(_P, "p", f"lead(v, 2) {_UNIT} as v"),
        "delta": _sql(_P, "p", f"v - lag(v) {_UNIT} as v"),
        "moving_average": _sql(_P, "p", f"avg(v) {_frame(5)} as v"),
        "moving_sum": _sql(_P, "p", f"coalesce(sum(v) {_frame(5)}, 0.0) as v"),
        "rollmax": _sql(_P, "p", f"max(v) {_frame(5)} as v"),
        "mean": _sql(_P, "p", "avg(v) over (partition by unit) as v"),
        "demean": _sql(_P, "p", "v - avg(v) over (partition by unit) as v"),
        "tlags": _sql(_P, "p", *(f"lag({f}, {k}) {_UNIT} as {f}_tlag_{k}" for f in ("v", "n") for k in (1, 2, 7))),
        "temporal_entropy": _sql(_P + ", h as (select time, unit, coalesce(v, 0.0) + 1.0 as x from p)", "h", f"case when min(x) {_frame(5)} > 0 then log2(sum(x) {_frame(5)}) - sum(x * log2(case when x > 0 then x else 1 end)) {_frame(5)} / sum(x) {_frame(5)} end as v"),
        "cweq": cweq(plain, "m"),
        "cweq_seeded": cweq(plain, "case when m = 1 and time = (select min(time) from w) then 3 else m end"),
        "time_since": cweq(lagged, "m"),
        "tick_time_since": f"with {_P}, w as (select time, unit, coalesce(v, 0.0) as v, coalesce(n, 0.0) as n from p) select b.time, b.unit, case when a.v > {EVENT} then 0.0::double else a.n + 1 end as s from w a join w b on a.unit = b.unit and b.time = (select max(time) from w) and a.time = (select max(time) from w where time < (select max(time) from w))",
        "onset_possible": f"with {_E}, l as (select time, unit, {prev} as x from e) select time, unit, (max(x) {_frame(3)} = 0)::int::bigint as e from l",
        "onset": f"with {_E}, l as (select time, unit, e, {prev} as x from e), m as (select *, max(x) {_frame(3)} as y from l) select time, unit, (y = 0 and (e is null or e <> 0))::int::bigint as e from m",
        "replace_na": _sql(_P, "p", "coalesce(v, -1.0) as v"),
        "list_totally_missing": f"with {_P}, o as (select v, case when n < 0 then n end as n, null::double as w from p) select name from (select 'v' as name, count(v) as k from o union all select 'n', count(n) from o union all select 'w', count(w) from o) where k = 0",
        "fill_groups_with_time_means": _sql(_G + ", g1 as (select *, count(v) over (partition by unit) + count(n) over (partition by unit) as seen, avg(v) over (partition by time) as mv, avg(n) over (partition by time) as mn from gp)", "g1", "case when seen = 0 then mv else v end as v", "case when seen = 0 then mn else n end as n"),
        "fill_with_group_and_global_means": _sql(group, "g1", "coalesce(v, (select avg(v) from g1)) as v", "coalesce(n, (select avg(n) from g1)) as n"),
        "extrapolate": _sql(around, "i", *both(True, True, True)),
        "extrapolate_forward_inside": _sql(around, "i", *both(True, False, False)),
        "extrapolate_backward_outside": _sql(around, "i", *both(False, True, False)),
        "fill": _sql(around, "i", *fills("coalesce($_b, $_a)")),
        "fill_forward": _sql(around, "i", *fills("$_b")),
        "fill_inside": _sql(around, "i", *fills("case when $_b is not null and $_a is not null then $_a else $ end")),
        "fill_outside": _sql(around, "i", *fills("case when $_b is null then $_a when $_a is null then $_b else $ end")),
        "grid_convolution": near(1, "case when a.unit <> b.unit then 1 / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) else 0 end"),
        "grid_convolution_wide": near(2, "1 / 25.0::double"),
        "country_lag": f"with {_K}, ring as (select a.n_nationkey::bigint as unit, b.n_nationkey::bigint as member, {far} as w from nation a join nation b on {region}) select k.time, k.unit, round(coalesce(sum(w * m.v) / sum(w), 0.0), 4) + 0.0 as v from k left join ring on ring.unit = k.unit left join k m on m.time = k.time and m.unit = ring.member group by 1, 2",
        "country_lag_two_hops": f"""with {_K}, e as (select a.n_nationkey::bigint as a, b.n_nationkey::bigint as b from nation a join nation b on abs(a.n_nationkey - b.n_nationkey) in (1, 7)),
            two as (select distinct e.a, f.b from e join e f on f.a = e.b), three as (select distinct two.a, e.b from two join e on e.a = two.b),
            ring as (select u.a as unit, u.b as member from (select * from two union select * from three) u where u.a <> u.b and not exists (select 1 from e where e.a = u.a and e.b = u.b)),
            far as (select unit, member, sqrt(pow(unit % 5 - member % 5, 2) + pow(unit // 5 - member // 5, 2)) as w from ring)
            select k.time, k.unit, round(coalesce(sum(w * m.v) / sum(w), 0.0) + {_OFF_TIES}, 4) + 0.0 as v from k left join far on far.unit = k.unit left join k m on m.time = k.time and m.unit = far.member group by 1, 2""",
        "quadtree_lag": _quadtree_sql(0.7),
        "quadtree_direct": direct("0.01", 0.0),
        "adaptive_grid_lag": _adaptive_sql(2000.0),
        "adaptive_grid_nodes": f"with recursive {_adaptive_ctes(2000.0)} select time, 'v' as feature, level::int as level, nx, ny, round(v, 2) as value from leaf",
        "adaptive_grid_direct": direct("0", _OFF_TIES),
        "fourier_lag_2d": _fourier_sql(),
        "temporal_tree_lag": _temporal_tree_sql(0.5, 5.0),
        "temporal_tree_uniform": _sql(_C, "c", f"case when time = (select max(time) from c) then 0.0 else sum(v) {_BACK} end as v"),
        "spacetime_distances": _nearest_sql(1, 0.5),
        "spacetime_distances_k3": _nearest_sql(3, 1.0),
        "spacetime_weights": _nearest_sql(1, 0.37, True),
        "transform_chain": f"with {_P}, f as (select time, unit, coalesce(last_value(v ignore nulls) {_BACK}, 0.0) as v from p), d as (select time, unit, v - lag(v) {_UNIT} as v from f) select time, unit, round(max(v) {_frame(3)}, 6) + 0.0 as v from d",
    }
