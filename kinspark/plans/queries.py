"""Registered queries of the core operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.functions.transforms import transform
from kinspark.operators import anchors, boost, embed, expression, graph, groups, integrate, knn, plotdata, sketch, stats
from kinspark.plans.inputs import CELLS_SQL, EXPR_SQL, cells, event_cells, expr, knn_sql, order_cells
from kinspark.sources.store import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- groups -------------------------------------------------------------------------------------------------


@query("select cast(o_custkey as varchar) as clone, count(*) as n_cells from orders group by 1")
def clone_sizes(spark, sf):
    return groups.group_sizes(order_cells(spark, sf), min_size=1)


@query("""
with k as (select cast(user_id as varchar) as clone, count(*) as n_cells from events group by 1 having count(*) >= 5)
select clone, n_cells, (select count(distinct event_type) from events e where cast(e.user_id as varchar) = k.clone) as n_fates from k
""")
def clones_min_size(spark, sf):
    return groups.group_table(event_cells(spark, sf), "fate", min_size=5)


def _composition_sql(table_name: str, clone: str, fate: str, least: int) -> str:
    return f"""
with k as (select cast({clone} as varchar) as clone from {table_name} group by 1 having count(*) >= {least}),
c as (select cast({clone} as varchar) as clone, {fate} as fate, count(*) as n from {table_name} group by 1, 2),
s as (select * from k, (select distinct fate from c join k using (clone))),
d as (select clone, fate, coalesce(n, 0) as n from s left join c using (clone, fate))
select clone, fate, n, round(coalesce(n / nullif(sum(n) over (partition by clone), 0), 0), 6) as prop from d
"""


@query(_composition_sql("events", "user_id", "event_type", 3))
def clone_composition(spark, sf):
    v = event_cells(spark, sf)
    return groups.composition(v, groups.group_sizes(v), "fate").select("clone", "fate", "n", *r6("prop"))


@query(_composition_sql("orders", "o_custkey", "o_orderpriority", 3))
def clone_composition_orders(spark, sf):
    o = order_cells(spark, sf)
    return groups.composition(o, groups.group_sizes(o), "fate").select("clone", "fate", "n", *r6("prop"))


@query("""
with k as (select cast(user_id as varchar) as clone from events group by 1 having count(*) >= 3),
c as (select cast(user_id as varchar) as clone, cast(event_id % 4 as varchar) as fate, count(*) as n from events group by 1, 2),
d as (select clone, fate, coalesce(n, 0) as n from k cross join (select distinct fate from c) left join c using (clone, fate))
select clone, fate, n, round(n / sum(n) over (partition by clone), 6) as prop from d
""")
def recalc_composition(spark, sf):
    v = event_cells(spark, sf)
    return groups.composition(v, groups.group_sizes(v), "split").select("clone", "fate", "n", *r6("prop"))


@query("""
with c as (select cast(user_id as varchar) as clone, event_type as fate from events)
select fate, count(distinct clone) as n_clones from c where clone in (select clone from c group by 1 having count(*) >= 3) group by fate
""")
def fate_counts(spark, sf):
    v = event_cells(spark, sf)
    return groups.fate_table(groups.composition(v, groups.group_sizes(v), "fate"))


@query("""
with v as (
  select event_id as cell, case when event_id % 10 = 0 then null else 'label_1_' || user_id end as a,
         case when event_id % 10 = 0 or event_id % 3 = 0 then null else 'label_2_' || (event_id % 7) end as b from events
)
select cell, a as clone from v where a is not null union all select cell, b from v where b is not null
union all select cell, 'NA' from v where a is null and b is null
""")
def make_unique_clones(spark, sf):
    return groups.unique_labels(event_cells(spark, sf), ["label_1", "label_2"], out="new").select("cell", F.col("new").alias("clone"))


@query("""
select o_orderkey as cell, case when c_custkey is null then 'NA' else c_mktsegment end as group_segment
from orders left join customer on o_custkey = c_custkey
""")
def annotate_cells(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("clone"), F.col("c_mktsegment").alias("segment"))
    return groups.annotate_cells(order_cells(spark, sf), c, "segment").select("cell", "group_segment")


@query("select cast(o_custkey as varchar) as clone, min(c_mktsegment) as gex_segment from orders join customer on o_custkey = c_custkey group by 1 having count(*) >= 3")
def annotate_clones(spark, sf):
    o = order_cells(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("clone"), F.col("c_mktsegment").alias("segment"))
    return groups.annotate_clones(o.join(c, "clone"), groups.group_sizes(o), "segment").select("clone", "gex_segment")


@query("""
with s as (select o_custkey, count(*) as n_cells from orders group by 1 having count(*) >= 3), h as (select n_cells, count(*) as n_clones from s group by 1)
select n_cells, n_clones, cast(sum(n_clones) over (order by n_cells desc) as bigint) as n_at_least from h
""")
def clone_size_hist(spark, sf):
    return groups.size_histogram(groups.group_sizes(order_cells(spark, sf)))


@query("""
with v as (
  select case when event_id % 10 = 0 then 'NA' else cast(user_id as varchar) end as e,
         case when event_id % 10 = 0 or event_id % 3 = 0 then null else cast(event_id % 7 as varchar) end as l from events
),
a as (select e, count(*) as n from v where e <> 'NA' group by 1), b as (select l, count(*) as n from v where l is not null group by 1),
c as (select e, l, count(*) as n from v where e <> 'NA' and l is not null group by 1, 2)
select c.e as early, c.l as late, c.n as n_both, a.n - c.n as early_only, b.n - c.n as late_only from c join a on a.e = c.e join b on b.l = c.l
""")
def nesting_clones(spark, sf):
    return groups.nesting(event_cells(spark, sf), "label_1", "label_2")


def _connect_sql(rule: str, weight: str) -> str:
    base = "o as (select o_orderkey as k, o_custkey as g, o_orderdate as t, 1.0 / count(*) over (partition by o_custkey) as share from orders)"
    w = f"cast({weight} as double) as weight"
    if rule == "pairs":
        return f"with {base} select a.k as src, b.k as dst, round({w.replace('share', 'a.share').split(' as weight')[0]}, 6) as weight from o a join o b on a.g = b.g and a.k <> b.k"
    way = "desc" if rule.endswith("decrease") else "asc"
    ranked = f"r as (select k, g, share, row_number() over (partition by g order by t {way}, k) as n from o)"
    on = "a.n < b.n" if rule.startswith("all_") else "a.n + 1 = b.n"
    return f"with {base}, {ranked} select a.k as src, b.k as dst, round(cast({weight.replace('share', 'a.share')} as double), 6) as weight from r a join r b on a.g = b.g and {on}"


def _connect(rule: str, weighted: bool):
    def run(spark, sf):
        o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clone"), F.col("o_custkey").alias("g"), F.col("o_orderdate").alias("t"))
        out = groups.connect(o, "g", weighted=weighted) if rule == "pairs" else groups.connect(o, "g", "t", rule, weighted=weighted)
        return out.select("src", "dst", *r6("weight"))

    run.__name__ = f"connect_clones_{rule}" + "_weighted" * weighted
    return run


for _rule in ("pairs", "increase", "decrease", "all_increase", "all_decrease"):
    for _weighted in (False, True):
        query(_connect_sql(_rule, "share" if _weighted else "1.0"))(_connect(_rule, _weighted))


# --- expression ---------------------------------------------------------------------------------------------

_V_SQL = """v as (select event_id as cell, cast(user_id as varchar) as clone, event_type as gene, value, cast(event_id % 4 as varchar) as split from events),
k as (select clone, count(*) as n from v group by 1 having count(*) >= 3)"""


def _event_expr(spark, sf):
    v = event_cells(spark, sf)
    return v, v.select("cell", F.col("fate").alias("gene"), "value"), expression.group_labels(v, groups.group_sizes(v))


@query(f"with {_V_SQL} select clone as grp, gene, round(sum(value), 4) as value from v join k using (clone) group by 1, 2")
def transfer_expr_sum(spark, sf):
    _, x, labels = _event_expr(spark, sf)
    return expression.transfer(x, labels, "sum").select("grp", "gene", F.round("value", 4).alias("value"))


@query(f"with {_V_SQL} select clone as grp, gene, round(sum(value) / max(n) + 1e-9, 6) as value from v join k using (clone) group by 1, 2")
def transfer_expr_average(spark, sf):
    _, x, labels = _event_expr(spark, sf)
    return expression.transfer(x, labels).select("grp", "gene", F.round(F.col("value") + 1e-9, 6).alias("value"))  # off exact halves


@query(f"""with {_V_SQL}, n as (select clone, split, count(*) as m from v group by 1, 2)
select clone as grp, split, gene, round(sum(value) / max(m), 6) as value from v join k using (clone) join n using (clone, split) group by 1, 2, 3""")
def transfer_expr_split(spark, sf):
    v, x, labels = _event_expr(spark, sf)
    return expression.transfer(x, labels, split=v.select("cell", "split")).select("grp", "split", "gene", *r6("value"))


@query(f"""with {_V_SQL}, w as (select v.*, 'm' || (cast(clone as bigint) % 5) as cat from v join k using (clone)), n as (select cat, count(*) as m from w group by 1)
select cat as grp, gene, round(sum(value) / max(m), 6) as value from w join n using (cat) group by 1, 2""")
def transfer_expr_use_col(spark, sf):
    v, x, _ = _event_expr(spark, sf)
    clones = groups.group_sizes(v).withColumn("cat", F.concat(F.lit("m"), (F.col("clone").cast("long") % 5).cast("string")))
    return expression.transfer(x, expression.group_labels(v, clones, use_col="cat")).select("grp", "gene", *r6("value"))


@query("""
with l as (select cast(l_suppkey as varchar) as grp, unnest(['quantity', 'price', 'discount', 'tax']) as gene, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value, l_returnflag as split from lineitem)
select grp, split, gene, round(avg(value), 4) as value from l group by 1, 2, 3
""")
def transfer_lineitem(spark, sf):
    # Wide rows: the columns are averaged as they lie and turned long only once there is one row per group.
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("grp"), F.col("l_returnflag").alias("split")).agg(*[F.avg(c).alias(n) for n, c in names.items()])
    return wide.unpivot(["grp", "split"], list(names), "gene", "value").withColumn("value", F.round("value", 4))


@query(f"""with {_V_SQL}, s as (select distinct split from v), h as (select distinct clone, split from v)
select k.clone as grp, s.split, h.clone is not null as has_cells from k cross join s left join h on h.clone = k.clone and h.split = s.split""")
def split_mask(spark, sf):
    v, _, labels = _event_expr(spark, sf)
    return expression.split_mask(labels, v.select("cell", "split"))


def _layers(spark, sf):
    v = event_cells(spark, sf).select(F.col("cell").alias("obs"), F.col("fate").alias("gene"), "value")
    holes = v.withColumn("value", F.when(F.col("obs") % 6 == 0, F.lit(float("nan"))).when(F.col("obs") % 10 == 3, None).otherwise(F.col("value")))
    return v, holes


@query("""
select 'l1:' || event_id as obs, 'l1' as layer, event_id as source_obs, event_type as gene, value from events
union all select 'l2:' || event_id, 'l2', event_id, event_type, value from events where event_id % 6 <> 0 and event_id % 10 <> 3
""")
def stack_layers(spark, sf):
    v, holes = _layers(spark, sf)
    return expression.stack_layers({"l1": v, "l2": holes}, v.select("obs"))


@query("select event_id as obs, event_id % 6 = 0 or event_id % 10 = 3 as missing from events")
def nan_mask(spark, sf):
    v, holes = _layers(spark, sf)
    return expression.missing_rows(holes, v.select("obs"))


@query(f"with {CELLS_SQL}, {EXPR_SQL}, d as (select expr.*, batch from expr join cells using (cell)) select cell, gene, round(value - avg(value) over (partition by batch, gene), 6) + 0.0 as value from d")
def regress_categories(spark, sf):
    dense = expr(spark, sf).join(cells(spark, sf).select("cell", "batch"), "cell")
    return expression.regress_categories(dense, ["batch"]).select("cell", "gene", (F.round("value", 6) + 0.0).alias("value"))


@query(f"""with {CELLS_SQL}, {EXPR_SQL}, d as (select expr.*, batch, cell_type from expr join cells using (cell)),
e as (select *, value - avg(value) over (partition by batch, gene) as v from d)
select cell, gene, round(v - avg(v) over (partition by cell_type, gene), 6) + 0.0 as value from e""")
def regress_categories_two(spark, sf):
    dense = expr(spark, sf).join(cells(spark, sf).select("cell", "batch", "cell_type"), "cell")
    return expression.regress_categories(dense, ["batch", "cell_type"]).select("cell", "gene", (F.round("value", 6) + 0.0).alias("value"))


@query(f"""with {_V_SQL}, c as (select clone, gene, count(*) as n from v join k using (clone) group by 1, 2),
d as (select k.clone, g.gene, coalesce(c.n, 0) / k.n as p from k cross join (select distinct gene from c) g left join c on c.clone = k.clone and c.gene = g.gene),
e as (select *, greatest(0.01, least(0.99, p)) as q, ln(p + 0.001) as l from d)
select clone, gene as fate, round(ln(q / (1 - q)), 6) as logit, round(ln(1 + p), 6) as log1p, round(sqrt(p), 6) as sqrt, round(l - avg(l) over (partition by clone), 6) as clr from e""")
def transforms(spark, sf):
    v = event_cells(spark, sf)
    comp = groups.composition(v, groups.group_sizes(v), "fate")
    return comp.select("clone", "fate", *[F.round(transform(F.col("prop"), k), 6).alias(k) for k in ("logit", "log1p", "sqrt", "clr")])


# --- neighbours and graphs ----------------------------------------------------------------------------------

_K = 15
_SELF = f"{CELLS_SQL}, {knn_sql(_K, 'a.clone <> ' + repr('NA'), 'b.clone <> ' + repr('NA'))}, g as (select a.clone as src, b.clone as dst, count(*) as weight from nn join cells a on a.cell = q join cells b on b.cell = n group by 1, 2)"


def _graph(spark, sf):
    """The group graph, computed once for all branches of a plan that read it."""
    return stored(clonal_nn_self(spark, sf), "graph")


@query(f"with {_SELF} select * from g")
def clonal_nn_self(spark, sf):
    c = cells(spark, sf)
    return knn.group_graph(knn.neighbour_pairs(c, groups.group_sizes(c, min_size=1), _K))[0]


@query(f"""with {CELLS_SQL}, {knn_sql(_K, "a.clone <> 'NA' and a.cell % 5 = 0", "b.cell % 5 <> 0")}
select a.clone as src, b.clone as dst, count(*) as weight from nn join cells a on a.cell = q join cells b on b.cell = n where b.clone <> 'NA' group by 1, 2""")
def clonal_nn_ref(spark, sf):
    c = cells(spark, sf)
    q, ref = c.where("cell % 5 = 0"), c.where("cell % 5 <> 0")
    return knn.group_graph(knn.neighbour_pairs(q, groups.group_sizes(q, min_size=1), _K, ref=ref, ref_clones=groups.group_sizes(ref, min_size=1)))[0]


@query(f"""with {CELLS_SQL}, {knn_sql(_K, "a.clone <> 'NA'", "b.clone <> 'NA'", "a.batch = b.batch")}
select a.clone as src, b.clone as dst, count(*) as weight from nn join cells a on a.cell = q join cells b on b.cell = n group by 1, 2""")
def clonal_nn_split(spark, sf):
    c = cells(spark, sf)
    return knn.group_graph(knn.neighbour_pairs(c, groups.group_sizes(c, min_size=1), _K, split="batch"))[0]


@query(f"""with {CELLS_SQL}, {knn_sql(_K, "a.clone <> 'NA'", "b.clone <> 'NA'")},
p as (select a.clone as src, b.clone as dst, a.cell % 7 = 0 as m from nn join cells a on a.cell = q join cells b on b.cell = n)
select src, dst, count(*) as weight from p where not m group by 1, 2 union all select src, 'mask:seven', count(*) from p where m group by 1""")
def clonal_nn_masked(spark, sf):
    c = cells(spark, sf)
    masked = c.where("cell % 7 = 0").select("cell", F.lit("seven").alias("mask"))
    edges, apart = knn.group_graph(knn.neighbour_pairs(c, groups.group_sizes(c, min_size=1), _K), masked)
    return edges.unionByName(apart.select("src", F.concat(F.lit("mask:"), F.col("mask")).alias("dst"), F.col("n").alias("weight")))


def _means(spark, sf):
    c = cells(spark, sf)
    labels = expression.group_labels(c, groups.group_sizes(c, min_size=1))
    return labels, expr(spark, sf).join(labels, "cell").groupBy("grp", "gene").agg(F.avg("value").alias("value"))


_MEANS = f"{EXPR_SQL}, m0 as (select clone as node, gene, avg(value) as value from expr join cells using (cell) where clone <> 'NA' group by 1, 2), h as (select src, dst from g where weight > 0 union select node, node from m0)"


def _smooth_sql(steps: int) -> str:
    chain = "".join(f", m{i} as (select src as node, gene, avg(value) as value from h join m{i - 1} on dst = node group by 1, 2)" for i in range(1, steps + 1))
    return f"with {_SELF}, {_MEANS}{chain} select node, gene as name, round(value, 6) + 0.0 as value from m{steps}"


def _smooth(steps: int):
    def run(spark, sf):
        values = _means(spark, sf)[1].select(F.col("grp").alias("node"), F.col("gene").alias("name"), "value")
        return graph.smooth(_graph(spark, sf), values, steps).select("node", "name", (F.round("value", 6) + 0.0).alias("value"))

    run.__name__ = f"smooth_expr_{steps}"
    return run


for _steps in (1, 2, 3):
    query(_smooth_sql(_steps))(_smooth(_steps))

_HOPS = "h as (select src, dst from g where weight > 0 union select node, node from o)"


@query(f"""with {_SELF}, o as (select clone as node, count(*)::double as n, max(cell % 5 = 0)::int::double as b from cells where clone <> 'NA' group by 1), {_HOPS},
m as (select src as node, avg(n) as n, avg(b) as b from h join o on dst = node group by 1), z as (select src as node, avg(n) as n, avg(b) as b from h join m on dst = node group by 1)
select node, 'n_cells' as name, round(n, 6) as value from z union all select node, 'fifth=true', round(b, 6) from z""")
def smooth_obs(spark, sf):
    # A number as it is, a category as the share of neighbours that have it.
    own = cells(spark, sf).where("clone <> 'NA'").groupBy(F.col("clone").alias("node")).agg(F.count("*").cast("double").alias("n_cells"), F.max((F.col("cell") % 5 == 0).cast("double")).alias("fifth=true"))
    return graph.smooth(_graph(spark, sf), own.unpivot("node", ["n_cells", "fifth=true"], "name", "value"), 2).select("node", "name", *r6("value"))


@query(f"""with {_SELF}, o as (select clone as node, i - 1 as i, avg(x[i]) as value from (select clone, x, unnest(range(1, 65)) as i from cells where clone <> 'NA') group by 1, 2), {_HOPS},
m as (select src as node, i, avg(value) as value from h join o on dst = node group by 1, 2)
select node, 'x_' || i as name, round(value, 6) + 0.0 as value from m""")
def smooth_obsm(spark, sf):
    rows = cells(spark, sf).where("clone <> 'NA'").select(F.col("clone").alias("node"), F.posexplode("x").alias("i", "value"))
    means = rows.groupBy("node", F.concat(F.lit("x_"), F.col("i").cast("string")).alias("name")).agg(F.avg("value").alias("value"))
    return graph.smooth(_graph(spark, sf), means, 1).select("node", "name", (F.round("value", 6) + 0.0).alias("value"))


_GROUPS = "u as (select distinct clone as node, 'm' || (cast(substr(clone, 2) as bigint) % 4) as grp from cells where clone <> 'NA'), s as (select grp, count(*) as size from u group by 1)"


def _clone_groups(spark, sf):
    c = groups.group_sizes(cells(spark, sf), min_size=1)
    return c.select(F.col("clone").alias("node"), F.concat(F.lit("m"), (F.expr("cast(substr(clone, 2) as bigint)") % 4).cast("string")).alias("grp"))


@query(f"""with {_SELF}, {_GROUPS}, o as (select a.grp as a, b.grp as b, count(*) as n from g join u a on a.node = src join u b on b.node = dst where weight > 0 group by 1, 2),
p as (select x.grp as a, y.grp as b, coalesce(n, 0) as n from s x cross join s y left join o on o.a = x.grp and o.b = y.grp),
e as (select *, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () as e from p)
select a, b, cast(n as double) as observed, round(e, 6) as expected, round(case when e > 0 then n / e else 0 end, 6) as connectivity from e""")
def group_connectivity_directed(spark, sf):
    return graph.group_connectivity(_graph(spark, sf), _clone_groups(spark, sf)).select("a", "b", "observed", *r6("expected", "connectivity"))


@query(f"""with {_SELF}, {_GROUPS}, w as (select src, dst from g where weight > 0 union select dst, src from g where weight > 0),
o as (select a.grp as a, b.grp as b, count(*) as n from w join u a on a.node = src join u b on b.node = dst group by 1, 2),
p as (select x.grp as a, y.grp as b, x.size as sa, y.size as sb, coalesce(n, 0) as n from s x cross join s y left join o on o.a = x.grp and o.b = y.grp),
e as (select *, (sum(n) over (partition by a) * sb + sa * sum(n) over (partition by b)) / (select sum(size) - 1 from s) as e from p)
select a, b, cast(n as double) as observed, round(e, 6) as expected, round(case when e > 0 then n / e else 0 end, 6) as connectivity from e""")
def group_connectivity_undirected(spark, sf):
    return graph.group_connectivity(_graph(spark, sf), _clone_groups(spark, sf), directed=False).select("a", "b", "observed", *r6("expected", "connectivity"))


@query(f"""with {_SELF}, {_GROUPS}, l as (select x.node as src, y.node as dst, 1.0 as l from u x join u y on x.grp = y.grp and x.node <> y.node)
select coalesce(l.src, g.src) as src, coalesce(l.dst, g.dst) as dst, round(power(0.2, 0.1) * (coalesce(l, 0) - coalesce(weight, 0)) + coalesce(weight, 0), 6) as weight
from l full join g on l.src = g.src and l.dst = g.dst""")
def clonocluster(spark, sf):
    lineage = groups.connect(_clone_groups(spark, sf).withColumnRenamed("node", "clone"), "grp")
    return graph.blend(lineage, _graph(spark, sf)).select("src", "dst", *r6("weight"))


_MNN = f"""{CELLS_SQL}, ab as (select * from (select a.cell as a, b.cell as b, row_number() over (partition by a.cell order by list_distance(a.x, b.x), b.cell) - 1 as ra from cells a, cells b where a.batch = 'b0' and b.batch = 'b1') where ra < 10),
ba as (select * from (select a.cell as a, b.cell as b, row_number() over (partition by b.cell order by list_distance(a.x, b.x), a.cell) - 1 as rb from cells a, cells b where a.batch = 'b0' and b.batch = 'b1') where rb < 10),
j as (select a, b, ra, rb, ra + rb as s from ab join ba using (a, b)),
t as (select *, row_number() over (partition by a order by s, ra, b) as pa, row_number() over (partition by b order by s, rb, a) as pb from j)"""


@query(f"with {_MNN} select a, b, s as rank_sum, round(1 - s / 18.0, 6) as weight from t where pa <= 3 or pb <= 3")
def mnn_pairs(spark, sf):
    c = cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x")
    return integrate.mutual_pairs(c.where("batch = 'b0'").select("id", "x"), c.where("batch = 'b1'").select("id", "x")).select("a", "b", F.col("rank_sum").cast("long").alias("rank_sum"), *r6("weight"))


def _mnn_all() -> str:
    parts = []
    for p, q in (("b0", "b1"), ("b0", "b2"), ("b1", "b2")):
        body = _MNN.split("), ab as", 1)[1].replace("'b0'", "'first'").replace("'b1'", f"'{q}'").replace("'first'", f"'{p}'")
        parts.append(f"select a as src, b as dst, round(1 - s / 18.0, 6) as weight from (with ab as{body} select * from t where pa <= 3 or pb <= 3)")
    return f"with {CELLS_SQL}, m as ({' union all '.join(parts)})"


@query(f"{_mnn_all()} select src, dst, weight from m union all select dst, src, weight from m")
def mnn_graph(spark, sf):
    return integrate.find_mnn(cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x"))[0].select("src", "dst", *r6("weight"))


@query(f"{_mnn_all()} select least(a.batch, b.batch) as batch_a, greatest(a.batch, b.batch) as batch_b, round(sum(weight), 3) as value from m join cells a on a.cell = src join cells b on b.cell = dst group by 1, 2")
def batch_similarity(spark, sf):
    points = cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x")
    edges = integrate.find_mnn(points)[0].where("src < dst")
    # One direction of each pair, weights rounded as the twin has them.
    return integrate.batch_similarity(edges.withColumn("weight", F.round("weight", 6)), points).withColumn("value", F.round("value", 3))


def _impute_sql(kind: str, weights: str | None) -> str:
    w = {None: "1.0", "linear": "1.0 / (d + 1e-12)", "gaussian": "exp(-d * d / (2 * pow((select median(d) from nn where d > 0), 2)))"}[weights]
    head = f"{CELLS_SQL}, {knn_sql(10, 'a.cell % 9 = 0', 'b.cell % 9 <> 0')}, w as (select *, {w} as u from nn), z as (select q, n, u / sum(u) over (partition by q) as w from w)"
    if kind == "numeric":
        return f"with {head} select cell, round(cast(cell_type as double), 6) as value from cells where cell % 9 <> 0 union all select q, round(sum(w * cast(cell_type as double)), 6) from z join cells on cell = n group by 1"
    votes = "p as (select q, cell_type as c, sum(w) as p from z join cells on cell = n group by 1, 2), b as (select q, c, row_number() over (partition by q order by round(p, 12) desc, c) as r from p)"
    return f"with {head}, {votes} select cell, cell_type as value from cells where cell % 9 <> 0 union all select q, c from b where r = 1"


def _impute(kind: str, weights: str | None):
    def run(spark, sf):
        c = cells(spark, sf)
        value = F.col("cell_type").cast("double") if kind == "numeric" else F.col("cell_type")
        filled, _ = knn.impute(c.withColumn("y", F.when(F.col("cell") % 9 == 0, None).otherwise(value)), "y", weights=weights)
        return filled.select("cell", *r6("value")) if kind == "numeric" else filled

    run.__name__ = f"impute_{kind}_{weights or 'uniform'}"
    return run


for _kind in ("numeric", "categorical"):
    for _w in (None, "linear", "gaussian"):
        query(_impute_sql(_kind, _w))(_impute(_kind, _w))


@query(f"""with {CELLS_SQL}, {knn_sql(10, 'a.cell % 9 = 0', 'b.cell % 9 <> 0')}, w as (select *, 1.0 / (d + 1e-12) as u from nn), z as (select q, n, u / sum(u) over (partition by q) as w from w)
select q as cell, cell_type as cls, round(sum(w), 6) as prob from z join cells on cell = n group by 1, 2""")
def impute_probabilities(spark, sf):
    c = cells(spark, sf)
    return knn.impute(c.withColumn("y", F.when(F.col("cell") % 9 == 0, None).otherwise(F.col("cell_type"))), "y", weights="linear")[1].select("cell", "cls", *r6("prob"))


# --- statistics ---------------------------------------------------------------------------------------------


def _xy(spark, sf):
    x = expr(spark, sf).select(F.col("cell").alias("obs"), "gene", "value")
    y = expr(spark, sf).where("gene in ('g16', 'g17')").select(F.col("cell").alias("obs"), F.col("gene").alias("response"), "value")
    label = cells(spark, sf).select(F.col("cell").alias("obs"), F.lit("label").alias("response"), F.col("cell_type").cast("double").alias("value"))
    return x, y.unionByName(label)


_XY = f"""{CELLS_SQL}, x as (select cell as obs, 'g' || (i - 1) as gene, x[i] as v from (select cell, x, unnest(range(1, 65)) as i from cells)),
y as (select cell as obs, 'g' || (i - 1) as response, x[i] as v from (select cell, x, unnest([17, 18]) as i from cells) union all select cell, 'label', cast(cell_type as double) from cells)"""
_R = "round(r, 6) as r, round(slope, 6) as slope"


@query(f"with {_XY} select gene, response, round(corr(x.v, y.v), 6) as r, round(regr_slope(y.v, x.v), 6) as slope from x join y using (obs) group by 1, 2")
def pearson(spark, sf):
    return stats.correlate(*_xy(spark, sf)).select("gene", "response", *r6("r", "slope"))


@query(f"""with {_XY}, a as (select obs, gene, rank() over (partition by gene order by v) + (count(*) over (partition by gene, v) - 1) / 2.0 as v from x),
b as (select obs, response, rank() over (partition by response order by v) + (count(*) over (partition by response, v) - 1) / 2.0 as v from y)
select gene, response, round(corr(a.v, b.v), 6) as r, round(regr_slope(b.v, a.v), 6) as slope from a join b using (obs) group by 1, 2""")
def spearman(spark, sf):
    return stats.correlate(*_xy(spark, sf), method="spearman").select("gene", "response", *r6("r", "slope"))


@query(f"""with {_XY}, j as (select gene, response, x.v as a, y.v as b, 1.0 + obs % 10 as w from x join y using (obs)),
m as (select gene, response, a, b, w, sum(w * a) over p / sum(w) over p as ma, sum(w * b) over p / sum(w) over p as mb from j window p as (partition by gene, response)),
s as (select gene, response, sum(w * (a - ma) * (b - mb)) as ab, sum(w * (a - ma) * (a - ma)) as aa, sum(w * (b - mb) * (b - mb)) as bb from m group by 1, 2)
select gene, response, round(ab / sqrt(aa * bb), 6) as r, round(ab / aa, 6) as slope from s""")
def weighted_corr(spark, sf):
    x, y = _xy(spark, sf)
    weights = cells(spark, sf).select(F.col("cell").alias("obs"), (1.0 + F.col("cell") % 10).alias("weight"))
    return stats.correlate(x, y, weights=weights).select("gene", "response", *r6("r", "slope"))


@query(f"""with {CELLS_SQL}, {EXPR_SQL}, s as (select cell, cast(substr(gene, 2) as bigint) as i, value from expr), t as (select cell, i - 32 as i, value from s where i >= 32)
select 'g' || i as gene, round(corr(s.value, t.value), 6) as r, round(regr_slope(t.value, s.value), 6) as slope from s join t using (cell, i) group by 1""")
def corr_columns(spark, sf):
    # Each coordinate of the first half with its counterpart in the second.
    rows = expr(spark, sf).select(F.col("cell").alias("obs"), F.expr("cast(substr(gene, 2) as bigint)").alias("i"), "value")
    named = lambda df, off: df.select("obs", F.concat(F.lit("g"), (F.col("i") - off).cast("string")).alias("gene"), "value")
    return stats.correlate_columns(named(rows.where("i < 32"), 0), named(rows.where("i >= 32"), 32)).select("gene", *r6("r", "slope"))


@query("""
with p as (select event_id as id, value / 500 as p from events), n as (select count(*) as m from p),
r as (select id, p, rank() over (order by p) + count(*) over (partition by p) - 1 as r from p)
select id, round(least(1.0, min(p * m / r) over (order by p desc)), 6) as p_adj from r, n
""")
def bh_adjust(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("pvalue"))
    return stats.adjust(p).select("id", *r6("p_adj"))


@query("""
with p as (select event_id as id, value / 500 as p from events), n as (select count(*) as m from p),
r as (select id, p, rank() over (order by p) as r from p)
select id, round(least(1.0, p * m), 6) as bonferroni, round(least(1.0, max(p * (m - r + 1)) over (order by p)), 6) as holm from r, n
""")
def family_adjust(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("pvalue"))
    return stats.adjust(stats.adjust(p, method="bonferroni", out="bonferroni"), method="holm", out="holm").select("id", *r6("bonferroni", "holm"))


@query(f"""with {_SELF}, {_MEANS}, n as (select count(distinct node)::double as n from m0), b as (select src, dst, weight::double as w from g union all select dst, src, weight from g),
c as (select (select sum(weight)::double from g) as w, (select 0.5 * sum(w * w) from (select sum(w) as w from b group by src, dst)) as s1, (select sum(w * w) from (select sum(w) as w from b group by src)) as s2),
i as (select u.gene, sum(weight * u.value * v.value) as s from g join m0 u on u.node = src join m0 v on v.node = dst and v.gene = u.gene group by 1),
q as (select gene, sum(value * value) as q from m0 group by 1),
f as (select gene, n / w * s / q as i, -1 / (n - 1) as e, n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / ((n - 1) * (n - 1)) as v from q join i using (gene), n, c)
select gene, round(i, 6) as morans_i, round(e, 6) as expected, round(v, 6) as variance, round((i - e) / sqrt(v), 4) as z from f""")
def morans_i(spark, sf):
    values = _means(spark, sf)[1].select(F.col("grp").alias("node"), "gene", "value")
    return stats.morans_i(_graph(spark, sf), values).select("gene", *r6("morans_i", "expected", "variance"), F.round("z", 4).alias("z"))


def _tail(source: str, df: str) -> str:
    """CTEs p and a: two-sided p-values of the rows r, df of ``source`` by Simpson's rule over the t density, and their BH adjustment."""
    area = "list_sum([(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end) * pow(cos(({0}) * i / 2000), {1} - 1) for i in range(0, 2001)]) * ({0})"
    return f"""w as (select distinct {df} as df from {source}), h as (select df, {area.format("pi() / 2", "df")} as whole from w),
p as (select s.*, greatest(0.0, 1 - {area.format("asin(least(1.0, abs(s.r)))", "h.df")} / whole) as pvalue from {source} s join h on h.df = s.{df}),
k as (select *, rank() over (order by pvalue) + count(*) over (partition by pvalue) - 1 as rk, count(*) over () as m from p),
a as (select *, least(1.0, min(pvalue * m / rk) over (order by pvalue desc)) as p_adj from k)"""


@query(f"""with {_XY}, s as (select gene, response, corr(x.v, y.v) as r, regr_slope(y.v, x.v) as slope, count(*) - 2.0 as df from x join y using (obs) group by 1, 2), {_tail("s", "df")}
select 'all' as layer, gene, response, {_R}, round(pvalue, 6) as pvalue, round(p_adj, 6) as p_adj from a""")
def association_pvalues(spark, sf):
    x, y = _xy(spark, sf)
    return stats.associations({"all": x}, y).select("layer", "gene", "response", *r6("r", "slope", "pvalue", "p_adj"))


@query(f"""with n as (select user_id, count(*) as n from events group by 1 having count(*) >= 3), f as (select distinct event_type as response from events where user_id in (select user_id from n)),
c as (select n.user_id, response, n as w, n as x, (select count(*) from events e where e.user_id = n.user_id and e.event_type = response) / n as y from n, f),
d as (select *, sum(w * x) over o / sum(w) over o as mx, sum(w * y) over o / sum(w) over o as my from c window o as (partition by response)),
s as (select response, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * pow(x - mx, 2)) * sum(w * pow(y - my, 2))) as r, sum(w * (x - mx) * (y - my)) / sum(w * pow(x - mx, 2)) as slope, pow(sum(w), 2) / sum(w * w) - 2 as df from d group by 1),
{_tail("s", "df")} select 'all' as layer, 'n_cells' as gene, response, {_R}, round(pvalue, 6) as pvalue, round(p_adj, 6) as p_adj from a""")
def association_binomial(spark, sf):
    v = event_cells(spark, sf)
    k = groups.group_sizes(v)
    comp = groups.composition(v, k, "fate").select(F.col("clone").alias("obs"), F.col("fate").alias("response"), "n")
    x = k.select(F.col("clone").alias("obs"), F.lit("n_cells").alias("gene"), F.col("n_cells").cast("double").alias("value"))
    return stats.associations({"all": x}, comp.withColumnRenamed("n", "value"), binomial=True).select("layer", "gene", "response", *r6("r", "slope", "pvalue", "p_adj"))


@query()
def gam(spark, sf):
    x, y = _xy(spark, sf)
    return stats.associations({"all": x}, y, method="gam")


@query(f"""with {_XY} select gene, response, round(quantile_cont(x.v, 1.0 / 3), 6) as q1, round(quantile_cont(x.v, 2.0 / 3), 6) as q2
from x join y using (obs) where response <> 'g17' or y.v > 0 group by 1, 2""")
def gam_knots(spark, sf):
    # One response has fewer observations, so its knots are its own.
    x, y = _xy(spark, sf)
    knots = stats.pair_quantiles(x, y.where("response <> 'g17' or value > 0"), [1 / 3, 2 / 3])
    return knots.select("gene", "response", F.round(F.col("inner")[0], 6).alias("q1"), F.round(F.col("inner")[1], 6).alias("q2"))


@query()
def gpca_scores(spark, sf):
    values = _means(spark, sf)[1].select(F.col("grp").alias("node"), "gene", "value")
    return stats.graph_components(_graph(spark, sf), values, 5)[1]


@query()
def eigenvalue_test(spark, sf):
    return stats.eigenvalue_test(cells(spark, sf).select("x"))


@query()
def tracy_widom_test(spark, sf):
    return stats.eigenvalue_test(cells(spark, sf).select("x"), flavor="asymptotic")


# --- models -------------------------------------------------------------------------------------------------


@query()
def skipgram(spark, sf):
    return embed.fit_softmax(_graph(spark, sf)).embedding(spark)


@query()
def poisson_embedding(spark, sf):
    return embed.fit_poisson(_graph(spark, sf)).embedding(spark)


@query()
def project_skipgram(spark, sf):
    return embed.project_softmax(clonal_nn_ref(spark, sf), embed.fit_softmax(_graph(spark, sf)))


@query()
def project_poisson(spark, sf):
    return embed.project_poisson(clonal_nn_ref(spark, sf), embed.fit_poisson(_graph(spark, sf)))


@query()
def align(spark, sf):
    points = cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x")
    edges, order = integrate.find_mnn(points)
    return integrate.align(points, edges, order)


@query(f"""{_mnn_all()}, v as (select least(a.batch, b.batch) as p, greatest(a.batch, b.batch) as q, count(*) as s from m join cells a on a.cell = src join cells b on b.cell = dst group by 1, 2),
f as (select p, q from v order by s desc, p, q limit 1), o as (select unnest(['b0', 'b1', 'b2']) as r)
select format('[{{0}}] + [{{1}}] = [({{0}}+{{1}})]; [{{2}}] + [({{0}}+{{1}})] = [({{2}}+({{0}}+{{1}}))];', p, q, r) as merges from f, o where r not in (p, q)""")
def merge_order(spark, sf):
    order = integrate.find_mnn(cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x"))[1]
    return spark.createDataFrame([(integrate.write_order(order),)], "merges string")


def _gene_points(spark, sf):
    return cells(spark, sf).select(F.col("cell").alias("id"), "batch", "x")


@query()
def anchors_cca(spark, sf):
    return anchors.find_anchors(_gene_points(spark, sf))


@query()
def anchors_rpca(spark, sf):
    return anchors.find_anchors(_gene_points(spark, sf), "rpca")


@query()
def integrate_data(spark, sf):
    points = _gene_points(spark, sf)
    return anchors.integrate(points, anchors.find_anchors(points), scale=True)


@query()
def geometric_sketch(spark, sf):
    return sketch.sketch(cells(spark, sf).select("cell", "batch", "x"), 0.2, by="batch")


def _boosted(spark, sf):
    wide = _means(spark, sf)[1].groupBy(F.col("grp").alias("clone")).pivot("gene", [f"g{i}" for i in range(64)]).agg(F.first("value"))
    size = groups.group_sizes(cells(spark, sf), min_size=1)
    responses = {"y1": 3 * F.col("g0") - F.col("g1"), "y2": F.col("g2") * F.col("g3") + F.col("g4"), "y3": F.col("n_cells").cast("double")}
    wide = stored(wide.join(size, "clone").withColumns(responses).withColumn("val", F.xxhash64("clone") % 4 == 0), "boost")
    return boost.fit_boosted(wide, [f"g{i}" for i in range(64)], list(responses), "val")


def _classes(spark, sf):
    v = event_cells(spark, sf)
    comp = groups.composition(v, groups.group_sizes(v, min_size=1), "fate").groupBy("clone").pivot("fate").agg(F.first("prop"))
    fates = [c for c in comp.columns if c != "clone"]
    means = v.groupBy("clone").agg(F.avg("value").alias("mean"), F.count("*").cast("double").alias("n"), F.max("split").alias("split"))
    return boost.fit_classes(stored(comp.join(means, "clone"), "classes"), ["mean", "n", "split"], fates)


def _attributed(spark, shaps, model):
    """(clone, response, s): what the model starts from and all attributions of a row."""
    mean = spark.createDataFrame([(r, float(m)) for r, m in zip(model.responses, model.mean(), strict=True)], "response string, mean double")
    return shaps.groupBy("clone", "response").agg(F.sum("shap").alias("s")).join(F.broadcast(mean), "response").select("clone", "response", (F.col("s") + F.col("mean")).alias("s"))


@query()
def class_predictions(spark, sf):
    return _classes(spark, sf)[0]


@query("""
with c as (select cast(user_id as varchar) as clone, event_type as response, count(*) as n from events group by 1, 2),
k as (select clone, sum(n) as n from c group by 1)
select k.clone, f.response, round(coalesce(c.n, 0) / k.n, 6) as y, 1.0::double as whole, 0.0::double as gap
from k cross join (select distinct response from c) f left join c on c.clone = k.clone and c.response = f.response
""")
def class_sums(spark, sf):
    # A row's probabilities add up to 1, and are the softmax of what attributions add up to.
    predictions, shaps, fit = _classes(spark, sf)
    p = stored(predictions, "class-predictions")
    odds = _attributed(spark, shaps, fit.model).withColumn("e", F.exp("s"))
    own = odds.withColumn("share", F.col("e") / F.sum("e").over(Window.partitionBy("clone"))).drop("s", "e")
    whole = p.groupBy("clone").agg(F.round(F.sum("predicted"), 6).alias("whole"))
    gap = F.round(F.abs(F.col("share") - F.col("predicted")), 6) + 0.0
    return p.join(own, ["clone", "response"]).join(whole, "clone").select("clone", "response", *r6("y"), "whole", gap.alias("gap"))


@query()
def boosted_predictions(spark, sf):
    return _boosted(spark, sf)[0]


@query(f"with {CELLS_SQL} select distinct clone, response, 0.0::double as gap from cells cross join (select unnest(['y1', 'y2', 'y3']) as response) where clone <> 'NA'")
def boosted_shap_sums(spark, sf):
    # Attributions and what the model starts from add up to the prediction, row by row and response by response.
    predictions, shaps, fit = _boosted(spark, sf)
    sums = _attributed(spark, shaps, fit.model).join(predictions, ["clone", "response"])
    return sums.select("clone", "response", (F.round(F.abs(F.col("s") - F.col("predicted")), 6) + 0.0).alias("gap"))


@query()
def boosted_shap(spark, sf):
    return boost.correct_shap(boost.shap_summary(_boosted(spark, sf)[1]), normalize=True)


# --- tables behind figures ----------------------------------------------------------------------------------

_BY_GENE = f"with {CELLS_SQL}, {EXPR_SQL}, t as (select gene, avg(value) as lfc, abs(avg(value) / stddev_samp(value)) as p from expr group by 1)"


def _by_gene(spark, sf):
    return expr(spark, sf).groupBy("gene").agg(F.avg("value").alias("lfc"), F.abs(F.avg("value") / F.stddev_samp("value")).alias("p"))


@query(f"""{_BY_GENE}, c as (select *, -log10(greatest(p, 1e-300)) as l, case when p < 0.05 and abs(lfc) >= 0.002 and lfc > 0 then 'up' when p < 0.05 and abs(lfc) >= 0.002 then 'down'
when p < 0.05 and lfc > 0 then 'up_p' when p < 0.05 then 'down_p' when abs(lfc) >= 0.002 then 'lfc_only' else 'none' end as cls from t),
r as (select *, row_number() over (partition by cls order by l desc, abs(lfc) desc, gene) as r from c)
select gene, round(l, 6) as neg_log_p, cls, cls in ('up', 'down') and r <= 5 as labelled from r""")
def volcano_classes(spark, sf):
    return plotdata.volcano(_by_gene(spark, sf), "lfc", "p", lfc_cut=0.002).select("gene", *r6("neg_log_p"), "cls", "labelled")


@query(f"""{_BY_GENE} select gene, 'top' as side from (select * from t order by lfc desc, gene limit 5) union all select gene, 'bottom' from (select * from t order by lfc, gene limit 5)""")
def top_bottom(spark, sf):
    return plotdata.top_bottom(_by_gene(spark, sf), "lfc", 5, "gene").select("gene", "side")


@query(f"""with {CELLS_SQL}, {EXPR_SQL}, m as (select cell_type as response, gene as feature, avg(abs(value)) as s from expr join cells using (cell) where cell_type in ('0', '1') group by 1, 2),
d as (select a.feature, a.s as a, b.s as b, a.s - b.s as d from m a join m b using (feature) where a.response = '0' and b.response = '1')
select feature, round(a, 6) as a, round(b, 6) as b, round(d, 6) as difference, 'top' as side from (select * from d order by d desc, feature limit 10)
union all select feature, round(a, 6), round(b, 6), round(d, 6), 'bottom' from (select * from d order by d, feature limit 10)""")
def predictors_difference(spark, sf):
    s = expr(spark, sf).join(cells(spark, sf).select("cell", F.col("cell_type").alias("response")), "cell").groupBy("response", F.col("gene").alias("feature")).agg(F.avg(F.abs("value")).alias("mean_shap"))
    return plotdata.predictors_difference(s, "0", "1").select("feature", *r6("a", "b", "difference"), "side")


_XYC = f"with {CELLS_SQL}, c as (select cell as node, x[1] as x, x[2] as y, cell_type as grp from cells)"


def _coords(spark, sf):
    c = cells(spark, sf).select(F.col("cell").alias("node"), F.col("x")[0].alias("x"), F.col("x")[1].alias("y"), F.col("cell_type").alias("grp"))
    return c.select("node", "x", "y"), c.select("node", "grp")


@query(f"{_XYC} select grp, round(avg(x), 6) + 0.0 as x, round(avg(y), 6) + 0.0 as y, count(*) as n from c group by 1")
def centroids(spark, sf):
    return plotdata.centroids(*_coords(spark, sf)).select("grp", *[(F.round(c, 6) + 0.0).alias(c) for c in "xy"], "n")


@query(f"{_XYC} select grp, round(median(x), 6) + 0.0 as x, round(median(y), 6) + 0.0 as y from c group by 1")
def legend_positions(spark, sf):
    return plotdata.medians(*_coords(spark, sf)).select("grp", *[(F.round(c, 6) + 0.0).alias(c) for c in "xy"])


@query(f"""{_XYC}, b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from c),
s as (select grp, count(*) as n, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as k, pow(count(*), -1.0 / 3) as h from c group by 1 having count(*) >= 5),
t as (select *, vx * vy - k * k as det from s), g as (select i, j from range(100) a(i), range(100) e(j)),
p as (select i, j, x0 - 0.05 * (x1 - x0) + i * 1.1 * (x1 - x0) / 99 as gx, y0 - 0.05 * (y1 - y0) + j * 1.1 * (y1 - y0) / 99 as gy from g, b)
select grp, round(gx, 6) + 0.0 as gx, round(gy, 6) + 0.0 as gy,
       round(sum(exp(-0.5 * (vy * (gx - x) * (gx - x) - 2 * k * (gx - x) * (gy - y) + vx * (gy - y) * (gy - y)) / det / h)) / max(n) / max(2 * pi() * sqrt(det) * h), 4) as density
from c join t using (grp), p group by grp, i, j, gx, gy""")
def kde_grid(spark, sf):
    return plotdata.kde_grid(*_coords(spark, sf)).select("grp", *[(F.round(c, 6) + 0.0).alias(c) for c in ("gx", "gy")], F.round("density", 4).alias("density"))


@query(f"{_BY_GENE} select gene, round((lfc - min(lfc) over ()) / (max(lfc) over () - min(lfc) over ()), 6) as scaled from t")
def minmax_scaled(spark, sf):
    return plotdata.min_max(_by_gene(spark, sf), "lfc").select("gene", *r6("scaled"))


@query(f"""{_XYC}, q as (select quantile_cont(x, 0.1) as x0, quantile_cont(x, 0.9) as x1, quantile_cont(y, 0.1) as y0, quantile_cont(y, 0.9) as y1 from c),
z as (select node, (greatest(x0, least(x1, x)) - x0) / (x1 - x0) as u, (greatest(y0, least(y1, y)) - y0) / (y1 - y0) as v from c, q)
select node, round((1 - u) * (1 - v) * 0.9 + u * (1 - v) * 1.0, 6) as red, round((1 - u) * (1 - v) * 0.9, 6) as green, round((1 - u) * (1 - v) * 0.9 + (1 - u) * v * 1.0, 6) as blue, round(u + v, 6) as combined from z""")
def blended_colours(spark, sf):
    corners = ((0.9, 0.9, 0.9), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0))
    return plotdata.blend_colours(_coords(spark, sf)[0], "x", "y", corners, (0.1, 0.9)).select("node", *r6("red", "green", "blue", "combined"))


@query(f"""with {CELLS_SQL}, {EXPR_SQL}, z as (select cell, gene, value, least(1.5, (value - avg(value) over (partition by gene)) / stddev_samp(value) over (partition by gene)) as z from expr)
select cell_type as grp, gene, round(avg(z), 6) + 0.0 as mean_z, round(avg(case when value > 0 then 1.0 else 0.0 end), 6) as share from z join cells using (cell) group by 1, 2""")
def scaled_dotplot(spark, sf):
    x = expr(spark, sf).withColumnRenamed("cell", "node")
    out = plotdata.dotplot(x, cells(spark, sf).select(F.col("cell").alias("node"), F.col("cell_type").alias("grp")), cap=1.5)
    return out.select("grp", "gene", (F.round("mean_z", 6) + 0.0).alias("mean_z"), *r6("share"))


@query("""
select cast(user_id as varchar) as clone, count(*) as n, count(*) filter (event_type = 'click') as n_selected, round(count(*) filter (event_type = 'click') / count(*), 6) as share
from events group by 1
""")
def clones_to_cells(spark, sf):
    v = event_cells(spark, sf)
    return plotdata.selected_share(v, v.where("fate = 'click'")).select("clone", "n", "n_selected", *r6("share"))


@query(f"with {_SELF}, c as (select clone, avg(x[1]) as x, avg(x[2]) as y from cells where clone <> 'NA' group by 1) select src, dst, weight, round(a.x, 6) + 0.0 as x0, round(a.y, 6) + 0.0 as y0, round(b.x, 6) + 0.0 as x1, round(b.y, 6) + 0.0 as y1 from g join c a on a.clone = src join c b on b.clone = dst where weight > 0")
def graph_edges(spark, sf):
    means = cells(spark, sf).where("clone <> 'NA'").groupBy(F.col("clone").alias("node")).agg(F.avg(F.col("x")[0]).alias("x"), F.avg(F.col("x")[1]).alias("y"))
    out = graph.plot_edges(_graph(spark, sf), means)
    return out.select("src", "dst", "weight", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query()
def loss_history(spark, sf):
    return plotdata.loss_changes(embed.fit_softmax(_graph(spark, sf)).losses(spark))


@query()
def heatmap_order(spark, sf):
    values = _means(spark, sf)[1].select(F.col("grp").alias("row"), F.col("gene").alias("name"), "value")
    return spark.createDataFrame(list(enumerate(plotdata.heatmap_order(values))), "place int, name string")


@query()
def boosted_performance(spark, sf):
    return plotdata.performance(_boosted(spark, sf)[0])


@query()
def shap_volcano(spark, sf):
    return boost.shap_summary(_boosted(spark, sf)[1])
