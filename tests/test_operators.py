import time
from collections import Counter
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions.splines import spline_fit
from kinspark.functions.transforms import transform
from kinspark.operators import anchors, boost, booster, embed, expression, graph, groups, integrate, knn, plotdata, ranged, sketch, stats
from kinspark.sources.models import load_model, save_model

CELLS = "cell long, clone string, fate string, x array<double>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def points(spark, n=60, dim=3, seed=0, batches=2):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, frame(spark, [(i, f"b{i % batches}", x[i].tolist()) for i in range(n)], "id long, batch string, x array<double>")


def test_groups_skip_null_and_sentinel(spark):
    c = frame(spark, [(1, "a", "f", None), (2, "a", None, None), (3, "NA", "f", None), (4, None, "g", None), (5, "b", "g", None)], CELLS)
    assert {tuple(r) for r in groups.group_sizes(c, min_size=1).collect()} == {("a", 2), ("b", 1)}
    assert [tuple(r) for r in groups.group_table(c, "fate", min_size=2).collect()] == [("a", 2, 1)]
    comp = {(r.clone, r.fate): (r.n, r.prop) for r in groups.composition(c, groups.group_sizes(c, min_size=1), "fate").collect()}
    assert comp == {("a", "f"): (1, 1.0), ("a", "g"): (0, 0.0), ("b", "f"): (0, 0.0), ("b", "g"): (1, 1.0)}
    none = groups.composition(c, groups.group_sizes(c, min_size=1), None).collect()
    assert {r.fate for r in none} == {"None"} and {r.n for r in none} == {0}
    with pytest.raises(ValueError):
        groups.group_table(c, min_size=9)


def test_unique_labels_keep_every_member(spark):
    c = frame(spark, [(1, "a", "x"), (2, None, "y"), (3, "NA", None)], "cell long, l1 string, l2 string")
    got = {(r.cell, r.clone) for r in groups.unique_labels(c, ["l1", "l2"]).collect()}
    assert got == {(1, "l1_a"), (1, "l2_x"), (2, "l2_y"), (3, "NA")}


def test_annotation_keeps_nulls_and_refuses_two_values(spark):
    clones = frame(spark, [("a", "v"), ("b", None)], "clone string, t string")
    c = frame(spark, [(1, "a", "p", None), (2, "b", "q", None), (3, "z", "r", None), (4, "a", "s", None)], CELLS)
    assert {(r.cell, r.group_t) for r in groups.annotate_cells(c, clones, "t").collect()} == {(1, "v"), (2, None), (3, "NA"), (4, "v")}
    with pytest.raises(Exception, match="more than one value"):
        groups.annotate_clones(c, clones, "fate").collect()


def test_connect_with_a_callable(spark):
    c = frame(spark, [(i, "g", i) for i in range(4)], "clone long, g string, t long")
    got = {(r.src, r.dst) for r in groups.connect(c, "g", rule=lambda rows: [(0, 1), (2, 3)]).collect()}
    assert len(got) == 2
    with pytest.raises(ValueError):
        groups.connect(c, "g", "t", "sideways")


def test_means_count_zeros_and_layers_choose(spark):
    x = frame(spark, [(1, "g", 4.0)], "cell long, gene string, value double")
    labels = frame(spark, [(1, "a"), (2, "a")], "cell long, grp string")
    assert expression.transfer(x, labels).first().value == 2.0
    assert expression.transfer(x, labels, "sum").first().value == 4.0
    assert expression.choose_source("x", "raw", {"l": "layer"}, layer="l") == "layer"
    assert expression.choose_source("x", "raw") == "raw" and expression.choose_source("x", "raw", use_raw=False) == "x"
    assert expression.densify(x, labels).count() == 2
    with pytest.raises(ValueError):
        expression.transfer(x, labels, "median")


def test_transform_refuses_unknown_names(spark):
    with pytest.raises(ValueError):
        transform(F.lit(1.0), "cube")


@pytest.mark.parametrize("most", [0, 1 << 20])
@pytest.mark.parametrize("metric", knn.METRICS)
def test_knn_is_brute_force(spark, metric, most):
    x, p = points(spark)
    rows = knn.knn(p, p, 4, metric, block_rows=17, most_sent=most).collect()
    got = {(r.q, r.n) for r in rows}
    assert Counter(r.r for r in rows) == dict.fromkeys(range(4), len(x))
    want = set()
    for i in range(len(x)):
        d = {"euclidean": ((x - x[i]) ** 2).sum(1), "manhattan": np.abs(x - x[i]).sum(1), "cosine": 1 - x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])}[metric]
        want |= {(i, int(j)) for j in np.argsort(d, kind="stable")[:4]}
    assert got == want


def test_nearest_ranks_by_exact_distances_far_from_the_origin():
    rng = np.random.default_rng(11)
    x = 1e6 + rng.normal(size=(40, 5))
    y = np.concatenate([1e6 + rng.normal(size=(50, 5)), x[:5], x[:5]])
    i, j, d = knn.nearest(x, y, 7, "euclidean")
    full = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    want = np.argsort(full, axis=1, kind="stable")[:, :7]
    assert np.array_equal(j.reshape(40, 7), want) and np.array_equal(i, np.repeat(np.arange(40), 7)) and np.allclose(d, np.take_along_axis(full, want, 1).ravel())


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_knn_ties_few_rows_and_nulls(spark, most):
    p = frame(spark, [(3, [0.0]), (1, [0.0]), (2, [0.0]), (4, None)], "id long, x array<double>")
    assert {r.q: r.n for r in knn.knn(p, p, 1, most_sent=most).collect()} == {1: 1, 2: 1, 3: 1}
    assert knn.knn(p, p, 10, most_sent=most).count() == 9
    assert knn.knn(p.where("id = 9"), p, 2, most_sent=most).count() == 0 and knn.knn(p, p.where("id = 9"), 2, most_sent=most).count() == 0
    g = frame(spark, [(1, [0.0], "a"), (2, [0.1], "b"), (3, [0.2], "a"), (4, [0.3], None)], "id long, x array<double>, g string")
    assert {(r.q, r.n) for r in knn.knn(g, g, 2, by="g", most_sent=most).collect()} == {(1, 1), (1, 3), (3, 1), (3, 3), (2, 2)}


@pytest.mark.parametrize("far", [0.0, 1e6])
@pytest.mark.parametrize("metric", knn.METRICS)
def test_best_of_passing_blocks_is_brute_force(metric, far):
    rng = np.random.default_rng(5)
    x, y = far + rng.normal(size=(70, 6)), far + rng.normal(size=(300, 6))
    y[250:] = y[:50]  # equal distances: the lower id counts
    ids, best = rng.permutation(300), knn._Best(x, 9, metric, np.int64)
    for lo in range(0, 300, 4):
        best.add(ids[lo : lo + 4], np.zeros(4, np.int32), y[lo : lo + 4])
    order = np.argsort(ids)
    _, j, d = knn.nearest(x, y[order], 9, metric)
    assert np.array_equal(best.d.ravel(), d) if metric != "cosine" else np.allclose(best.d.ravel(), d)
    assert metric == "cosine" or np.array_equal(best.id.ravel(), j)


def test_masked_graph_seeks_neighbours_once(spark, monkeypatch):
    # Both results read stored pairs: rows that each reading would make anew are made once.
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    pairs = spark.createDataFrame([(1, "a", 2, "b"), (2, "b", 1, "a"), (3, "a", 1, "a")], "src_cell long, src string, dst_cell long, dst string")
    edges, apart = knn.group_graph(pairs.mapInPandas(run, pairs.schema), spark.createDataFrame([(1, "m")], "cell long, mask string"))
    assert {tuple(r) for r in edges.collect()} == {("b", "a", 1), ("a", "a", 1)} and [tuple(r) for r in apart.collect()] == [("a", "m", 1)]
    assert seen.value == 3


def test_larger_indexes_pass_no_driver(spark):
    # What is sent is bounded by a few MB an index, however many a query makes.
    assert knn.MOST_SENT <= 8 << 20


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8)) + rng.integers(0, 5, (3000, 1)) * 2
    p = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    some = p.where("id % 50 = 0")
    want = {(r.q, r.n) for r in knn.knn(some, p, 10).collect()}
    rows = knn.approximate_knn(some, p, 10, lists=40, probes=12, list_rows=50).collect()
    got = {(r.q, r.n) for r in rows}
    assert len(rows) == len(got) == 600 and len(want & got) >= 0.9 * len(want)
    assert {(r.q, r.n) for r in knn.approximate_knn(some, p, 10, lists=8, probes=8).collect()} == want
    assert knn.approximate_knn(some, p.limit(0), 10).count() == 0


def test_impute_edges(spark):
    c = frame(spark, [(1, [0.0], "a"), (2, [1.0], "b"), (3, [0.1], "NA")], "cell long, x array<double>, y string")
    filled, prob = knn.impute(c, "y", k=1)
    assert {(r.cell, r.value) for r in filled.collect()} == {(1, "a"), (2, "b"), (3, "a")} and prob.count() == 1
    filled, prob = knn.impute(c.where("cell < 3"), "y")
    assert filled.count() == 2 and prob.count() == 0
    with pytest.raises(ValueError):
        knn.impute(c.where("cell = 3"), "y")


def test_smoothing_keeps_constants_and_blend_has_limits(spark):
    edges = frame(spark, [("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    values = frame(spark, [(n, "v", 7.0) for n in "abc"], "node string, name string, value double")
    assert {r.value for r in graph.smooth(edges, values, 2).collect()} == {7.0}
    lineage = frame(spark, [("a", "b", 5.0)], "src string, dst string, weight double")
    assert {(r.src, r.weight) for r in graph.blend(lineage, edges, 0.5, 0.0).collect()} == {("a", 5.0), ("b", 0.0)}
    with pytest.raises(ValueError):
        graph.blend(lineage, edges, 2, 0.1)
    empty = graph.group_connectivity(edges.limit(0), frame(spark, [("a", "p"), ("b", "q")], "node string, grp string"))
    assert empty.count() == 4 and {r.connectivity for r in empty.collect()} == {0.0}
    assert graph.connectivity_matrix(empty).count() == 2


def test_mnn_alignment_moves_the_smaller_batch(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    rows = [(i, "big", x[i].tolist()) for i in range(40)] + [(100 + i, "small", (x[i] + 3.0).tolist()) for i in range(30)]
    p = frame(spark, rows, "id long, batch string, x array<double>")
    pairs = frame(spark, [(100 + i, i, 1.0) for i in range(30)] + [(i, 100 + i, 1.0) for i in range(30)], "src long, dst long, weight double")
    out = {r.id: r.x for r in integrate.align(p, pairs, [("big", "small", "(big+small)")]).collect()}
    assert np.allclose([out[100 + i] for i in range(30)], x[:30], atol=1e-8) and np.allclose(out[5], x[5])
    graph_edges, order = integrate.find_mnn(points(spark, 60, 3, 1, 3)[1])
    got = {(r.src, r.dst): r.weight for r in graph_edges.collect()}
    assert all(got[b, a] == w for (a, b), w in got.items()) and len(order) == 2


def test_order_codec_and_linkage():
    order = integrate.merge_order(["a", "b", "c"], np.array([[0, 5, 2], [5, 0, 3], [2, 3, 0.0]]))
    assert order[0] == ("a", "b", "(a+b)") and integrate.read_order(integrate.write_order(order)) == order
    d = np.abs(np.subtract.outer([0.0, 1.0, 10.0, 11.5], [0.0, 1.0, 10.0, 11.5]))
    assert [m[:2] for m in integrate.linkage(d, "average")] == [(0, 1), (2, 3), (4, 5)]
    assert integrate.leaf_order(integrate.linkage(d), 4) == [0, 1, 2, 3]


def long(spark, m, name):
    return frame(spark, [(i, f"c{j}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], f"obs long, {name} string, value double")


def test_weighted_correlation_is_the_formula(spark):
    rng = np.random.default_rng(42)
    x, y, w = rng.normal(size=(100, 5)), rng.normal(size=(100, 2)), 10 * rng.uniform(size=100) + 1
    weights = frame(spark, [(i, float(v)) for i, v in enumerate(w)], "obs long, weight double")
    for r in stats.correlate(long(spark, x, "gene"), long(spark, y, "response"), weights=weights).collect():
        a, b = x[:, int(r.gene[1:])], y[:, int(r.response[1:])]
        a, b = a - (w * a).sum() / w.sum(), b - (w * b).sum() / w.sum()
        assert r.r == pytest.approx((w * a * b).sum() / np.sqrt((w * a * a).sum() * (w * b * b).sum()), abs=1e-10)


def test_constant_columns_have_no_correlation(spark):
    x = long(spark, np.column_stack([np.full(10, 0.1), np.arange(10.0)]), "gene")
    y = long(spark, np.arange(10.0)[:, None] ** 2, "response")
    got = {r.gene: r for r in stats.associations({"l": x}, y).collect()}
    assert got["c0"].r is None and got["c0"].pvalue is None and got["c0"].p_adj is None
    assert 0 < got["c1"].pvalue < 1e-5 and got["c1"].p_adj == got["c1"].pvalue


@pytest.mark.parametrize("binomial", [False, True])
@pytest.mark.parametrize("p_method", ["lrt", "wald"])
def test_splines_summed_in_tasks_are_the_direct_fit(spark, binomial, p_method):
    rng = np.random.default_rng(8)
    n = 90
    x = {"a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float), "c": np.full(n, 2.0), "d": np.where(np.arange(n) < 4, 1.0, 0.0)}
    total = rng.integers(5, 60, n)
    share = 1 / (1 + np.exp(-(np.sin(x["a"]) + 0.3 * x["b"])))
    y = {"p": rng.binomial(total, share) / total, "q": rng.binomial(total, 0.3) / total} if binomial else {"p": 100 + np.sin(2 * x["a"]) + rng.normal(size=n) / 5, "q": rng.normal(size=n)}
    xs = frame(spark, [(i, g, float(v[i])) for g, v in x.items() for i in range(n)], "obs long, gene string, value double").repartition(5)
    ys = frame(spark, [(i, r, float(v[i])) for r, v in y.items() for i in range(n)], "obs long, response string, value double")
    totals = frame(spark, [(i, int(t)) for i, t in enumerate(total)], "obs long, total long") if binomial else None
    got = {(r.gene, r.response): r for r in stats.gam(xs, ys, totals, p_method=p_method).collect()}
    assert len(got) == 8
    for (g, r), row in got.items():
        want = spline_fit(x[g], y[r], total if binomial else None, p_method=p_method)
        for name, v in want.items():
            have = getattr(row, name)
            assert (have is None) if np.isnan(v) else have == pytest.approx(v, rel=2e-4, abs=1e-6), (g, r, name)


def test_layers_stack_or_stand_alone(spark):
    x = long(spark, np.random.default_rng(1).normal(size=(12, 2)), "gene")
    y = long(spark, np.random.default_rng(2).normal(size=(12, 1)), "response")
    holes = x.withColumn("value", F.when(F.col("obs") < 3, F.lit(float("nan"))).otherwise(F.col("value")))
    assert stats.associations({"a": x, "b": holes}, y).count() == 4
    assert stats.associations({"a": x, "b": holes}, y, concat_layers=True, adjust_by=None).count() == 2


def test_adjustment_methods(spark):
    p = frame(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id long, pvalue double")
    for method, want in {"fdr_bh": [0.03, 0.04, 0.04], "bonferroni": [0.03, 0.12, 0.09], "holm": [0.03, 0.06, 0.06]}.items():
        got = {r.id: r.p_adj for r in stats.adjust(p, method=method).collect()}
        assert [got[i] for i in (1, 2, 3)] == pytest.approx(want) and got[4] is None
    assert stats.adjust(p, method=None) is p


def test_graph_components_are_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(8, 3)), rng.uniform(size=(8, 8))
    w = w + w.T
    edges = frame(spark, [(i, j, float(w[i, j])) for i in range(8) for j in range(8)], "src long, dst long, weight double")
    values = long(spark, x, "gene").withColumnRenamed("obs", "node")
    _, scores, table = stats.graph_components(edges, values, 2)
    want = np.sort(np.linalg.eigvalsh(x.T @ w @ x))[::-1][:2]
    assert [r.eigenvalue for r in table.orderBy("pc").collect()] == pytest.approx(want.tolist()) and scores.count() == 16


def test_eigenvalue_test_sees_structure(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(size=(60, 4))
    signal = noise + 5 * rng.normal(size=(60, 1))
    run = lambda m, **k: stats.eigenvalue_test(frame(spark, [(r.tolist(),) for r in m], "x array<double>"), **k).first()
    assert run(signal, n_simulations=40).p_is_upper_bound and run(signal, flavor="asymptotic").p_value < 0.01
    assert run(noise, n_simulations=40).p_value > 0.02


def edges_of(spark, a):
    return frame(spark, [(f"r{i:02}", f"r{j:02}", int(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j]], "src string, dst string, weight long")


def test_embeddings_learn_and_project(spark):
    rng = np.random.default_rng(7)
    half = np.arange(12) < 6
    a = rng.poisson(np.where(half[:, None] == half[None, :], 20, 1))
    e = edges_of(spark, a)
    for fit, project in ((embed.fit_softmax, embed.project_softmax), (embed.fit_poisson, embed.project_poisson)):
        m = fit(e, 2)
        assert m.history[-1] < m.history[0]
        first = lambda u: np.linalg.norm(u[:6].mean(0) - u[6:].mean(0)) > 2 * np.linalg.norm(u[:6] - u[:6].mean(0), axis=1).mean()
        assert first(m.u)
        got = np.array([r.u for r in project(e, m).orderBy("clone").collect()])
        assert first(got) and got.shape == m.u.shape
    with pytest.raises(ValueError):
        embed.fit_softmax(e.withColumn("weight", F.lit(0.5)))
    masked = embed.add_mask_columns(e, frame(spark, [("r00", "mask", 3)], "src string, mask string, n long"))
    assert embed.fit_softmax(masked, 2, max_iter=3).v.shape == (13, 2)


def test_softmax_rows_are_solved_and_projected_alike(spark):
    a = np.random.default_rng(3).poisson(3.0, (20, 20)) + np.eye(20, dtype=int) * 5
    e = edges_of(spark, a)
    m = embed.fit_softmax(e, 3)
    assert all(y <= x + 1e-9 for x, y in zip(m.history, m.history[1:], strict=False))

    def loss(u):
        p = np.exp(u @ m.v.T + m.bias)
        p /= p.sum(axis=1, keepdims=True)
        return -(a * np.log(p)).sum(axis=1) + 5e-4 * a.sum(axis=1) * (u * u).sum(axis=1)

    got = np.array([r.u for r in embed.project_softmax(e, m).orderBy("clone").collect()])
    rng = np.random.default_rng(1)
    for _ in range(20):  # no step away makes any row likelier
        assert (loss(got + rng.normal(size=got.shape) * 0.05) > loss(got)).all()
    plain = -(a * np.log(a.sum(axis=0) / a.sum())).sum() / a.sum()
    assert m.history[-1] < plain
    start = rng.normal(size=(20, 3))
    assert embed.fit_softmax(e, 3, init=start, max_iter=2).u.shape == start.shape and embed.fit_softmax(e, 3, init="random", max_iter=2).v.shape == (20, 3)


def test_svd_start_is_the_singular_value_decomposition(spark):
    a = np.random.default_rng(2).poisson(2.0, (15, 15))
    counts, turned, rows, cols = embed.count_rows(edges_of(spark, a), both=True)
    assert counts.row_sums.tolist() == a.sum(axis=1).tolist() and turned.row_sums.tolist() == a.sum(axis=0).tolist() and len(rows) == len(cols) == 15
    u, v = embed.svd_start(counts, 3)
    p, s, q = np.linalg.svd(np.log1p(a))
    assert u @ v.T == pytest.approx(p[:, :3] * s[:3] @ q[:3], abs=1e-6)


def test_poisson_rows_are_at_their_optimum(spark):
    a = np.random.default_rng(4).poisson(4.0, (12, 12))
    m = embed.fit_poisson(edges_of(spark, a), 2, tol=1e-9)
    eta = m.row_bias[:, None] + m.bias[None, :] + m.u @ m.v.T
    assert np.abs((a - np.exp(eta)) @ m.v).max() < 0.1 and np.abs((a - np.exp(eta)).T @ m.u).max() < 0.1
    assert m.u.T @ m.u == pytest.approx(np.diag(np.diag(m.u.T @ m.u)), abs=1e-6)


def plain_linkage(distance, method):
    """Merges by looking through all pairs each time."""
    n = len(distance)
    d = {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    for new in range(n, 2 * n - 1):
        height, (i, j) = min((v, p) for p, v in d.items())
        size[new] = size[i] + size[j]
        for m in {k for p in d for k in p} - {i, j}:
            a, b, si, sj, sm = d[min(i, m), max(i, m)], d[min(j, m), max(j, m)], size[i], size[j], size[m]
            ward = np.sqrt(max(0.0, ((si + sm) * a * a + (sj + sm) * b * b - sm * height * height) / (si + sj + sm)))
            d[m, new] = float(ward if method == "ward" else (si * a + sj * b) / (si + sj))
        d = {p: v for p, v in d.items() if not {i, j} & set(p)}
        out.append((i, j, height, size[new]))
    return out


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_is_that_of_all_pairs(method):
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 17, 40):
        for x in (rng.normal(size=(n, 2)), rng.integers(0, 4, (n, 2)).astype(float), np.zeros((n, 2))):  # ties, too
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            assert integrate.linkage(d, method) == plain_linkage(d, method)
    x = rng.normal(size=(2000, 5))
    begun = time.time()
    assert integrate.linkage(np.sqrt(np.maximum(((x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * x @ x.T), 0)), method)[-1][3] == 2000
    assert time.time() - begun < 10
    with pytest.raises(ValueError):
        integrate.linkage(np.zeros((2, 2)), "single")


def test_sums_of_many_tasks_are_added_up_before_the_driver(spark, monkeypatch):
    a = np.random.default_rng(4).poisson(3.0, (60, 60))
    want = embed.fit_softmax(edges_of(spark, a), 3, max_iter=6)
    monkeypatch.setattr(embed, "_CELLS", 100)
    monkeypatch.setattr(embed, "_SENT", 7)
    counts = embed.count_rows(edges_of(spark, a))[0]
    assert counts.parts > 4
    sent = []
    collect = type(counts.frame).collect
    monkeypatch.setattr(type(counts.frame), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    sums = counts.sums(lambda i, x: [(0, x.sum(axis=0)), (1, np.ones(3))])
    assert sums[0].tolist() == a.sum(axis=0).tolist() and len(sent[-1]) == -(-60 // 7) + 1
    got = embed.fit_softmax(edges_of(spark, a), 3, max_iter=6)
    assert got.history == pytest.approx(want.history, rel=1e-9) and got.u == pytest.approx(want.u, abs=1e-6)


def test_tree_attributions_are_shapley_values():
    t = boost.Tree([1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0, 1, -1, -1, -1], [0.5, 0.5, 0, 0, 0], [0, 0, 10.0, 2.0, 6.0], [10, 6, 4, 2, 4])

    def value(at, row, known):
        if t.left[at] < 0:
            return t.value[at]
        f, (a, b) = t.feature[at], (t.left[at], t.right[at])
        if f in known:
            return value(a if row[f] <= t.threshold[at] else b, row, known)
        return (t.cover[a] * value(a, row, known) + t.cover[b] * value(b, row, known)) / t.cover[at]

    for row in ([0.2, 0.9, 0.0], [0.9, 0.1, 0.0], [0.1, 0.1, 5.0]):
        phi = np.zeros(3)
        phi += t.shap(np.array([row, row]))[1]
        want = np.zeros(3)
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            for n in range(3):
                for s in combinations(rest, n):
                    want[f] += factorial(n) * factorial(2 - n) / 6 * (value(0, row, {*s, f}) - value(0, row, {*s}))
        assert phi == pytest.approx(want)


def plain_boosting(kind, x, y, held, base, n_trees, depth, rate, l2):
    """The same trees by trying every value of every feature in every node, without codes or histograms."""
    score, trees = np.tile(base, (len(x), 1)), []
    for _ in range(n_trees):
        g, h, _, weight = booster.derivatives(kind, y, score)
        use = ~held & (weight > 0)
        worth = lambda rows: (g[rows].sum(axis=0) ** 2 / (h[rows].sum(axis=0) + l2)).sum()

        def node(rows, left):
            value = rate * g[rows & use].sum(axis=0) / (h[rows & use].sum(axis=0) + l2)
            best = None
            for f in range(x.shape[1] if left else 0):
                for t in np.unique(x[~held, f])[:-1]:
                    low, high = rows & use & (x[:, f] <= t), rows & use & (x[:, f] > t)
                    if low.any() and high.any():
                        gain = worth(low) + worth(high) - worth(rows & use)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, t
            if best is None:
                return np.where(rows[:, None], value, 0.0)
            low = x[:, best[1]] <= best[2]
            return node(rows & low, left - 1) + node(rows & ~low, left - 1)

        trees.append(node(np.ones(len(x), bool), depth))
        score = score + trees[-1]
    return score


def many_responses(n=120, seed=8):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return [(i, float(a), float(b), None if i % 17 == 0 else float(c), float(3 * a - b), float(b * b), None if i % 9 == 0 else float(a * c), float(a > 0), float(a <= 0 < b), float(a <= 0 and b <= 0), 0.0, i % 4 == 0) for i, (a, b, c) in enumerate(x)]


MANY = "clone long, a double, b double, c double, y0 double, y1 double, y2 double, c0 double, c1 double, c2 double, c3 double, val boolean"


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_boosting_of_many_responses_is_plain_boosting(spark, one_task):
    rows = many_responses()
    table = frame(spark, rows, MANY).repartition(3)
    x = np.array([[booster.MISSING if v is None else v for v in r[1:4]] for r in rows])
    held = np.array([r[11] for r in rows])
    for kind, names, at in ((booster.SQUARES, ["y0", "y1", "y2"], 4), (booster.CLASSES, ["c0", "c1", "c2"], 7)):
        y = np.array([[np.nan if v is None else v for v in r[at : at + 3]] for r in rows])
        mean = np.nanmean(y[~held], axis=0)
        base = mean if kind == booster.SQUARES else np.log(mean / mean.sum())
        fit = boost.fit_boosted if kind == booster.SQUARES else boost.fit_classes
        pred, shap, found = fit(table, ["a", "b", "c"], names, "val", n_trees=4, depth=3, patience=99, most_codes=256, one_task=one_task)
        want = plain_boosting(kind, x, y, held, base, 4, 3, 0.1, 1.0)
        got = {(r.clone, r.response): r.predicted for r in pred.collect()}
        out = want if kind == booster.SQUARES else booster.softmax(want)
        assert all(got[i, r] == pytest.approx(out[i, j], abs=1e-9) for i in range(len(rows)) for j, r in enumerate(names))
        # Attributions add up to the scores, row by row.
        sums = {(r.clone, r.response): r.s for r in shap.groupBy("clone", "response").agg(F.sum("shap").alias("s")).collect()}
        start = dict(zip(names, found.model.mean(), strict=True))
        assert all(sums[i, r] + start[r] == pytest.approx(want[i, j], abs=1e-9) for i in range(len(rows)) for j, r in enumerate(names))


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_boosting_stops_at_the_least_joint_loss(spark, one_task):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(a + 3 * e), float(f), i % 2 == 0) for i, (a, e, f) in enumerate(rng.normal(size=(60, 3)))]
    table = frame(spark, rows, "clone long, a double, y0 double, y1 double, val boolean")
    _, _, fit = boost.fit_boosted(table, ["a"], ["y0", "y1"], "val", n_trees=60, learning_rate=0.5, patience=3, one_task=one_task)
    held = fit.model.losses[:, 1]
    assert len(fit.model.first) == held.argmin() and len(held) <= held.argmin() + 4 and len(held) < 61
    none = boost.fit_boosted(table, ["a"], ["y0", "y1"], n_trees=13, one_task=one_task)[2]
    assert len(none.model.first) == 13 and np.isnan(none.model.losses[:, 1]).all() and (np.diff(none.model.losses[:, 0]) < 0).all()


def test_a_level_is_one_job_however_many_responses(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    jobs = []
    for n in (1, 6):
        rows = [(i, *map(float, v), *map(float, [v[0] * j - v[1] for j in range(1, n + 1)])) for i, v in enumerate(x)]
        table = frame(spark, rows, "clone long, a double, b double, " + ", ".join(f"y{j} double" for j in range(n)))
        spark.sparkContext.setJobGroup(f"responses {n}", "")
        boost.fit_boosted(table, ["a", "b"], [f"y{j}" for j in range(n)], n_trees=3, depth=2, one_task=0)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"responses {n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_models_of_trees_are_kept(spark, tmp_path):
    fit = boost.fit_boosted(frame(spark, many_responses(60), MANY), ["a", "b", "c"], ["y0", "y1"], n_trees=3)[2]
    save_model(spark, fit.model, f"{tmp_path}/m")
    back, x = load_model(spark, boost.Boosted, f"{tmp_path}/m"), np.random.default_rng(1).normal(size=(20, 3))
    assert (back.scores(x) == fit.model.scores(x)).all() and back.responses == ["y0", "y1"]


def test_boosting_of_odd_tables(spark):
    table = frame(spark, many_responses(60), MANY)
    pred, shap, fit = boost.fit_boosted(table, ["a", "b"], ["y0", "c3"], "val", n_trees=5, depth=2)
    assert fit.left_out == ["c3"] and pred.count() == 60 and shap.count() == 120
    top = boost.correct_shap(boost.shap_summary(shap), normalize=True).orderBy("feature").collect()
    assert top[0].corrected == pytest.approx(1.0) and top[1].corrected < 0
    assert boost.shap_norm(shap).count() == 120 and plotdata.performance(pred, True).first().r > 0.8
    with pytest.raises(ValueError):
        boost.fit_boosted(table, ["a"], ["y0"], min_size=1000)
    with pytest.raises(ValueError):
        boost.fit_classes(table, ["a", "b"], ["c3"])
    pred, _, fit = boost.fit_classes(table, ["a", "b"], ["c0", "c1", "c2", "c3"], n_trees=20, depth=2)
    got = {(r.clone, r.response): r.predicted for r in pred.collect()}
    assert len(got) == 240 and fit.left_out == ["c3"] and all(got[i, "c3"] == 0 for i in range(60))
    assert all(sum(got[i, f"c{c}"] for c in range(4)) == pytest.approx(1) for i in range(60))
    constant = boost.fit_boosted(table.withColumn("a", F.lit(1.0)), ["a"], ["y0"])[2]
    assert len(constant.model.first) == 0


def test_sums_before_within_keys_of_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.integers(0, 40)}", int(rng.integers(0, 5)), i, float(i % 7)) for i in range(3000)]
    table = frame(spark, rows, "k string, o int, i long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.i: r.v_before for r in ranged.sums_before(table, ["k"], ["o", "i"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums, want = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = sums.get(k, 0.0)
        sums[k] = want[i] + v
    assert got == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_ranks_and_quantiles_of_keys_of_any_size(spark, one_task):
    rng = np.random.default_rng(7)
    values = {"a": np.round(rng.normal(size=3000), 2), "b": np.zeros(500), "c": rng.normal(size=1), "d": rng.integers(0, 3, 700).astype(float), "e": rng.normal(size=2)}
    rows = [(k, i, float(v)) for k, own in values.items() for i, v in enumerate(own)]
    table = frame(spark, rows, "k string, i long, v double").repartition(4)
    ranks = {(r.k, r.i): r.rank for r in ranged.with_average_ranks(table, ["k"], "v", "rank", one_task=one_task, hot=100).collect()}
    assert len(ranks) == len(rows)
    for k, own in values.items():
        at = np.sort(own)
        want = (np.searchsorted(at, own, "left") + np.searchsorted(at, own, "right") + 1) / 2
        assert [ranks[k, i] for i in range(len(own))] == want.tolist()
    shares = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    got = {r.k: r.quantiles for r in ranged.quantiles(table, ["k"], "v", shares, one_task=one_task).collect()}
    assert set(got) == set(values) and all(got[k] == pytest.approx(np.quantile(own, shares), abs=1e-14) for k, own in values.items())


def test_knots_are_exact_however_many_observations(spark):
    n = 120_000
    x = spark.range(n).selectExpr("id as obs", "array('g', 'h') as g").select("obs", F.explode("g").alias("gene")).selectExpr("obs", "gene", "if(gene = 'g', cast(hash(obs) as double) / 1e6, cast(obs % 7 as double)) as value")
    y = spark.range(n).selectExpr("id as obs", "'all' as response", "cast(id as double) as value").unionByName(spark.range(50).selectExpr("id as obs", "'few' as response", "1d as value"))
    shares = [1 / 3, 2 / 3]
    got = {(r.gene, r.response): r.inner for r in stats.pair_quantiles(x, y, shares).collect()}
    held = x.toPandas()
    for gene, own in held.groupby("gene"):
        assert got[gene, "all"] == pytest.approx(np.quantile(own["value"], shares), rel=1e-14)
        assert got[gene, "few"] == pytest.approx(np.quantile(own[own["obs"] < 50]["value"], shares), rel=1e-14)


def encoded(spark, table, **options):
    rows = boost._rows(table, ["k"], "clone", F.col("val"), F.array("y0", "y1"), F.array(F.lit(1.0), F.lit(1.0)))
    return boost.encode_categories(rows, ["k"], {"k": "string"}, ["y0", "y1"], np.array([0.5, 2.0]), **options)


@pytest.mark.parametrize("most", [0, 1000])
def test_categories_get_ordered_statistics(spark, most):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 2 else f"k{i % 5}", float(i % 3), float(i % 7), i % 4 == 0) for i in range(200)] + [(200, "new", 1.0, 1.0, True)]
    out, names, found = encoded(spark, frame(spark, rows, "clone long, k string, y0 double, y1 double, val boolean"), most_broadcast=most)
    assert names == ["k~y0", "k~y1"] and found[0].feature == "k"
    got = out.select("_key", "_row", "_x", "_seen", F.xxhash64(F.lit(42), "_row").alias("h")).collect()
    assert len(got) == len(rows)
    order = {r._key: (r.h, r._row) for r in got}
    for r in got:
        i, k, *_ = rows[r._key]
        same = [x for x in rows if x[1] == k and not x[4]]
        before = [x for x in same if order[x[0]] < order[i]]
        for c, prior in ((2, 0.5), (3, 2.0)):
            mean = lambda of: (sum(x[c] for x in of) + prior) / (len(of) + 1.0)  # noqa: B023, E731
            assert r._x[c - 2] == pytest.approx(mean(same)) and r._seen[c - 2] == pytest.approx(mean(same if rows[i][4] else before))


def test_very_many_categories_and_a_hot_one(spark):
    rows = spark.range(300_000).selectExpr("id as clone", "if(id % 3 = 0, 'hot', concat('v', id div 2)) as k", "cast(id % 3 = 0 as double) as y0", "1d as y1", "false as val")
    out, _, found = encoded(spark, rows, most_broadcast=1000)
    assert found[0].table.count() > 100_000
    one = out.where("k = 'hot'").agg(F.count("*"), F.min(F.get("_x", F.lit(0))), F.min(F.get("_seen", F.lit(0))), F.max(F.get("_seen", F.lit(0)))).first()
    assert one[0] == 100_000 and one[1] == pytest.approx((100_000 + 0.5) / 100_001) and one[2] == 0.5 and one[3] == pytest.approx((99_999 + 0.5) / 100_000)


def test_classes_follow_their_feature(spark):
    rows = [(i, float(i % 10), "u" if i % 2 else "v", 1.0 if i % 10 < 5 else 0.0, 0.0 if i % 10 < 5 else 1.0) for i in range(60)]
    table = frame(spark, rows, "clone long, a double, k string, y0 double, y1 double")
    pred, shap, _ = boost.fit_classes(table, ["a", "k"], ["y0", "y1"], n_trees=30, depth=2)
    got = {(r.clone, r.response): r.predicted for r in pred.collect()}
    assert got[0, "y0"] > 0.8 and got[9, "y0"] < 0.2 and got[0, "y0"] + got[0, "y1"] == pytest.approx(1)
    top = {(r.response, r.feature): r.mean_shap for r in boost.shap_summary(shap).collect()}
    assert top["y0", "a"] > max(top["y0", "k~y0"], top["y0", "k~y1"])


def test_sketch_takes_the_number_asked_for(spark):
    p = points(spark, 60, 3)[1].withColumnRenamed("id", "cell")
    count = lambda n, **k: sketch.sketch(p, n, **k).where("gs = 'sketch'").count()
    assert count(0.2) == 12 and count(7) == 7 and count(0.5, by="batch") == 30 and count(1.0) == 60


def test_sketch_covers_the_space_in_a_constant_number_of_jobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 2)) * 0.05, rng.uniform(-10, 10, (60, 2))])  # a dense spot and a wide rest
    jobs = []
    for batches in (1, 5):
        rows = [(i, None if i % batches == 4 else f"b{i % batches}", v.tolist()) for i, v in enumerate(x)]
        p = frame(spark, rows, "cell long, batch string, x array<double>")
        spark.sparkContext.setJobGroup(f"sketch {batches}", "")
        got = sketch.sketch(p, 0.25, by="batch").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sketch {batches}")))
        taken = [r.cell for r in got if r.gs == "sketch"]
        size = Counter(b for _, b, _ in rows)
        assert len(got) == 460 and Counter(rows[i][1] for i in taken) == {b: round(0.25 * n) for b, n in size.items()}
        wide = sum(i >= 400 for i in taken)
        assert wide > 0.4 * len(taken)  # 13 % of the rows
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 2
    same = frame(spark, [(i, [1.0, 1.0]) for i in range(30)], "cell long, x array<double>")
    assert sketch.sketch(same, 7).where("gs = 'sketch'").count() == 7 and sketch.sketch(same.limit(0)).count() == 0


def test_null_gram_has_the_law_of_standardised_samples():
    rng = np.random.default_rng(5)

    def direct(n, dim):
        z = rng.normal(size=(n, dim))
        z = (z - z.mean(axis=0)) / z.std(axis=0)
        return z.T @ z

    for n, dim in ((30, 5), (4, 6)):
        top = [np.sort([np.linalg.eigvalsh(f(n, dim))[-1] for _ in range(4000)]) for f in (direct, lambda n, dim: stats.null_gram(n, dim, rng))]
        assert np.quantile(top[1], [0.1, 0.5, 0.9]) == pytest.approx(np.quantile(top[0], [0.1, 0.5, 0.9]), rel=0.02)
    assert np.diag(stats.null_gram(10**9, 5, rng)) == pytest.approx([1e9] * 5)  # a table of this size is not drawn


def test_stacked_layers_send_no_table_of_observations(spark):
    v = frame(spark, [(i, "g", None if i % 4 == 0 else float("nan") if i % 4 == 1 else 1.0) for i in range(40)] + [(2, "h", None)], "obs long, gene string, value double")
    obs = frame(spark, [(i,) for i in [*range(30), 5, 6, 77]], "obs long")
    mask = frame(spark, [(i, "l", i != 3) for i in range(40)], "obs long, layer string, has_cells boolean")
    got = expression.stack_layers({"l": v}, obs, mask)
    assert sorted(r.source_obs for r in got.collect()) == [i for i in range(30) if i % 4 in (2, 3) and i not in (2, 3)]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("binomial", [False, True])
def test_spline_rows_carry_no_knots(spark, monkeypatch, binomial):
    rng = np.random.default_rng(4)
    x = frame(spark, [(i, g, float(rng.normal())) for i in range(60) for g in ("g1", "g2")], "obs long, gene string, value double")
    y = frame(spark, [(i, "r", float(rng.integers(0, 5)) / 4) for i in range(60)], "obs long, response string, value double")
    totals = frame(spark, [(i, 4) for i in range(60)], "obs long, total long") if binomial else None
    seen, plain, got = [], stats._pair_sums, {}
    monkeypatch.setattr(stats, "_pair_sums", lambda rows, *a: seen.append(set(rows.columns)) or plain(rows, *a))
    for few in (20_000, 0):
        monkeypatch.setattr(stats, "_FEW_PAIRS", few)
        got[few] = sorted(tuple(r) for r in stats.gam(x, y, totals).collect())
        assert seen and all(({"t", "beta"} <= c) == (few == 0) for c in seen)
        seen.clear()
    assert len(got[0]) == 2
    for a, b in zip(got[0], got[20_000], strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_densities_make_no_row_a_point_and_cell(spark, monkeypatch):
    monkeypatch.setattr(plotdata, "_HELD", 100)  # grids are sent in parts
    rng = np.random.default_rng(2)
    xy, of = rng.normal(size=(90, 2)) @ [[1.0, 0.9], [0.0, 0.3]], rng.integers(0, 3, 90)
    coords = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [(90, None, 1.0)], "node long, x double, y double").repartition(3)
    got = plotdata.kde_grid(coords, frame(spark, [(i, f"g{g}") for i, g in enumerate(of)], "node long, grp string"), size=12)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    rows, lo, hi = got.collect(), xy.min(axis=0), np.maximum(xy.max(axis=0), [-np.inf, 1.0])
    assert len(rows) == 3 * 144 and min(r.gx for r in rows) == pytest.approx(lo[0] - 0.05 * (hi[0] - lo[0])) and max(r.gy for r in rows) == pytest.approx(hi[1] + 0.05 * (hi[1] - lo[1]))
    for r in rows:
        own = xy[of == int(r.grp[1])]
        cov = np.cov(own.T) * len(own) ** (-1 / 3)
        d = np.array([r.gx, r.gy]) - own
        want = np.exp(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1)).mean() / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
        assert r.density == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_figure_tables(spark):
    h = frame(spark, [(0, 3.0), (1, 2.0)], "epoch int, loss double")
    assert [r.change for r in plotdata.loss_changes(h).orderBy("epoch").collect()] == [None, -1.0]
    v = frame(spark, [("r1", "a", 0.0), ("r1", "b", 0.1), ("r1", "c", 9.0)], "row string, name string, value double")
    assert plotdata.heatmap_order(v) in (["a", "b", "c"], ["c", "a", "b"])
    coords = frame(spark, [(i, float(i), float(i * i)) for i in range(6)], "node long, x double, y double")
    grp = frame(spark, [(i, f"g{i}") for i in range(6)], "node long, grp string")
    with pytest.raises(ValueError):
        plotdata.group_scatter(coords, grp, most=3)
    assert plotdata.group_scatter(coords, grp).count() == 6
    assert plotdata.kde_grid(coords, grp).count() == 0
    e = frame(spark, [("a", [1.0, 2.0, 3.0])], "clone string, u array<double>")
    assert plotdata.embedding_table(e, frame(spark, [("a", "red")], "clone string, colour string")).first().colour == "red"


def test_canonical_directions_are_singular_vectors():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(20, 5))
    left, right = anchors._canonical(a.T @ a, b.T @ b, 3)
    u, s, vt = np.linalg.svd(a @ b.T)
    assert np.allclose(np.abs((a @ left).T @ u[:, :3]), np.eye(3), atol=1e-8)
    assert np.allclose(np.abs((b @ right).T @ vt[:3].T), np.eye(3), atol=1e-8)


def test_neighbours_and_anchors_are_not_broadcast_by_joins(spark, monkeypatch):
    # Their tables look small to Spark, so joins sent all neighbours through the driver: 738 MB in memory over 10,256 cells.
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng(14)
    p = frame(spark, [(i, "ab"[i % 2], rng.normal(size=4).tolist()) for i in range(80)], "id long, batch string, x array<double>")
    near = knn.knn(p, p, 3)
    assert "BroadcastHashJoin" not in plan(near.join(p.select(F.col("id").alias("n")), "n"))
    plans, stored = {}, anchors.stored
    monkeypatch.setattr(anchors, "stored", lambda df, name: plans.setdefault(name, plan(df)) and stored(df, name))
    anchors.integrate(p, anchors.find_anchors(p, n_comps=3, k_score=10, k_filter=30), k_weight=10, n_comps=3)
    for name in ("pairs", "anchors", "shifts", "integrated"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name


@pytest.mark.parametrize("method", ["cca", "rpca"])
def test_anchors_bring_shifted_batches_together(spark, method):
    rng = np.random.default_rng(10)
    centre = 6 * rng.normal(size=(3, 6))
    x = np.concatenate([centre[i % 3] + rng.normal(size=(1, 6)) * 0.3 for i in range(90)])
    shift = np.where(np.arange(90) < 50, 0.0, 4.0)[:, None]
    p = frame(spark, [(i, "a" if i < 50 else "b", (x[i] + shift[i]).tolist()) for i in range(90)], "id long, batch string, x array<double>")
    found = anchors.find_anchors(p, method, n_comps=3, k_score=10, k_filter=30)
    got = found.collect()
    assert len(got) > 20 and np.mean([r.a % 3 == r.b % 3 for r in got]) > 0.95 and all(0 <= r.weight <= 1 for r in got)
    out = {r.id: np.array(r.x) for r in anchors.integrate(p, found, k_weight=10, n_comps=3).collect()}
    gap = lambda m: np.mean([np.linalg.norm(np.mean([m[i] for i in range(50) if i % 3 == c], axis=0) - np.mean([m[i] for i in range(50, 90) if i % 3 == c], axis=0)) for c in range(3)])
    assert gap(out) < 0.2 * gap({i: x[i] + shift[i] for i in range(90)})
    with pytest.raises(ValueError):
        anchors.find_anchors(p, "other")
