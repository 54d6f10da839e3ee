"""Association statistics over long tables: correlation, splines, spatial autocorrelation, eigenvalue test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from kinspark.functions import tails
from kinspark.functions.splines import design, solve, wald_statistic
from kinspark.operators.products import summed_product
from kinspark.operators.ranged import quantiles, with_average_ranks
from kinspark.sources.store import stored


@pandas_udf(DoubleType())
def t_pvalue(r: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation; null where r is, or where no degree of freedom is left."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.abs(r) * np.sqrt(df / np.maximum(0.0, 1 - r * r))
        p = np.where(df > 0, 2 * tails.t_sf(t.fillna(0.0).to_numpy(), np.maximum(df.to_numpy(), 1e-9)), np.nan)
    return pd.Series(p).where(r.notna().to_numpy() & (df > 0).to_numpy())


@pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series(tails.normal_sf(z.to_numpy(dtype=float))).where(z.notna().to_numpy())


def _centred(long: DataFrame, name: str, weights: DataFrame | None, method: str) -> DataFrame:
    """(obs, name, w, c) with c the centred value, or the centred rank.

    Means are summed map-side and joined back, one row a column, so no column's rows meet in one task.
    """
    if method == "spearman":
        long = long.select("obs", name, "value")
        long = stored(with_average_ranks(long, [name], "value", "rank").select("obs", name, F.col("rank").alias("value")), "ranked")
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    rows = long.withColumn("w", F.lit(1.0)) if weights is None else long.join(weights.select("obs", F.col("weight").cast("double").alias("w")), "obs")
    means = rows.groupBy(name).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("m"))
    return rows.join(means, name).select("obs", name, "w", (F.col("value") - F.col("m")).alias("c"))


def _finish(sums: DataFrame, keys: list[str]) -> DataFrame:
    # A sum of squares that is nothing but rounding is none.
    flat = (F.col("sx") <= 1e-24) | (F.col("sy") <= 1e-24)
    r = F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("sxy", F.sqrt("sx") * F.sqrt("sy")))))
    out = sums.withColumn("r", r).withColumn("slope", F.col("r") * F.try_divide(F.sqrt("sy"), F.sqrt("sx")))
    n_eff = F.col("w") * F.col("w") / F.col("w2")
    return out.select(*keys, "r", "slope", t_pvalue("r", n_eff - 2).alias("pvalue"))


def _products():
    of = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
    return of("cx", "cy").alias("sxy"), of("cx", "cx").alias("sx"), of("cy", "cy").alias("sy"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2")


def correlate(x: DataFrame, y: DataFrame, method: str = "pearson", weights: DataFrame | None = None) -> DataFrame:
    """(gene, response, r, slope, pvalue) for all pairs of columns of x (obs, gene, value) and y (obs, response, value).

    Both need a row for each observation, zeros too.  ``weights`` (obs, weight) weigh means and sums of squares, the
    p-value has Kish's effective number of observations.  r is null for a constant column.
    """
    a, b = _centred(x, "gene", weights, method), _centred(y, "response", weights, method)
    both = a.select("obs", "gene", "w", F.col("c").alias("cx")).join(b.select("obs", "response", F.col("c").alias("cy")), "obs")
    return _finish(both.groupBy("gene", "response").agg(*_products()), ["gene", "response"])


def correlate_columns(x: DataFrame, y: DataFrame, method: str = "pearson", weights: DataFrame | None = None) -> DataFrame:
    """(gene, r, slope, pvalue): each column of x with the column of y of the same name."""
    a, b = _centred(x, "gene", weights, method), _centred(y, "gene", weights, method)
    both = a.select("obs", "gene", "w", F.col("c").alias("cx")).join(b.select("obs", "gene", F.col("c").alias("cy")), ["obs", "gene"])
    return _finish(both.groupBy("gene").agg(*_products()), ["gene"])


def adjust(df: DataFrame, p: str = "pvalue", method: str | None = "fdr_bh", out: str = "p_adj") -> DataFrame:
    """Adjusted p-values over all rows; null p-values are no part of the family and stay null.

    Distinct p-values with their counts are dealt by ranges.  Ranks and running extremes are taken within each
    range and carried over by one row per range, so no task orders them all.
    """
    if method is None:
        return df
    if method not in ("fdr_bh", "bonferroni", "holm"):
        raise ValueError(f"unknown method {method!r}")
    df = stored(df, "tests")  # p-values computed anew could differ in their last bit and miss the join
    counts = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranged = stored(counts.repartitionByRange("_p").withColumn("_b", F.spark_partition_id()), "pvalues")
    m = float(ranged.agg(F.sum("_n")).first()[0] or 0)
    if method == "bonferroni":
        table = ranged.withColumn("_q", F.col("_p") * F.lit(m))
    else:
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranged.groupBy("_b").agg(F.sum("_n").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
        up = Window.partitionBy("_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        ranks = ranged.join(F.broadcast(starts), "_b").withColumn("_r", F.col("_o") + F.sum("_n").over(up))
        if method == "fdr_bh":
            # The least value at this p-value or a larger one.
            one, pick, inner, outer = F.col("_p") * F.lit(m) / F.col("_r"), F.min, Window.partitionBy("_b").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        else:
            # The largest value at this p-value or a smaller one.
            one, pick, inner, outer = F.col("_p") * (F.lit(m) - F.col("_r") + F.col("_n")), F.max, up, before
        ranks = ranks.withColumn("_s", one)
        ends = ranks.groupBy("_b").agg(pick("_s").alias("_e")).select("_b", pick("_e").over(outer).alias("_e"))
        join_up = F.least if method == "fdr_bh" else F.greatest
        table = ranks.join(F.broadcast(ends), "_b").withColumn("_q", join_up(pick("_s").over(inner), F.col("_e")))
    return df.join(table.select("_p", F.least(F.lit(1.0), F.col("_q")).alias(out)), F.col(p) == F.col("_p"), "left").drop("_p")


_PAIR = ["gene", "response"]


#: Pairs whose knots and coefficients are sent to the tasks as one table, and not with every row.
_FEW_PAIRS = 20_000


def _pair_table(pairs: DataFrame):
    """A broadcast table (gene, response) -> (knots, coefficients or None)."""
    held = {(r.gene, r.response): (np.asarray(r.t), None if r.beta is None else np.asarray(r.beta)) for r in pairs.select(*_PAIR, "t", "beta").collect()}
    return pairs.sparkSession.sparkContext.broadcast(held)


def _pair_sums(rows: DataFrame, df: int, degree: int, binomial: bool, sent=None) -> DataFrame:
    """(gene, response, sums, low, high) of each task's rows (gene, response, x, y, total, t, beta): what one round of least squares needs.

    With ``sent``, a table of :func:`_pair_table`, rows need no t and beta.

    sums: the weighted products of the design with itself and with the working response, the weighted square of that, and the
    log-likelihood at ``beta``; low and high: of the fit at ``beta``.  Binomial rows are reweighted at ``beta``, or start from
    their smoothed share without one.
    """
    k = df + 1

    def run(frames):
        held: dict[tuple, list] = {}
        for f in frames:
            if not len(f):
                continue
            code, keys = pd.factorize(pd.MultiIndex.from_arrays([f["gene"], f["response"]]))
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(keys)))
            x, y, of = f["x"].to_numpy(dtype=float)[order], f["y"].to_numpy(dtype=float)[order], code[order]
            once = order[starts]  # knots and coefficients are the pair's: one row of each is read
            knots, betas = zip(*(sent.value[key] for key in keys), strict=True) if sent is not None else (f["t"].iloc[once], f["beta"].iloc[once])
            d = design(x, np.array([np.asarray(t) for t in knots])[of], degree)
            known = next(iter(betas)) is not None
            eta = (d * np.array([np.asarray(b) for b in betas])[of]).sum(axis=1) if known else np.zeros(len(x))
            w, z, like, fit = np.ones(len(x)), y, np.zeros(len(x)), eta
            if binomial:
                total = f["total"].to_numpy(dtype=float)[order]
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700))) if known else (total * y + 0.5) / (total + 1.0)
                fit = mu = np.clip(mu, 1e-12, 1 - 1e-12)
                spread = np.maximum(mu * (1 - mu), 1e-12)
                like = total * (y * np.log(mu) + (1 - y) * np.log(1 - mu))
                w, z = total * spread, np.log(mu / (1 - mu)) + (y - mu) / spread
            both = np.column_stack([(d[:, :, None] * d[:, None, :] * w[:, None, None]).reshape(len(x), -1), d * (w * z)[:, None], w * z * z, like])
            sums = np.add.reduceat(both, starts, axis=0)
            low, high = np.minimum.reduceat(fit, starts), np.maximum.reduceat(fit, starts)
            for key, *own in zip(keys, sums, low, high, strict=True):
                if (old := held.get(key)) is None:
                    held[key] = own
                else:
                    old[0], old[1], old[2] = old[0] + own[0], min(old[1], own[1]), max(old[2], own[2])
            if len(held) > 50_000:
                yield pd.DataFrame([(*key, v[0].tolist(), v[1], v[2]) for key, v in held.items()], columns=[*_PAIR, "sums", "low", "high"])
                held = {}
        yield pd.DataFrame([(*key, v[0].tolist(), v[1], v[2]) for key, v in held.items()], columns=[*_PAIR, "sums", "low", "high"])

    parts = rows.select(*_PAIR, "x", "y", *(["total"] if binomial else []), *(["t", "beta"] if sent is None else [])).mapInPandas(run, "gene string, response string, sums array<double>, low double, high double")
    wide = k * k + k + 2
    summed = parts.groupBy(*_PAIR).agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(wide)], F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.select(*_PAIR, F.array(*[f"s{i}" for i in range(wide)]).alias("sums"), "low", "high")


def pair_quantiles(x: DataFrame, y: DataFrame, shares: list[float]) -> DataFrame:
    """(gene, response, inner): exact quantiles of each x column (obs, gene, value) over the observations of each y column (obs, response, value).

    Responses of the same observations share their quantiles: these are told by count, sum and exclusive or of hashes of their observations, and x
    is ranked once for each such set of observations.
    """
    mark = F.xxhash64("obs")
    sets = y.groupBy("response").agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("s"), F.bit_xor(mark).alias("o"))
    sets = stored(sets.withColumn("first", F.min("response").over(Window.partitionBy("n", "s", "o"))).select("response", "first"), "sets")
    obs = y.join(F.broadcast(sets.where("response = first").select("response", "first")), "response").select("obs", "first")
    own = x.select("obs", "gene", F.col("value").alias("x")).join(obs, "obs")
    inner = quantiles(own.where("x is not null"), ["gene", "first"], "x", shares, "inner")
    return inner.join(F.broadcast(sets), "first").select("gene", "response", "inner")


def gam(x: DataFrame, y: DataFrame, totals: DataFrame | None = None, df: int = 5, degree: int = 3, p_method: str = "lrt", max_rounds: int = 25) -> DataFrame:
    """(gene, response, r2, amplitude, slope, pvalue) of a spline of each x column in a model of each y column.

    Knots are exact quantiles of each pair's observations, however many they are.  A round of least squares is one pass in which tasks sum the products of
    their rows' splines, some fifty numbers a pair; the small systems are solved on a row a pair.  Gaussian models take one round,
    binomial ones (``totals``) reweight until the likelihood settles.  No pair's observations meet in one task.
    """
    both = x.select("obs", "gene", F.col("value").alias("x")).join(y.select("obs", "response", F.col("value").alias("y")), "obs")
    both = both.withColumn("total", F.lit(1.0)) if totals is None else both.join(totals.select("obs", F.col("total").cast("double").alias("total")), "obs")
    binomial, k = totals is not None, df + 1
    shares = [float(q) for q in np.linspace(0, 1, df - degree + 2)[1:-1]]
    edge = F.sum(F.col("total") * F.col("y")).alias("wy")
    pairs = both.groupBy(*_PAIR).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("mean"), F.sum("total").alias("w"), edge)
    ends = lambda c: F.array_repeat(c, degree + 1)
    pairs = pairs.join(pair_quantiles(x, y, shares), _PAIR)
    pairs = stored(pairs.withColumn("t", F.concat(ends("x0"), "inner", ends("x1"))), "pairs")
    good = pairs.where((F.col("n") >= df + 2) & (F.abs(F.col("x1") - F.col("x0")) > 1e-8 + 1e-5 * F.abs("x0")))
    n_good = good.count()
    near = F.broadcast if n_good <= 500_000 else (lambda d: d)
    fields = "gene string, response string, beta array<double>, rank int, like double"

    def solved(frames):
        for f in frames:
            out = []
            for gene, response, sums in zip(f["gene"], f["response"], f["sums"], strict=True):
                sums = np.asarray(sums)
                beta, rank = solve(sums[: k * k].reshape(k, k), sums[k * k : k * k + k])
                out.append((gene, response, beta.tolist(), rank, sums[-1]))
            yield pd.DataFrame(out, columns=["gene", "response", "beta", "rank", "like"])

    def summed(betas):
        of = good.select(*_PAIR, "t", "mean")
        of = of.withColumn("beta", F.lit(None).cast("array<double>")) if betas is None else of.join(betas.select(*_PAIR, "beta"), _PAIR)
        sent = _pair_table(of) if n_good <= _FEW_PAIRS else None
        own = both.join(near(of if sent is None else of.select(*_PAIR, "mean")), _PAIR)
        own = own if binomial else own.withColumn("y", F.col("y") - F.col("mean"))  # off the mean, so squares lose nothing
        return stored(_pair_sums(own, df, degree, binomial, sent), "sums")

    sums = summed(None)
    betas, last = stored(sums.mapInPandas(solved, fields), "betas"), None
    for _ in range(max_rounds if binomial else 1):
        sums = summed(betas)
        if not binomial:
            break
        like = sums.agg(F.sum(F.get("sums", F.lit(k * k + k + 1)))).first()[0]
        if like is None or last is not None and abs(like - last) < 1e-10 * (abs(like) + 1e-10):
            break
        last, betas = like, stored(sums.mapInPandas(solved, fields), "betas")
    first = good.select(*_PAIR, "n", "x0", "x1", "t", "w", "wy")
    done = first.join(betas, _PAIR).join(sums, _PAIR)

    def finish(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                s, beta = np.asarray(r.sums), np.asarray(r.beta)
                gram, right = s[: k * k].reshape(k, k), s[k * k : k * k + k]
                ends = design(np.array([r.x1, r.x0]), np.asarray(r.t), degree) @ beta
                if binomial:
                    base = min(max(r.wy / r.w, 1e-12), 1 - 1e-12)
                    lrt, size = 2 * (s[-1] - r.w * (r.wy / r.w * math.log(base) + (1 - r.wy / r.w) * math.log(1 - base))), r.w
                    wald, ends = wald_statistic(gram, beta), 1 / (1 + np.exp(-np.clip(ends, -700, 700)))
                else:
                    tss, rss = s[-2], s[-2] - right @ beta
                    if tss <= 0 or rss <= 1e-14 * tss:
                        out.append((r.gene, r.response, None, None, None, None))
                        continue
                    lrt, size, wald = r.n * math.log(tss / rss), r.n, (tss - rss) / (rss / (r.n - r.rank - 1))
                stat = lrt if p_method == "lrt" else wald
                out.append((r.gene, r.response, 1 - math.exp(-lrt / size), r.high - r.low, float(ends[0] - ends[1]), float(tails.chi2_sf(stat, r.rank))))
            yield pd.DataFrame(out, columns=[*_PAIR, "r2", "amplitude", "slope", "pvalue"])

    fitted = done.mapInPandas(finish, "gene string, response string, r2 double, amplitude double, slope double, pvalue double")
    return pairs.select(*_PAIR).join(fitted, _PAIR, "left")


def associations(sources: dict[str, DataFrame], response: DataFrame, method: str = "pearson", adjust_by: str | None = "fdr_bh", binomial: bool = False, mask: DataFrame | None = None, concat_layers: bool = False) -> DataFrame:
    """Associations of every layer with the responses, adjusted as one family.

    ``sources``: layer -> (obs, gene, value); rows of an observation with a null or NaN value are left out;
    ``mask`` (obs, layer, has_cells) leaves out more.  ``binomial``: responses are counts; proportions are weighted by, and
    splines get, the row totals.  ``concat_layers`` stacks the layers' rows instead of testing each.
    """
    weights = totals = None
    if binomial:
        totals = response.groupBy("obs").agg(F.sum("value").cast("double").alias("total")).withColumn("total", F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
        response = response.join(totals, "obs").select("obs", "response", (F.col("value") / F.col("total")).alias("value"))
        weights = totals.withColumnRenamed("total", "weight")
    out = None
    if concat_layers:
        parts = None
        for name in sorted(sources):
            own = _good(sources[name], name, mask).withColumn("obs", F.concat(F.lit(f"{name}:"), F.col("obs").cast("string")))
            parts = own if parts is None else parts.unionByName(own)

        def spread(df):
            whole = None
            for name in sorted(sources):
                own = df.withColumn("obs", F.concat(F.lit(f"{name}:"), F.col("obs").cast("string")))
                whole = own if whole is None else whole.unionByName(own)
            return whole

        response = spread(response).join(parts.select("obs").distinct(), "obs", "left_semi")
        weights, totals = (spread(weights), spread(totals)) if binomial else (None, None)
        sources, mask = {"all": parts}, None
    for name in sorted(sources):
        x = _good(sources[name], name, mask)
        y = response.join(x.select("obs").distinct(), "obs", "left_semi")
        one = gam(x, y, totals) if method == "gam" else correlate(x, y, method, weights)
        one = one.withColumn("layer", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return adjust(out, "pvalue", adjust_by) if adjust_by else out


def _good(x: DataFrame, layer: str, mask: DataFrame | None) -> DataFrame:
    bad = x.where(F.col("value").isNull() | F.isnan("value")).select("obs").distinct()
    out = x.join(bad, "obs", "left_anti")
    return out if mask is None else out.join(mask.where((F.col("layer") == layer) & F.col("has_cells")).select("obs"), "obs", "left_semi")


def morans_i(edges: DataFrame, x: DataFrame, n_obs: int | None = None, center: bool = False) -> DataFrame:
    """(gene, morans_i, expected, variance, z, pvalue) of x (node, gene, value) on a weighted graph.

    Values are not centred by default: columns are expected to be scaled.  One-sided normal p-value.
    """
    edges, x = stored(edges, "edges"), stored(x, "values")
    n = n_obs if n_obs is not None else x.select("node").distinct().count()
    if center:
        x = x.join(x.groupBy("gene").agg(F.avg("value").alias("m")), "gene").select("node", "gene", (F.col("value") - F.col("m")).alias("value"))
    w = edges.agg(F.sum("weight").cast("double")).first()[0] or 0.0
    both = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").cast("double").alias("w")))
    s1 = 0.5 * (both.groupBy("src", "dst").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0)
    s2 = both.groupBy("src").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
    a, b = x.select(F.col("node").alias("src"), "gene", F.col("value").alias("u")), x.select(F.col("node").alias("dst"), "gene", F.col("value").alias("v"))
    cross = edges.join(a, "src").join(b, ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("weight") * F.col("u") * F.col("v")).alias("s"))
    square = x.groupBy("gene").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    e = -1.0 / (n - 1) if n > 1 else math.nan
    variance = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - e * e if n > 3 and w else None
    out = square.join(cross, "gene", "left").select("gene", (F.lit(n / w if w else None).cast("double") * F.try_divide(F.coalesce("s", F.lit(0.0)), "q")).alias("morans_i"))
    out = out.withColumn("expected", F.lit(e)).withColumn("variance", F.lit(variance).cast("double"))
    out = out.withColumn("z", F.try_divide(F.col("morans_i") - F.col("expected"), F.sqrt("variance")))
    return out.withColumn("pvalue", normal_tail("z"))


def graph_components(edges: DataFrame, x: DataFrame, n_pcs: int = 50, most_genes: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph principal components: eigenvectors of X' W X, largest eigenvalues first.

    Returns loadings (gene, pc, value), scores (node, pc, value) and (pc, eigenvalue, varexpl).  The product is summed in
    Spark; its genes x genes matrix (at most ``most_genes``) is solved on the driver.
    """
    genes = [r[0] for r in x.select("gene").distinct().orderBy("gene").limit(most_genes + 1).collect()]
    if len(genes) > most_genes:
        raise ValueError(f"more than {most_genes} genes")
    # W X first: one row per node and gene, so edges are joined once and not once for each pair of genes.
    spark = x.sparkSession
    at = {g: i for i, g in enumerate(genes)}
    places = spark.createDataFrame(list(at.items()), "gene string, at int")
    b = x.select(F.col("node").alias("dst"), "gene", "value")
    wx = edges.join(b, "dst").groupBy(F.col("src").alias("node"), "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))

    def packed(rows, name):
        own = rows.join(F.broadcast(places), "gene").groupBy("node")
        return own.agg(F.collect_list("at").alias(f"{name}_at"), F.collect_list(F.col("value").cast("double")).alias(name))

    s = summed_product(packed(x, "x").join(packed(wx, "wx"), "node"), "x", "wx", len(genes), len(genes), "x_at", "wx_at")
    value, vector = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-value)[: min(n_pcs, len(genes))]
    value, vector = value[order], vector[:, order]
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])] < 0, -1.0, 1.0)
    total = x.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    loadings = spark.createDataFrame([(g, j, float(vector[i, j])) for g, i in at.items() for j in range(vector.shape[1])], "gene string, pc int, value double")
    scores = x.join(F.broadcast(loadings.withColumnRenamed("value", "l")), "gene").groupBy("node", "pc").agg(F.sum(F.col("value") * F.col("l")).alias("value"))
    table = spark.createDataFrame([(j, float(v), float(v / total)) for j, v in enumerate(value)], "pc int, eigenvalue double, varexpl double")
    return loadings, scores, table


def _statistic(singular: np.ndarray, n: int, p: int) -> float:
    value = singular**2
    dof = n - 1
    mu = (math.sqrt(dof) + math.sqrt(p)) ** 2
    scale = (math.sqrt(dof) + math.sqrt(p)) * (1 / math.sqrt(dof) + 1 / math.sqrt(p)) ** (1 / 3)
    return float((value[0] / (value[1:].mean() / dof) - mu) / scale)


def null_gram(n: int, dim: int, rng: np.random.Generator) -> np.ndarray:
    """Gram matrix of n x dim standardised normal values, drawn without them where n exceeds dim.

    Centred rows have a Wishart matrix of n - 1 degrees of freedom, whose root is drawn by Bartlett's decomposition.
    """
    if n <= dim:
        z = rng.normal(size=(n, dim))
        root = (z - z.mean(axis=0)).T
    else:
        root = np.tril(rng.normal(size=(dim, dim)), -1)
        root[np.diag_indices(dim)] = np.sqrt(rng.chisquare(n - 1 - np.arange(dim)))
    g = root @ root.T
    sd = np.sqrt(np.diag(g) / n)
    return g / sd / sd[:, None]


def eigenvalue_test(points: DataFrame, flavor: str = "synthetic", n_simulations: int = 10_000, seed: int = 42, null: np.ndarray | None = None) -> DataFrame:
    """(statistic, p_value, p_is_upper_bound): is the largest eigenvalue of standardised points (x) more than noise?

    The Gram matrix is summed in Spark.  ``asymptotic`` uses the Tracy-Widom law, ``synthetic`` Gram matrices of
    normal samples of the same shape, drawn in Spark tasks with a seed of their own each.  If no sample reaches the statistic the p-value is
    the bound 1 / n_simulations.
    """
    spark = points.sparkSession
    dim = points.select(F.size("x")).first()[0]
    stats = points.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("*").alias("n")).collect()
    mean, sd, n = np.zeros(dim), np.ones(dim), stats[0]["n"]
    for r in stats:
        mean[r.i], sd[r.i] = r.m, r.s

    unit = F.zip_with(F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m), F.array(*[F.lit(float(v)) for v in sd]), lambda v, d: v / d)
    total = summed_product(points.select(unit.alias("z")), "z", "z", dim, dim)
    stat = _statistic(np.sqrt(np.maximum(np.linalg.eigvalsh(total)[::-1], 0)), n, dim)
    bound = False
    if flavor == "asymptotic":
        p = 1.0 - tails.tracy_widom_cdf(stat)
    elif flavor == "synthetic":
        if null is not None:
            p, count = float((np.asarray(null) >= stat).mean()), len(null)
        else:

            def simulate(frames):
                for f in frames:
                    hits = 0
                    for i in f["id"]:
                        g = null_gram(n, dim, np.random.default_rng([seed, int(i)]))
                        hits += _statistic(np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0)), n, dim) >= stat
                    yield pd.DataFrame({"hits": [int(hits)]})

            count = n_simulations
            p = (spark.range(count).mapInPandas(simulate, "hits long").agg(F.sum("hits")).first()[0] or 0) / count
        if p == 0:
            p, bound = 1.0 / count, True
    else:
        raise ValueError(f"unknown flavor {flavor!r}")
    return spark.createDataFrame([(stat, float(p), bound)], "statistic double, p_value double, p_is_upper_bound boolean")
