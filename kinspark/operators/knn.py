"""Exact and approximate k nearest neighbours, and the group graph that they make.

An index of a checked size is sent to every task as one matrix, and queries never move.  A larger one is cut into blocks of some
thousands of rows that pass by all parts of the queries: a task holds one part with its best k rows so far, and meets one block
at a time.  No side has to fit in memory.  Ties go to the lower id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.operators.groups import NA, labelled
from kinspark.sources.store import stored

METRICS = ("euclidean", "cosine", "manhattan")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a to all rows of b, from differences, a few rows at a time."""
    if metric == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        return 1.0 - a @ b.T
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        diff = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.abs(diff).sum(axis=2) if metric == "manhattan" else np.sqrt((diff * diff).sum(axis=2))
    return out


def nearest(x: np.ndarray, y: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y for each row of x, ties to the lower row of y.

    For Euclidean distances a matrix product gives all squares up to rounding; what can be among the k
    nearest within that rounding is computed again from differences and ranked by it.
    """
    k = min(k, len(y))
    if metric != "euclidean":
        d = _distances(x, y, metric)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.repeat(np.arange(len(x)), k), best.ravel(), np.take_along_axis(d, best, axis=1).ravel()
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    square = nx[:, None] + ny[None, :] - 2.0 * (x @ y.T)
    edge = np.partition(square, k - 1, axis=1)[:, k - 1] + 1e-12 * (nx + ny.max()) * x.shape[1] + 1e-300
    rows, cols = np.nonzero(square <= edge[:, None])
    exact = np.empty(len(rows))
    for at in range(0, len(rows), 50_000):
        diff = x[rows[at : at + 50_000]] - y[cols[at : at + 50_000]]
        exact[at : at + 50_000] = np.sqrt((diff * diff).sum(axis=1))
    order = np.lexsort((cols, exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.searchsorted(rows, np.arange(len(x)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], exact[keep]


#: Bytes of an index that is sent to every task as a whole; it passes through the driver, and some queries send a score of them.
MOST_SENT = 2 << 20
#: Cells of a matrix of distances in a task.
_CELLS = 4_000_000


def _matrix(xs) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in xs])


def _nearest(x: np.ndarray, y: np.ndarray, k: int, metric: str):
    """:func:`nearest`, some rows of x at a time."""
    step = max(1, _CELLS // max(1, len(y)))
    parts = [nearest(x[at : at + step], y, k, metric) for at in range(0, len(x), step)]
    return np.concatenate([i + n * step for n, (i, _, _) in enumerate(parts)]), np.concatenate([j for _, j, _ in parts]), np.concatenate([d for _, _, d in parts])


def _sent_knn(queries: DataFrame, index: DataFrame, k: int, metric: str, by: str | None) -> DataFrame:
    """Neighbours in an index that is sent to every task: queries stay where they are, and each is done at one go."""
    q_kind, n_kind = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    keys, cols = ([by] if by else []), ["id", "x", "label"] + ([by] if by else [])

    def pack(frames):
        for f in frames:
            for key, part in f.groupby(keys[0], sort=False) if keys else [(None, f)]:
                yield pd.DataFrame({"key": [None if key is None else str(key)], "ids": [part["id"].tolist()], "labels": [part["label"].tolist()], "x": [_matrix(part["x"]).tobytes()]})

    parts: dict[str | None, list] = {}
    for r in index.where("x is not null").select(*cols).mapInPandas(pack, f"key string, ids array<{n_kind}>, labels array<string>, x binary").collect():
        parts.setdefault(r.key, []).append((np.array(r.ids, dtype=object), np.array(r.labels, dtype=object), np.frombuffer(r.x).reshape(len(r.ids), -1)))
    held = {}
    for key, some in parts.items():
        ids, labels, x = (np.concatenate(v) for v in zip(*some, strict=True))
        order = np.argsort(ids, kind="stable")
        held[key] = ids[order], labels[order], x[order]
    sent = queries.sparkSession.sparkContext.broadcast(held)

    def run(frames):
        for f in frames:
            for key, part in f.groupby(keys[0], sort=False) if keys else [(None, f)]:
                ids, labels, y = sent.value.get(None if key is None else str(key), (None, None, None))
                step = max(1, 100_000 // k)
                for lo in range(0, len(part) if ids is not None else 0, step):
                    own = part.iloc[lo : lo + step]
                    i, j, d = _nearest(_matrix(own["x"]), y, k, metric)
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    yield pd.DataFrame({"q": own["id"].to_numpy(dtype=object)[i], "n": ids[j], "d": d, "r": rank, "q_label": own["label"].to_numpy(dtype=object)[i], "n_label": labels[j]})

    return queries.where("x is not null").select(*cols).mapInPandas(run, f"q {q_kind}, n {n_kind}, d double, r int, q_label string, n_label string")


class _Best:
    """The k nearest rows of each row of x among blocks of rows that come one after the other: (d, id, label code), ties to the lower id.

    A matrix product says which rows of a block can be among the k best so far: for Euclidean distances in single precision, with
    room for its rounding.  Only these are computed from differences and ranked.
    """

    def __init__(self, x: np.ndarray, k: int, metric: str, kind):
        self.x, self.k, self.metric = x, k, metric
        self.d, self.label, self.id = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int32), np.zeros((len(x), k), kind)
        self.filled = np.zeros(len(x), np.int64)
        # Seen from their middle, rows far from the origin are told apart in single precision too.
        self.middle = x.mean(axis=0)
        self.off = x - self.middle
        self.norm = (self.off * self.off).sum(axis=1)

    def _squares(self, at: slice, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of some rows to all of y (off the middle), and by how much each row's may be off."""
        x, nx = self.off[at], self.norm[at]
        most = max(float(nx.max()), float(ny.max()))
        kind = np.float32 if most < 1e30 else np.float64
        a, b = np.column_stack([x, nx, np.ones(len(x))]).astype(kind), np.column_stack([-2.0 * y, np.ones(len(y)), ny]).astype(kind)
        moved = 4 * np.finfo(np.float64).eps * (np.linalg.norm(self.middle) + math.sqrt(most))
        return a @ b.T, 4 * float(np.finfo(kind).eps) * (y.shape[1] + 4) * (nx + ny.max()) + 4 * moved * (math.sqrt(most) + moved) + 1e-36

    def add(self, ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> None:
        if not len(y):
            return
        off_y = y - self.middle
        ny, some = (off_y * off_y).sum(axis=1), min(self.k, len(y))
        step = max(1, _CELLS // len(y))
        for lo in range(0, len(self.x), step):
            at = slice(lo, min(lo + step, len(self.x)))
            if self.metric == "euclidean":
                near, off = self._squares(at, off_y, ny)
                worst = self.d[at, -1] ** 2 * (1 + 1e-12) + off
            else:
                near, off = _distances(self.x[at], y, self.metric), 0.0
                worst = self.d[at, -1].copy()
            part = np.flatnonzero(self.filled[at] < self.k)
            if len(part):  # until k are known, the k best of the block
                worst[part] = np.minimum(worst[part], np.partition(near[part], some - 1, axis=1)[:, some - 1].astype(np.float64) + 2 * (off[part] if self.metric == "euclidean" else 0.0))
            worst = worst.astype(near.dtype) if near.dtype == np.float64 else np.nextafter(worst.astype(np.float32), np.float32(np.inf))
            cells = np.flatnonzero((near <= worst[:, None]).ravel())
            rows, cols = cells // len(y), cells % len(y)
            if self.metric == "euclidean":
                exact = np.empty(len(rows))
                for i in range(0, len(rows), 50_000):
                    diff = self.x[lo + rows[i : i + 50_000]] - y[cols[i : i + 50_000]]
                    exact[i : i + 50_000] = np.sqrt((diff * diff).sum(axis=1))
            else:
                exact = near.ravel()[cells]
            good = exact <= self.d[lo + rows, -1]
            self._merge(lo + rows[good], exact[good], ids[cols[good]], labels[cols[good]])

    def _merge(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        if not len(rows):
            return
        met = np.unique(rows)
        held = np.arange(self.k) < self.filled[met, None]
        rows = np.r_[np.repeat(met, self.k)[held.ravel()], rows]
        d, ids, labels = np.r_[self.d[met][held], d], np.r_[self.id[met][held], ids], np.r_[self.label[met][held], labels]
        rank = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((rank, d, rows))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        order, place = order[place < self.k], place[place < self.k]
        at = rows[order], place
        self.d[at], self.id[at], self.label[at] = d[order], ids[order], labels[order]
        self.filled[met] = np.minimum(self.k, np.bincount(np.searchsorted(met, rows), minlength=len(met)))


def _packed(rows: DataFrame, kind: int, by: str | None, parts: int) -> DataFrame:
    """(kind, key, part, ids, labels, x): rows of one key together, all vectors of them as bytes; queries are dealt into parts, an index goes to each.

    Rows are packed where they lie, so what is shuffled are few long rows.
    """
    own = rows.where("x is not null").select(F.lit("").alias("key") if by is None else F.col(by).cast("string").alias("key"), "id", "label", F.col("x").cast("array<double>").alias("x"))
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int") if kind == 0 else F.lit(0))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch]).sort_by([("key", "ascending"), ("part", "ascending")]).combine_chunks().to_batches()[0]
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            key, part = pc.rank(batch.column("key"), tiebreaker="min").to_numpy(), batch.column("part").to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
            new[np.arange(len(new)) % 2048 == 0] = True
            at = np.r_[np.flatnonzero(new), batch.num_rows].astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(at), batch.column(c)) for c in ("id", "label")]
            first = pa.array(at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(first), batch.column("part").take(first), *columns, pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["key", "part", "ids", "labels", "x"])

    out = own.mapInArrow(run, f"key string, part int, ids array<{dict(rows.dtypes)['id']}>, labels array<string>, x binary")
    if kind == 1:
        out = out.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return out.select(F.lit(kind).alias("kind"), "key", "part", "ids", "labels", "x")


def _block_knn(queries: DataFrame, index: DataFrame, k: int, metric: str, by: str | None, block_rows: int) -> DataFrame:
    """Neighbours of parts of the queries: a task holds a part and its k best rows, and the index passes by in blocks."""
    n = queries.count()
    # Parts of four blocks, or of one where there would be fewer than keep all cores busy.
    parts = max(1, math.ceil(n / (4 * block_rows)), min(math.ceil(n / block_rows), 3 * queries.sparkSession.sparkContext.defaultParallelism))
    q_kind, n_kind = dict(queries.dtypes)["id"], dict(index.dtypes)["id"]
    both = _packed(queries, 0, by, parts).withColumnRenamed("ids", "q_ids").withColumn("n_ids", F.lit(None).cast(f"array<{n_kind}>"))
    both = both.unionByName(_packed(index, 1, by, parts).withColumnRenamed("ids", "n_ids").withColumn("q_ids", F.lit(None).cast(f"array<{q_kind}>")))
    both = both.repartition(4 * parts, "key", "part").sortWithinPartitions("key", "part", "kind")

    def run(batches):
        of, own, best, names = None, [], None, {}

        def done():
            if best is None:
                return
            ids, labels = (pa.concat_arrays([o[i] for o in own]) for i in (0, 1))
            known = pa.array(list(names), pa.string())
            for lo in range(0, len(ids), step := max(1, 50_000 // k)):
                rows, place = np.nonzero(np.arange(k) < best.filled[lo : lo + step, None])
                at, rows = (lo + rows, place), pa.array(lo + rows)
                columns = {"q": ids.take(rows), "n": pa.array(best.id[at], from_pandas=False).cast(n_type), "d": pa.array(best.d[at]), "r": pa.array(place.astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns | {"q_label": labels.take(rows), "n_label": known.take(pa.array(best.label[at]))})

        for batch in batches:
            for i in range(batch.num_rows):
                kind, key, part = (batch.column(c)[i].as_py() for c in ("kind", "key", "part"))
                if (key, part) != of:
                    yield from done()
                    of, own, best, names = (key, part), [], None, {}
                ids, labels = batch.column("n_ids" if kind else "q_ids")[i].values, batch.column("labels")[i].values
                x = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(len(ids), -1)
                if kind == 0:  # copies, as a view would keep its whole batch
                    every = pa.array(np.arange(len(ids)))
                    own.append((ids.take(every), labels.take(every), x.copy()))
                elif own:
                    n_type, whole = ids.type, pa.types.is_integer(ids.type)
                    if best is None:
                        best, own = _Best(np.concatenate([o[2] for o in own]), k, metric, np.int64 if whole else object), [o[:2] for o in own]
                    kinds = labels.dictionary_encode()
                    codes = np.array([names.setdefault(v, len(names)) for v in [*kinds.dictionary.to_pylist(), None]], np.int32)
                    best.add(ids.to_numpy(zero_copy_only=False).astype(np.int64) if whole else np.array(ids.to_pylist(), dtype=object), codes[pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False)], x)
            batch = ids = labels = x = kinds = None  # else the next batch is read beside this one
        yield from done()

    return both.mapInArrow(run, f"q {q_kind}, n {n_kind}, d double, r int, q_label string, n_label string")


def knn(queries: DataFrame, index: DataFrame, k: int = 15, metric: str = "euclidean", by: str | None = None, block_rows: int = 4096, most_sent: int = MOST_SENT, label: str | None = None) -> DataFrame:
    """(q, n, d, r) : for each row of ``queries`` (id, x) its k nearest rows of ``index``, r from 0.

    With ``label``, a string column of both sides, also (q_label, n_label), so that no join has to find it afterwards.

    With ``by`` only rows with the same non-null value of that column are compared.  Fewer than k rows are all
    neighbours.  Rows without a vector take no part.  An index of up to ``most_sent`` bytes (counted first) is sent to
    the tasks, a larger one is met block by block; both give the same rows.

    The result has k rows a query where Spark expects one, so it asks to be joined by a shuffle: else it would pass the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if by:
        queries, index = queries.where(F.col(by).isNotNull()), index.where(F.col(by).isNotNull())
    queries, index = (df.withColumn("label", F.col(label) if label else F.lit(None).cast("string")) for df in (queries, index))
    size = index.agg(F.coalesce(F.sum(F.greatest(F.size("x"), F.lit(0)) + 4), F.lit(0))).first()[0] * 8
    out = _sent_knn(queries, index, k, metric, by) if size <= most_sent else _block_knn(queries, index, k, metric, by, block_rows)
    return (out if label else out.drop("q_label", "n_label")).hint("merge")


def approximate_knn(queries: DataFrame, index: DataFrame, k: int = 15, metric: str = "euclidean", lists: int = 256, probes: int = 32, sample_rows: int = 20_000, list_rows: int = 8192) -> DataFrame:
    """(q, n, d, r) as :func:`knn`, but each query only meets the rows of the ``probes`` of ``lists`` lists nearest to it.

    Centres of the lists are means of at most ``sample_rows`` rows with the least hashes; every row of the index is in the list of its
    nearest centre, and a list of more than ``list_rows`` rows is cut into parts, so no list is gathered whole.  Distances
    are exact; some neighbours may be missed, fewer with more probes.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    index, queries = index.where("x is not null"), queries.where("x is not null")
    n = index.count()
    share = int(min(1.0, sample_rows / max(1, n)) * (1 << 31))
    some = index.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < share).select("id", "x").collect()
    if not some:
        return knn(queries, index, k, metric)
    sample = _matrix(r.x for r in sorted(some, key=lambda r: str(r.id)))
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(8):
        at = _nearest(sample, centres, 1, metric)[1]
        for c in np.unique(at):
            centres[c] = sample[at == c].mean(axis=0)
    sent = index.sparkSession.sparkContext.broadcast(centres)

    def listed(count):
        def run(frames):
            for f in frames:
                if len(f):
                    i, j, _ = _nearest(_matrix(f["x"]), sent.value, count, metric)
                    yield pd.DataFrame({"id": f["id"].to_numpy()[i], "x": f["x"].to_numpy()[i], "list": j})

        return run

    fields = lambda df: f"id {dict(df.dtypes)['id']}, x array<double>, list int"
    parts = max(1, math.ceil(n / max(1, len(centres)) / list_rows) * 2)
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    b = index.select("id", "x").mapInPandas(listed(1), fields(index)).groupBy("list", part.alias("part")).agg(F.collect_list("id").alias("n_id"), F.flatten(F.collect_list("x")).alias("n_x"))
    a = queries.select("id", "x").mapInPandas(listed(probes), fields(queries)).groupBy("list", part.alias("q_part")).agg(F.collect_list("id").alias("q_id"), F.flatten(F.collect_list("x")).alias("q_x"))

    def run(frames):
        for frame in frames:
            for q_id, q_x, n_id, n_x in zip(frame["q_id"], frame["q_x"], frame["n_id"], frame["n_x"], strict=True):
                order = np.argsort(np.array(n_id, dtype=object), kind="stable")
                y = np.asarray(n_x, dtype=float).reshape(len(n_id), -1)[order]
                i, j, d = _nearest(np.asarray(q_x, dtype=float).reshape(len(q_id), -1), y, k, metric)
                yield pd.DataFrame({"q": np.array(q_id, dtype=object)[i], "n": np.array(n_id, dtype=object)[order][j], "d": d})

    found = a.join(b, "list").select("q_id", "q_x", "n_id", "n_x").mapInPandas(run, f"q {dict(queries.dtypes)['id']}, n {dict(index.dtypes)['id']}, d double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "n")))
    return ranked.where(F.col("r") <= k).withColumn("r", F.col("r") - 1)


def neighbour_pairs(cells: DataFrame, clones: DataFrame, k: int = 15, split: str | None = None, ref: DataFrame | None = None, ref_clones: DataFrame | None = None, metric: str = "euclidean", na: str = NA) -> DataFrame:
    """(src_cell, src, dst_cell, dst): neighbour edges between labelled cells, each with its group.

    ``cells``: cell, clone, x and the split column.  Own mode: labelled cells of ``clones`` among themselves, each its
    own neighbour.  Reference mode: neighbours are sought among all of ``ref`` and those outside ``ref_clones``
    are dropped afterwards.
    """
    if split and ref is not None:
        raise ValueError("split and reference exclude each other")
    own = labelled(cells, "clone", na).join(clones.select("clone"), "clone", "left_semi")
    cols = [F.col("cell").alias("id"), "x", "clone"] + ([F.col(split)] if split else [])
    other = own
    if ref is not None:  # neighbours are any rows of ref, and only those of its groups have a label
        known = labelled(ref, "clone", na).select("cell", "x", "clone").join(ref_clones.select("clone", F.lit(True).alias("known")).distinct(), "clone", "left")
        rest = ref.where(F.col("clone").isNull() | (F.col("clone") == na)).select("cell", "x", F.lit(None).cast("string").alias("clone"))
        other = known.select("cell", "x", F.when(F.col("known"), F.col("clone")).alias("clone")).unionByName(rest)
    found = knn(own.select(*cols), other.select(*cols), k, metric, by=split, label="clone")
    return found.where("n_label is not null").select(F.col("q").alias("src_cell"), F.col("q_label").alias("src"), F.col("n").alias("dst_cell"), F.col("n_label").alias("dst"))


def group_graph(pairs: DataFrame, masked: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, weight) counts of edges between groups; with ``masked`` (cell, mask) edges from masked cells are
    left out and counted apart as (src, mask, n)."""
    apart = None
    if masked is not None:
        pairs = stored(pairs, "pairs")  # both results read them; neighbours are sought once
        m = masked.select(F.col("cell").alias("src_cell"), "mask")
        apart = pairs.join(m, "src_cell").groupBy("src", "mask").agg(F.count("*").alias("n"))
        pairs = pairs.join(m.select("src_cell").distinct(), "src_cell", "left_anti")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight")), apart


def impute(cells: DataFrame, column: str, missing: str = NA, weights: str | None = None, k: int = 10, sigma: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill the cells (cell, x, column) that hold ``missing`` or null from their nearest cells that do not.

    Numbers get the weighted mean, strings the class of most weight (the first in order of equal ones).  Returns
    (cell, value) for every cell and (cell, cls, prob) for imputed strings, empty if there is nothing to fill.
    ``weights``: None, ``linear`` (1 / d) or ``gaussian`` with the median of positive distances as sigma.
    """
    if weights not in (None, "linear", "gaussian"):
        raise ValueError(f"unknown weights {weights!r}")
    numeric = dict(cells.dtypes)[column] not in ("string",)
    gone = F.col(column).isNull() | (F.col(column).cast("string") == missing)
    if numeric:
        gone = gone | F.isnan(F.col(column).cast("double"))
    target, donor = cells.where(gone), cells.where(~gone)
    kept = donor.select("cell", (F.col(column).cast("double") if numeric else F.col(column)).alias("value"))
    none = kept.limit(0).select("cell", F.lit("").alias("cls"), F.lit(0.0).alias("prob"))
    if target.isEmpty():
        return kept, none
    if donor.isEmpty():
        raise ValueError("no cells to impute from")
    near = knn(target.select(F.col("cell").alias("id"), "x"), donor.select(F.col("cell").alias("id"), "x"), k)
    if weights == "gaussian" and sigma is None:
        near = stored(near, "near")  # the median reads them first
    if weights is None:
        w = F.lit(1.0)
    elif weights == "linear":
        w = 1.0 / (F.col("d") + 1e-12)
    else:
        s = sigma if sigma is not None else near.where("d > 0").agg(F.median("d")).first()[0] or 1.0
        w = F.exp(-F.pow("d", F.lit(2.0)) / (2.0 * s * s))
    near = near.withColumn("w", w).withColumn("w", F.coalesce(F.try_divide("w", F.sum("w").over(Window.partitionBy("q"))), F.lit(0.0)))
    voted = near.join(donor.select(F.col("cell").alias("n"), F.col(column).alias("y")), "n")
    if numeric:
        return kept.unionByName(voted.groupBy(F.col("q").alias("cell")).agg(F.sum(F.col("w") * F.col("y").cast("double")).alias("value"))), none
    prob = voted.groupBy(F.col("q").alias("cell"), F.col("y").alias("cls")).agg(F.sum("w").alias("prob"))
    best = prob.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy(F.round("prob", 12).desc(), "cls"))).where("r = 1")
    return kept.unionByName(best.select("cell", F.col("cls").alias("value"))), prob
