"""Quality classifier taught by weak labels.

Heuristic labellers vote good, bad or nothing on each document.  Expectation-maximisation over the counts of
vote patterns of all documents estimates how often each labeller is right on good and on bad documents and so
the probability that a document with given votes is good.  These posteriors are the labels of a linear scorer
over hashed byte trigrams, which sees texts and no heuristics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SLICE_ROWS, columns_of, forget, stored, text_slices, to_batch

GOOD, NONE, BAD = 1, 0, -1


#: What each labeller looks at, the most that it calls good and the least that it calls bad.
LABELLERS = (
    ("symbols a word", 0.05, 0.2),
    ("bars a word", 0.02, 0.1),
    ("share of words without a letter or digit", 0.05, 0.12),
    ("share of capital words", 0.2, 0.5),
    ("exclamation marks a word", 0.1, 0.5),
    ("share of repeated lines", 0.35, 0.6),
    ("share of words equal to the one before", 0.1, 0.3),
    ("share of repeated words", 0.7, 0.85),
    ("share of other characters than letters and digits", 0.3, 0.42),
    ("distance of the mean word length from 6", 4, 8),
)
#: Texts of fewer words get no votes.
LEAST_WORDS = 10
_NO_LETTER = bytes(i for i in range(256) if i > 127 or not chr(i).isalnum())


def measures(text: str, words: list[str]) -> tuple[float, ...]:
    """The values that the labellers look at, in their order."""
    n = len(words)
    letters = len(text.encode().translate(None, _NO_LETTER)) if text.isascii() else sum(map(str.isalnum, text))
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        sum(map(text.count, "#*$%&|<>{}=~^")) / n,
        text.count("|") / n,
        sum(len(w) < 4 and not any(map(str.isalnum, w)) for w in words) / n,
        sum(map(str.isupper, words)) / n,
        text.count("!") / n,
        1 - len(set(lines)) / len(lines),
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - letters / len(text),
        abs(len(text) / n - 7),
    )


def votes(text: str | None) -> tuple[int, ...]:
    """The votes of all labellers on a text."""
    words = text.split() if text else []
    if len(words) < LEAST_WORDS:
        return (NONE,) * len(LABELLERS)
    return tuple(GOOD if x <= good else BAD if x >= bad else NONE for x, (_, good, bad) in zip(measures(text, words), LABELLERS, strict=True))


@dataclass
class LabelModel:
    """Share of good documents; for each labeller how often a vote is right on good and on bad ones."""

    good: float
    right_good: np.ndarray
    right_bad: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        up, down = v == GOOD, v == BAD
        a = np.log(self.good) + (up * np.log(self.right_good) + down * np.log(1 - self.right_good)).sum(axis=1)
        b = np.log(1 - self.good) + (up * np.log(1 - self.right_bad) + down * np.log(self.right_bad)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(b - a, -60, 60)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, quiet: float = 0.99, weight: float = 0.01, rounds: int = 500) -> LabelModel:
    """EM from patterns of votes and how many documents have each.

    Labellers are taken as independent within a class, and every accuracy is estimated.  They are alarms, so EM starts from
    alarms that are seldom false (right on the share ``quiet`` of good documents) and quiet on most bad documents too; that
    belief also stands as a prior that weighs as much as the share ``weight`` of all documents, so it is alike at every size.
    """
    m, prior = patterns.shape[1], weight * counts.sum() + 1
    model = LabelModel(0.9, np.full(m, quiet), np.full(m, 0.3))
    up, down = patterns == GOOD, patterns == BAD
    for _ in range(rounds):
        p = model.posterior(patterns)
        g, b = (counts * p)[:, None], (counts * (1 - p))[:, None]
        new = LabelModel(
            float(np.clip((g.sum() + 9) / (counts.sum() + 10), 1e-6, 1 - 1e-6)),
            np.clip(((g * up).sum(axis=0) + prior * quiet) / ((g * (up | down)).sum(axis=0) + prior), 1e-6, 1 - 1e-6),
            np.clip(((b * down).sum(axis=0) + 0.3) / ((b * (up | down)).sum(axis=0) + 1), 1e-6, 1 - 1e-6),
        )
        step = max(abs(new.good - model.good), np.abs(new.right_good - model.right_good).max(), np.abs(new.right_bad - model.right_bad).max())
        model = new
        if step < 1e-9:
            break
    return model


def features(text: str | None, bits: int) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and of word pairs that are one word twice.

    The pairs have a place behind the trigrams' places.  All is zero for a text under three bytes.
    """
    out = np.zeros((1 << bits) + 1, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) >= 3:
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        h = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
        out[:-1] = np.bincount(h, minlength=1 << bits) / len(h)
        words = data.split()
        out[-1] = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    return np.sqrt(out)


def _fit_scorer(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities y by accelerated gradient steps; (weights, intercept)."""
    y = y.astype(np.float32)  # all in one type: a product of mixed types would copy x each time
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    pw, pb = w.copy(), b
    step = np.float32(1.3)  # rows have a squared norm of at most 2, so the curvature is at most (2 + 1) / 4
    for t in range(rounds):
        k = np.float32(t / (t + 3))
        lw, lb = w + k * (w - pw), b + k * (b - pb)
        g = 1 / (1 + np.exp(-np.clip(x @ lw + lb, -60, 60))) - y
        pw, pb = w, b
        w, b = lw - step * (g @ x / np.float32(len(x)) + np.float32(l2) * lw), lb - step * g.mean()
    return w, float(b)


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    intercept: float
    bits: int

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.bits) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -60, 60)))


def _voted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, votes): votes as one number in base 3; key orders documents at random but always alike."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("votes", pa.int32())])
    powers = [3**j for j in range(len(LABELLERS))]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, rows=SLICE_ROWS):
                v = [sum((x + 1) * p for x, p in zip(votes(t), powers, strict=True)) for t in part.column(2).to_pylist()]
                yield to_batch(schema, id=part.column(0), key=part.column(1), votes=v)

    src = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(id_col, text_col), F.lit(0)).alias("key"), text_col)
    return src.mapInArrow(run, "id long, key long, votes int")


def _unpack(codes: np.ndarray) -> np.ndarray:
    return np.array([[c // 3**j % 3 - 1 for j in range(len(LABELLERS))] for c in codes.tolist()]).reshape(-1, len(LABELLERS))


def fit_quality_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 3000, bits: int = 12) -> QualityModel:
    """Label model from the votes on all documents; scorer from at most ``sample_docs`` of them.

    The sample is balanced: at most half from patterns whose posterior says bad, as far as there are any, and half from the
    others.  Each side takes the hashes of id and text below its share, so no task orders or gathers a side; rows that repeat both, null
    ids or not, count once.  A null or empty text votes nothing.  An empty table gives a model that scores all alike.  The driver gets
    the counts of patterns (at most 3 to the number of labellers) and the sample's features.
    """
    voted = stored(_voted(docs, id_col, text_col), "votes")
    table = voted.groupBy("votes").count().orderBy("votes").collect()
    if not table:
        return QualityModel(LabelModel(0.5, np.full(len(LABELLERS), 0.9), np.full(len(LABELLERS), 0.9)), np.zeros((1 << bits) + 1, np.float32), 0.0, bits)
    codes, counts = np.array([r[0] for r in table]), np.array([r[1] for r in table], dtype=float)
    labels = fit_label_model(_unpack(codes), counts)
    posterior = dict(zip(codes.tolist(), labels.posterior(_unpack(codes)).tolist(), strict=True))
    bad = [c for c, p in posterior.items() if p < 0.5]
    half, isbad = sample_docs // 2, F.col("votes").isin(bad)
    n_bad = float(sum(n for c, n in zip(codes.tolist(), counts.tolist(), strict=True) if posterior[c] < 0.5))
    # A little more than half, so that chance hardly falls below it; the driver leaves the rest.
    share = [min(1.0, (1.2 * half + 50) / max(1.0, n)) * (1 << 31) for n in (n_bad, counts.sum() - n_bad)]
    below = F.pmod("key", F.lit(1 << 31)) < F.when(isbad, F.lit(share[0])).otherwise(F.lit(share[1]))
    picked = voted.where(below).select(F.col("key").alias("_key"), "votes").dropDuplicates(["_key"])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, rows=SLICE_ROWS):
                x = [features(t, bits).astype(np.float16).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["key", "votes", "x"])

    keyed = columns_of(docs, id_col, text_col).select(F.coalesce(F.xxhash64(id_col, text_col), F.lit(0)).alias("key"), text_col)
    rows = keyed.join(F.broadcast(picked), F.col("key") == F.col("_key")).dropDuplicates(["key"]).select("key", "votes", text_col)
    found = sorted(rows.mapInArrow(run, "key long, votes int, x binary").collect(), key=lambda r: (r.key % (1 << 31), r.key))
    got = [r for side in (True, False) for r in [r for r in found if (posterior[r.votes] < 0.5) == side][:half]]
    forget(voted)
    x = np.array([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32)
    y = np.array([posterior[r.votes] for r in got])
    w, b = _fit_scorer(x, y)
    # The sample has more bad documents than the corpus: put the odds right.
    whole = float(np.clip((counts * [posterior[c] for c in codes.tolist()]).sum() / counts.sum(), 1e-3, 1 - 1e-3))
    mine = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    b += float(np.log(whole / (1 - whole)) - np.log(mine / (1 - mine)))
    return QualityModel(labels, w, b, bits)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_good and n_bad (votes), label_posterior, score, kept (score >= threshold).

    Whole texts are read.  A null text counts as empty; a text under three bytes has no trigram and gets the
    score of the intercept; null ids and repeated rows have their rows; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("n_good", pa.int32()), ("n_bad", pa.int32()), ("label_posterior", pa.float64()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        m = sent.value
        for batch in batches:
            for part in text_slices(batch, 1, rows=SLICE_ROWS):
                texts = part.column(1).to_pylist()
                v = np.array([votes(t) for t in texts]).reshape(len(texts), -1)
                s = m.scores(texts)
                yield to_batch(schema, id=part.column(0), n_good=(v == GOOD).sum(axis=1), n_bad=(v == BAD).sum(axis=1), label_posterior=m.labels.posterior(v), score=s, kept=s >= threshold)

    src = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text_col)
    return src.mapInArrow(run, "id long, n_good int, n_bad int, label_posterior double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``.

    Whole texts are read.  A null or empty text has the score of the intercept; null ids and repeated rows are judged one by
    one; an empty table stays empty; extra columns go through untouched.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, rows=SLICE_ROWS):
                yield part.filter(pa.array(sent.value.scores(part.column(at).to_pylist()) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
