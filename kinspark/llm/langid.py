"""Language identification with a string kernel.

The kernel of two texts counts the n-grams of letters (n = 1 to 4, the blended spectrum) that are present in
both, over the root of the product of their own counts.  Presence is kept in hashed bits.  A long text holds nearly
every n-gram, so presence is taken in windows of a text and the windows' scores are averaged by their letters: a score
does not fall or rise with a text's length.  Nyström landmarks stand for the training windows; kernel ridge regression of
one language against the rest is solved in their space.  As the kernel is a product of bit vectors, landmark coordinates
and regression fold into one matrix (bits x languages), and a batch of windows is scored by one matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SLICE_ROWS, columns_of, text_slices, to_batch

UNDETERMINED = "und"
#: Scores of texts that are unlike all learnt languages are less.
UNLIKE = 0.25
#: Characters of a window.
WINDOW = 2048


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def presence(text: str | None, bits: int, longest: int = 4) -> tuple[np.ndarray, int] | None:
    """Hashed presence of the n-grams of a text's letters, words parted by one space, and their number; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character behind a letter parts words
    c = np.concatenate([np.uint32([32]), c[keep]])
    out, h, shift = np.zeros(1 << bits, dtype=bool), np.zeros(len(c), np.uint32), np.uint32(32 - bits)
    for n in range(1, longest + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        out[(h * np.uint32(0x9E3779B1)) >> shift] = True
    return out, int(letter.sum())


def windows_of(text: str | None, bits: int):
    """(presence, letters) of each window of a text that has a letter; together the windows are the whole text."""
    for at in range(0, len(text or ""), WINDOW):
        if (found := presence(text[at : at + WINDOW], bits)) is not None:
            yield found


@dataclass
class LanguageModel:
    """Languages and the folded matrix (bits x languages); no languages if there was nothing to learn from.

    The regression tells languages apart, but a text that shares nothing with any of them gets half marks from it.
    So ``shares`` (bits x languages: the share of a language's documents that have an n-gram) tells whether the
    n-grams of a text are those of a learnt language: their mean share, for the language where it is largest, must
    reach a line over the logarithm of the number of n-grams, ``line``: value at 0, slope, first and last logarithm.
    """

    languages: list[str]
    weights: np.ndarray
    bits: int
    shares: np.ndarray
    line: tuple[float, float, float, float]

    def likeness(self, n: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Mean share of the ``n`` n-grams of each window, over what the line asks for; below 1 is unlike all learnt."""
        asked = self.line[0] + self.line[1] * np.clip(np.log(n), *self.line[2:])
        return shared.max(axis=1) / n / np.maximum(asked, 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; memory is bounded by 256 windows, however long a text is."""
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return lang, score
        k, both = len(self.languages), np.concatenate([self.weights, self.shares], axis=1)
        total, like, letters = np.zeros((len(texts), k)), np.zeros(len(texts)), np.zeros(len(texts))
        every = ((i, *w) for i, text in enumerate(texts) for w in windows_of(text, self.bits))
        while some := list(islice(every, 256)):
            at, x, size = np.array([w[0] for w in some]), np.array([w[1] for w in some], dtype=np.float32), np.array([w[2] for w in some], dtype=float)
            n, product = x.sum(axis=1), x @ both
            np.add.at(total, at, product[:, :k] / np.sqrt(n)[:, None] * size[:, None])
            np.add.at(like, at, self.likeness(n, product[:, k:]) * size)
            np.add.at(letters, at, size)
        for i in np.flatnonzero(letters).tolist():
            mean, near = total[i] / letters[i], like[i] / letters[i]
            # Targets of the regression are 1 for a window's language and -1 for others; a text unlike all stays below UNLIKE.
            value = float(np.clip((mean.max() + 1) / 2, 0, 1))
            lang[i], score[i] = self.languages[int(mean.argmax())], value * (UNLIKE * near if near < 1 else 1.0)
        return lang, score


def held_out(id_col: str) -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _least_likeness(mean: np.ndarray, label: np.ndarray, count: np.ndarray, n: np.ndarray) -> tuple[float, float, float, float]:
    """The line of :class:`LanguageModel`, from the mean shares (rows x languages) of the ``n`` n-grams of its own documents.

    A document's own part is taken out of its language's share.  All but the 2 in 1,000 least like the rest lie above
    the line with a third to spare.  Without a second document of some language nothing can be asked for.
    """
    if count.min() < 2:
        return 0.0, 0.0, 0.0, 0.0
    mean, own, each = mean.copy(), np.arange(len(label)), count[label]
    mean[own, label] = (mean[own, label] * each - 1) / (each - 1)
    most, at = mean.max(axis=1), np.log(n)
    slope = float(np.polyfit(at, most, 1)[0]) if np.ptp(at) > 1 else 0.0
    rest = most - slope * at
    middle = float(np.median(rest))
    return middle - 4 / 3 * (middle - float(np.quantile(rest, 0.002))), slope, float(at.min()), float(at.max())


def fit_language_model(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, landmarks: int = 256, ridge: float = 0.3, bits: int = 14, most_languages: int = 200, windows: int = 1
) -> LanguageModel:
    """Learn from at most ``windows`` windows each of at most ``per_language`` documents of each language that are not held out.

    Both bounds keep what the driver gets small: at most ``windows`` x ``per_language`` rows a language.

    They are those with the least hashes of id and text; rows that repeat both count once.  Only hashes below the
    language's share of its count of distinct ones are looked at, so the sample depends on no order and no language's
    rows meet in one task.  The hash also picks the windows of a long text, at equal distances.  The driver gets bits (2 KB each), not texts.
    Null texts and null languages teach nothing, null and repeated ids are told apart by their texts; an empty table
    gives a model without languages; more than ``most_languages`` languages are an error.
    """
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = columns_of(train, id_col, lang_col, text_col).select(F.xxhash64(id_col, text_col).alias("_hash"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    # A little more than the bound, so that neither chance nor the rough count falls below it; the driver leaves the rest.
    share = F.when(F.col("_n") <= per_language, F.lit(1.0)).otherwise((1.2 * per_language + 50) / F.col("_n"))
    if len(hashed.select("_lang").distinct().limit(most_languages + 1).collect()) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    shares = hashed.groupBy(F.col("_lang").alias("_of")).agg(F.approx_count_distinct("_hash", 0.02).alias("_n")).select("_of", (share * (1 << 31)).alias("_share"))
    below = F.pmod(F.col("_hash"), F.lit(1 << 31)) < F.col("_share")
    rows = hashed.join(F.broadcast(shares), F.col("_lang") == F.col("_of")).where(below)

    def run(batches):
        seen = set()  # of the sample only, which is small
        for batch in batches:
            for part in text_slices(batch, 2, rows=SLICE_ROWS):
                out = []
                for key in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if key[:2] not in seen:
                        seen.add(key[:2])
                        n = max(1, -(-len(key[2]) // WINDOW))
                        some = min(n, windows)
                        for part_no in range(some):
                            at = (key[0] + n * part_no // some) % n * WINDOW
                            if (found := presence(key[2][at : at + WINDOW], bits)) is not None:
                                out.append((*key[:2], part_no, np.packbits(found[0]).tobytes()))
                yield to_batch(schema, **{f: [x[i] for x in out] for i, f in enumerate(schema.names)})

    schema = pa.schema([("hash", pa.int64()), ("lang", pa.string()), ("part", pa.int32()), ("bits", pa.binary())])
    once = rows.select("_hash", "_lang", "_text").mapInArrow(run, "hash long, lang string, part int, bits binary").dropDuplicates(["hash", "lang", "part"]).collect()
    once.sort(key=lambda r: (r.lang, r.hash % (1 << 31), r.hash, r.part))
    texts = [(lang, list(rows)) for (lang, _), rows in groupby(once, key=lambda r: (r.lang, r.hash))]
    got = [r for _, of_one in groupby(texts, key=lambda t: t[0]) for _, rows in islice(of_one, per_language) for r in rows]
    languages = sorted({r.lang for r in got})
    if not languages:
        nothing = np.zeros((1 << bits, 0), np.float32)
        return LanguageModel([], nothing, bits, nothing, (0.0, 0.0, 0.0, 0.0))
    packed = np.array([np.frombuffer(r.bits, np.uint8) for r in got])
    label = np.array([languages.index(r.lang) for r in got])
    # Landmarks: the same number of each language, spread over its sample.
    each = max(1, landmarks // len(languages))
    marks = np.concatenate([own[np.linspace(0, len(own) - 1, min(each, len(own))).astype(int)] for own in (np.flatnonzero(label == k) for k in range(len(languages)))])

    def unit(rows):
        x = np.unpackbits(packed[rows], axis=1).astype(np.float32)
        return x / np.sqrt(x.sum(axis=1, keepdims=True))

    z = unit(marks)
    k_nm = np.concatenate([unit(np.arange(a, min(a + 256, len(packed)))) @ z.T for a in range(0, len(packed), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])  # Nyström coordinates of a text: its landmark kernels times this
    phi = k_nm @ root
    share = np.bincount(label, minlength=len(languages))
    w = 1.0 / share[label]  # languages weigh alike
    y = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ (phi * w[:, None]) + ridge / len(phi) * np.eye(phi.shape[1]), phi.T @ (y * w[:, None]))
    shares, n = np.zeros((1 << bits, len(languages)), np.float32), np.zeros(len(packed))
    parts = [np.arange(a, min(a + 256, len(packed))) for a in range(0, len(packed), 256)]
    for part in parts:
        x = np.unpackbits(packed[part], axis=1).astype(np.float32)
        shares += x.T @ (label[part][:, None] == np.arange(len(languages))).astype(np.float32)
        n[part] = x.sum(axis=1)
    shares /= share.astype(np.float32)
    mean = np.concatenate([np.unpackbits(packed[part], axis=1).astype(np.float32) @ shares for part in parts]) / n[:, None]
    return LanguageModel(languages, (z.T @ (root @ beta).astype(np.float32)).astype(np.float32), bits, shares, _least_likeness(mean, label, share, n))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    Whole texts are read, nothing else of a row.  A text unlike all learnt languages has the best of them with a score
    below ``UNLIKE``.  A null text, a text without a letter, and every text
    while no language was learnt, is ``und`` with score 0; null ids and repeated rows have their rows; ties
    go to the first language in order; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, rows=SLICE_ROWS):
                lang, score = sent.value.predict(part.column(2).to_pylist())
                yield to_batch(schema, id=part.column(0), held_out=part.column(1), lang_pred=lang, score=score)

    src = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), text_col)
    return src.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = UNLIKE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``least_score``; none unlike all learnt.

    Whole texts are read and their length is no matter.  Rows with a null text or one without a letter go; null ids and repeated
    rows are judged one by one; an empty table stays empty; extra columns go through untouched.
    """
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at, rows=SLICE_ROWS):
                lang, score = sent.value.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
