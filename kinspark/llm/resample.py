"""Importance resampling towards a target: documents drawn by how much more their words are the target's than the corpus's.

Word n-grams fall into buckets by CRC-32.  Two passes read the texts: the first counts buckets, and only its totals are
shuffled; the second turns each text into the array of its buckets and adds up their gains, looked up in a literal
array, without exploding a text.  Gumbel noise from a hash of the id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, made_of, stored
from kinspark.llm.decontaminate import words_of

#: Rows of one sorted range: the low bits of monotonically_increasing_id(), whose high bits are the range's number.
_ROW_BITS = 33


def feature_buckets(text: Column, longest: int, n_buckets: int) -> Column:
    """The bucket of each run of 1 to ``longest`` words of a text, repeats included; null and wordless texts have none."""

    def runs(words: Column, length: int) -> Column:
        hashed = lambda run: F.crc32(run.cast("binary")) % n_buckets
        if length == 1:
            return F.transform(words, hashed)
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - length + 1, F.lit(1)))
        found = F.transform(starts, lambda at: hashed(F.array_join(F.slice(words, at, length), " ")))
        return F.when(F.size(words) >= length, found).otherwise(F.array().cast("array<bigint>"))

    # The words are bound by a lambda, so the text is cut once however many lengths there are.
    words = F.array(words_of(text))
    return F.flatten(F.transform(words, lambda w: F.concat(*[runs(w, length) for length in range(1, longest + 1)])))


def bucket_totals(docs: DataFrame, text_col: str, longest: int, n_buckets: int) -> dict[int, int]:
    """How many features of all rows each bucket holds: summed in tasks, at most ``n_buckets`` rows reach the driver."""
    buckets = columns_of(docs, text_col).select(F.explode(feature_buckets(F.col(f"`{text_col}`"), longest, n_buckets)).alias("bucket"))
    return dict(buckets.groupBy("bucket").agg(F.count("*")).collect())


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", longest: int = 1, n_buckets: int = 10_000) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each of B buckets; S, s count features of ``docs``, T, t those of ``target``.

    Null and empty texts have no features.  With an empty ``docs`` or ``target`` the counts of that side are zero.
    """
    raw, aim = bucket_totals(docs, text_col, longest, n_buckets), bucket_totals(target, target_text_col, longest, n_buckets)
    every, aimed = sum(raw.values()) + n_buckets, sum(aim.values()) + n_buckets
    ratio = lambda b: (aim.get(b, 0) + 1) * float(every) / ((raw.get(b, 0) + 1) * float(aimed))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(n_buckets)]


def resample(
    docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024, percent: int = 10, least_words: int = 20
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    weight is the sum of the gains of a document's features, score adds Gumbel noise from SHA-256 of ``seed`` and id.  Of the N
    documents with at least ``least_words`` words the floor(percent N / 100) highest scores are drawn, ties to the smaller id;
    rank counts them from 1 and is null for all others.  Scores are written once; ranks come from a sort by ranges, each
    numbered within itself and moved by the sizes of the ranges before, so no task sees all scores.
    Defined results: a null or empty text has no features, weight 0, and is never drawn; a null id has the noise of an empty
    id and comes last among equal scores; repeated rows each have their row and, if drawn, each their rank; an empty
    table gives no rows; only the two named columns are read.
    """
    spark, n_buckets = docs.sparkSession, len(gains)
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded into one literal
    found = F.col("buckets")
    src = columns_of(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), feature_buckets(F.col(f"`{text_col}`"), longest, n_buckets).alias("buckets"))
    weight = F.aggregate(found, F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, (b + 1).cast("int")))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.ln(-F.ln((noise + 0.5) / 4294967296.0)))
    # So many features has a text of just enough words.
    least = sum(max(0, least_words - length) for length in range(longest))
    scored = src.select("id", F.size(found).cast("long").alias("n_features"), weight.alias("weight"), gumbel.alias("gumbel"))
    scored = stored(scored.select("id", "n_features", "weight", (F.col("weight") + F.col("gumbel")).alias("score"), (F.col("n_features") >= least).alias("able")), "scored")

    # Equal scores and ids are parted by a number of their row, so no range holds more than its share of them.
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("tie")]
    ranged = scored.where("able").withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged_file = ranged = stored(ranged.select("id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("place")), "ranged")
    part = F.shiftright("place", _ROW_BITS).cast("int").alias("part")
    sizes = sorted(ranged.groupBy(part).agg(F.count("*")).collect())  # one row a range
    starts = [0, *itertools.accumulate(n for _, n in sizes)]
    offsets = spark.createDataFrame([(p, at) for (p, _), at in zip(sizes, starts, strict=False)], "part int, before long")
    draws = starts[-1] * percent // 100
    rank = F.col("before") + F.col("place").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    ranged = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    ranged = ranged.select("id", "n_features", "weight", "score", F.when(rank <= draws, rank).alias("rank"))
    rest = scored.where("not able").select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return made_of(ranged.unionByName(rest).withColumnRenamed("id", id_col), scored, ranged_file)
