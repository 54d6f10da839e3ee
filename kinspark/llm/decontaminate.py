"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Each window of a benchmark item is a set of word shingles of which a document that holds the window must hold
all.  So one is enough to find it: the rarest by the corpus's own counts, the window's prefix in the order of
rarity.  Shingles of documents are joined with these; the shingle's place in the window gives the only place
where the window can begin, the lengths say whether it fits there, and the words there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, forget, made_of, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z is lower case: all of ASCII but digits and letters.
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
_SHINGLE = 3
#: Parts of a shingle's places in a join by shuffle.
_SALTS = 16


def words_of(text: Column) -> Column:
    """The words of a text (array of strings; empty for null), A-Z in lower case."""
    # lower() is right for texts of ASCII alone and much cheaper than translate().
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(low, _BREAKS), ""), F.array().cast("array<string>"))


def _shingled(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows (id, h, w, pos, key): one with pos 0 and no key for each row of docs, and one for each key of each word from pos 1 on.

    A key is the hash of the shingle that begins at pos; near the end of a text it is of fewer words.  Where windows of one or
    two words exist (``lengths``), a place also has the keys of its sequences that short.  All keys of a place come from one array,
    so a join behind it filters them before a row with the words ``w`` is made of any.
    """
    zipped = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), F.col("w")).alias("a"), F.col("w").alias("b"), F.expr("slice(w, 2, size(w))").alias("c"))
    rows = docs.where(F.size("w") >= 0).select("id", "h", "w", F.posexplode(zipped).alias("pos", "s"))
    there = F.col("s.a").isNotNull()
    keys = [F.when(there, F.xxhash64("s.a", "s.b", "s.c"))]
    if 2 in lengths:  # before the last word; there the longest key is of two words already
        keys.append(F.when(there & F.col("s.b").isNotNull() & F.col("s.c").isNotNull(), F.xxhash64("s.a", "s.b")))
    if 1 in lengths:
        keys.append(F.when(there & F.col("s.b").isNotNull(), F.xxhash64("s.a")))
    if len(keys) == 1:
        return rows.select("id", "h", "w", "pos", keys[0].alias("key"))
    # A row of pos 0 is there once.  No function with a lambda here: it would leave the code stage that the join is in.
    every = F.when(there, F.array(*keys)).otherwise(F.array(F.lit(None).cast("long")))
    return rows.select("id", "h", "w", "pos", F.explode(every).alias("key"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct windows: words, len, items (sorted ids as strings); and all shingles of each, (offset, key)."""
    items = columns_of(benchmark, id_col, text_col).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1)))
    windows = items.select("item", "w", at.alias("at")).select("item", F.expr(f"slice(w, at, {width})").alias("words"))
    windows = windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # A window of one or two words has one shingle, itself.
    offsets = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - _SHINGLE)))
    windows = windows.select("words", "items", F.size("words").alias("len"), offsets.alias("offset"))
    part = [F.try_element_at("words", F.col("offset") + i) for i in range(1, _SHINGLE + 1)]
    return windows.select("*", F.xxhash64(*part).alias("key"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, broadcast_windows: int = 200_000, most_broadcast: int = 1_000_000
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, text_xxhash64, contaminated.

    A window is ``width`` consecutive words of an item, or all words of a shorter item.  A word of a document is
    hit if it lies in an occurrence of a window; a document is contaminated if n_hit > 0 and at least a
    twentieth of its words are hit.  Defined results: a null or empty text has no words and no hits; an item
    without words has no window; windows of an item with a null id hit words, the item is not counted or named; null
    ids and repeated rows of ``docs`` each have their row; with an empty benchmark nothing is hit; only the
    named columns are read.
    Up to ``broadcast_windows`` windows (counted first) are broadcast and documents are read where they lie.
    Beyond it shingles are joined by a shuffle of (row, place, hash), and only texts that may hold a window move, or
    none that doesn't while the keys of those (counted first) are at most ``most_broadcast``.
    """
    texts = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"), F.col(text_col).alias("text"))
    src = texts.select("id", "h", words_of(F.col("text")).alias("w"))
    windows = stored(item_windows(benchmark, item_col, item_text_col, width), "windows")
    lengths = [r[0] for r in windows.where(f"len < {_SHINGLE}").select("len").distinct().collect()]
    small = windows.count() <= broadcast_windows * width
    near = F.broadcast if small else (lambda x: x)

    seen = _shingled(src, lengths).where("key is not null").select("key")
    counts = stored(seen.join(near(windows.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")), "counts")
    rarest = Window.partitionBy("words").orderBy("n", "key", "offset")
    # A window with a shingle that no document holds is in no document; the inner join leaves it out if it
    # is the rarest, so the count of all others doesn't matter.
    ranked = windows.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("r", F.row_number().over(rarest))
    prefix = ranked.where("r = 1 and n > 0").select(F.col("key").alias("wkey"), "offset", "len", "words", "items")

    def hits(at: DataFrame) -> DataFrame:
        """Rows with ``start``, ``len`` and ``items`` where the words are those of the window, else with nulls."""
        fits = F.col("words").isNotNull() & (F.col("first") >= 1) & (F.col("first") + F.col("len") - 1 <= F.size("w"))
        same = F.when(fits, F.expr("slice(w, greatest(first, 1), len) = words")).otherwise(False)
        return at.select("id", "h", F.size("w").alias("n_words"), F.when(same, F.struct("first", "len")).alias("span"), F.when(same, F.col("items")).alias("items"), F.col("row").alias("row"))

    first = (F.col("pos") - F.col("offset")).alias("first")
    places = _shingled(src, lengths)
    if small:
        found = places.join(F.broadcast(prefix), F.col("key") == F.col("wkey"), "left").where("words is not null or pos = 0")
        met = stored(hits(found.select("id", "h", "w", first, "len", "words", "items", (F.col("pos") == 0).alias("row"))), "met")
        rows, spans = met.where("row").select("id", "h", "n_words"), met
    else:
        # A window of one frequent word is met by most of the corpus: its places are dealt to several tasks.
        salted = prefix.withColumn("wsalt", F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])))
        salt = F.pmod(F.xxhash64("id", "pos"), F.lit(_SALTS)).cast("int").alias("salt")
        near_rows = places.where("key is not null").select("id", "h", "pos", "key", salt).join(salted, (F.col("key") == F.col("wkey")) & (F.col("salt") == F.col("wsalt")))
        near_rows = stored(near_rows.select(F.col("id").alias("id2"), F.col("h").alias("h2"), first, "len", "words", "items").dropDuplicates(["id2", "h2", "first", "words"]), "near")
        keys = near_rows.select("id2", "h2").distinct()
        few = F.broadcast if keys.count() <= most_broadcast else (lambda x: x)
        same_row = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
        # Texts that may hold a window, each once; all others stay where they are.
        cand = texts.join(few(keys), same_row, "left_semi").dropDuplicates(["id", "h"]).select("id", "h", words_of(F.col("text")).alias("w"))
        spans = hits(cand.join(near_rows, same_row).select("id", "h", "w", "first", "len", "words", "items", F.lit(False).alias("row")))
        rows = src.select("id", "h", F.size("w").alias("n_words"))
    per = spans.where("span is not null").groupBy(F.col("id").alias("id3"), F.col("h").alias("h3")).agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # Spans by their first word: each adds what reaches beyond the words hit so far.
    add = "greatest(0, s.first + s.len - greatest(s.first, x.next))"
    covered = F.expr(f"aggregate(array_sort(spans), struct(0 as next, 0 as hit), (x, s) -> struct(greatest(x.next, s.first + s.len) as next, x.hit + {add} as hit)).hit")
    per = per.select("id3", "h3", covered.cast("long").alias("n_hit"), "items")
    # Every row has its result, also repeated ones; rows without hits are the most and meet nothing.
    out = rows.join(per, F.col("id").eqNullSafe(F.col("id3")) & (F.col("h") == F.col("h3")), "left")
    out = out.select("id", "h", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        F.col("h").alias("text_xxhash64"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
    return made_of(out, windows, counts, met if small else near_rows)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 1_000_000, **options) -> DataFrame:
    """``docs``, all columns, without the rows that are contaminated; options are those of :func:`contamination`.

    Rows are told apart by id and text hash.  Texts stay where they are while the contaminated ones are at most
    ``most_broadcast`` (counted first).  Null, empty and very long texts, null ids and repeated rows follow the rule of
    :func:`contamination`; an empty table stays empty, an empty benchmark drops nothing; extra columns go through untouched.
    """
    judged = contamination(docs, benchmark, id_col, text_col, **options)
    bad = stored(judged.where("contaminated").select(F.col(id_col).alias("_bad_id"), F.col("text_xxhash64").alias("_bad_h")).distinct(), "contaminated")
    forget(judged)
    few = F.broadcast if bad.count() <= most_broadcast else (lambda x: x)
    same = docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.coalesce(F.xxhash64(docs[text_col]), F.lit(0)) == bad["_bad_h"])
    return made_of(docs.join(few(bad), same, "left_anti"), bad)
