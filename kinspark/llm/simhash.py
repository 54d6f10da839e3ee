"""Near-duplicate detection: SimHash fingerprints linked through Golay-code keys.

A fingerprint of 64 bits is cut into three segments.  A segment is decoded to the nearest codeword of the
perfect binary Golay code; the codewords nearest to it or to a neighbour one bit away are its fuzzy keys:
one for one vector in seven and six for the others.  If u and v differ by at most one bit in a segment, the
codeword of v is among the fuzzy keys of u.  At most three differing bits leave two cases:

* a segment has two or three of them: then of the other two one has none and one at most one.  Six kinds of
  keys, for the ordered pairs of segments: all bits of the first, the Golay key of the second.
* no segment has more than one.  One kind of key: the Golay keys of all three.

One side of the join carries fuzzy keys where the other carries the codeword, so every link meets, with some
70 short rows per distinct fingerprint and keys of 34 to 36 bits, and is verified on all 64 bits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import SLICE_ROWS, columns_of, forget, made_of, slices, stored, text_slices, to_batch
from kinspark.llm.components import connected_components

#: Bits of the three segments, from the lowest bit on; each is at most the code's length of 23.
SEGMENTS = (22, 21, 21)
#: Most differing bits of a link.  The segments are made for this number.
MAX_BITS = 3
# Fixed value: generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code of length 23.
_GENERATOR = 0b110001110101
#: Most rows of two longs that are sent to every task.
MOST_BROADCAST = 1_000_000


@lru_cache(maxsize=1)
def codeword_index() -> np.ndarray:
    """For each vector of 22 bits the index (its 12 message bits) of the nearest codeword of length 23."""
    column = np.zeros(23, dtype=np.uint16)  # syndrome of each single bit
    for b in range(23):
        r = 1 << b
        for top in range(22, 10, -1):
            if r >> top & 1:
                r ^= _GENERATOR << (top - 11)
        column[b] = r
    error = np.zeros(2048, dtype=np.uint32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            error[np.bitwise_xor.reduce(column[list(bits)])] = sum(1 << b for b in bits)
    v = np.arange(1 << max(SEGMENTS), dtype=np.uint32)
    syndrome = np.zeros(len(v), dtype=np.uint16)
    for b in range(max(SEGMENTS)):
        syndrome ^= ((v >> np.uint32(b)) & np.uint32(1)).astype(np.uint16) * column[b]
    return ((v ^ error[syndrome]) >> np.uint32(11)).astype(np.uint16)


def fuzzy_keys(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): the distinct codeword indexes of each segment and of its one-bit neighbours."""
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    keys = np.sort(codeword_index()[segment[:, None] ^ flips], axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for bits in SEGMENTS:
        out.append(((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        at += bits
    return out


def _cross(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int):
    """All pairs of the keys of a and of b at the same position: (positions, keys of a, keys of b)."""
    per = np.bincount(b[0], minlength=n)
    first = np.cumsum(per) - per
    reps = per[a[0]]
    i = np.repeat(np.arange(len(a[0])), reps)
    j = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[a[0]], reps)
    return a[0][i], a[1][i], b[1][j]


def join_keys(prints: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of u64 fingerprints on one side (0 or 1) of the join that finds all links."""
    segments, everyone = _segments(prints), np.arange(len(prints))
    code = [(everyone, codeword_index()[s]) for s in segments]
    fuzzy = [fuzzy_keys(s, b) for s, b in zip(segments, SEGMENTS, strict=True)]
    wide = [(p, k.astype(np.int64)) for p, k in fuzzy]
    code = [(p, k.astype(np.int64)) for p, k in code]
    out = []
    for kind, (i, j) in enumerate(permutations(range(3), 2)):
        p, k = wide[j] if side == 0 else code[j]
        out.append((p, (kind << 40) + (segments[i][p].astype(np.int64) << 12) + k))
    x, y, z = (wide[0], wide[1], code[2]) if side == 0 else (code[0], code[1], wide[2])
    p, a, b = _cross(x, y, len(prints))
    p, ab, c = _cross((p, (a << 12) + b), z, len(prints))
    out.append((p, (6 << 40) + (ab << 12) + c))
    return np.concatenate([p for p, _ in out]), np.concatenate([k for _, k in out])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over word shingles: bit is 1 if set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        h = np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(spaces[: len(found) - words] + 1).tolist()]
        ends = [*spaces[words - 1 :].tolist(), len(joined)]
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    """XXH64 of a text that tells texts of one id apart; 0 for null."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp) per row: the text's hash, and its fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, rows=SLICE_ROWS):
                fp = np.array([fingerprint(x) for x in part.column(2).to_pylist()], dtype=np.uint64)
                yield to_batch(schema, doc_id=part.column(0), h=part.column(1), fp=fp.view(np.int64))

    src = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, h long, fp long")


def _keyed(prints: DataFrame, side: int) -> DataFrame:
    """(key, fp) of one side of the join, from distinct fingerprints ``fp``."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 4096):
                fp = part.column(0).to_numpy()
                p, k = join_keys(fp.view(np.uint64), side)
                for at in range(0, len(p), 100_000):
                    yield to_batch(schema, key=k[at : at + 100_000], fp=fp[p[at : at + 100_000]])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def _near(a: DataFrame, b: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a < b, of rows with the same key whose fingerprints differ in at most ``max_bits`` bits."""
    both = a.select("key", F.col("fp").alias("a")).join(b.select("key", F.col("fp").alias("b")), "key")
    return both.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits.

    The join meets every pair that shares a key; :func:`chains` is for families that are too dense for that.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find links of at most {MAX_BITS} bits")
    return _near(_keyed(prints, 0), _keyed(prints, 1), max_bits).distinct()


def _stars(prints: DataFrame) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints ``fp`` within two bits of one another, over any number of steps.

    Each fingerprint names itself and its 64 neighbours of one bit.  Those that name the same vector are at most
    two bits apart, and there are at most 65; they become a star around the least of them.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    balls = prints.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("ball"))
    met = balls.groupBy("ball").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def chains(prints: DataFrame, max_bits: int = MAX_BITS, dense: int = 64) -> DataFrame:
    """(a, b): edges that connect the same fingerprints as :func:`links`, but few in a dense family.

    A key with more than ``dense`` codewords is hot: many variants of one text share it, and their pairs would grow
    with the square.  All other keys are joined as they are, at most ``dense`` rows for each fuzzy key.  Fingerprints
    of hot keys are first connected over links of one and two bits, by stars.  Links of three bits then only matter
    between what stars left apart: in each hot key the rows of its largest part meet those of others, and the
    others meet one another.
    """
    if max_bits < 2:
        return links(prints, max_bits)
    a, b = _keyed(prints, 0), _keyed(prints, 1)
    hot = stored(b.groupBy("key").count().where(F.col("count") > dense).select("key"), "hot-keys")
    n = hot.count()
    if n == 0:
        return made_of(_near(a, b, max_bits).distinct(), hot)
    side = F.broadcast(hot) if n <= MOST_BROADCAST else hot
    plain = _near(a.join(side, "key", "left_anti"), b.join(side, "key", "left_anti"), max_bits)
    a, b = stored(a.join(side, "key", "left_semi"), "hot-fuzzy"), stored(b.join(side, "key", "left_semi"), "hot-codes")
    stars = stored(_stars(a.select("fp").unionByName(b.select("fp")).distinct()), "stars")
    if max_bits == 2:
        return made_of(plain.unionByName(stars).distinct(), hot, a, b, stars)
    kept, part = (hot, a, b, stars), connected_components(stars, "a", "b")
    kept, part = (*kept, part), part.withColumnsRenamed({"node": "fp", "component": "part"})
    a, b = (x.join(part, "fp", "left").select("key", "fp", F.coalesce("part", "fp").alias("part")) for x in (a, b))
    sizes = a.unionByName(b).groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", "most")
    mixed = stored(mixed, "mixed-keys")
    a, b = (x.join(mixed, "key") for x in (a, b))
    inside, apart = F.col("part") == F.col("most"), F.col("part") != F.col("most")
    across = _near(a.where(apart), b, max_bits).unionByName(_near(a.where(inside), b.where(apart), max_bits))
    return made_of(plain.unionByName(across).unionByName(stars).distinct(), *kept, mixed)


def _placed(docs: DataFrame, id_col: str, text_col: str, max_bits: int, with_hash: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, fp) of ``docs``, h the text's hash, and (fp, n, first) of distinct fingerprints.

    first is of the component's first row: its least id, or ``with_hash`` a struct (none, doc_id, h) of the least id, null ids
    last, and the least h of that id.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h") if with_hash else F.col("doc_id")
    prints = stored(marked.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "prints")
    edges = chains(prints, max_bits)
    found = connected_components(edges, "a", "b")
    named = prints.join(found, prints.fp == found.node, "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("label"))
    # Only labels of more than one fingerprint need the first row of the whole component.
    whole = found.join(prints.select(F.col("fp").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("all"))
    placed = named.join(whole, named.label == whole.component, "left").select("fp", "n", F.coalesce("all", "first").alias("first"))
    placed = stored(placed, "placed")
    forget(edges, found, prints)
    return marked, placed


def _join_placed(marked: DataFrame, placed: DataFrame, hot_share: int) -> DataFrame:
    """``marked`` with what ``placed`` says of its fingerprint: frequent ones by a broadcast join, the others by a shuffle."""
    least = marked.count() // hot_share
    most, rare = placed.where(F.col("n") > least).drop("n"), placed.where(F.col("n") <= least).drop("n")
    return marked.join(F.broadcast(most), "fp").unionByName(marked.join(F.broadcast(most), "fp", "left_anti").join(rare, "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot_share: int = 10_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one node of the graph; links join nodes; component_id is the least doc_id of all
    that can be reached, itself included.  Documents without words (null, empty, blank) have fingerprint zero and
    link like others.  A null id takes part but never becomes a component's id while another is there; if all
    are null it is null.  Repeated rows share their component.  An empty table gives an empty result.
    No group is expanded into pairs of documents: the most frequent fingerprints (at most ``hot_share`` can have over one
    row in that many) get their component by a broadcast join, the others by a shuffle.
    """
    out = _join_placed(*_placed(docs, id_col, text_col, max_bits, False), hot_share)
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, most_broadcast: int = MOST_BROADCAST, hot_share: int = 10_000) -> DataFrame:
    """``docs``, all columns, with one row of each component: the least id, null ids last, of equal ids the least text hash.

    Rows are told apart by id and text hash, so the order of rows is no matter, and an id that two texts share loses
    neither.  Of rows equal in both one stays, the one with the least hash over all columns.  Null ids and null, empty or
    very long texts follow the same rule; an empty table stays empty; extra columns are kept whatever their names.
    Texts don't move while the rows that go are few enough to broadcast (counted first); else they are shuffled once.
    """
    marked, placed = _placed(docs, id_col, text_col, max_bits, True)
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    keys = _join_placed(marked, placed, hot_share).groupBy("doc_id", "h").agg(F.bool_and(same).alias("stays"), F.count("*").alias("n"))
    keys = stored(keys.where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "stays"), "not-single")
    forget(marked, placed)
    near = F.broadcast if keys.count() <= most_broadcast else (lambda x: x)

    def on(df):
        return docs[id_col].cast("long").eqNullSafe(df["_id"]) & (text_hash(docs[text_col]) == df["_h"])

    rest = docs.join(near(keys), on(keys), "left_anti")
    again = keys.where("stays")
    if again.isEmpty():
        return made_of(rest, keys)
    # Rows that repeat the one that stays: one of each, without sending more than one from a task.
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    repeated = docs.join(near(again), on(again), "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(*plain).alias("_of"), F.col(f"`{id_col}`").cast("long").alias("_id"), text_hash(F.col(f"`{text_col}`")).alias("_h"))
    one = repeated.groupBy("_id", "_h").agg(F.min_by("_row", "_of").alias("_row")).select("_row.*")
    return made_of(rest.unionByName(one), keys)
