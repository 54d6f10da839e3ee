"""Repeated byte strings of a corpus by merging Burrows-Wheeler transforms.

A string of 100 bytes is sent where the least hash of its 32-byte parts says, so equal strings meet wherever they
lie; neighbouring strings with the same least hash travel as one segment.  Hashes that occur once in the corpus are left
out, as nothing that holds them can repeat.  A bucket of segments is cut into shards.  Each shard has its Burrows-Wheeler
transform, and the transforms are merged by refining an interleave: at first shard after shard, then each round puts
twenty more preceding symbols in front, so that the order is right for twenty more symbols.  The round in which neighbours are parted gives
their common prefix; what is still together after 100 symbols is an interval of one repeated string, of which only
its earliest occurrence stays.  No suffix is compared with one of another shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, forget, made_of, stored, text_slices, to_batch
from kinspark.llm.hashcount import Bitmap, bitmap_bits, chunk_bits, frequent_slots, mixed

_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
#: Bytes of a part whose hash may be the least of its string; a power of two.
_PART = 32
#: Symbols that a round of refinement puts in front.
_STEP = 20
#: Bytes of the texts that are worked on at once; several arrays of eight bytes a byte are made of them.
_SLICE = 1 << 19
#: Windows of one segment at most.
_MOST_WINDOWS = 256
_LAST = (1 << 63) - 1


def part_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on; the width is made of powers of two, from the least."""
    done, whole, h, k = 0, None, _BYTE[data], 1
    while True:
        if width & k:
            whole = h if whole is None else whole[: len(h) - done] * np.uint64(0xD6E8FEB86659FD93) + mixed(h[done:])
            done += k
            if done == width:
                return mixed(whole)
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + (h[k:] ^ (h[k:] >> np.uint64(29)))
        k *= 2


def sliding(h: np.ndarray, width: int, choose) -> np.ndarray:
    """The least (or most) of each ``width`` neighbours."""
    k = 1
    out = h
    while 2 * k <= width:
        out = choose(out[:-k], out[k:])
        k *= 2
    n = len(h) - width + 1
    return choose(out[:n], out[width - k : width - k + n])


def joined(marks: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(id, h, start, stop) with those of a document that overlap or touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for doc, h, start, stop in sorted(marks):
        if out and out[-1][:2] == (doc, h) and start <= out[-1][3]:
            out[-1] = doc, h, out[-1][2], max(stop, out[-1][3])
        else:
            out.append((doc, h, start, stop))
    return out


class Anchors:
    """Least hashes of all strings of ``width`` bytes within the texts of a column."""

    def __init__(self, texts: pa.Array, width: int):
        self.width = width
        texts = pc.fill_null(texts, "")
        self.ends = np.cumsum(np.r_[0, pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)])
        buffers = texts.buffers()
        first = int(np.frombuffer(buffers[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset]) if len(texts) else 0
        self.data = np.frombuffer(buffers[2], np.uint8)[first : first + self.ends[-1]] if self.ends[-1] else np.zeros(0, np.uint8)
        n = len(self.data)
        # Where strings begin that don't cross the end of a text.
        starts = np.zeros(n + 1, np.int64)
        lengths = np.diff(self.ends)
        own = lengths >= width
        np.add.at(starts, self.ends[:-1][own], 1)
        np.add.at(starts, self.ends[1:][own] - width + 1, -1)
        self.begins = np.cumsum(starts)[:n] > 0
        if n < width:
            self.hashes = self.least = np.zeros(0, np.uint64)
            return
        self.hashes = part_hashes(self.data, _PART)
        self.least = sliding(self.hashes, width - _PART + 1, np.minimum)
        self.begins = self.begins[: len(self.least)]

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is the least of a string, and these hashes spread: two equal strings have two places.

        Least hashes are small numbers: as they are, nine in ten would share the first of 32 chunks.
        """
        if not len(self.least):
            return np.zeros(0, np.int64), self.least
        span = self.width - _PART
        seen = np.zeros(len(self.hashes) + span, np.uint64)
        seen[span : span + len(self.least)] = np.where(self.begins, self.least, 0)
        most = sliding(seen, span + 1, np.maximum)
        at = np.flatnonzero((most == self.hashes) & (most > 0))
        return at, mixed(self.hashes[at])

    def doubled(self) -> np.ndarray:
        """Hashes, in order, of places of :meth:`chosen` that have the same hash again so near that one run may hold both."""
        at, h = self.chosen()
        order = np.lexsort((at, h))
        at, h = at[order], h[order]
        near = (h[1:] == h[:-1]) & (np.diff(at) <= _MOST_WINDOWS + self.width)
        return np.unique(h[1:][near])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, number of strings, and row of each run of neighbouring strings of a text with one least hash."""
        # Between the strings of two texts there are places where none begins.
        same = np.r_[False, self.begins[1:] & self.begins[:-1] & (self.least[1:] == self.least[:-1])] if len(self.least) else self.begins
        first = np.flatnonzero(self.begins & ~same)
        n = np.diff(np.r_[np.flatnonzero(~same), len(same)])[np.isin(np.flatnonzero(~same), first, assume_unique=True)]
        # Runs of periodic texts are cut, so no segment is long.
        parts = -(-n // _MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + nth * _MOST_WINDOWS, np.minimum(np.repeat(n, parts) - nth * _MOST_WINDOWS, _MOST_WINDOWS)
        return first, n, np.searchsorted(self.ends, first, side="right") - 1


class Shard:
    """The Burrows-Wheeler transform of strings with their own ends; rows are the sorted rotations."""

    def __init__(self, strings: list[bytes], code: np.ndarray):
        lengths = np.array([len(s) + 1 for s in strings], np.int64)
        first = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        text = np.zeros(n, np.uint8)  # 0 is a string's end
        inner = np.ones(n, bool)
        inner[first + lengths - 1] = False
        text[inner] = code[np.frombuffer(b"".join(strings), np.uint8)]
        follow = np.arange(1, n + 1)
        follow[first + lengths - 1] = first
        # Eight symbols in one key, then pairs of ranks of twice as many symbols, until all rotations differ.
        key, ahead, bits = text.astype(np.uint64), follow, 8
        while bits < 64:
            key = (key << np.uint64(bits)) | key[ahead]
            ahead, bits = ahead[ahead], 2 * bits
        order = np.argsort(key)
        ordered = key[order]
        new, rank = np.r_[True, ordered[1:] != ordered[:-1]], np.empty(n, np.uint64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        while len(open_ := np.flatnonzero(~(new & np.r_[new[1:], True]))):  # places in the order of rotations that are still alike
            own = order[open_]
            key = (rank[own] << np.uint64(32)) | rank[ahead[own]]
            by = np.argsort(key)
            own, key = own[by], key[by]
            parted = np.r_[True, key[1:] != key[:-1]]
            order[open_], new[open_], ahead = own, parted, ahead[ahead]
            rank[own] = open_[parted][np.cumsum(parted) - 1]
        before = np.empty(n, np.int64)
        before[follow] = np.arange(n)
        self.bwt = text[before[order]]
        self.string = np.repeat(np.arange(len(strings)), lengths)[order]
        self.offset = (np.arange(n) - np.repeat(first, lengths))[order]

    def last_to_first(self) -> np.ndarray:
        """The row of each rotation with the symbol before it put in front, from the transform alone."""
        out = np.empty(len(self.bwt), np.int64)
        out[np.argsort(self.bwt, kind="stable")] = np.arange(len(self.bwt))
        return out


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards, numbered one shard after the other, in the order of their first ``depth`` symbols, and their common prefixes.

    ``depth`` is a number of whole rounds.  The second array has for each row the length of its prefix in common with the row before in
    whole rounds, and ``depth`` where they are alike so far.
    """
    bwt = np.concatenate([s.bwt for s in shards]).astype(np.uint64)
    sizes = np.array([len(s.bwt) for s in shards])
    front = np.concatenate([s.last_to_first() + at for s, at in zip(shards, np.cumsum(sizes) - sizes, strict=True)])
    # Five symbols in front at once, then ten, then twenty, numbered in their order; and the row that results.
    symbols, row, n = bwt, front, len(bwt)
    for k in range(1, 5):
        symbols = symbols | (bwt[row] << np.uint64(8 * k))
        row = front[row]
    for _ in range(2):
        ranks = np.unique(symbols, return_inverse=True)[1].astype(np.uint64)
        symbols, row = (ranks[row] << np.uint64(32)) | ranks, row[row]
    symbols = np.unique(symbols, return_inverse=True)[1].astype(np.uint64) << np.uint64(32)
    order, block, place = np.arange(n), np.zeros(n, np.int32), np.arange(n, dtype=np.uint64)
    common, blocks = np.full(n, depth, np.int32), 1
    for reached in range(0, depth, _STEP):
        # A stable sort by symbols: the row's present place is in the key's lower half.
        key = np.sort(symbols[order] | place)
        at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key >>= np.uint64(32)
        order, behind = row[order[at]], block[at]
        new = np.r_[False, (key[1:] != key[:-1]) | (behind[1:] != behind[:-1])]
        common[new & (common == depth)] = reached
        block = np.cumsum(new, dtype=np.int32)
        if int(block[-1]) + 1 == blocks:
            break  # nothing was parted, so nothing ever will be
        blocks = int(block[-1]) + 1
    return order, common


def repeated(strings: list[bytes], doc: np.ndarray, start: np.ndarray, width: int, shard_bytes: int) -> list[tuple[int, int, int]]:
    """(string, first, last) of runs of places where ``width`` bytes begin that also begin earlier.

    String i lies at ``start[i]`` of document ``doc[i]``; documents are numbered in their order.
    """
    seen = np.unique(np.frombuffer(b"".join(strings), np.uint8))
    code = np.zeros(256, np.uint8)
    code[seen] = np.arange(1, len(seen) + 1)  # at most 244 of all bytes are in UTF-8
    shards, bases, part, size = [], [], [], 0
    for i, s in enumerate(strings):
        part.append(s)
        size += len(s)
        if size >= shard_bytes or i + 1 == len(strings):
            bases.append(i + 1 - len(part))
            shards.append(Shard(part, code))
            part, size = [], 0
    order, common = merged(shards, width)
    string = np.concatenate([s.string + at for s, at in zip(shards, bases, strict=True)])[order]
    offset = np.concatenate([s.offset for s in shards])[order]
    interval = np.cumsum(common < width)
    whole = offset <= np.array([len(s) for s in strings])[string] - width
    string, offset, interval = string[whole], offset[whole], interval[whole]
    if not len(string):
        return []
    # Of each interval the earliest place stays.
    place = (doc[string] << 40) + start[string] + offset
    at = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    first = np.repeat(np.minimum.reduceat(place, at), np.diff(np.r_[at, len(place)]))
    gone = place > first
    pairs = np.sort((string[gone] << 20) + offset[gone])
    if not len(pairs):
        return []
    new = np.flatnonzero(np.r_[True, np.diff(pairs) > 1])
    lows, highs = pairs[new], pairs[np.r_[new[1:], len(pairs)] - 1]
    return list(zip((lows >> 20).tolist(), (lows & 0xFFFFF).tolist(), (highs & 0xFFFFF).tolist(), strict=True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, id, h, own): ids with null as the largest number, the hash of the text, and the id as it is."""
    text = F.col(f"`{text_col}`")
    return columns_of(docs, id_col, text_col).select(text.alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("h"), F.col(f"`{id_col}`").cast("long").alias("own"))


def _segments(texts: DataFrame, known: Bitmap, hot: np.ndarray, n_buckets: int, width: int, most_kept: int) -> DataFrame:
    """(bucket, hash, twice, id, h, start, length, body): segments to be compared; those with a null body are known to be repeats.

    Equal segments that a task meets again are told apart from the earliest at once, and neighbours of them are joined, so a whole copy is one
    row; ``twice``: the segment may repeat itself.  ``hash`` has 32 bits: two that share it in a bucket are compared in vain.  Strings with a
    hash of ``hot`` travel one by one, each by its own hash, so a hash that fills a third of the table fills no bucket.
    """
    sent = texts.sparkSession.sparkContext.broadcast((known, hot))
    schema = pa.schema([("bucket", pa.int32()), ("hash", pa.int32()), ("twice", pa.bool_()), ("id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("body", pa.binary())])

    def run(batches):
        known, hot = sent.value
        first: dict[bytes, tuple] = {}
        gone: list[tuple] = []

        def flush(all_: bool):
            # What is known to go is done, so any bucket will do.
            out = [((doc + start) % n_buckets, 0, False, doc, h, start, stop - start, None) for doc, h, start, stop in joined(gone)]
            out += [(*own, *key, len(body), body) for body, (key, own) in first.items()] if all_ else []
            gone.clear()
            if all_:
                first.clear()
            for lo in range(0, len(out), 10_000):
                yield to_batch(schema, **dict(zip(schema.names, zip(*out[lo : lo + 10_000], strict=True), strict=True)))

        for batch in batches:
            for part in text_slices(batch, 0, most_bytes=_SLICE):
                a = Anchors(part.column(0), width)
                at, n, row = a.runs()
                own = mixed(a.least[at])
                wanted = known.has(own)
                at, n, row, own = at[wanted], n[wanted], row[wanted], own[wanted]
                if not len(at):
                    continue
                twice = np.isin(own, a.doubled())
                many = np.isin(known.slots(own), hot) if len(hot) else np.zeros(len(own), bool)
                if many.any():
                    single = np.repeat(at[many], n[many]) + np.arange(n[many].sum()) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                    row = np.r_[row[~many], np.repeat(row[many], n[many])]
                    own = np.r_[own[~many], part_hashes(a.data, width)[single]]
                    at, n, twice = np.r_[at[~many], single], np.r_[n[~many], np.ones(len(single), np.int64)], np.r_[twice[~many], np.zeros(len(single), bool)]
                bucket = mixed(own) % np.uint64(n_buckets)
                data, ids, hs = a.data.tobytes(), part.column(1).to_pylist(), part.column(2).to_pylist()
                columns = (at, n + width - 1, row, at - a.ends[row], bucket.astype(np.int32), own.astype(np.uint32).view(np.int32), twice)
                for p, k, r, s, *to in zip(*(c.tolist() for c in columns), strict=True):
                    body, key = data[p : p + k], (ids[r], hs[r], s)
                    before = first.setdefault(body, (key, to))[0]
                    if before != key:
                        later = max(before, key)
                        gone.append((*later, later[2] + k))
                        if key < before:
                            first[body] = (key, to)
                    if len(first) >= most_kept:
                        yield from flush(True)
                if len(gone) >= 100_000:
                    yield from flush(False)
        yield from flush(True)

    return texts.mapInArrow(run, "bucket int, hash int, twice boolean, id long, h long, start long, length int, body binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, shard_bytes: int = 1 << 18, bucket_bytes: int = 1 << 20, hot: int = 8192, most_hot: int = 1_000_000, most_kept: int = 60_000) -> DataFrame:
    """(id, h, start, stop): the bytes of each document that lie in a string of ``width`` bytes that also starts earlier, as maximal runs.

    Null ids are the largest number; h is the hash of the text.  Hashes that occur more than ``hot`` times are hot; the line is
    doubled while more than ``most_hot`` would be, as they are broadcast.
    """
    if width % _STEP or width <= _PART:
        raise ValueError(f"width must be a multiple of {_STEP} above {_PART}")
    texts = _keyed(docs, id_col, text_col).where(F.octet_length("text") >= width)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = chunk_bits(int(size) // 32)
    # Two strings share a place of the corpus or have two: what occurs once is no repeat.
    again = stored(frequent_slots(texts, lambda part: [Anchors(part.column(0), width).chosen()[1]], chunks, 2, _SLICE), "anchors")
    n, places = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = Bitmap(bitmap_bits(n), chunks).with_slots(again.select("slot"))
    while again.where(F.col("n") > hot).count() > most_hot:
        hot *= 2
    often = np.array([r[0] for r in again.where(F.col("n") > hot).select("slot").collect()], np.uint64)
    forget(again)
    n_buckets = max(1, int(places) * (2 * width - _PART) // bucket_bytes)
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def judged(table: pa.Table) -> pa.Table:
        """Repeats of a bucket: of equal segments all but the earliest, and what the transforms of the rest have in common.

        Segments of one hash only are compared; one that is alone with its hash shares nothing.
        """
        known = pc.is_null(table.column("body"))
        done, table = table.filter(known), table.filter(pc.invert(known))
        ids, h, start, hashes = (table.column(c).to_numpy() for c in ("id", "h", "start", "hash"))
        order = np.lexsort((start, h, ids))
        ids, h, start, hashes, twice = ids[order], h[order], start[order], hashes[order], table.column("twice").to_numpy()[order]
        body = table.column("body").take(pa.array(order)).to_pylist()
        doc = np.cumsum(np.r_[False, (np.diff(ids) != 0) | (np.diff(h) != 0)]) if len(ids) else ids
        first: dict[bytes, int] = {}
        own = np.array([first.setdefault(b, i) for i, b in enumerate(body)], np.int64)
        again = np.flatnonzero((doc != doc[own]) | (start != start[own]))
        length = np.array([len(b) for b in body], np.int64)
        out = [done.select(["id", "h", "start"]).append_column("stop", pc.add(done.column("start"), pc.cast(done.column("length"), pa.int64())))]
        out.append(pa.table([ids[again], h[again], start[again], start[again] + length[again]], schema=schema))
        distinct = np.fromiter(first.values(), np.int64, len(first))
        _, of, n = np.unique(hashes[distinct], return_inverse=True, return_counts=True)
        some = distinct[(n[of] > 1) | twice[distinct]]
        if len(some):
            found = np.array(repeated([body[i] for i in some], doc[some], start[some], width, shard_bytes), np.int64).reshape(-1, 3)
            i = some[found[:, 0]]
            out.append(pa.table([ids[i], h[i], start[i] + found[:, 1], start[i] + found[:, 2] + width], schema=schema))
        return pa.concat_tables(t.cast(schema) for t in out)

    marks = _segments(texts, known, often, n_buckets, width, most_kept).groupBy("bucket").applyInArrow(judged, "id long, h long, start long, stop long")
    # Overlapping and touching marks of a document as one run.
    marks = marks.withColumn("reach", F.expr("max(stop) over (partition by id, h order by start, stop rows between unbounded preceding and 1 preceding)"))
    marks = marks.withColumn("run", F.expr("sum(if(start <= reach, 0, 1)) over (partition by id, h order by start, stop rows between unbounded preceding and current row)"))
    return marks.groupBy("id", "h", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, most_broadcast: int = 32 << 20, with_kept: bool = False, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if ``with_kept``.

    A byte goes if it lies in a string of ``width`` bytes of its text (UTF-8) that also starts earlier: in a document of
    smaller id, or before in the same one; what is left is not judged again.  ``options`` are those of :func:`repeated_spans`.  The runs that go
    are broadcast up to ``most_broadcast`` bytes (counted first); else texts are shuffled once.
    Defined results: null and empty texts have no bytes; a null id is the largest; of equal ids the text of smaller
    hash comes first; rows equal in id and text are one document, each with its result; an empty table gives no rows; other
    columns are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, width, **options)
    spans = stored(spans.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")).select("id", "h", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")), "spans")
    small = spans.agg(F.coalesce(F.sum(16 * F.size("starts") + 80), F.lit(0))).first()[0] <= most_broadcast
    texts = _keyed(docs, id_col, text_col)
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * with_kept])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for doc, text, starts, stops in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw, gone, kept, at = (text or "").encode("utf-8", "surrogatepass"), 0, [], 0
                    for a, b in zip(starts or (), stops or (), strict=True):
                        kept.append(raw[at:a])
                        gone, at = gone + b - a, b
                    left = b"".join([*kept, raw[at:]])
                    rows.append((doc, len(raw), gone, len(starts or ()), hashlib.sha256(left).hexdigest(), left)[: len(schema.names)])
                yield to_batch(schema, **dict(zip(schema.names, zip(*rows, strict=True), strict=True)))

    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    none = F.lit(None).cast("array<long>")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) >= width
    joined = texts.where(long).join(F.broadcast(spans) if small else spans, ["id", "h"], "left").select("own", "text", "starts", "stops")
    short = texts.where(~long).select("own", "text", none.alias("starts"), none.alias("stops"))  # never in a run
    return made_of(joined.unionByName(short).mapInArrow(run, fields).withColumnRenamed("id", id_col), spans)
