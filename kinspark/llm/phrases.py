"""Phrases that occur together more than their parts do, by language.

Words are counted exactly.  Longer runs of words are counted in a sketch: short hashes, some sixteen for each word of the table, whose
sums, upper bounds of the true counts, are formed by chunks of the hash space.  Hashes that reach the least count go into a bitmap, and
stretches of text whose runs are all in the bitmap are kept, equal ones of all tasks once with their number, packed by block and language.  The runs in them are the
candidates.  Blocks of candidates are compiled into Aho-Corasick automata, whose patterns begin and end with the blank that
parts words; these scan shards of the stretches and count overlapping matches.  Sums over shards are the true counts, to
which thresholds and scores apply: a hash that two runs share costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.llm.common import columns_of, forget, made_of, stored, text_slices, to_batch
from kinspark.llm.hashcount import Bitmap, bitmap_bits, chunk_bits, frequent_slots, mixed

_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: parts words, 2: parts pieces
_KIND[list(_BLANKS)], _KIND[list(_BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[list(_BLANKS + _BREAKS)] = 32
_random = np.random.default_rng(13)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64)
#: A byte at place i of a word counts times the i-th power of this odd number, which has an inverse among 64-bit numbers.
_BASE = 0x2545F4914F6CDD1D
#: Bytes of the texts that are worked on at once; arrays of eight bytes a byte are made of them.
_SLICE = 3 << 19
#: Bits of a slot besides its chunk's: a chunk has some million words.
_LOW_BITS = 24


class Words:
    """The words of a column of texts: hashes that depend on the text's language too, rows, pieces, and a buffer of them parted by single blanks."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        # Texts in one, a break after each.
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.string())), "\n")[0].as_buffer()
        data = joined.to_pybytes() + b"\n"
        kind, data = np.frombuffer(data.translate(_KIND.tobytes()), np.uint8), np.frombuffer(data, np.uint8)
        inner = kind == 0
        border = np.flatnonzero(np.diff(np.r_[False, inner]))
        start, stop = border[0::2], border[1::2]
        self.length = stop - start
        self.row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0))
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        # Each word after one blank, and a blank at the end.
        inner[stop] = True
        self.buffer = np.frombuffer(b" " + data[inner].tobytes().translate(_LOWER.tobytes()), np.uint8)
        self.at = np.cumsum(self.length + 1) - self.length
        h = np.zeros(0, np.uint64)
        if len(start):
            # Sums over a word's bytes from those over the whole buffer; the inverse makes its first byte's power the lowest.
            sums = _BYTE[self.buffer]
            sums *= _powers(_BASE, len(sums))
            np.cumsum(sums, out=sums)
            h = (sums[self.at + self.length - 1] - sums[self.at - 1]) * _powers(pow(_BASE, -1, 1 << 64), len(sums), self.at)
        names = langs.dictionary_encode()
        seeds = np.array([hash_of(n) for n in names.dictionary.to_pylist()], np.uint64)
        self.langs, self.lang = names.dictionary, names.indices.to_numpy(zero_copy_only=False)[self.row] if len(start) else start
        self.hash = mixed(h + seeds[self.lang] + np.uint64(1)) if len(start) else h

    def strings(self, first: np.ndarray, last: np.ndarray, blanks: int) -> pa.Array:
        """The words from first to last of each pair, parted by blanks, with a blank before and after if ``blanks`` is 1."""
        a, b = self.at[first] - blanks, self.at[last] + self.length[last] + blanks
        ends = np.cumsum(np.r_[0, b - a])
        taken = self.buffer[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(taken))


def _powers(base: int, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """The first n powers of ``base`` among 64-bit numbers, or those ``at`` places."""
    low, high = (np.cumprod(np.r_[np.uint64(1), np.full(k, b % (1 << 64), np.uint64)])[:k] for k, b in ((1 << 11, base), ((n >> 11) + 1, pow(base, 1 << 11, 1 << 64))))
    return np.multiply.outer(high, low).ravel()[:n] if at is None else high[at >> 11] * low[at & 2047]


def hash_of(text: str) -> int:
    """A 64-bit hash of a string, the same in every process."""
    b = np.frombuffer(text.encode(), np.uint8)
    return int(mixed(np.array([(_BYTE[b] * _powers(_BASE, len(b))).sum(dtype=np.uint64)], np.uint64))[0])


def _longer(words: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words from those of k - 1 words."""
    return mixed(hashes[: len(words.hash) - k + 1] * np.uint64(0xD6E8FEB86659FD93) + words.hash[k - 1 :] + np.uint64(k))


def runs_of(words: Words, known: Bitmap, longest: int, tested: int):
    """(k, first words, hashes) of the runs of 2 to ``longest`` words within a piece whose every part of up to ``tested`` words is in ``known``.

    Runs of at most ``tested`` words are themselves tested.
    """
    n, h = len(words.hash), words.hash
    fits = known.has(h)
    for k in range(2, longest + 1):
        m = n - k + 1
        if m <= 0:
            return
        h = _longer(words, h, k)
        fits = fits[:m] & fits[1 : m + 1] & (words.piece[:m] == words.piece[k - 1 :])
        if k <= tested:
            at = np.flatnonzero(fits)
            fits[at] = known.has(h[at])
        at = np.flatnonzero(fits)
        yield k, at, h[at]


class _Summing:
    """Rows whose last column is a number: equal ones are added up before they are sent, some ``most`` distinct ones or ``most_bytes`` at a time."""

    most, most_bytes = 200_000, 64 << 20

    def __init__(self, schema: pa.Schema, sent: int = 50_000):
        self.schema, self.sent, self.parts, self.rows, self.done, self.bytes, self.done_bytes = schema, sent, [], 0, 0, 0, 0

    def add(self, **columns):
        """Take rows; yields what is full."""
        self.parts.append(pa.table([columns[n].cast(t) for n, t in zip(self.schema.names, self.schema.types, strict=True)], schema=self.schema))
        self.rows += len(self.parts[-1])
        self.bytes += self.parts[-1].nbytes
        if self.rows - self.done >= self.most or self.bytes - self.done_bytes >= self.most_bytes:
            self.sum()
            if self.done >= self.most or self.done_bytes >= self.most_bytes:
                yield from self.send()

    def sum(self) -> None:
        *names, n = self.schema.names
        whole = pa.concat_tables(self.parts).group_by(names).aggregate([(n, "sum")])
        self.parts = [whole.rename_columns([*names, n]).cast(self.schema)]
        self.rows = self.done = len(whole)
        self.bytes = self.done_bytes = self.parts[0].nbytes
        pa.default_memory_pool().release_unused()

    def send(self):
        """All rows that are held."""
        if self.rows > self.done:
            self.sum()
        for table in self.parts:
            yield from table.combine_chunks().to_batches(max_chunksize=self.sent)
        self.parts, self.rows, self.done, self.bytes, self.done_bytes = [], 0, 0, 0, 0


def _sending(df: DataFrame, sent: Broadcast) -> DataFrame:
    """``df``, with a note of the broadcast that its tasks read, for :func:`_kept`."""
    df.sent = sent
    return df


def _kept(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored`, after which no machine keeps its copies of what was broadcast for ``df``."""
    out = stored(df, name)
    df.sent.destroy()
    return out


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return columns_of(docs, text_col, lang_col).select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, a) of single words of (text, lang), summed in tasks before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        sums = _Summing(schema)
        for batch in batches:
            for part in text_slices(batch, 0, most_bytes=_SLICE):
                w = Words(part.column(0), part.column(1))
                every = np.arange(len(w.hash))
                own = pa.array(w.hash).dictionary_encode().indices.to_numpy()
                n = np.bincount(own)
                at = np.empty(len(n), np.int64)
                at[own] = every  # any word of those that have a hash
                strings, langs = w.strings(every, every, 0), w.lang[at]
                phrase = strings.take(pa.array(at))
                if pc.all(pc.equal(phrase.take(pa.array(own)), strings)).as_py() is False or (langs[own] != w.lang).any():
                    phrase, langs, n = strings, w.lang, np.ones(len(every), np.int64)  # two words with one hash: all are sent singly
                yield from sums.add(lang=w.langs.take(pa.array(langs)), phrase=phrase, n=pa.array(n))
        yield from sums.send()

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _sketched(texts: DataFrame, known: Bitmap, shortest: int, longest: int, n_chunks: int, least: int) -> DataFrame:
    """(slot): those of runs of ``shortest`` to ``longest`` words that occur ``least`` times or more, all lengths together."""
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def hashes(part):
        return [h for k, _, h in runs_of(Words(part.column(0), part.column(1)), sent.value, longest, shortest - 1) if k >= shortest]

    return _sending(frequent_slots(texts, hashes, n_chunks, least, _SLICE, _LOW_BITS).select("slot"), sent)


def _with_words(known: Bitmap, words: DataFrame, least: int) -> Bitmap:
    """``known`` with the words that occur ``least`` times or more."""
    few = Bitmap(20, known.chunks, known.low)  # tasks need no map

    def slots_of(batch):
        return few.slots(Words(batch.column(1), batch.column(0)).hash)

    return known.with_slots(words.where(F.col("a") >= least).select("lang", "phrase"), slots_of)


def _stretches(texts: DataFrame, known: Bitmap, longest: int, n_blocks: int, route_blocks: int | None = None) -> DataFrame:
    """Stretches of words that the candidates of a block cover, equal ones summed: rows of :func:`_packed_stretches`.

    A block's stretches are together, so that each of its candidates is found in about one task and not in all.  Tasks send what they have
    by routes of ``route_blocks`` blocks, up to four as there are more blocks; where a route ends the equal stretches of all tasks become one.  So
    what follows works on different stretches, some rows a block, and not on rows of every task for every block.
    """
    route_blocks = route_blocks or min(4, max(1, n_blocks // 64))  # some 64 tasks before routes get wider
    sent = texts.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("block", pa.int32()), ("lang", pa.string()), ("stretch", pa.string()), ("n", pa.int64())])

    def run(batches):
        sums = _Summing(schema, 1 << 30)
        for batch in batches:
            for part in text_slices(batch, 0, most_bytes=_SLICE):
                w = Words(part.column(0), part.column(1))
                found = [(at, at + k - 1, h % np.uint64(n_blocks)) for k, at, h in runs_of(w, sent.value, longest, longest)]
                if not found or not sum(len(x[0]) for x in found):
                    continue
                first, last, block = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
                order = np.argsort((block << 32) + first, kind="stable")
                first, block = first[order], block[order]
                reach = np.maximum.accumulate((block << 32) + last[order])
                new = np.r_[True, ((block << 32) + first)[1:] > reach[:-1]]  # shares no word with what came before
                at, ends = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)] - 1
                text = w.strings(first[at], reach[ends] & 0xFFFFFFFF, 1)
                for full in sums.add(block=pa.array(block[at]), lang=w.langs.take(pa.array(w.lang[first[at]])), stretch=text, n=pa.array(np.ones(len(at), np.int64))):
                    yield routed(full)
        for full in sums.send():
            yield routed(full)

    def routed(full):
        route = full.column("block").to_numpy() // route_blocks
        order = np.argsort(route, kind="stable")
        full, route = full.take(pa.array(order)), route[order]
        at = np.flatnonzero(np.r_[True, route[1:] != route[:-1]])
        rows = [_as_bytes(full.slice(i, j - i)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(route)], strict=True)]
        return to_batch(_ROUTED, route=route[at], rows=rows)

    def merged(batches):
        sums = _Summing(schema, 1 << 30)
        for batch in batches:
            for data in batch.column(1):
                for full in sums.add(**_from_bytes(data)):
                    yield _packed_stretches(full)
        for full in sums.send():
            yield _packed_stretches(full)

    routes = texts.mapInArrow(run, "route int, rows binary").repartition("route").sortWithinPartitions("route")
    return _sending(routes.mapInArrow(merged, ", ".join(f"{f.name} {_SPARK[f.type]}" for f in _PACKED)), sent)


_ROUTED = pa.schema([("route", pa.int32()), ("rows", pa.binary())])


def _as_bytes(rows: pa.RecordBatch) -> bytes:
    """Rows in Arrow's stream format, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: pa.BinaryScalar) -> dict[str, pa.ChunkedArray]:
    """The columns of :func:`_as_bytes`."""
    with pa.ipc.open_stream(data.as_buffer()) as rows:
        table = rows.read_all()
    return dict(zip(table.column_names, table.columns, strict=True))


_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
#: once, more: stretches that are there once or more often, in their order, a line each, compressed; times: how often the latter.
_PACKED = pa.schema([("block", pa.int32()), ("lang", pa.string()), ("bytes", pa.int64()), ("once", pa.binary()), ("once_bytes", pa.int64()), ("more", pa.binary()), ("more_bytes", pa.int64()), ("times", pa.binary())])


def _packed_stretches(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each block, language and some megabyte of (block, lang, stretch, n); bytes are those of the stretches."""
    rows = pa.Table.from_batches([rows]).append_column("many", pc.greater(rows.column("n"), 1)).sort_by([(c, "ascending") for c in ("block", "lang", "many", "stretch")]).combine_chunks()
    ranks = [pc.rank(rows.column(c), tiebreaker="min").to_numpy() for c in ("block", "lang")]
    block, lang, stretch = (rows.column(c).combine_chunks() for c in ("block", "lang", "stretch"))
    many, n = rows.column("many").to_numpy(), rows.column("n").to_numpy()
    ranks.append(np.cumsum(pc.binary_length(stretch).to_numpy().astype(np.int64)) >> 20)
    at = np.flatnonzero(np.r_[True, np.any([r[1:] != r[:-1] for r in ranks], axis=0)])
    out: dict[str, list] = {c: [] for c in ("bytes", "once", "once_bytes", "more", "more_bytes", "times")}
    lines = lambda i, j: "\n".join(stretch[i:j].to_pylist()).encode()
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(n)], strict=True):
        middle = i + int(np.searchsorted(many[i:j], True))
        once, more = lines(i, middle), lines(middle, j)
        for c, v in zip(out, (len(once) + len(more), pa.compress(once, codec="zstd", asbytes=True), len(once), pa.compress(more, codec="zstd", asbytes=True), len(more), n[middle:j].astype("<i8").tobytes()), strict=True):
            out[c].append(v)
    return to_batch(_PACKED, block=block.take(pa.array(at)), lang=lang.take(pa.array(at)), **out)


def _lines(rows: pa.Table | pa.RecordBatch, column: str) -> list[str]:
    """The lines of each row of :data:`_PACKED` as one text."""
    return [pa.decompress(d, n, codec="zstd", asbytes=True).decode() if n else "" for d, n in zip(rows.column(column).to_pylist(), rows.column(f"{column}_bytes").to_pylist(), strict=True)]


def _candidates(stretches: DataFrame, known: Bitmap, longest: int, n_blocks: int) -> DataFrame:
    """(block, lang, phrase): the distinct runs of a language that pass the bitmap and belong to the block, a blank before and after."""
    sent = stretches.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("block", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches):
        sums = _Summing(schema)
        for batch in batches:
            for part in (batch.slice(i, 1) for i in range(batch.num_rows)):
                # Lines are pieces of their own.
                w = Words(pa.array([*_lines(part, "once"), *_lines(part, "more")]), pa.array(part.column("lang").to_pylist() * 2, pa.string()))
                own = np.repeat(part.column("block").to_numpy(zero_copy_only=False), 2)
                for k, at, h in runs_of(w, sent.value, longest, longest):
                    mine = (h % np.uint64(n_blocks)).astype(np.int64) == own[w.row[at]]
                    # Of runs with one hash the first; two that share it by chance differ in words or language, so they are compared.
                    _, one, of = np.unique(h[mine], return_index=True, return_inverse=True)
                    at = at[mine]
                    text = w.strings(at, at + k - 1, 1)
                    few = text.take(pa.array(one))
                    if pc.all(pc.equal(few.take(pa.array(of)), text)).as_py() is not False and (w.lang[at[one]][of] == w.lang[at]).all():
                        at, text = at[one], few
                    yield from sums.add(block=pa.array(own[w.row[at]]), lang=w.langs.take(pa.array(w.lang[at])), phrase=text, n=pa.array(np.ones(len(at), np.int64)))
        yield from sums.send()

    return _sending(stretches.drop("bytes", "times").mapInArrow(run, "block int, lang string, phrase string, n long").select("block", "lang", "phrase").distinct(), sent)


def _scan(candidates: pa.Table, shard: pa.Table) -> pa.Table:
    """(lang, phrase, n): overlapping occurrences of a block's candidates in a shard of packed stretches, each in its own language only.

    The same words are in another block for another language, and stretches there hold all of its occurrences.
    """
    import ahocorasick

    asked = set(zip(candidates.column("lang").to_pylist(), candidates.column("phrase").to_pylist(), strict=True))
    phrases = sorted({p for _, p in asked})
    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        automaton.add_word(phrase, i)
    out: dict[str, list] = {"lang": [], "phrase": [], "n": []}
    if phrases:
        automaton.make_automaton()
        of = shard.column("lang").to_pylist()
        for lang in sorted(set(of)):
            n = [0] * len(phrases)
            for k in (i for i, x in enumerate(of) if x == lang):
                row = shard.slice(k, 1)
                # Stretches that are there once are scanned as one text; the break between two is in no pattern.
                for _, i in automaton.iter(_lines(row, "once")[0]):
                    n[i] += 1
                times = np.frombuffer(row.column("times")[0].as_py(), "<i8").tolist()
                for text, m in zip(_lines(row, "more")[0].split("\n") if times else (), times, strict=True):
                    for _, i in automaton.iter(text):
                        n[i] += m
            met = [i for i, x in enumerate(n) if x and (lang, phrases[i]) in asked]
            out["lang"] += [lang] * len(met)
            out["phrase"] += [phrases[i][1:-1] for i in met]
            out["n"] += [n[i] for i in met]
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, block_phrases: int = 50_000, block_words: int = 2_000_000, shard_bytes: int = 32 << 20, most_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all words, and of the phrases of 2 to ``longest`` words that occur ``least`` times or more: stored tables.

    The bitmap has a thousand bits for each frequent word, at most 2 to the ``most_bits``: beyond that more runs than
    necessary become candidates, and the counts are the same.  Candidates are dealt by hash into blocks of at most some
    ``block_phrases``, and for at most some ``block_words`` words of the table each; where a block's stretches have more than ``shard_bytes``, as
    with one that is very frequent, they are dealt into shards that each get the block's candidates.  So neither an automaton's nor a
    task's size grows with the table, and few candidates are sent twice.
    """
    texts = _texts(docs, text_col, lang_col)
    words = stored(word_counts(texts), "words")
    total, frequent = words.agg(F.coalesce(F.sum("a"), F.lit(0)), F.count_if(F.col("a") >= least)).first()
    n_chunks = chunk_bits(int(total))
    known = Bitmap(bitmap_bits(frequent, most_bits, 1024), n_chunks, _LOW_BITS)
    known = _with_words(known, words, least)
    n_slots = 0
    # Pairs first; longer runs only where every pair is frequent.
    for shortest, upto in ((2, 2), (3, longest)):
        if upto >= shortest:
            slots = _kept(_sketched(texts, known, shortest, upto, n_chunks, least), "slots")
            n_slots += slots.count()
            known = known.with_slots(slots)
            forget(slots)
    n_blocks = max(1, -(-n_slots // block_phrases), -(-int(total) // block_words))
    stretches = _kept(_stretches(texts, known, longest, n_blocks), "stretches")
    candidates = _kept(_candidates(stretches, known, longest, n_blocks), "candidates")
    sizes = F.broadcast(stretches.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / shard_bytes).cast("int")).alias("shards")))  # one row a block
    left = candidates.join(sizes, "block").select("block", "lang", "phrase", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = stretches.join(sizes, "block").select(*stretches.columns, F.expr("cast(pmod(xxhash64(lang, once, more), shards) as int)").alias("shard"))
    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_scan, "lang string, phrase string, n long")
    phrases = stored(met.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least), "phrases")
    forget(stretches, candidates)
    return words, phrases


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, top: int = 2000, covered: int = 80, most_broadcast: int = 200_000, **options
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language; ``options`` are those of :func:`phrase_counts`.

    A phrase's score is the least of floor(2000000 a / (l + r)) over its cuts into a left and a right part, ties to the
    shortest left one.  A phrase goes if a longer candidate holds it and occurs at least ``covered`` % as often.  Arithmetic is
    decimal.  Counts up to ``most_broadcast`` rows (counted first) are broadcast, more are joined by a shuffle.
    Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; an empty
    table gives no rows; other columns than the two named are not read.
    """
    words, phrases = phrase_counts(docs, text_col, lang_col, longest, least, **options)
    parts = words.where(F.col("a") >= least).select("lang", "phrase", "a").unionByName(phrases)
    few = F.broadcast if parts.count() <= most_broadcast else (lambda x: x)
    split = phrases.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cuts = split.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(few(parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))), ["lang", side])
    score = F.expr("cast(2000000 * cast(a as decimal(28, 0)) div (cast(l as decimal(28, 0)) + r) as long)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # What lies inside longer ones: the most frequent of these decides.
    span = F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))"))
    inner = split.where(F.size("w") > 2).select("lang", span.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * cast(longer as decimal(28, 0)) < {covered} * cast(a as decimal(28, 0))"))
    # First within hash parts of a language, so no task sorts all its phrases.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = F.broadcast(words.groupBy("lang").agg(F.sum("a").alias("n")))
    return made_of(rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), words, phrases)
