"""Suffix-array dedup: bytes covered by a 400-byte string that starts anywhere else, by column-wise construction.

The collection is first cut so that no part needs to know another. Every 400-byte window
has a key: the smallest hash of the 200-byte strings in it. Windows that are equal have
equal keys, so a text falls into segments, runs of neighbouring windows with one key, and
only segments of one key can have a window in common. Keys that occur once go (unless a
segment repeats within itself); equal segments enter once, with their count. A key with
very many different segments is cut again, each segment into shorter ones by the smallest
hash of longer strings (`GRAMS`), and in the end into single windows, which are counted:
rows in proportion to the segments' bytes, however many share a key.

Many keys make a part. Windows of a part that no other has by its hash are left out first,
so that segments shrink to the runs of windows that may repeat; equal runs are one string
from then on, with their count. The strings are one collection for a column-wise
construction: round t inserts one symbol of each string, the t-th from its end. The
Burrows-Wheeler transform of the collection and the lengths of the prefixes that
neighbours in suffix order have in common are two sequential files, read from front to
back and written anew each round. The position of each new suffix follows from the
symbols before its last place in the transform, its common prefixes from the smallest
values back and forth to the same symbol. A window is repeated if a neighbour shares 400
bytes with it, or if its string stands in several places.

All strings of a key hold its 200-byte string, and so does each of their windows. It enters
the collection as a mark and the key's number, four symbols instead of 200; with it a
window has 204. (Keys with a segment that holds the string twice go without the mark.)

A collection is bounded (`BLOCK` strings, and those of one key more, of 600 bytes at most), so
its files stay below `SPOOL` bytes and in memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, BASE_INVERSE, BYTE_VALUES, _power_table, byte_rows, doc_columns, mapped, mix, name_columns, scratch, signed, stored

LENGTH = 400
#: Lengths of the strings whose hashes are keys: the first for all texts, each further one for keys with more than BLOCK different segments.
GRAMS = (200, 300, 360)
BLOCK = 1024
#: Segments that go to one task's turn together, at about.
PART = 4096
SPOOL = 64 << 20
#: A mark, which is no byte of UTF-8, and three digits stand for a key's string. The digits
#: are letters that texts have anyway, so that the alphabet stays small.
MARK = b"\xff"
DIGITS = b"etaoinshrdlucmfw"
_U = np.uint64


def _sliding(x: np.ndarray, width: int, low) -> np.ndarray:
    """`low` (minimum or maximum) of every `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = low(x[:-have], x[have:])
        have *= 2
    return low(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(row: bytes, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, digest, start, size and whether a key's string stands in it twice, for each segment of a text of LENGTH bytes or more."""
    span = LENGTH - gram + 1
    grams, sums, down = _hashes(np.frombuffer(row, dtype=np.uint8), gram)
    keys = _sliding(grams, span, np.minimum)
    start = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    size = np.diff(np.append(start, len(keys)))
    if size.max() > span:
        more = -(-size // span)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        start = np.repeat(start, more) + step * span
        size = np.diff(np.append(start, len(keys)))
    own = keys[start]
    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), keys, np.zeros(span - 1, dtype=np.uint64)])
    most = _sliding(padded, span, np.maximum)
    places = np.flatnonzero(grams == most)
    twice = np.zeros(len(start), dtype=bool)
    for i in np.flatnonzero(grams[places[1:]] == grams[places[:-1]]).tolist():
        a, b = places[i], places[i + 1]
        lo = np.searchsorted(start, max(0, b - span + 1), "right") - 1
        hi = np.searchsorted(start, a, "right")
        for k in range(max(0, lo), hi):
            if own[k] == grams[a] and start[k] <= a and b < start[k] + size[k] - 1 + span:
                twice[k] = True
    size = size + (LENGTH - 1)
    digest = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
    return own, digest, start, size, twice


def _marks(batch: pa.RecordBatch):
    """The segments of documents (doc, version, text)."""
    docs, versions, held, owner, total = batch.column(0), batch.column(1), [], [], 0

    def made():
        own, digest, start, size, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        of = pa.array(np.concatenate(owner))
        return pa.record_batch(
            [pa.array(signed(own)), pa.array(signed(digest)), docs.take(of), versions.take(of), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(twice)],
            names=["key", "digest", "doc", "version", "start", "size", "twice"],
        )

    for i, row in enumerate(byte_rows(batch.column(2))):
        if len(row) >= LENGTH:
            held.append(segments(row, GRAMS[0]))
            owner.append(np.full(len(held[-1][0]), i))
            total += len(held[-1][0])
        if total > 50_000:
            yield made()
            held, owner, total = [], [], 0
    if held:
        yield made()


def _cut_again(gram: int):
    """The segments by longer strings of segments (key, digest, n, data)."""

    def each(batch: pa.RecordBatch):
        for key, digest, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, digests, start, size, twice = segments(data, gram)
            m = len(own)
            slices = [data[a : a + k] for a, k in zip(start.tolist(), size.tolist(), strict=True)]
            yield pa.record_batch(
                [pa.array([key] * m, type=pa.int64()), pa.array([digest] * m, type=pa.int64()), pa.array(start.astype(np.int32)), pa.array(signed(own)), pa.array(signed(digests)), pa.array([n] * m, type=pa.int64()), pa.array(size.astype(np.int32)), pa.array(twice), pa.array(slices, type=pa.binary())],
                names=["of_key", "of_digest", "offset", "key", "digest", "n", "size", "twice", "data"],
            )

    return each


def _windows(batch: pa.RecordBatch):
    """Every window of segments (key, digest, n, data) by two hashes."""
    for key, digest, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        a = _hashes(np.frombuffer(data, dtype=np.uint8), LENGTH)[0]
        b = _hashes(np.frombuffer(data[::-1], dtype=np.uint8), LENGTH)[0][::-1]
        m = len(a)
        yield pa.record_batch([pa.array([key] * m, type=pa.int64()), pa.array([digest] * m, type=pa.int64()), pa.array([n] * m, type=pa.int64()), pa.array(signed(a)), pa.array(signed(b)), pa.array(np.arange(m, dtype=np.int32))], names=["key", "digest", "n", "a", "b", "from"])


class _File:
    """A column of values as a sequential file."""

    def __init__(self, values: np.ndarray):
        self.kind, self.file = values.dtype, None
        self.write(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), dtype=self.kind)

    def write(self, values: np.ndarray) -> None:
        if self.file is not None:
            self.file.close()
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.file.write(values.tobytes())


def _smallest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest of values[lo : hi + 1] for each pair."""
    if not len(lo):
        return np.empty(0, dtype=values.dtype)
    order = np.argsort(lo, kind="stable")
    edges = np.empty(2 * len(lo), dtype=np.int64)
    edges[::2], edges[1::2] = lo[order], hi[order] + 1
    out = np.empty(len(lo), dtype=values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), edges)[::2]
    return out


class _Occurrences:
    """Counts of each symbol up to each block of a transform, and from them ranks and the nearest equal symbols of some places."""

    SHIFT = 8

    def __init__(self, symbols: np.ndarray, alphabet: int, offsets: np.ndarray):
        n, width = len(symbols), 1 << self.SHIFT
        self.n, self.alphabet, self.blocks = n, alphabet, (n + width - 1) >> self.SHIFT
        padded = np.full(self.blocks << self.SHIFT, np.iinfo(symbols.dtype).max, dtype=symbols.dtype)
        padded[:n] = symbols
        self.rows = padded.reshape(self.blocks, width)
        self.held = np.bincount(offsets[:n] + symbols, minlength=self.blocks * alphabet).reshape(self.blocks, alphabet)
        self.upto = self.held.cumsum(axis=0)
        self.totals = self.upto[-1]
        #: For each symbol but 0, the symbols below it, without 0.
        self.below = np.cumsum(self.totals) - self.totals - self.totals[0]
        self.flat = (self.upto.T + np.arange(alphabet)[:, None] * (n + 1)).ravel()
        self.columns = np.arange(width)

    def rank(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How many of the same symbol come before each place."""
        block = at >> self.SHIFT
        before = self.columns < (at & (len(self.columns) - 1))[:, None]
        return self.upto[block, own] - self.held[block, own] + np.count_nonzero((self.rows[block] == own[:, None]) & before, axis=1)

    def nearest(self, at: np.ndarray, own: np.ndarray, nth: np.ndarray, ahead: bool) -> np.ndarray:
        """The place of the same symbol nearest to each place, the nth of all (from 1)."""
        block = np.searchsorted(self.flat, own.astype(np.int64) * (self.n + 1) + nth) - own.astype(np.int64) * self.blocks
        equal = self.rows[block] == own[:, None]
        column = (at & (len(self.columns) - 1))[:, None]
        elsewhere = (block != at >> self.SHIFT)[:, None]
        if ahead:
            place = (equal & (elsewhere | (self.columns > column))).argmax(axis=1)
        else:
            place = len(self.columns) - 1 - (equal & (elsewhere | (self.columns < column)))[:, ::-1].argmax(axis=1)
        return (block << self.SHIFT) + place


def construct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a collection (0 ends a text, other symbols are its bytes, numbered from 1 in order) and the common prefixes of neighbours in suffix order."""
    m = len(texts)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    letters = np.unique(raw)
    kind = np.uint8 if len(letters) < 255 else np.uint16
    number = np.zeros(256, dtype=kind)
    number[letters] = np.arange(1, len(letters) + 1)
    flat = number[raw]
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    width = np.int16 if sizes.max(initial=0) < 2**15 - 1 else np.int32
    alphabet = len(letters) + 1
    offsets = (np.arange(len(raw) + m) >> _Occurrences.SHIFT) * alphabet
    everyone = np.arange(m)

    def preceding(j: np.ndarray, t: int) -> np.ndarray:
        return np.where(sizes[j] > t, flat[np.maximum(ends[j] - t - 1, 0)] if len(flat) else 0, 0).astype(kind)

    transform, prefixes = _File(preceding(everyone, 0)), _File(np.zeros(m, dtype=width))
    at, live = everyone.copy(), everyone
    for t in range(1, int(sizes.max(initial=0)) + 1):
        alive = sizes[live] >= t
        live, at = live[alive], at[alive]
        symbols, shared = transform.read(), prefixes.read()
        seen = _Occurrences(symbols, alphabet, offsets)
        own = symbols[at]
        rank = seen.rank(at, own)
        to = m + seen.below[own] + rank
        back, ahead = np.flatnonzero(rank > 0), np.flatnonzero(rank + 1 < seen.totals[own])
        total = len(symbols) + len(live)
        old = np.ones(total, dtype=bool)
        old[to] = False
        new_shared = np.zeros(total, dtype=width)
        new_shared[old] = shared
        new_shared[to[back]] = 1 + _smallest(shared, seen.nearest(at[back], own[back], rank[back], False) + 1, at[back])
        new_shared[to[ahead] + 1] = 1 + _smallest(shared, at[ahead] + 1, seen.nearest(at[ahead], own[ahead], rank[ahead] + 2, True))
        new_symbols = np.empty(total, dtype=kind)
        new_symbols[old] = symbols
        new_symbols[to] = preceding(live, t)
        transform.write(new_symbols)
        prefixes.write(new_shared)
        at = to
    return transform.read(), prefixes.read()


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, where strings of `length` bytes start that also start elsewhere in the collection."""
    symbols, shared = construct(texts)
    m, n = len(texts), len(symbols)
    sizes = np.array([len(t) for t in texts])
    most = np.maximum(shared, np.append(shared[1:], 0))
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(symbols, kind="stable")] = np.arange(n)
    found: list[list[int]] = [[] for _ in range(m)]
    live, at = np.arange(m), np.arange(m)
    for t in range(1, int(sizes.max(initial=0)) + 1):
        alive = sizes[live] >= t
        live, at = live[alive], place[at[alive]]
        if t >= length:
            for j in live[most[at] >= length].tolist():
                found[j].append(int(sizes[j]) - t)
    return [np.array(f[::-1], dtype=np.int64) for f in found]


def united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (start, end) that touch or overlap, put together."""
    out: list[list[int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[k]), int(ends[k])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the string of so many bytes at each place, and what it was made from."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * _power_table("up", BASE, n)[:n], out=sums[1:])
    down = _power_table("down", BASE_INVERSE, n)
    return mix((sums[length:] - sums[:-length]) * down[: n - length + 1]), sums, down


def _marked(data: bytes, number: int, gram: int) -> bytes:
    """A string with its key's string replaced by the mark and the key's number."""
    at = int(_hashes(np.frombuffer(data, dtype=np.uint8), gram)[0].argmin())
    n = len(DIGITS)
    return data[:at] + MARK + bytes(DIGITS[number // n**k % n] for k in range(3)) + data[at + gram :]


def candidate_runs(texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, start, end) of the maximal runs of windows whose hash another window has; the end is that of the last window."""
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    hashes = _hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), LENGTH)[0]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(hashes)]
    places = np.flatnonzero(np.arange(len(hashes)) + LENGTH <= (begins + sizes)[owner])
    order = np.argsort(hashes[places], kind="stable")
    own = hashes[places[order]]
    equal = np.zeros(len(own) + 1, dtype=bool)
    equal[1:-1] = own[1:] == own[:-1]
    found = np.sort(places[order[equal[1:] | equal[:-1]]])
    if not len(found):
        return []
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]])
    first, last = found[new], found[np.append(new[1:], True)]
    k = owner[first]
    return list(zip(k.tolist(), (first - begins[k]).tolist(), (last - begins[k] + LENGTH).tolist(), strict=True))


def _collected(gram: int):
    def each(table: pa.Table) -> pa.Table:
        keys, digests, data = (table.column(c).to_pylist() for c in ("key", "digest", "data"))
        plain = table.column("any")[0].as_py()
        runs: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for k, a, b in candidate_runs(data):
            runs.setdefault((keys[k], data[k][a:b]), []).append((k, a))
        out: dict[str, list] = {"key": [], "digest": [], "from": [], "to": []}
        strings = sorted(runs)
        numbers = {key: i for i, key in enumerate(dict.fromkeys(key for key, _ in strings))}
        at = 0
        while at < len(strings):
            upto = min(at + BLOCK, len(strings))
            while upto < len(strings) and strings[upto][0] == strings[upto - 1][0]:
                upto += 1
            own, length = strings[at:upto], LENGTH
            texts = [text for _, text in own]
            base = numbers[own[0][0]]
            if not plain and numbers[own[-1][0]] - base < len(DIGITS) ** 3:
                texts, length = [_marked(text, numbers[key] - base, gram) for key, text in own], LENGTH - gram + 4
            for (key, text), starts in zip(own, repeated_windows(texts, length), strict=True):
                places = runs[key, text]
                ranges = [(0, len(text))] if len(places) > 1 else united(starts, starts + LENGTH)
                for k, offset in places:
                    for a, b in ranges:
                        for c, v in zip(out, (key, digests[k], a + offset, b + offset), strict=True):
                            out[c].append(v)
            at = upto
        return pa.table({"key": pa.array(out["key"], type=pa.int64()), "digest": pa.array(out["digest"], type=pa.int64()), "from": pa.array(out["from"], type=pa.int32()), "to": pa.array(out["to"], type=pa.int32())})

    return each


def _sliced(batch: pa.RecordBatch):
    for row, keys, digests, starts, sizes in zip(byte_rows(batch.column(0)), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
        yield pa.record_batch([pa.array(keys, type=pa.int64()), pa.array(digests, type=pa.int64()), pa.array([row[a : a + n] for a, n in zip(starts, sizes, strict=True)], type=pa.binary())], names=["key", "digest", "data"])


_RANGE = ["key", "digest", "from", "to"]


def _ranges(segs: DataFrame, data: Callable[[DataFrame], DataFrame], level: int = 0) -> DataFrame:
    """key, digest, from, to: repeated ranges of different segments (key, digest, n, size, twice), given a way to the bytes of some of them."""
    context = segs.sparkSession.sparkContext
    copies = segs.filter("n > 1").select("key", "digest", F.lit(0).alias("from"), F.col("size").alias("to"))
    by_key = stored(segs.groupBy("key").agg(F.count("*").alias("m"), F.max("twice").alias("any")).filter("m > 1 OR any"), "keys")
    unclear = stored(segs.select("key", "digest", "n").join(by_key, "key"), "unclear")
    total, most = unclear.agg(F.count("*"), F.max("m")).first()
    if not total:
        return copies
    held = data(unclear)
    # As many tasks as there is work for, however few bytes it has.
    parts = max(1, total // PART, min(total // 64, 4 * context.defaultParallelism))
    few = held.filter(F.col("m") <= BLOCK).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    spread = few.select("part", "any", "key", "digest", "data").repartition(min(parts, 16 * context.defaultParallelism), "part", "any")
    out = copies.union(spread.groupBy("part", "any").applyInArrow(_collected(GRAMS[level]), "key long, digest long, `from` int, `to` int"))
    if most <= BLOCK:
        return out
    hot = held.filter(F.col("m") > BLOCK).select("key", "digest", "n", "data")
    if level + 1 == len(GRAMS):
        windows = stored(mapped(hot, ["key", "digest", "n", "data"], "key long, digest long, n long, a long, b long, `from` int", _windows), "windows")
        again = windows.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b")
        return out.union(windows.join(stored(again, "again"), ["a", "b"]).select("key", "digest", "from", (F.col("from") + LENGTH).alias("to")))
    shorter = stored(mapped(hot, ["key", "digest", "n", "data"], "of_key long, of_digest long, offset int, key long, digest long, n long, size int, twice boolean, data binary", _cut_again(GRAMS[level + 1])), "shorter")
    different = stored(shorter.groupBy("key", "digest").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.max("twice").alias("twice"), F.first("data").alias("data")), "different")
    below = _ranges(different.drop("data"), lambda some: some.join(different.select("key", "digest", "data"), ["key", "digest"]), level + 1)
    offset = F.col("offset")
    return out.union(shorter.drop("data", "n").join(stored(below, "below"), ["key", "digest"]).select(F.col("of_key").alias("key"), F.col("of_digest").alias("digest"), (offset + F.col("from")).alias("from"), (offset + F.col("to")).alias("to")))


def _repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segments of documents (doc, version, text) whose keys occur again, and the repeated ranges of different ones."""
    marks = stored(mapped(docs, ["doc", "version", "text"], "key long, digest long, doc long, version int, start int, size int, twice boolean", _marks), "marks")
    keys = stored(marks.groupBy("key").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select("key"), "keys")
    held = stored(marks.join(keys, "key", "left_semi"), "segments")
    place = F.struct("doc", "version", "start")
    different = stored(held.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.min("size").alias("size"), F.max("twice").alias("twice")), "different")

    def data(some: DataFrame) -> DataFrame:
        found = some.select("key", "digest").join(different.select("key", "digest", "size", "place.*"), ["key", "digest"])
        wanted = found.groupBy("doc", "version").agg(*[F.collect_list(c).alias(c) for c in ("key", "digest", "start", "size")])
        sliced = mapped(docs.join(wanted, ["doc", "version"]), ["text", "key", "digest", "start", "size"], "key long, digest long, data binary", _sliced)
        return stored(some.join(sliced.groupBy("key", "digest").agg(F.first("data").alias("data")), ["key", "digest"]), "data")

    return held, stored(_ranges(different.select("key", "digest", "n", "size", "twice"), data), "ranges")


def _spans(docs: DataFrame) -> DataFrame:
    """doc, version, from, to: lists of ranges of repeated bytes, for documents (doc, version, text) that have any."""
    with scratch(docs.sparkSession) as kept:
        held, ranges = _repeated(docs)
        kept += [held, ranges]
    spans = held.select("key", "digest", "doc", "version", "start").join(ranges, ["key", "digest"]).select("doc", "version", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to")).distinct()
    return spans.groupBy("doc", "version").agg(F.collect_list("from").alias("from"), F.collect_list("to").alias("to"))


def _kept(batch: pa.RecordBatch):
    rows, out = byte_rows(batch.column(1)), {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
    for row, lo, hi in zip(rows, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        runs = united(np.array(lo), np.array(hi)) if lo else []
        digest, at = hashlib.sha256(), 0
        for a, b in runs:
            digest.update(row[at:a])
            at = b
        digest.update(row[at:])
        for c, v in zip(out, (len(row), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"start": a, "end": b} for a, b in runs]), strict=True):
            out[c].append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    yield pa.record_batch([batch.column(0), *[pa.array(v, type=k) for v, k in zip(out.values(), kinds, strict=True)]], names=["doc_id", *out])


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (byte ranges that repeat) for every row of `documents` (doc_id, text).

    Every row is a text of its own: rows that repeat each other, with a doc_id or without,
    are texts that repeat each other, and rows that share a doc_id may have different texts.
    Null and empty texts have no bytes. Other columns are ignored; an empty table gives no
    rows.
    """
    docs = documents.select(documents["doc_id"], *name_columns(documents), documents["text"])
    wide = docs.join(_spans(docs.drop("doc_id")), ["doc", "version"], "left")
    return mapped(wide, ["doc_id", "text", "from", "to"], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", _kept)
