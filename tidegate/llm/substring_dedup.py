"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest.

A 16-bit gear hash h = 2h + G[byte] rolls over each text, so it knows the last 16 bytes.
A cut falls before a byte whose hash is the smallest within 24 bytes on either side;
starts of words come before other places, and no cut falls inside a character. Cuts
depend on the bytes near them alone, so an insertion shifts no other cut, and a passage
has the same chunks wherever it stands. A chunk without a cut for 4096 bytes is split.

Every chunk has a 128-bit digest. The first document (smallest doc_id) keeps its first
copy; other copies are cut out, if a run of neighbouring copies has at least `run` bytes
(64 unless told otherwise: shorter runs are phrases, not passages) or is the whole text:
a whole copy goes, however short it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_map, byte_rows, chunks, doc_columns, in_bits, mapped, name_columns, stored, trimmed

REACH = 24
LONGEST = 4096
#: Bytes that neighbouring copies must have together to be cut out, unless they are a whole text.
RUN = 64
#: Bits of the map of repeated digests. One that is full costs time and changes no result.
BITS = 1 << 26

_GEAR = np.random.default_rng(11).integers(1, 2**16, 256, dtype=np.uint16)
_GEAR[0] = 0
_PAD = 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True


def _shifted(x: np.ndarray, n: int, fill: int) -> np.ndarray:
    out = np.empty_like(x)
    out[:n] = fill
    out[n:] = x[:-n]
    return out


def cuts(rows: list[bytes]) -> list[list[int]]:
    """Where each row is cut: 0, the cuts, and its length; an empty row has none."""
    gap = bytes(_PAD)
    buffer = np.frombuffer(gap + gap.join(rows) + gap, dtype=np.uint8)
    h = _GEAR[buffer]
    for step in (1, 2, 4, 8):
        h = h + (_shifted(h, step, 0) << np.uint16(step))
    key = h >> np.uint16(1)
    key |= np.where(_shifted(_SPACE[buffer].view(np.uint8), 1, 1) > 0, np.uint16(0), np.uint16(0x8000))
    key[(buffer & 0xC0) == 0x80] = 0xFFFF
    begins = np.cumsum([_PAD] + [len(r) + _PAD for r in rows])
    low = key
    for step in (1, 2, 4, 8, 8):  # the smallest of the 24 that end here
        low = np.minimum(low, _shifted(low, step, 0xFFFF))
    before = _shifted(low, 1, 0xFFFF)
    after = np.full_like(low, 0xFFFF)
    after[:-REACH] = low[REACH:]
    places = np.flatnonzero((key < before) & (key <= after) & (key < 0xFFFF))
    first = np.searchsorted(places, begins)
    out = []
    for i, row in enumerate(rows):
        a, n = int(begins[i]), len(row)
        own = (places[first[i] : first[i + 1]] - a).tolist()
        own = [p for p in own if 0 < p < n]
        marks = [0, *own, n] if n else []
        if n > LONGEST and any(y - x > LONGEST for x, y in zip(marks, marks[1:], strict=False)):
            marks = _split(row, marks)
        out.append(marks)
    return out


def _split(row: bytes, marks: list[int]) -> list[int]:
    out = [0]
    for y in marks[1:]:
        while y - out[-1] > LONGEST:
            p = out[-1] + LONGEST
            while row[p] & 0xC0 == 0x80 and p > out[-1] + LONGEST - 4:
                p -= 1
            out.append(p)
        out.append(y)
    return out


def _marked(batch: pa.RecordBatch, bits=None):
    """The chunks of documents (doc, version, text); with a bit map, those whose digests it may hold."""
    digest = xxhash.xxh3_128_digest
    docs, versions, rows = batch.column(0), batch.column(1), byte_rows(batch.column(2))
    for lo, hi in chunks(rows):
        digests, ats, sizes, agains, owner = [], [], [], [], []
        for i, marks in enumerate(cuts(rows[lo:hi])):
            row, seen = rows[lo + i], set()
            for a, b in zip(marks, marks[1:], strict=False):
                d = digest(row[a:b])
                digests.append(d)
                ats.append(a)
                sizes.append(b - a)
                agains.append(d in seen)
                seen.add(d)
                owner.append(i)
        both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        of = pa.array(np.array(owner, dtype=np.int64) + lo)
        out = pa.record_batch(
            [docs.take(of), versions.take(of), pa.array(ats, type=pa.int32()), pa.array(sizes, type=pa.int32()), pa.array(agains, type=pa.bool_()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
            names=["doc", "version", "at", "size", "again", "a", "b"],
        )
        yield out if bits is None else out.filter(pa.array(in_bits(bits.value, both[:, 0].view(np.uint64))))


def joined_runs(copies: list[tuple[int, int]], least: int, whole: int) -> list[tuple[int, int]]:
    """Runs (start, end) of neighbouring (at, size) with at least so many bytes, or with all of the `whole`."""
    runs: list[list[int]] = []
    for at, size in sorted(set(copies)):
        if runs and runs[-1][1] == at:
            runs[-1][1] = at + size
        else:
            runs.append([at, at + size])
    return [(a, b) for a, b in runs if b - a >= min(least, whole)]


def _cut_out(run: int):
    def each(batch: pa.RecordBatch):
        rows = byte_rows(batch.column(1))
        texts, removed, spans = [], [], []
        for row, null, ats, sizes in zip(rows, batch.column(1).is_null().to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = joined_runs(list(zip(ats, sizes, strict=True)), run, len(row)) if ats else []
            kept, at = [], 0
            for a, b in runs:
                kept.append(row[at:a])
                at = b
            kept.append(row[at:])
            texts.append(None if null else b"".join(kept).decode("utf-8", "replace"))
            removed.append(sum(b - a for a, b in runs))
            spans.append(runs)
        yield pa.record_batch(
            [batch.column(0), pa.array([len(r) for r in rows], type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array([len(s) for s in spans], type=pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, type=pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "text"],
        )

    return each


def _copies(documents: DataFrame) -> DataFrame:
    """copy_doc, copy_version, copy_at, copy_size: the places of the copies to cut out of each document that has any."""
    named = documents.select(*name_columns(documents), documents["text"])
    names, kind = ["doc", "version", "text"], "doc long, version int, at int, size int, again boolean, a long, b long"
    marks = mapped(named, names, kind, _marked)
    repeated = marks.groupBy("a", "b").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.max("again").alias("repeated")).filter("repeated OR first_doc < last_doc")
    shared = stored(repeated.select("a", "b", "first_doc"), "shared")
    # Most chunks stand once; the map keeps them out of the join, as far as its size reaches.
    bits = documents.sparkSession.sparkContext.broadcast(bit_map(shared.select(F.col("a").alias("key")), BITS))  # BITS / 8 bytes, whatever the input
    marks = mapped(named, names, kind, lambda batch: _marked(batch, bits))
    copies = marks.join(shared, ["a", "b"]).filter("again OR doc <> first_doc")
    return copies.groupBy("doc", "version").agg(F.collect_list("at").alias("copy_at"), F.collect_list("size").alias("copy_size")).withColumnsRenamed({"doc": "copy_doc", "version": "copy_version"})


def _with_copies(documents: DataFrame) -> DataFrame:
    """`documents` with copy_at and copy_size behind its own columns."""
    copies = _copies(documents)
    doc, version = name_columns(documents)
    same = (doc == copies["copy_doc"]) & (version == copies["copy_version"])
    return documents.join(copies, same, "left").select(*[documents[n] for n in documents.columns], copies["copy_at"], copies["copy_size"])


def deduplicated(documents: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges cut out) and text (what is left) for every row of `documents` (doc_id, text).

    A null text stays null and an empty one empty, with nothing removed. A run of copies
    goes if it has `run` bytes or is the whole text. Rows that share a doc_id are one
    document: repeated rows get the same result, different texts each their own, and none
    is a copy of another. A row without doc_id is a document named by its text, after all that
    have one. Other columns are ignored; an empty table gives no rows.
    """
    wide = _with_copies(doc_columns(documents, "doc_id", "text"))
    return mapped(wide, ["doc_id", "text", "copy_at", "copy_size"], "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, text string", _cut_out(run))


def with_cut_texts(documents: DataFrame, run: int = RUN) -> DataFrame:
    """`documents` with all its columns, and the copies cut out of text; see `deduplicated`."""
    names = documents.columns
    wide = _with_copies(documents)
    each, at = _cut_out(run), names.index("text")

    def cut(batches):
        for batch in batches:
            if batch.num_rows:
                n = len(names)
                (done,) = each(pa.record_batch([batch.column(names.index("doc_id")), batch.column(at), batch.column(n), batch.column(n + 1)], names=["doc_id", "text", "at", "size"]))
                yield pa.record_batch([done.column(5) if i == at else batch.column(i) for i in range(n)], names=names)
        trimmed()

    return wide.mapInArrow(cut, documents.schema)
