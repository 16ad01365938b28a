"""Benchmark decontamination by winnowing.

Fingerprints are hashes of 5 consecutive words. In every window of 6 such hashes the
smallest is kept (ties: all of them), on either side, so any 10 words that a document
shares with a benchmark item have a fingerprint in common. Fingerprints of documents are
joined with those of the benchmark, and each hit is extended to the windows of 10 words
that hold it, which are joined with the benchmark's windows in turn.

Items of fewer than 10 words are one window of their own length; they are found through
hashes of that many words, without winnowing.

All of it are tables, so the benchmark may have any size. A bit map of `BITS` bits, the
only thing that goes to every task, holds the benchmark's fingerprints as a Bloom filter
of one hash would: it keeps most fingerprints of documents out of the join, and only that,
so a benchmark that fills it costs time but changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, Words, bit_map, byte_rows, chunks, doc_columns, gram_hashes, in_bits, mapped, signed, stored

WINDOW = 10
GRAM = 5
BITS = 1 << 26


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Where hashes are the smallest of some `width` neighbours; of fewer hashes, none are."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    low = grams[:n].copy()
    for j in range(1, width):
        np.minimum(low, grams[j : n + j], out=low)
    most = np.zeros(len(grams), dtype=np.uint64)
    for j in range(width):
        np.maximum(most[j : n + j], low, out=most[j : n + j])
    return np.flatnonzero(grams == most)


def _long_places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the fingerprints in rows with a window's words; those that cross rows are left out."""
    grams = gram_hashes(words.hashes, GRAM)
    at = winnowed(grams, WINDOW - GRAM + 1)
    row = np.searchsorted(words.first, at, "right") - 1
    # Windows that cross rows only add fingerprints; a gram that does is no row's.
    at = at[(at + GRAM <= words.first[row + 1]) & (words.first[row + 1] - words.first[row] >= WINDOW)]
    return grams[at], at


def _item_keys(batch: pa.RecordBatch):
    """(item_id, size of a window, fingerprints, windows) of each item that has words."""
    ids, sizes, keys, windows = [], [], [], []
    for item, row in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
        words = Words([row], ALNUM)
        n = len(words.hashes)
        if n:
            own = gram_hashes(words.hashes, min(n, WINDOW))
            ids.append(item)
            sizes.append(min(n, WINDOW))
            windows.append(signed(np.unique(own)))
            keys.append(signed(np.unique(_long_places(words)[0])) if n >= WINDOW else windows[-1])
    yield pa.record_batch([pa.array(ids, type=pa.int64()), pa.array(sizes, type=pa.int32()), pa.array(keys, type=pa.list_(pa.int64())), pa.array(windows, type=pa.list_(pa.int64()))], names=["item_id", "size", "keys", "windows"])


_HIT = pa.struct([("key", pa.int64()), ("size", pa.int32()), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))])


def _doc_hits(bits, short: list[int]):
    def each(batch: pa.RecordBatch):
        rows = byte_rows(batch.column(2))
        for lo, hi in chunks(rows):
            words = Words(rows[lo:hi], ALNUM)
            first = words.first
            hits: list[list[dict]] = [[] for _ in range(hi - lo)]
            keys, at = _long_places(words)
            seen = in_bits(bits.value, keys)
            if seen.any():
                windows = gram_hashes(words.hashes, WINDOW)
                for key, p in zip(signed(keys[seen]).tolist(), at[seen].tolist(), strict=True):
                    r = int(np.searchsorted(first, p, "right")) - 1
                    a, b = max(int(first[r]), p - (WINDOW - GRAM)), min(p, int(first[r + 1]) - WINDOW)
                    hits[r].append({"key": key, "size": WINDOW, "starts": list(range(a - int(first[r]), b + 1 - int(first[r]))), "windows": signed(windows[a : b + 1])})
            for n in short:
                grams = gram_hashes(words.hashes, n)
                at = np.flatnonzero(in_bits(bits.value, grams))
                row = np.searchsorted(first, at, "right") - 1
                inside = at + n <= first[row + 1]
                at, row = at[inside], row[inside]
                order = np.lexsort((at, grams[at], row))
                at, row = at[order], row[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (grams[at[1:]] != grams[at[:-1]])
                edges = np.append(np.flatnonzero(new), len(at)).tolist()
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    r, own = int(row[a]), at[a:b]
                    hits[r].append({"key": int(signed(grams[at[a : a + 1]])[0]), "size": n, "starts": own - first[r], "windows": signed(grams[own])})
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first), type=pa.int64()), pa.array([h or None for h in hits], type=pa.list_(_HIT))],
                names=["doc_id", "at", "n_words", "hits"],
            )

    return each


def _spans(batch: pa.RecordBatch):
    """Ranges (start, end) of words from a list of windows (start, size)."""
    out = []
    for own in batch.column(2).to_pylist():
        spans: list[dict] = []
        for w in sorted(own, key=lambda w: w["start"]):
            a, b = w["start"], w["start"] + w["size"]
            if spans and a <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], b)
            else:
                spans.append({"start": a, "end": b})
        out.append(spans)
    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["hit_id", "hit_at", "spans"])


def _windows(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, at, n_words) of every document; (doc_id, at, start, size, window) of those with words in the benchmark's windows; the latter's (window, item_id)."""
    spark = documents.sparkSession
    items = doc_columns(benchmark, "item_id", "text").filter("text IS NOT NULL").distinct()
    items = stored(mapped(items, ["item_id", "text"], "item_id long, size int, keys array<long>, windows array<long>", _item_keys), "items")
    keys = items.select(F.explode("keys").alias("key")).distinct()
    windows = items.select(F.explode("windows").alias("window"), "item_id").distinct()
    short = sorted(r.size for r in items.select(F.col("size")).distinct().collect() if r.size < WINDOW)  # nine sizes at most
    bits = spark.sparkContext.broadcast(bit_map(keys, BITS))  # BITS / 8 bytes, whatever the input

    docs = doc_columns(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("at"), "text")
    schema = "doc_id long, at long, n_words long, hits array<struct<key:long,size:int,starts:array<int>,windows:array<long>>>"
    marks = stored(mapped(docs, ["doc_id", "at", "text"], schema, _doc_hits(bits, short)), "marks")
    hits = marks.filter("hits IS NOT NULL").select("doc_id", "at", F.explode("hits").alias("hit")).select("doc_id", "at", "hit.*").join(keys, "key", "left_semi")
    extended = hits.select("doc_id", "at", "size", F.explode(F.arrays_zip("starts", "windows")).alias("w")).select("doc_id", "at", F.col("w.starts").alias("start"), "size", F.col("w.windows").alias("window"))
    found = extended.join(windows.select("window").distinct(), "window", "left_semi").distinct()
    return marks.select("doc_id", "at", "n_words"), stored(found, "found"), windows


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `documents` that hold no benchmark window, with all their columns."""
    _, found, _ = _windows(documents, benchmark)
    hit = found.select(F.col("doc_id").alias("hit_id"), F.col("at").alias("hit_at")).distinct()
    same = documents["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(documents["text"]) == hit["hit_at"])
    return documents.join(hit, same, "left_anti")


def occurrences(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (ranges of words inside benchmark windows) and items (their ids) for every row of `documents` (doc_id, text), given `benchmark` (item_id, text).

    Words are runs of ASCII letters and digits and of all that is not ASCII, in lower
    case (A-Z only). Null and empty texts have no words; such items match nothing. Items
    may repeat. Every row of documents gives a row: rows may repeat, and rows that share
    a doc_id, or have none, may have different texts. The windows of an item without item_id
    are hits as others are, but it is not in the list of items. Other columns are ignored; an
    empty table on either side is valid.
    """
    marks, found, windows = _windows(documents, benchmark)
    places = found.groupBy("doc_id", "at").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    spans = mapped(places, ["doc_id", "at", "places"], "hit_id long, hit_at long, spans array<struct<start:long,end:long>>", _spans)
    items = found.join(windows, "window").groupBy("doc_id", "at").agg(F.array_sort(F.collect_set("item_id")).alias("items")).toDF("item_doc", "item_at", "items")
    same = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("at") == F.col(b))
    wide = marks.join(spans, same("hit_id", "hit_at"), "left").join(items, same("item_doc", "item_at"), "left")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})")).alias(c)
    return wide.select("doc_id", "n_words", none("spans", "array<struct<start:long,end:long>>"), none("items", "array<long>"))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see `occurrences`."""
    named = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = occurrences(documents, benchmark).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)
