"""LM scoring by deleted interpolation.

The model mixes a bigram and a unigram maximum-likelihood estimate with a uniform one,

    p(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1),

with weights for each bucket of the context's frequency c(v) (powers of two). The weights
come from expectation-maximisation on held-out counts: a seventh of the training
documents, against counts from which their own are deleted. Each text ends with one end
token, whose place before the text is the first word's context.

Tokens are never joined as rows. Documents are dealt into blocks; a block sends its
distinct n-grams, as sorted 64-bit hashes with their training counts, to ranges of hash
values, a range adds up the counts of all blocks and answers each in the order asked, and
the block, put together again, looks every token up. So an n-gram of any frequency counts
once for each block. A block sends nothing to ranges of which it has no n-gram, so there
are never more packed rows than distinct n-grams of blocks, and what moves grows with the
documents.

Expectation-maximisation sees the held-out estimates rounded to quarter octaves (factors of
2 ** 0.25), so that what reaches the driver is a bounded table; scores are not rounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACED, Words, byte_rows, chunks, doc_columns, mix, stored

#: Bytes of text in a block: a 64th of all, within these.
BLOCK_BYTES = (4 << 20, 32 << 20)
BUCKETS = 40
ROUNDS = 60
_U = np.uint64
_END = np.array([0x5851F42D4C957F2D], dtype=np.uint64)
_LEFT, _RIGHT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of equal place together, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def _unsqueezed(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _squeezed(np.diff(x, prepend=_U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(data, np.uint64), dtype=np.uint64)


@dataclass
class Tokens:
    """The tokens of a block's documents in order: hashes of words and of bigrams, and where documents begin."""

    words: np.ndarray
    bigrams: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(rows: list[bytes]) -> Tokens:
        parts, sizes = [], []
        for lo, hi in chunks(rows):
            w = Words(rows[lo:hi], SPACED)
            n = np.diff(w.first)
            parts.append(np.insert(w.hashes, w.first[1:], _END[0]))
            sizes.append(n + 1)
        words = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        first = np.cumsum(np.concatenate([[0], *sizes]).astype(np.int64))
        before = np.concatenate([_END, words[:-1]])
        return Tokens(words, mix(before * _LEFT + words * _RIGHT), first)

    def contexts(self, of_words: np.ndarray) -> np.ndarray:
        """The value of each token's context, from a value for each token; `end` stands before each document."""
        out = np.empty_like(of_words)
        out[1:] = of_words[:-1]
        if len(out):
            out[0] = of_words[-1]  # an end token too
        return out


def _ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hash values begins, and the end."""
    edges = np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _asked(ranges: int):
    def each(table: pa.Table) -> pa.Table:
        tokens = Tokens.of(byte_rows(table.column("text").combine_chunks()))
        weight = np.repeat(table.column("trains").to_numpy().astype(np.int64), np.diff(tokens.first))
        grams = []
        for hashes in (tokens.words, tokens.bigrams):
            found, back = np.unique(hashes, return_inverse=True)
            grams.append((found, np.bincount(back, weights=weight, minlength=len(found)).astype(np.uint32), _ranges(found, ranges)))
        rows = {c: [] for c in ("words", "word_counts", "bigrams", "bigram_counts")}
        (_, _, a), (_, _, b) = grams
        held = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
        for k in held:
            for (found, count, at), a, b in zip(grams, ("words", "bigrams"), ("word_counts", "bigram_counts"), strict=True):
                rows[a].append(_pack_sorted(found[at[k] : at[k + 1]]))
                rows[b].append(_squeezed(count[at[k] : at[k + 1]]))
        block, tuning = table.column("block")[0].as_py(), table.column("tunes")[0].as_py()
        return pa.table({"block": pa.array([block] * len(held), type=pa.int32()), "tunes": pa.array([tuning] * len(held), type=pa.bool_()), "range": pa.array(held, type=pa.int32()), **{k: pa.array(v, type=pa.binary()) for k, v in rows.items()}})

    return each


def _answered(table: pa.Table) -> pa.Table:
    tunes = table.column("tunes").to_pylist()
    out = {c: [] for c in ("words", "bigrams", "own_words", "own_bigrams")}
    stats = {}
    for kind, counts in (("words", "word_counts"), ("bigrams", "bigram_counts")):
        asked = [_unpack_sorted(x) for x in table.column(kind).to_pylist()]
        own = [_unsqueezed(x, np.uint32).astype(np.int64) for x in table.column(counts).to_pylist()]
        found, back = np.unique(np.concatenate(asked), return_inverse=True)
        flat = np.concatenate(own)
        total = np.bincount(back, weights=flat, minlength=len(found)).astype(np.uint64)
        tuned = np.concatenate([x if t else np.zeros_like(x) for x, t in zip(own, tunes, strict=True)])
        apart = np.bincount(back, weights=tuned, minlength=len(found)).astype(np.uint64)
        stats[kind] = (int(np.count_nonzero(total)), int(total.sum()), int(apart.sum()))
        at = 0
        for x, t in zip(asked, tunes, strict=True):
            here = back[at : at + len(x)]
            out[kind].append(_squeezed(total[here]))
            out[f"own_{kind}"].append(_squeezed(apart[here]) if t else None)
            at += len(x)
    n = table.num_rows
    spread = lambda v: pa.array([v] + [0] * (n - 1), type=pa.int64())
    return pa.table({"block": table.column("block"), "tunes": table.column("tunes"), "range": table.column("range"), "types": spread(stats["words"][0]), "tokens": spread(stats["words"][1]), "tuning_tokens": spread(stats["words"][2]), **{k: pa.array(v, type=pa.binary()) for k, v in out.items()}})


def _looked_up(tokens: Tokens, answers: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The counts of each token's word and bigram."""
    out = []
    order = np.argsort(answers.column("range").to_numpy())
    for kind, hashes in (("words", tokens.words), ("bigrams", tokens.bigrams)):
        column = answers.column(prefix + kind).to_pylist()
        counts = np.concatenate([_unsqueezed(column[i], np.uint64) for i in order]).astype(np.int64)
        out.append(counts[np.unique(hashes, return_inverse=True)[1]])
    return out[0], out[1]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(np.maximum(context, 1))).astype(np.int64) + (context > 0), BUCKETS - 1)


def _cells(total: int):
    """Held-out tokens by bucket and by both estimates in quarter octaves (-1000: none)."""

    def each(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens.of(byte_rows(docs.column("text").combine_chunks()))
        (w, b), (ow, ob) = _looked_up(tokens, answers), _looked_up(tokens, answers, "own_")
        w, b = w - ow, b - ob
        c = tokens.contexts(w)
        octaves = lambda p: np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), -1000).astype(np.int64)
        key = np.stack([_bucket(c), octaves(b / np.maximum(c, 1)), octaves(w / max(1, total))], axis=1)
        found, n = np.unique(key, axis=0, return_counts=True)
        return pa.table({"bucket": found[:, 0].copy(), "two": found[:, 1].copy(), "one": found[:, 2].copy(), "n": n.astype(np.int64)})

    return each


def mixture(cells: list[tuple[int, int, int, int]], types: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket, by expectation-maximisation over (bucket, two, one, n)."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    data = np.array(cells, dtype=np.float64).reshape(-1, 4)
    for bucket in range(BUCKETS):
        own = data[data[:, 0] == bucket]
        if bucket == 0:
            out[bucket] = [0.0, 0.9, 0.1]
        if not len(own):
            continue
        p = np.stack([*(np.where(own[:, k] > -1000, 2.0 ** (own[:, k] / 4), 0.0) for k in (1, 2)), np.full(len(own), 1 / (types + 1))], axis=1)
        weights = out[bucket].copy()
        for _ in range(ROUNDS):
            share = p * weights
            share *= (own[:, 3] / share.sum(axis=1))[:, None]
            # One count of each is added, so that no weight that a text may need is nought.
            weights = share.sum(axis=0) + ([0, 1, 1] if bucket == 0 else 1)
            weights /= weights.sum()
        out[bucket] = weights
    return out


def _scored(weights: np.ndarray, total: int, types: int):
    def each(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens.of(byte_rows(docs.column("text").combine_chunks()))
        w, b = _looked_up(tokens, answers)
        c = tokens.contexts(w)
        a = weights[_bucket(c)]
        p = a[:, 0] * b / np.maximum(c, 1) + a[:, 1] * w / max(1, total) + a[:, 2] / (types + 1)
        at = tokens.first[:-1]
        over = lambda x: np.add.reduceat(x, at)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": np.diff(tokens.first),
                "n_known": over((w > 0).astype(np.int64)),
                "train_tokens": np.full(len(at), total, dtype=np.int64),
                "base_score": over(np.log10((w + 1) / (total + types + 1))),
                "score": over(np.log10(p)),
            }
        )

    return each


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `documents` (doc_id, text).

    Words are lower-cased (A-Z only) and split at ASCII white space. Counts come from the
    rows whose crc32(doc_id) mod 7 is not 2; those of remainder 3 tune the weights. Null
    and empty texts have an end token only. A null doc_id is scored and learnt from.
    Repeated rows count as often as they stand there. Other columns are ignored; an empty
    table gives no rows.
    """
    docs = doc_columns(documents, "doc_id", "text")
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = (size or 0) + 8 * n
    blocks = max(1, -(-size // min(max(size // 64, BLOCK_BYTES[0]), BLOCK_BYTES[1])))
    of_tuning = max(1, round(blocks / 7))
    fold = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7, F.lit(0))
    place = F.xxhash64("doc_id", "text")
    dealt = docs.select(
        "doc_id",
        "text",
        (fold == 2).alias("held_out"),
        (fold != 2).alias("trains"),
        (fold == 3).alias("tunes"),
        F.when(fold == 3, F.pmod(place, F.lit(of_tuning))).otherwise(F.lit(of_tuning) + F.pmod(place, F.lit(max(1, blocks - of_tuning)))).cast("int").alias("block"),
    )
    asked = dealt.groupBy("block").applyInArrow(_asked(blocks), "block int, tunes boolean, range int, words binary, word_counts binary, bigrams binary, bigram_counts binary")
    answers = stored(
        asked.groupBy("range").applyInArrow(_answered, "block int, tunes boolean, range int, types long, tokens long, tuning_tokens long, words binary, bigrams binary, own_words binary, own_bigrams binary"),
        "answers",
    )
    types, total, apart = (int(x or 0) for x in answers.agg(F.sum("types"), F.sum("tokens"), F.sum("tuning_tokens")).first())
    tuning = dealt.filter("tunes").groupBy("block").cogroup(answers.filter("tunes").groupBy("block"))
    cells = tuning.applyInArrow(_cells(total - apart), "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = mixture([tuple(r) for r in cells.orderBy("bucket", "two", "one").collect()], types)  # as many cells as there are quarter octaves, whatever the input
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.select("block", "range", "words", "bigrams").groupBy("block")).applyInArrow(_scored(weights, total, types), schema)
