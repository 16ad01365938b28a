"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 2-, 3- and 4-grams within and at the edges of words (what
is not a letter counts as one gap). Each is hashed to a row of an embedding table; the
mean of the rows goes through a linear layer and a softmax. Table and layer are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled texts
(`SAMPLE` of each language, the smallest by a hash of text, so that rare languages are
learnt too), and a temperature is fitted on a part of the sample that training does not
see, so that scores are calibrated. The executors count the sampled texts' subwords; what
reaches the driver is one row of buckets for each, however long the text. A text is
rejected if its score is below a threshold under which `REJECTED` of that part's
correct texts fall, at most one half.

For prediction, table and layer are multiplied out once: a text's logits are the mean of
a small row for each subword, so whole texts of any length take one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import byte_rows, chunks, doc_columns, mapped, stored, trimmed

UNKNOWN = "und"
#: Texts of each language that the model learns from, at most.
SAMPLE = 1000
BUCKETS = 1 << 12
DIMENSIONS = 16
EPOCHS = 12
#: Steps at least; small samples are gone over more often.
STEPS = 1500
BATCH = 32
RATE = 40.0
REJECTED = 0.001
ORDERS = (2, 3, 4)

#: Bytes that are letters or parts of letters; all others, as one gap.
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_SPREAD = np.random.default_rng(4).integers(1, 2**32, (max(ORDERS), 256), dtype=np.uint32)


def subwords(rows: list[bytes], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the subword that starts at each place (the last bucket: none there), and where rows begin."""
    buffer = _LETTER[np.frombuffer(b" " + b" ".join(rows) + b" " * (max(ORDERS) + 1), dtype=np.uint8)]
    begins = np.cumsum([0] + [len(r) + 1 for r in rows])
    n = int(begins[-1]) + 1
    gap = buffer == 0
    out = []
    for order in ORDERS:
        h = _SPREAD[0][buffer[:n]]
        for j in range(1, order):
            h = h * np.uint32(0x01000193) + _SPREAD[j][buffer[j : n + j]]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        at = (h >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)
        # A gap may only be the first or the last byte of a subword.
        bad = gap[:n] & gap[1 : n + 1] if order == 2 else gap[1 : n + 1].copy()
        for j in range(2, order - 1):
            bad |= gap[j : n + j]
        at[bad] = buckets
        out.append(at)
    return out, begins


def features(rows: list[bytes], buckets: int) -> np.ndarray:
    """The share of each bucket in each row's subwords; zero for a row without any."""
    out = np.zeros((len(rows), buckets), dtype=np.float32)
    for lo, hi in chunks(rows):
        grams, begins = subwords(rows[lo:hi], buckets)
        for i in range(hi - lo):
            count = np.bincount(np.concatenate([g[begins[i] : begins[i + 1]] for g in grams]), minlength=buckets + 1)[:buckets]
            out[lo + i] = count / max(1, count.sum())
    return out


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    rows: np.ndarray  # (buckets + 1, languages); the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        buckets = len(self.rows) - 1
        out = np.empty((len(texts), len(self.langs)))
        if not self.langs:
            return out
        for lo, hi in chunks(texts):
            grams, begins = subwords(texts[lo:hi], buckets)
            sums = np.zeros((hi - lo, len(self.langs)))
            counts = np.zeros(hi - lo)
            for g in grams:
                counts += np.add.reduceat((g != buckets).astype(np.int32), begins[:-1])
                for k in range(len(self.langs)):
                    sums[:, k] += np.add.reduceat(self.rows[:, k][g], begins[:-1])
            out[lo:hi] = _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], buckets: int = BUCKETS) -> Model:
    """A model of the languages given; with no texts, one that knows none."""
    return train_on(features(texts, buckets), langs)


def train_on(x: np.ndarray, langs: list[str], dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rejected: float = REJECTED) -> Model:
    """The same from the texts' features."""
    names, buckets = tuple(sorted(set(langs))), x.shape[1]
    if not names:
        return Model((), np.zeros((buckets + 1, 0), dtype=np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(0)
    y = np.array([names.index(v) for v in langs])
    order = rng.permutation(len(y))
    aside, order = order[: len(y) // 5], order[len(y) // 5 :]
    table = rng.normal(0, 1 / np.sqrt(dimensions), (buckets, dimensions)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dimensions, len(names))).astype(np.float32), np.zeros(len(names), dtype=np.float32)
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(order))))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(order)
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            mean = x[at] @ table
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = error @ layer.T
            layer -= rate / 20 * (mean.T @ error)
            bias -= rate / 100 * error.sum(axis=0)
            table -= rate * (x[at].T @ back)
    own = aside if len(aside) else order
    logits = (x[own] @ table) @ layer + bias
    tried = [float(2**e) for e in np.arange(-1, 6.25, 0.25)]
    loss = [-np.log(_softmax(logits / t)[np.arange(len(own)), y[own]] + 1e-12).mean() for t in tried]
    temperature = tried[int(np.argmin(loss))]
    best = _softmax(logits / temperature)
    right = best[np.arange(len(own)), y[own]][best.argmax(axis=1) == y[own]]
    threshold = min(0.5, float(np.quantile(right, rejected))) if len(right) else 0.0
    return Model(names, np.vstack([table @ layer, np.zeros((1, len(names)), dtype=np.float32)]).astype(np.float32), bias, temperature, threshold)


def _counted(batch: pa.RecordBatch):
    """(at, lang, packed features) of sampled texts."""
    shares = [zstandard.compress(row.tobytes(), 1) for row in features(byte_rows(batch.column(2)), BUCKETS)]
    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(shares, type=pa.binary())], names=["at", "lang", "features"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows of (text, lang); `sample` bounds the texts of each language, whole ones, that it learns from.

    Hashes choose the texts; for each of them 4 bytes a bucket reach the driver, at most.
    Equal texts are one, of the language that comes first.
    """
    known = doc_columns(labelled, "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''").withColumn("at", F.xxhash64("text"))
    chosen = known.groupBy("at").agg(F.min("lang").alias("lang"))
    # First within parts of a language, so that no task sees all texts of a frequent one.
    for own in (Window.partitionBy("lang", F.pmod("at", F.lit(64))), Window.partitionBy("lang")):
        chosen = chosen.withColumn("n", F.row_number().over(own.orderBy("at"))).filter(F.col("n") <= sample).select("at", "lang")
    chosen = chosen.select("at", F.col("lang").alias("chosen"))
    texts = known.join(stored(chosen, "chosen"), "at").groupBy("at").agg(F.first("chosen").alias("lang"), F.min("text").alias("text"))
    picked = mapped(texts, ["at", "lang", "text"], "at long, lang string, features binary", _counted).orderBy("at").collect()
    rows = [np.frombuffer(zstandard.decompress(r.features), dtype=np.float32) for r in picked]
    return train_on(np.stack(rows) if rows else np.zeros((0, BUCKETS), dtype=np.float32), [r.lang for r in picked])


_ASCII = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predicted(model, batch: pa.RecordBatch):
    m: Model = model.value
    rows = byte_rows(batch.column(1))
    scores = m.scores(rows)
    best = scores.argmax(axis=1) if m.langs else np.zeros(len(rows), dtype=int)
    top = scores.max(axis=1) if m.langs else np.zeros(len(rows))
    langs = []
    for row, k in zip(rows, best.tolist(), strict=True):
        lettered = len(row) != len(row.translate(None, _ASCII)) if len(row) < 4096 else True
        if not lettered or len(row) >= 4096:
            lettered = has_letter(row.decode())
        langs.append(m.langs[k] if lettered and m.langs else UNKNOWN)
    named = np.array([v != UNKNOWN for v in langs])
    top = np.where(named, top, 0.0)
    yield pa.record_batch(
        [batch.column(0), pa.array(langs, type=pa.string()), pa.array(top, type=pa.float64()), pa.array(~named | (top < m.threshold))],
        names=["doc_id", "lang_pred", "score", "rejected"],
    )


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of `documents` (doc_id, text); nothing but the text decides.

    Null, empty and letterless texts are `und` with score 0 and rejected, as all texts are
    if the model knows no language. Repeated rows and a null doc_id are kept as they are;
    other columns are ignored; an empty table gives no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the input
    return mapped(documents, ["doc_id", "text"], "doc_id long, lang_pred string, score double, rejected boolean", lambda batch: _predicted(held, batch))


def recognised(documents: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """The rows of `documents` whose text the model doesn't reject, with all their columns; a null `lang` becomes the predicted one.

    `least` takes the place of the model's own threshold: the score below which a text is rejected.
    """
    held = documents.sparkSession.sparkContext.broadcast(model if least is None else replace(model, threshold=least))
    at, own = documents.columns.index("text"), documents.columns.index("lang")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                (marked,) = _predicted(held, pa.record_batch([batch.column(at)] * 2, names=["doc_id", "text"]))
                lang = batch.column(own)
                filled = pc.if_else(lang.is_null(), marked.column(1).cast(lang.type), lang)
                yield batch.set_column(own, batch.schema.field(own), filled).filter(pc.invert(marked.column(3)))
        trimmed()

    return documents.mapInArrow(run, documents.schema)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def evaluated(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: a model from the documents that are not held out predicts all. A null doc_id isn't held out."""
    model = fit(documents.filter(~is_held_out(documents["doc_id"])))
    return predict(documents, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
