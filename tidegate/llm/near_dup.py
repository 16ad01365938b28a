"""Near-duplicate documents: MinHash bands for candidates, odd sketches to screen them, whole sets to confirm.

1. Each document becomes its set of distinct 5-word shingles (64-bit hashes), 128
   MinHash samples, 32 band keys of 4 samples each, and an odd sketch: each sample
   flips one bit of a 512-bit map, so that the XOR of two maps has about as many
   ones as the samples in which the sets differ. A second odd sketch, of 1024 bits, is
   folded from all shingles: the ones of its XOR are never more than the shingles that
   only one of two sets has, which rules pairs out with certainty.
2. Equal sets become one representative first, so copies cost an aggregate only.
3. Every representative is compared with the smallest one of each of its bands by
   sketch, and with the likeliest of these by whole set; links found so are joined
   into classes.
4. What is left are pairs of different classes in one band. Of each band the largest
   class stands once, and only members of other classes go to the blocks of bounded size
   that it is cut into, and to the blocks of each other: pairs within the largest class
   are never made, so a hot band that is nearly one class costs in proportion to its
   rows. Each member tries its likeliest partner in a block; members that had more then try
   the likeliest of each class that they are not in by now, and those for which that failed
   and which had still more try all. No partner is capped.

A pair of similarity 0.85 shares no band with a chance below 1e-10, and the screen
lies eight standard deviations under it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import SPACED, Words, byte_rows, chunks, doc_columns, gram_hashes, mapped, mix, scratch, signed, stored, trimmed

SHINGLE = 5
SAMPLES = 128
BAND_ROWS = 4
SKETCH_BITS = 512
SET_BITS = 1024
#: Pairs whose sketches put them below this are not confirmed.
SCREEN = 0.6
#: Members of a band, at about, that are in one block.
BLOCK = 1024
#: Pairs whose sketches are compared in one go.
AT_ONCE = 1 << 16

_U = np.uint64
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
_SALTS = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)


def shingle_sets(rows: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = Words(rows, SPACED)
    grams = gram_hashes(words.hashes, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            g = np.sort(grams[a : b - SHINGLE + 1])
            keep = np.empty(len(g), dtype=bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            out.append(g[keep])
        else:
            out.append(gram_hashes(words.hashes[a:b], b - a) if b > a else grams[:0])
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of samples for each set; none may be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SAMPLES, len(sets)), dtype=np.uint64)
    turned = np.empty_like(flat)
    for k in range(SAMPLES):
        np.multiply(flat, _FACTORS[k], out=turned)
        out[k] = np.minimum.reduceat(turned, starts)
    return out.T


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    bits = (mix(samples ^ _SALTS) >> _U(32)).astype(np.int64) % SKETCH_BITS
    counts = np.zeros((len(samples), SKETCH_BITS), dtype=np.uint8)
    np.add.at(counts, (np.arange(len(samples))[:, None], bits), 1)
    return np.packbits(counts & 1, axis=1)


def sketch_similarity(ones: np.ndarray) -> np.ndarray:
    """The similarity for so many ones in the XOR of two sketches."""
    left = np.maximum(1 - 2 * ones / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(left)


def _signatures(batch: pa.RecordBatch):
    rows = byte_rows(batch.column(2))
    for lo, hi in chunks(rows):
        sets = shingle_sets(rows[lo:hi])
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        n = hi - lo
        digests = set_digests(sets)
        bands: list = [None] * n
        sketches: list = [None] * n
        parities: list = [None] * n
        full = np.flatnonzero(sizes)
        if len(full):
            own = [sets[i] for i in full]
            samples = min_hashes(own)
            keys = np.zeros((len(full), SAMPLES // BAND_ROWS), dtype=np.uint64)
            for r in range(BAND_ROWS):
                keys = mix(keys * _U(3) + samples[:, r::BAND_ROWS])
            keys = mix(keys + _SALTS[: keys.shape[1]])
            for i, k, s, own_set in zip(full.tolist(), signed(keys), odd_sketches(samples), own, strict=True):
                bands[i], sketches[i] = k, s.tobytes()
                flips = np.bincount((own_set >> _U(40)).astype(np.int64) % SET_BITS, minlength=SET_BITS)
                parities[i] = np.packbits((flips & 1).astype(np.uint8)).tobytes()
        yield pa.record_batch(
            [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sizes), pa.array(signed(digests[0])), pa.array(signed(digests[1])), pa.array(bands, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary()), pa.array(parities, type=pa.binary())],
            names=["doc_id", "at", "n_shingles", "set_a", "set_b", "bands", "sketch", "parity"],
        )


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two rows of digests, of which each set has one column; zeros for empty sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((2, len(sets)), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        flat = np.concatenate([sets[i] for i in full])
        for k in range(2):
            out[k, full] = mix(np.add.reduceat(mix(flat + _SALTS[k]), starts) + sizes[full].astype(np.uint64))
    return out


def _sets(batch: pa.RecordBatch):
    rows = byte_rows(batch.column(0))
    for lo, hi in chunks(rows):
        sets = shingle_sets(rows[lo:hi])
        digests = set_digests(sets)
        yield pa.record_batch([pa.array(signed(digests[0])), pa.array(signed(digests[1])), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["set_a", "set_b", "shingles"])


def _alike(percent: int):
    def each(batch: pa.RecordBatch):
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return each


def _packed(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _rated(percent: int):
    """Pairs that their sketches leave open, with a rate: the smaller, the likelier."""

    def each(batch: pa.RecordBatch):
        ones = _ones(_packed(batch.column(2).to_pylist()) ^ _packed(batch.column(3).to_pylist()))
        odd = _ones(_packed(batch.column(4).to_pylist()) ^ _packed(batch.column(5).to_pylist()))
        sizes = batch.column(6).to_numpy() + batch.column(7).to_numpy()
        is_open = pa.array(_may_be_alike(odd, sizes, percent) & (sketch_similarity(ones) >= SCREEN))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_rate(ones, odd, sizes))], names=["u", "v", "rate"]).filter(is_open)

    return each


def _may_be_alike(odd: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """By the ones of the XOR of their sets' parities and the sum of their sizes."""
    return odd * (100 + percent) <= sizes * (100 - percent)


def _rate(ones: np.ndarray, odd: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return (ones + 1) * (odd + 1) / sizes


class _Groups:
    """Rows of whole groups, sorted by group, as arrays."""

    LONGS = ("band", "a", "b", "rep", "component", "n_shingles")
    FLAGS = ("left", "right")
    PACKED = ("sketch", "parity")

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Groups:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return cls({n: at[n].to_numpy(zero_copy_only=False) for n in cls.LONGS + cls.FLAGS} | {n: _packed(at[n].to_pylist()) for n in cls.PACKED})

    def followed_by(self, other: _Groups) -> _Groups:
        return _Groups({n: np.concatenate([v, other.columns[n]]) for n, v in self.columns.items()})

    def starts(self) -> np.ndarray:
        new = np.zeros(len(self.columns["band"]), dtype=bool)
        new[:1] = True
        for n in ("band", "a", "b"):
            new[1:] |= self.columns[n][1:] != self.columns[n][:-1]
        return np.flatnonzero(new)

    def split(self, at: int) -> tuple[_Groups, _Groups]:
        return _Groups({n: v[:at] for n, v in self.columns.items()}), _Groups({n: v[at:] for n, v in self.columns.items()})

    def pairs(self, percent: int, tries: str) -> pa.RecordBatch:
        """(u, v, more): open pairs of a left and a right row of different classes; for each left row the likeliest (`one`), that of each class (`class`), or `all`, and whether there were more."""
        c, starts = self.columns, self.starts()
        n = len(c["band"])
        group = np.searchsorted(starts, np.arange(n), "right") - 1
        lefts, rights = np.flatnonzero(c["left"]), np.flatnonzero(c["right"])
        held = np.bincount(group[rights], minlength=len(starts))
        first = np.cumsum(held) - held
        counts = held[group[lefts]]
        upto = np.cumsum(counts)
        found: list[tuple[np.ndarray, ...]] = []
        lo = done = 0
        while lo < len(lefts):
            hi = max(lo + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
            own = counts[lo:hi]
            i = np.repeat(lefts[lo:hi], own)
            j = rights[np.repeat(first[group[lefts[lo:hi]]], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
            x, y = c["n_shingles"][i], c["n_shingles"][j]
            ok = (c["component"][i] != c["component"][j]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            i, j, sizes = i[ok], j[ok], (x + y)[ok]
            odd = _ones(c["parity"][i] ^ c["parity"][j])
            ok = _may_be_alike(odd, sizes, percent)
            i, j, sizes, odd = i[ok], j[ok], sizes[ok], odd[ok]
            ones = _ones(c["sketch"][i] ^ c["sketch"][j])
            ok = sketch_similarity(ones) >= SCREEN
            i, j, rate = i[ok], j[ok], _rate(ones, odd, sizes)[ok]
            more = np.zeros(len(i), dtype=bool)
            if tries != "all" and len(i):
                of = c["component"][j] if tries == "class" else np.zeros(len(j), dtype=np.int64)
                order = np.lexsort((c["rep"][j], rate, of, i))
                i, j, of = i[order], j[order], of[order]
                new = np.ones(len(i), dtype=bool)
                new[1:] = (i[1:] != i[:-1]) | (of[1:] != of[:-1])
                at = np.flatnonzero(new)
                i, j, more = i[at], j[at], np.diff(np.append(at, len(order))) > 1
            found.append((c["rep"][i], c["rep"][j], more))
            done, lo = int(upto[hi - 1]), hi
        u, v, more = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(more)], names=["u", "v", "more"])


def _block_pairs(percent: int, tries: str):
    """Over rows sorted by group; a group is held until its last row is there, and is bounded by two blocks."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Groups.of(batch)
            rows = rows if held is None else held.followed_by(rows)
            whole, held = rows.split(int(rows.starts()[-1]))
            yield whole.pairs(percent, tries)
        if held is not None:
            yield held.pairs(percent, tries)
        trimmed()

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of representatives whose whole sets are alike enough."""
    wide = pairs.select("u", "v").join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    return stored(mapped(wide, ["u", "v", "x", "y"], "u long, v long", _alike(percent)), "links")


def _left_over(labelled: DataFrame, reps: DataFrame, percent: int, tries: str) -> DataFrame:
    """Open pairs (u, v, more) of different classes in one band, from (band, rep, component, moves): rows that move go to all blocks of those that don't, and of each other."""
    counts = labelled.groupBy("band").agg(F.count(F.when(~F.col("moves"), 1)).alias("still"), F.count(F.when(F.col("moves"), 1)).alias("moving")).filter("moving > 0")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    left = labelled.join(counts.select("band", blocks("still").alias("still"), blocks("moving").alias("moving")), "band")
    left = left.withColumn("part", F.pmod(F.xxhash64("rep"), F.when(F.col("moves"), F.col("moving")).otherwise(F.col("still"))).cast("int"))
    part, upto = F.col("part"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    slot = lambda a, b, x, y: F.struct(a.alias("a"), b.alias("b"), x.alias("left"), y.alias("right"))
    stays = F.transform(upto("moving"), lambda i: slot(i, part, F.lit(False), F.lit(True)))
    goes = F.transform(upto("still"), lambda i: slot(part, i, F.lit(True), F.lit(False)))
    meets = F.transform(upto("moving"), lambda i: slot(F.least(part, i), F.col("still") + F.greatest(part, i), part <= i, part >= i))
    each = left.select("band", "rep", "component", F.explode(F.when(F.col("moves"), F.concat(goes, meets)).otherwise(stays)).alias("slot")).select("band", "slot.*", "rep", "component")
    wide = each.join(reps.select("rep", "n_shingles", "sketch", "parity"), "rep").select(*_Groups.LONGS, *_Groups.FLAGS, *_Groups.PACKED)
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = wide.repartition(tasks, "band", "a", "b").sortWithinPartitions("band", "a", "b")
    found = groups.mapInArrow(_block_pairs(percent, tries), "u long, v long, more boolean")
    return stored(found.groupBy("u", "v").agg(F.max("more").alias("more")), "pairs")


def _relabelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """`classes` (node, component) of more nodes than links join, after further links between nodes."""
    if links.isEmpty():
        return classes
    of = lambda c: classes.toDF(c, f"{c}_class")
    between = links.join(of("u"), "u").join(of("v"), "v").select(F.col("u_class").alias("u"), F.col("v_class").alias("v")).filter("u <> v")
    joined = components(between).toDF("component", "low")
    return stored(classes.join(joined, "component", "left").select("node", F.coalesce("low", "component").alias("component")), "classes")


def _classed(documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marks of all rows, the representatives of equal sets, and the classes (node, component) of those that share a band."""
    docs = doc_columns(documents, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("at"), "text")
    marks = stored(mapped(docs, ["doc_id", "at", "text"], "doc_id long, at long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary, parity binary", _signatures), "marks")
    grouped = marks.filter("n_shingles > 0").groupBy("set_a", "set_b")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")
    firsts = [F.min_by(c, order).alias(c) for c in ("doc_id", "at", "n_shingles", "bands", "sketch", "parity")]
    # Once stored, numbers stay what they are.
    reps = stored(grouped.agg(*firsts).withColumn("rep", F.monotonically_increasing_id()), "reps")

    in_bands = reps.select("rep", F.explode("bands").alias("band"))
    hubs = in_bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1").select("band", "hub")
    shared = stored(in_bands.join(hubs, "band"), "shared")
    in_any = stored(shared.select("rep").distinct(), "nodes")

    # The whole sets of representatives that share a band, each from its first row.
    wanted = reps.join(in_any, "rep", "left_semi").select("rep", "doc_id", "at", "set_a", "set_b")
    first_rows = docs.join(wanted.select(F.col("doc_id").alias("own_id"), F.col("at").alias("own_at")), (F.col("at") == F.col("own_at")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
    whole = mapped(first_rows, ["text"], "set_a long, set_b long, shingles binary", _sets).dropDuplicates(["set_a", "set_b"])
    sets = stored(wanted.join(whole, ["set_a", "set_b"]).select("rep", "shingles"), "sets")

    first = shared.filter("hub < rep").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    marked = reps.select("rep", "sketch", "parity", "n_shingles")
    wide = first.join(marked.toDF("u", "x", "xp", "xn"), "u").join(marked.toDF("v", "y", "yp", "yn"), "v")
    rated = mapped(wide, ["u", "v", "x", "y", "xp", "yp", "xn", "yn"], "u long, v long, rate double", _rated(percent))
    likeliest = stored(rated.groupBy("u").agg(F.min_by("v", F.struct("rate", "v")).alias("v")), "pairs")
    joined = components(_confirmed(likeliest, sets, percent))
    classes = stored(in_any.join(joined.toDF("rep", "component"), "rep", "left").select(F.col("rep").alias("node"), F.coalesce("component", "rep").alias("component")), "classes")

    # Of each band, all but its largest class move.
    labelled = stored(shared.select("band", "rep").join(classes.toDF("rep", "component"), "rep"), "labelled")
    largest = labelled.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("n")).filter("n > 1").select("band", "largest")
    pairs = _left_over(labelled.join(stored(largest, "largest"), "band").withColumn("moves", F.col("component") != F.col("largest")), reps, percent, "one")
    classes = _relabelled(classes, _confirmed(pairs, sets, percent))

    # Then only those move that have had more partners; at last, those that had more of a class that they are not in now.
    for tries in ("class", "all"):
        more = pairs.filter("more")
        if tries == "all":
            of = lambda c, classes=classes: classes.toDF(c, f"{c}_class")
            more = more.join(of("u"), "u").join(of("v"), "v").filter("u_class <> v_class")
        more = stored(more.select(F.col("u").alias("rep")).distinct().withColumn("moves", F.lit(True)), "more")
        if more.isEmpty():
            break
        again = shared.select("band", "rep").join(classes.toDF("rep", "component"), "rep").join(more, "rep", "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
        pairs = _left_over(again, reps, percent, tries)
        classes = _relabelled(classes, _confirmed(pairs, sets, percent))
    return marks, reps, classes


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `documents` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their shingle
    sets. Null and empty texts have no set and no links. Every row is a document of its
    own: rows may repeat, and rows that share a doc_id may have different texts, each with
    its own links. A row without doc_id links as others do; the component is the
    smallest doc_id of a class, or null if no row of it has one. Other columns are ignored.
    An empty table gives no rows. `percent` may be 80 to 100; below, the bands would miss
    links.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    with scratch(documents.sparkSession) as kept:
        marks, reps, classes = _classed(documents, percent)
        kept += [marks, reps, classes]
    named = reps.join(classes.toDF("rep", "component"), "rep", "left").select("doc_id", "set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = named.drop("doc_id").join(smallest, "component").drop("component")
    rows = marks.select("doc_id", "n_shingles", "set_a", "set_b").join(by_set, ["set_a", "set_b"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
