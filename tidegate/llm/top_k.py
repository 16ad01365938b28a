"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are made integer, floor(64 * x). Their strongest right singular vectors (from their
Gram matrix, summed in the cluster; for long vectors from its products with a few random
ones) rotate them, so that the first dimensions carry most of the length; what is left of a
vector is what these directions don't hold. So the driver has a few directions for a few
lengths of vectors, however long and many they are. Candidates are dealt by length, longest first, into blocks of a
bounded number of rows, and queries into blocks likewise. A first round runs each query
block against the block of the longest candidates, which gives each query a floor: its
k-th result so far. The second round meets only the pairs of blocks in which the longest
query times the longest candidate reaches the lowest floor (the join's condition, on two
numbers; its tasks are a grid of groups of blocks), and leaves out, in turn, queries whose floor exceeds |q| * |longest of the block|,
and candidates whose partial sum over the first dimensions plus the product of what is left
of both lengths stays below the floor. What remains is scored exactly, and only results
that come before the floor, by score, then vec_id, go on.

Bounds are taken with a margin for rounding, so no pair is lost; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import doc_columns, mapped, small_batches, stored, trimmed

SCALE = 64
BLOCK = 4096
QUERY_BLOCK = 1024
HEAD = 16
#: Numbers that the vectors of a block have together at most: long vectors make blocks of fewer rows.
VALUES = 1 << 20
#: Ranges of vectors, at most, however many rows there are; a range makes any number of blocks.
RANGES = 512
#: Vectors up to this length have their whole Gram matrix summed, longer ones its products with so many random vectors.
WHOLE = 256
SKETCH = 24
#: Lengths of vectors that are rotated, those with most rows, and the longest of them. Others stay as they are: any rotation is exact.
TURNED = 8
LONG = 8192


def whole_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and integer vectors (as double) of the rows that take part."""
    ids, out = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not v.is_valid:
            continue
        values = v.values
        if values.null_count:
            continue
        x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
        if np.isfinite(x).all():
            ids.append(i)
            out.append(np.floor(SCALE * x))
    return np.array(ids, dtype=np.int64), out


def _integers(batch: pa.RecordBatch):
    ids, rows = whole_vectors(batch)
    yield pa.record_batch([pa.array(ids), pa.array([len(x) for x in rows], type=pa.int32()), pa.array([float(np.sqrt(x @ x)) for x in rows], type=pa.float64()), pa.array([x.tobytes() for x in rows], type=pa.binary())], names=["vec_id", "dim", "norm", "vector"])


def _stack(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.float64).reshape(len(values), -1)


def _probes(dim: int) -> np.ndarray:
    """What the Gram matrix is multiplied by."""
    return np.eye(dim) if dim <= WHOLE else np.random.default_rng(dim).standard_normal((dim, SKETCH))


def _grams(lengths: list[int]):
    def each(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.intersect1d(dims, lengths).tolist():
                x = _stack(batch.filter(pa.array(dims == dim)).column(1).to_pylist())
                x = x / np.abs(x).max(initial=1.0)
                sums[dim] = sums.get(dim, 0) + x.T @ (x @ _probes(dim))
        yield pa.record_batch([pa.array(list(sums), type=pa.int32()), pa.array([m.tobytes() for m in sums.values()], type=pa.binary())], names=["dim", "gram"])

    return each


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g) for g in table.column("gram").to_pylist())
    return pa.table({"dim": table.column("dim").slice(0, 1), "gram": pa.array([total.tobytes()], type=pa.binary())})


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For the TURNED most frequent lengths of vectors, the HEAD strongest of their right singular vectors, as columns. Any directions are exact; these prune best."""
    small_batches(vectors.sparkSession)
    held = doc_columns(vectors, "dim", "vector").filter(f"dim > 0 AND dim <= {LONG}")
    lengths = [r.dim for r in held.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(TURNED).collect()]
    kind = "dim int, gram binary"
    each = held.filter(F.col("dim").isin(lengths)).mapInArrow(_grams(lengths), kind).withColumn("slot", F.spark_partition_id() % 32)
    whole = each.groupBy("dim", "slot").applyInArrow(_summed, kind).groupBy("dim").applyInArrow(_summed, kind)
    return {r.dim: np.linalg.svd(np.frombuffer(r.gram).reshape(r.dim, -1), full_matrices=False)[0][:, :HEAD].copy() for r in whole.collect()}  # LONG * SKETCH numbers for each of TURNED lengths


def _shrunk(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest form that holds them, named by the first byte."""
    peak = np.abs(x).max(initial=0)
    kind = "h" if peak < 2**15 else "i" if peak < 2**31 else "d"
    return kind.encode() + x.astype(kind).tobytes()


def _widened(packed: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=chr(packed[0]), offset=1).astype(np.float64).reshape(rows, -1) if rows and len(packed) > 1 else np.zeros((rows, 0))


BLOCKS = "dim int, block long, longest double, ids binary, vectors binary"


def _pack(block: int, table: pa.Table) -> pa.RecordBatch:
    """One row for all rows of a block, which come by descending norm."""
    row = [table.column("dim")[0].as_py(), block, table.column("norm")[0].as_py(), table.column("vec_id").to_numpy().tobytes(), _shrunk(_stack(table.column("vector").to_pylist()))]
    return pa.record_batch([pa.array([x], type=t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "block", "longest", "ids", "vectors"])


def _cut(size: int, values: int):
    """Blocks of a range's sorted rows, one after the other: what is held is a block and a batch."""

    def most(dim: int) -> int:
        return max(1, min(size, values // max(dim, 1)))

    def each(batches):
        held: list[pa.RecordBatch] = []
        dim, count, block = None, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            dims, at = batch.column(1).to_numpy(), 0
            while at < len(dims):
                if held and (dims[at] != dim or count >= most(dim)):
                    yield _pack(block, pa.Table.from_batches(held))
                    held, count, block = [], 0, block + 1
                dim = int(dims[at])
                others = np.flatnonzero(dims[at:] != dim)
                n = min(int(others[0]) if len(others) else len(dims) - at, most(dim) - count)
                held.append(batch.slice(at, n))
                at, count = at + n, count + n
        if held:
            yield _pack(block, pa.Table.from_batches(held))
        trimmed()

    return each


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (dim, block, longest, ids, vectors), blocks of `size` rows, and VALUES numbers, at most, by descending norm."""
    rows = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(VALUES / F.greatest("dim", F.lit(1)))))
    n = vectors.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max(F.ceil(F.col("n") / rows))).first()[0]
    if not n:
        return vectors.sparkSession.createDataFrame([], BLOCKS)
    # For each range Spark sends a few hundred keys to the driver. Ranges are cut row by row, so that a very frequent vector is spread too.
    ranged = vectors.repartitionByRange(min(n, RANGES), F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    return doc_columns(ranged.sortWithinPartitions(F.col("dim"), F.col("norm").desc(), F.col("vec_id")), "vec_id", "dim", "norm", "vector").mapInArrow(_cut(size, VALUES), BLOCKS)


def best_in(query: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, floor_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int):
    """(query row, vec_id, score) of the k best of a block for each query, of those that come before the query's floor. The columns of `turn` are unit vectors at right angles."""
    q_norm, v_norm = np.sqrt((query**2).sum(axis=1)), np.sqrt((vectors**2).sum(axis=1))
    slack = 1e-9 * (q_norm * v_norm.max(initial=0.0)) + 1e-6
    rows = np.flatnonzero(q_norm * v_norm.max(initial=0.0) + slack >= floor)
    if not len(rows) or not len(ids):
        return
    q_turn, v_turn = query[rows] @ turn, vectors @ turn
    q_rest, v_rest = (np.sqrt(((x - t @ turn.T) ** 2).sum(axis=1)) for x, t in ((query[rows], q_turn), (vectors, v_turn)))
    exact_doubles = q_norm.max() * v_norm.max() < 2**52
    for at in range(0, len(rows), 64):
        own = rows[at : at + 64]
        bound = q_turn[at : at + 64] @ v_turn.T + np.outer(q_rest[at : at + 64], v_rest)
        alive = bound + slack[own, None] >= floor[own, None]
        for j, r in enumerate(own.tolist()):
            c = np.flatnonzero(alive[j] & (ids != query_ids[r]))
            if exact_doubles:
                score = (vectors[c] @ query[r]).astype(np.int64)
            else:
                score = np.array([sum(int(a) * int(b) for a, b in zip(v, query[r], strict=True)) for v in vectors[c]], dtype=np.int64)
            keep = (score > floor[r]) | (score == floor[r]) & (ids[c] < floor_ids[r])
            c, score = c[keep], score[keep]
            if len(c) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= edge
                c, score = c[keep], score[keep]
            order = np.lexsort((ids[c], -score))[:k]
            for x, s in zip(ids[c][order].tolist(), score[order].tolist(), strict=True):
                yield r, x, s


def _scored(turns, k: int, seeded: bool):
    def each(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            query_ids, ids = np.frombuffer(row["query_ids"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)
            dim = row["dim"]
            query, vectors = _widened(row["queries"], len(query_ids)), _widened(row["vectors"], len(ids))
            floor = np.frombuffer(row["floors"], dtype=np.float64) if seeded else np.full(len(query_ids), -np.inf)
            floor_ids = np.frombuffer(row["floor_ids"], dtype=np.int64) if seeded else np.zeros(len(query_ids), dtype=np.int64)
            turn = turns.value[dim] if dim in turns.value else np.eye(dim, min(HEAD, dim))
            found = list(best_in(query, query_ids, floor, floor_ids, vectors, ids, turn, k))
            r = np.array([f[0] for f in found], dtype=np.int64)
            yield pa.record_batch([pa.array(query_ids[r]), pa.array([f[1] for f in found], type=pa.int64()), pa.array([f[2] for f in found], type=pa.int64())], names=["query_id", "vec_id", "score"])

    return each


def grid(tasks: int, queries: int, candidates: int) -> tuple[int, int]:
    """Rows and columns of a grid of about so many tasks for so many blocks: queries are copied to each row and candidates to each column, and all copies are fewest when both have as much."""
    across = round((tasks * queries * QUERY_BLOCK / (max(1, candidates) * BLOCK)) ** 0.5)
    across = max(1, min(across, queries, tasks))
    return max(1, min(-(-tasks // across), candidates)), across


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _floors(batch: pa.RecordBatch):
    """The floors of a block's queries, and the lowest."""
    floors, floor_ids, lowest = [], [], []
    for ids, at, low, low_ids in zip(*(batch.column(c).to_pylist() for c in (3, 5, 6, 7)), strict=True):
        known = dict(zip(at or [], zip(low or [], low_ids or [], strict=True), strict=True))
        own = [known.get(i, (-np.inf, 0)) for i in np.frombuffer(ids, dtype=np.int64).tolist()]
        floors.append(np.array([f for f, _ in own], dtype=np.float64).tobytes())
        floor_ids.append(np.array([i for _, i in own], dtype=np.int64).tobytes())
        lowest.append(min((f for f, _ in own), default=-np.inf))
    yield pa.record_batch([*batch.columns[:5], pa.array(floors, type=pa.binary()), pa.array(floor_ids, type=pa.binary()), pa.array(lowest, type=pa.float64())], names=["dim", "block", "q_longest", "query_ids", "queries", "floors", "floor_ids", "lowest"])


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each row whose vec_id is divisible by `every` with all other rows (all of them, if fewer).

    Only vectors of the same length have a product. Rows whose vec_id or vector is null,
    or whose vector has null or non-finite components, take no part. Rows may repeat: each is
    a result of its own. A vec_id is a query's name: rows that share one ask once, with the
    first of their vectors by length, norm and bytes, and are no results of each other. Other
    columns are ignored; an empty table gives no rows.
    """
    names = "vec_id long, dim int, norm double, vector binary"
    vectors = stored(mapped(embeddings, ["vec_id", "embedding"], names, _integers), "vectors")
    asking = F.min(F.struct("dim", "norm", "vector")).alias("v")
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(asking).select("vec_id", "v.dim", "v.norm", "v.vector")
    spark = vectors.sparkSession
    turns = spark.sparkContext.broadcast(rotation(vectors))  # HEAD * LONG numbers for each of TURNED lengths, at most
    against = stored(_blocks(vectors, BLOCK), "blocks")
    asked = stored(_blocks(queries, QUERY_BLOCK).withColumnsRenamed({"ids": "query_ids", "vectors": "queries", "longest": "q_longest"}), "queries")

    first = against.groupBy("dim").agg(F.max_by("block", "longest").alias("first"))
    # A number for each length of vectors is sent to all; a shuffle by length would bring all candidates to a few tasks.
    marked = against.join(F.broadcast(first), "dim").withColumn("seed", F.col("block") == F.col("first"))
    columns = ["dim", "query_ids", "queries", "floors", "floor_ids", "ids", "vectors"]
    scores = "query_id long, vec_id long, score long"
    none = F.lit(None).cast("binary")
    seeds = asked.withColumns({"floors": none, "floor_ids": none}).join(marked.filter("seed").drop("block", "longest"), "dim")
    seeded = stored(mapped(seeds.repartition(F.col("block")), columns, scores, _scored(turns, k, False)), "seeds")

    # The k-th by score, then vec_id: ~x turns the order of vec_id round.
    last = F.min(F.struct("score", F.bitwise_not("vec_id").alias("turned"))).alias("last")
    low = seeded.groupBy("query_id").agg(last, F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id", F.col("last.score").alias("low"), F.bitwise_not("last.turned").alias("low_id"))
    listed = mapped(asked, ["dim", "block", "query_ids"], "dim int, block long, query_id long", _opened)
    by_block = listed.join(low, "query_id").groupBy("dim", "block").agg(*[F.collect_list(c).alias(c) for c in ("query_id", "low", "low_id")])
    wide = asked.join(by_block, ["dim", "block"], "left")
    floored = mapped(wide, ["dim", "block", "q_longest", "query_ids", "queries", "query_id", "low", "low_id"], "dim int, block long, q_longest double, query_ids binary, queries binary, floors binary, floor_ids binary, lowest double", _floors)
    # Tasks are a grid: a block of candidates goes to one row and all its columns, a block of queries to one column and all its rows; the bound decides
    # which pairs are made. The copies are shuffled and never broadcast, as they may be many where the queries are few.
    down, across = grid(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count(), against.count())
    there = floored.withColumnRenamed("block", "query_block").withColumn("column", F.pmod(F.hash("query_block"), F.lit(across))).withColumn("slot", _each(down)).hint("merge")
    here = marked.filter("NOT seed").withColumn("slot", F.pmod(F.hash("block"), F.lit(down))).withColumn("column", _each(across))
    reaches = F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("lowest")
    rest = there.alias("q").join(here.alias("c"), (F.col("q.dim") == F.col("c.dim")) & (F.col("q.slot") == F.col("c.slot")) & (F.col("q.column") == F.col("c.column")) & reaches).select("q.dim", "query_ids", "queries", "floors", "floor_ids", "ids", "vectors")
    others = mapped(rest, columns, scores, _scored(turns, k, True))

    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return seeded.union(others).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _opened(batch: pa.RecordBatch):
    for dim, block, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ids = np.frombuffer(ids, dtype=np.int64)
        yield pa.record_batch([pa.array([dim] * len(ids), type=pa.int32()), pa.array([block] * len(ids), type=pa.int64()), pa.array(ids)], names=["dim", "block", "query_id"])
