"""Sharding along a Hilbert curve, with DataFrame functions only.

Each document has three quantised dimensions: language and source (hashed) and the
logarithm of its size, 5 bits each. Documents are ordered by the Hilbert index of that
cell, then by a hash of their text, and the order is cut into shards whose row counts
differ by one at most (law `rows`). Documents of a shard are near each other in all three
dimensions, so the minima and maxima in a file's footer rule most files out. Equal texts of
one cell stand together, and only the edge of a shard parts them.

No global sort is made. Ranks come from counts: cells (at most 32,768) are summed up
along the curve, sub-buckets of a cell within it, texts within their sub-bucket, and the
parts of a text's copies within the text. A cell with a third of all rows falls into 256
sub-buckets, copies of one text into 4,096 parts by doc_id, all spread over tasks. The index
is worked out for cells, not for rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 5
SUB_BUCKETS = 256
#: Parts of the copies of a text, at most.
PARTS = 4096


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a point with `bits` bits in each dimension, as long; null if a level is null.

    Levels are turned into the curve's transposed form, from the highest bit down (each
    bit exchanges or inverts the lower bits of two dimensions), Gray coded, and the bits
    of all dimensions interleaved.
    """
    n = len(levels)

    def turned(x: Column, axis: int, bit: Column) -> Column:
        """One exchange or inversion; `x` is bound once, by an aggregate of one element."""
        return F.aggregate(F.array(F.lit(0)), x, lambda acc, _: exchanged(acc, axis, bit))

    def exchanged(x: Column, axis: int, bit: Column) -> Column:
        low = bit - 1
        swap = x[0].bitwiseXOR(x[axis]).bitwiseAND(low)
        is_set = x[axis].bitwiseAND(bit) != 0
        return F.transform(x, lambda v, j: F.when(is_set, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((j == 0) | (j == axis), v.bitwiseXOR(swap)).otherwise(v)))

    def level(x: Column, bit: Column) -> Column:
        for axis in range(n):
            x = turned(x, axis, bit)
        return x

    high = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
    point = F.array(*[c.cast("long") for c in levels])
    x = F.aggregate(high, point, level)
    gray = F.aggregate(F.array(*[F.lit(i) for i in range(1, n)]), x, lambda acc, i: F.transform(acc, lambda v, j: F.when(j == i, v.bitwiseXOR(F.element_at(acc, i))).otherwise(v)))

    def finished(acc: Column) -> Column:
        flip = F.aggregate(high, F.lit(0).cast("long"), lambda t, bit: F.when(acc[n - 1].bitwiseAND(bit) != 0, t.bitwiseXOR(bit - 1)).otherwise(t))
        return F.aggregate(F.array(F.lit(0)), acc, lambda a, _: F.transform(a, lambda v: v.bitwiseXOR(flip)))

    done = F.aggregate(F.array(F.lit(0)), gray, lambda acc, _: finished(acc))
    order = [(b, d) for b in range(bits - 1, -1, -1) for d in range(n)]

    def interleaved(acc: Column) -> Column:
        out = F.lit(0).cast("long")
        for place, (b, d) in enumerate(order):
            out = out + F.shiftleft(F.shiftright(acc[d], b).bitwiseAND(F.lit(1).cast("long")), len(order) - 1 - place)
        return out

    return F.element_at(F.transform(F.array(done), interleaved), 1)


def hilbert_shards(documents: DataFrame, shards: int = 24, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and hilbert for every row of `documents` (doc_id, text, lang, source), with the columns in `carry` besides.

    A null text counts as empty (size 8, crc32 0); null languages and sources are a level
    of their own; a null doc_id comes first among equals. Repeated rows are rows like
    others and get slots of their own. Other columns are ignored; an empty table gives no
    rows. grown_shard is null: under this law a further shard moves rows between all.
    """
    text = F.coalesce(documents["text"], F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    top = (1 << BITS) - 1
    named = lambda c: F.coalesce(F.crc32(documents[c].cast("string").cast("binary")) % top + 1, F.lit(0)).cast("int")
    cell = ["q_lang", "q_source", "q_size"]
    rows = documents.select(
        documents["doc_id"],
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        named("lang").alias("q_lang"),
        named("source").alias("q_source"),
        F.least(F.floor(F.log2(size)), F.lit(top)).cast("int").alias("q_size"),
        *[documents[c].alias(f"carried_{c}") for c in carry],
        F.xxhash64(text).alias("text_hash"),
        F.pmod(F.xxhash64(documents["doc_id"]), F.lit(PARTS)).cast("int").alias("part"),
    ).withColumn("sub", F.pmod("text_hash", F.lit(SUB_BUCKETS)).cast("int"))

    in_sub = Window.partitionBy(*cell, "sub").orderBy("text_hash", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*cell, "sub", "text_hash", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(in_sub), F.lit(0)))
    counts = parts.groupBy(*cell, "sub").agg(F.sum("n").alias("n"))
    # At most SUB_BUCKETS counts for each cell: a list of them is bounded.
    listed = counts.groupBy(*cell).agg(F.sum("n").alias("cell_n"), F.array_sort(F.collect_list(F.struct("sub", "n"))).alias("subs"))
    cells = listed.withColumn("hilbert", hilbert_index([F.col(c) for c in cell], BITS))
    along = Window.orderBy("hilbert")
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("total", F.sum("cell_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    summed = F.aggregate(
        "subs",
        F.struct(F.col("cell_start").cast("long").alias("next"), F.expr("cast(array() as array<struct<sub:int,start:long>>)").alias("out")),
        lambda acc, s: F.struct((acc["next"] + s["n"]).alias("next"), F.concat(acc["out"], F.array(F.struct(s["sub"].alias("sub"), acc["next"].alias("start")))).alias("out")),
    )
    starts = cells.select(*cell, "hilbert", "total", F.explode(summed["out"]).alias("s")).select(*cell, "hilbert", "total", "s.sub", "s.start")

    place = [*cell, "sub", "text_hash", "part"]
    begins = parts.join(starts, [*cell, "sub"]).select(*place, "hilbert", "total", (F.col("start") + F.col("before")).alias("begin"))
    own = Window.partitionBy(*place).orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(own)).join(begins, place)
    ranked = ranked.withColumn("at", F.col("begin") + F.col("nth") - 1).withColumn("shard", F.expr(f"(at * {shards}L) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


def write_shards(documents: DataFrame, path: str, shards: int = 24) -> None:
    """All columns of `documents` as Parquet, a folder for each shard, rows in slot order."""
    carried = tuple(c for c in documents.columns if c != "doc_id")
    placed = hilbert_shards(documents, shards, carried).drop("law", "grown_shard", "hilbert", "size", "text_crc32")
    # One key a shard would put a whole shard into one task; ranges of (shard, slot) keep files sorted and bounded.
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
