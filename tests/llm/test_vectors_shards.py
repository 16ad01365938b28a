"""op3 and op10: shards along the curve, exact top-k; and the pipeline as a whole."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import components, hilbert, top_k

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_neighbours(spark, dimensions, bits):
    side = 1 << bits
    df = spark.range(side**dimensions)
    levels = [F.expr(f"cast(id div {side**d} as bigint) % {side}") for d in range(dimensions)]
    rows = df.select(*[c.alias(f"x{d}") for d, c in enumerate(levels)], hilbert.hilbert_index(levels, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**dimensions))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1


def shards_hold(rows, texts, n):
    assert len(rows) == len(texts)
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(n)) <= 1
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)


def test_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = hilbert.hilbert_shards(docs).collect()
    shards_hold(rows, [r.text for r in docs.collect()], 24)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in ordered] == sorted(r.hilbert for r in rows)
    hilbert.write_shards(docs, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_shards_edges(spark):
    schema = "doc_id bigint, text string, lang string, source string, shard int, hilbert int, total int, n int"
    assert hilbert.hilbert_shards(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "same", "en", "s", 0, 0, 0, 0)] * 500 + [(None, None, None, None, 9, 9, 9, 9), (2, "", None, "s", 0, 0, 0, 0), (3, "é" * 100_000, "fr", None, 0, 0, 0, 0)]
    shards_hold(hilbert.hilbert_shards(spark.createDataFrame(rows, schema)).collect(), [r[1] for r in rows], 24)


def test_equal_texts_stay_together(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "PARTS", 7)
    schema = "doc_id bigint, text string, lang string, source string"
    rows = [(i * 31 % 997, f"text number {i % 40}" if i % 3 else "the same", "en", "s") for i in range(900)] + [(5, "the same", "en", "s")] * 60
    out = hilbert.hilbert_shards(spark.createDataFrame(rows, schema), 8).collect()
    shards_hold(out, [r[1] for r in rows], 8)
    order = [r.text_crc32 for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    runs = collections.Counter(a for a, b in zip(order, [None, *order], strict=False) if a != b)
    sizes = collections.Counter(r.size for r in out)
    # Texts of one cell (here: of one size class) form one run each.
    assert set(runs.values()) == {1} and len(sizes) > 1


VECTORS = "vec_id bigint, embedding array<float>"


def by_hand(rows, k=20, every=20):
    seen = {i: np.floor(64 * np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in seen.items():
        if i % every == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for j, v in seen.items() if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (50, 3)])
def test_top_k_by_hand(spark, monkeypatch, blocks):
    monkeypatch.setattr(top_k, "BLOCK", blocks[0])
    monkeypatch.setattr(top_k, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=8) * rng.exponential()).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(90)] + [(1000, [0.0] * 8), (1001, None), (None, [1.0] * 8), (1003, [float("nan")] * 8), (1004, [None] + [1.0] * 7), (1020, [1e6] * 8)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("dim", "norm", "block", "vector")})
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df).collect()) == by_hand(rows)


def test_top_k_edges(spark):
    assert top_k.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [3.0]), (40, [])]
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(spark.createDataFrame(rows, VECTORS)).collect())
    assert out == [(0, 1, 1, 64 * 64 + 128 * 64)]


@pytest.mark.parametrize("values", [1 << 20, 3000])
def test_top_k_of_long_vectors_keeps_the_driver_small(spark, monkeypatch, values):
    monkeypatch.setattr(top_k, "VALUES", values)
    rng = np.random.default_rng(3)
    strong = rng.normal(size=(4, 900))
    rows = [(i, (rng.normal(size=4) @ strong + 0.1 * rng.normal(size=900)).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=1 + i % 40).astype(np.float32).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS)
    vectors = top_k.mapped(df, ["vec_id", "embedding"], "vec_id long, dim int, norm double, vector binary", top_k._integers)
    turns = top_k.rotation(vectors)
    assert len(turns) <= top_k.TURNED and turns[900].shape == (900, top_k.HEAD)
    assert np.allclose(turns[900].T @ turns[900], np.eye(top_k.HEAD))
    long = np.array([v for _, v in rows[:60]])
    assert ((long @ turns[900]) ** 2).sum() > 0.9 * (long**2).sum()
    blocks = top_k._blocks(vectors, top_k.BLOCK).collect()
    assert max(len(b.ids) // 8 * b.dim for b in blocks if len(b.ids) > 8) <= 2 * values
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df).collect()) == by_hand(rows)


@pytest.mark.parametrize("blocks", [(4096, 1024), (3, 2)])
def test_top_k_of_repeated_rows_and_ties(spark, monkeypatch, blocks):
    monkeypatch.setattr(top_k, "BLOCK", blocks[0])
    monkeypatch.setattr(top_k, "QUERY_BLOCK", blocks[1])
    one, two = [1.0, 0.0], [0.5, 0.5]
    rows = [(0, one), (1, one), (1, one), (3, two)] + [(20, two), (20, two)] + [(100 + i, one) for i in range(30)]
    out = [tuple(r) for r in top_k.top_k(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()]
    full = [(1, 4096), (1, 4096)] + [(100 + i, 4096) for i in range(18)]
    half = [(0, 2048), (1, 2048), (1, 2048), (3, 2048)] + [(100 + i, 2048) for i in range(16)]
    want = [(0, r, v, s) for r, (v, s) in enumerate(full, 1)] + [(20, r, v, s) for r, (v, s) in enumerate(half, 1)]
    want += [(100, r, v, s) for r, (v, s) in enumerate([(0, 4096), *full[:2], *[(101 + i, 4096) for i in range(17)]], 1)]
    want += [(120, r, v, s) for r, (v, s) in enumerate([(0, 4096), *full[:2], *[(100 + i, 4096) for i in range(17)]], 1)]
    assert out == want


def test_top_k_asks_for_few_ranges(spark, monkeypatch):
    """Spark sends keys of each range to the driver, so their number must not grow with the rows."""
    asked = []
    ranged = type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, n, *columns: asked.append(n) or ranged(self, n, *columns))
    monkeypatch.setattr(top_k, "RANGES", 3, raising=False)
    monkeypatch.setattr(top_k, "BLOCK", 4)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 2)
    random.seed(11)
    rows = [(i, [random.gauss(0, 1) for _ in range(3 if i % 4 else 2)]) for i in range(160)]
    rows += [(1000 + i, rows[40][1]) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(df).collect()) == by_hand(rows)
    assert asked and max(asked) <= 3
    vectors = top_k.mapped(df, ["vec_id", "embedding"], "vec_id long, dim int, norm double, vector binary", top_k._integers)
    blocks = top_k._blocks(vectors, 4).collect()
    assert all(len(b.ids) <= 4 * 8 for b in blocks) and len({b.block for b in blocks}) == len(blocks)
    assert sorted(i for b in blocks for i in np.frombuffer(b.ids, dtype=np.int64).tolist()) == sorted(i for i, _ in rows)


def test_top_k_broadcasts_no_copies_of_queries(spark):
    """Each row of tasks has a copy of the queries; together they may be larger than the driver, however small the queries are."""
    random.seed(13)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    out = top_k.top_k(spark.createDataFrame(rows, VECTORS))
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "longest" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out.collect()) == by_hand(rows)


@pytest.mark.parametrize(("tasks", "queries", "candidates"), [(12, 1, 3), (600, 1, 5722), (600, 1145, 5722), (211, 3, 3), (4, 100, 100), (1, 5, 1)])
def test_top_k_grid(tasks, queries, candidates):
    down, across = top_k.grid(tasks, queries, candidates)
    assert 1 <= across <= queries and 1 <= down <= candidates and down * across <= tasks + across
    # No more copies than queries in every task make.
    assert down * queries * top_k.QUERY_BLOCK + across * candidates * top_k.BLOCK <= tasks * queries * top_k.QUERY_BLOCK + candidates * top_k.BLOCK


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, None), (7, 7)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in links:
        if v is not None:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert out == {i: root(i) for i in list(parent)}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total, now = docs.count(), docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.stored(stage(spark, now, SF), name)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert 0.7 * total < now.count() <= total
    assert {r.n for r in now.select((F.char_length("text") - F.col("n_chars")).alias("n")).distinct().collect()} == {0}
    out = pipeline.run(spark, SF)
    assert out.count() == now.count() and out.filter("n_tokens * 4 <> octet_length(ids)").count() == 0
