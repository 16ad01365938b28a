"""Single stages of the pipeline on small tables."""

from functools import partial

import pytest
import test_pipeline
from brute import classes

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(key, n=100):
    return [f"{key}{k}" for k in range(n)]


def near_duplicates(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    out = pipeline.near_duplicates(spark, docs, "").collect()
    return sorted(((r.doc_id, r.text) for r in out), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_near_copies_of_80_percent_go(spark):
    a, b, c = words("a"), words("a"), words("a")
    for k in (20, 60):
        b[k] = "other"  # 86 of 106 shingles: 0.81
    for k in (10, 30, 60):
        c[k] = "third"  # 81 of 111 with a: 0.73
    a, b, c = map(" ".join, (a, b, c))
    assert near_duplicates(spark, [(1, a), (2, b), (3, c)]) == [(1, a), (3, c)]


def test_repeated_and_null_ids(spark):
    a, b, c, d = (" ".join(words(k)) for k in "abcd")
    near = c.replace("c50 ", "other ")
    rows = [(7, a), (3, a), (3, a), (None, a), (None, b), (None, b), (5, near), (None, c), (6, d), (6, d), (None, None), (9, None), (9, None)]
    assert near_duplicates(spark, rows) == [(3, a), (5, near), (6, d), (9, None), (None, None), (None, b)]


def test_rows_by_brute_force_at_80(spark, monkeypatch):
    monkeypatch.setattr(test_pipeline, "classes", partial(classes, percent=80))
    test_pipeline.test_rows_by_brute_force(spark)


PASSAGE = " ".join(words("p", 60))
ROWS = [
    (1, "The house of the river and the stone stands in the valley. " + PASSAGE, "en", "a", 0),
    (2, "The house of the river and the stone stands in the valley. " + PASSAGE, "en", "a", 0),
    (2, "Something else that shares the id: the day and the night and the evening, " + PASSAGE + " and so on", None, "a", 0),
    (2, "Something else that shares the id: the day and the night and the evening, " + PASSAGE + " and so on", None, "a", 0),
    (None, "A row of no name at all, the morning of the second day of the week", None, None, 0),
    (None, "A row of no name at all, the morning of the second day of the week", None, None, 0),
    (None, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, None, "en", None, 0),
    (5, "12 34 !!", "en", "a", 0),
    (6, "x" * 60_000, "en", "a", 0),
    (7, "é ü " * 9_000, "de", "a", 0),
]


def stage(spark, name, rows, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.selectExpr("*", "1 AS row", "2 AS class", "3 AS at", "4 AS spans", "5 AS hits", "6 AS copy_doc")
    return dict(pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_every_stage_on_odd_rows(spark, name):
    """Nulls anywhere, empty and very long texts, repeated rows, ids that are shared, clashing columns, no rows."""
    empty = stage(spark, name, [])
    assert empty.collect() == []
    out = stage(spark, name, ROWS, extra=True)
    rows = out.collect()
    assert out.dtypes == empty.dtypes
    last = name == "tokens"
    if not last:
        assert out.columns == pipeline.COLUMNS
    ids = sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))
    if name == "language":
        texts = [r.text for r in rows]
        assert not {None, "", "12 34 !!"} & set(texts) and texts.count(ROWS[4][1]) in (0, 2) and all(r.lang for r in rows if r.text in (ROWS[2][1], ROWS[4][1]))
    elif name == "near_duplicates":
        assert [(r.doc_id, r.text) for r in rows if r.text and PASSAGE in r.text and r.text.startswith("The")] == [(1, ROWS[0][1])]
        assert sum(r.text == ROWS[4][1] for r in rows) == 1 and sum(r.text == ROWS[2][1] for r in rows) == 1
        assert ids == [1, 2, 3, 4, 6, 7, None, None] or ids == [1, 2, 3, 4, 5, 6, 7, None, None]
    elif name == "substrings":
        assert len(rows) == len(ROWS) and {r.n_chars for r in rows if r.doc_id == 1} == {len(ROWS[0][1])}
        assert {r.text for r in rows if r.doc_id == 2 and r.lang == "en"} == {""} and {r.text for r in rows if r.doc_id == 4} == {None}
        assert len({r.text for r in rows if r.doc_id == 2 and r.lang is None}) == 1
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize(("own", "want"), [(None, "256"), ("64", "64")])
def test_every_stage_bounds_what_the_reader_holds(spark, own, want):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    docs = spark.read.parquet(f"{test_pipeline.SF}/documents.parquet").limit(20)
    before = spark.conf.get(key)
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.unset(key)
            if own:
                spark.conf.set(key, own)
            stage(spark, docs, test_pipeline.SF)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
