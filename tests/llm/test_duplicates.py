"""op1, op5, op7: near copies, passages and repeated strings, against brute force."""

import collections
import hashlib
import random
import re

import pytest
from brute import classes, cut, gear_cuts
from pyspark.sql import functions as F

from tidegate.llm import near_dup, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def words(rng, n, alphabet="abcdefghij"):
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 8))) for _ in range(n)]


def edge_rows():
    return [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "one two"), (905, "One  TWO"), (906, "x" * 50_000), (907, "é ü " * 5_000), (None, "one two"), (None, None)]


def clashing(df):
    """Extra columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit(1) for c in ("bands", "rep", "key", "n", "component", "at", "size", "from", "spans")})


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for base in range(6):
        text = words(rng, 150)
        for copy in range(8):
            own = list(text)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = "edit%d" % rng.randrange(9)
            rows.append((base * 10 + copy, " ".join(own)))
    rows += [r for r in edge_rows() if r[0] is not None]
    out = near_dup.near_duplicates(clashing(spark.createDataFrame(rows, DOCS))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_blocks(spark, monkeypatch):
    """A band of many members in many blocks loses no link."""
    rng = random.Random(5)
    text = words(rng, 120)
    rows = []
    for i in range(60):
        own = list(text)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    out = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == classes(rows)


def test_near_duplicates_edges(spark):
    empty = near_dup.near_duplicates(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = edge_rows() + [(903, "one two")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    assert sorted(r.component_id for r in out if r.n_shingles == 1 and r.doc_id in (903, 904, 905)) == [903] * 4
    assert [r.component_id for r in out if r.doc_id is None and r.n_shingles] == [903]
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([], DOCS), 50)


def test_near_duplicates_of_rows_that_share_names(spark):
    """Every row is a document with links of its own; a class without ids has none."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(100)) for k in "abc")
    near = a.replace("a50 ", "other ")
    rows = [(7, a), (7, b), (3, near), (9, b), (None, c), (None, c.replace("c50 ", "other ")), (None, near), (7, a)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in out)
    assert got == {(7, 3, False): 2, (7, 7, True): 1, (3, 3, True): 1, (9, 7, False): 1, (None, None, True): 2, (None, 3, False): 1}


def test_near_duplicates_that_chain(spark, monkeypatch):
    """Families in which neighbours are alike and ends are not: no link between different texts is lost."""
    rng = random.Random(13)
    rows = []
    for family in range(3):
        text = [f"f{family}w{i}" for i in range(120)]
        for copy in range(25):
            text = list(text)
            text[rng.randrange(120)] = f"f{family}c{copy}"
            rows.append((family * 100 + copy, " ".join(text)))
    rng.shuffle(rows)
    for block in (1024, 4):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        out = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == classes(rows)


def test_odd_sketch_estimates(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(400)]
    import numpy as np

    for share in (0.85, 0.95):
        cut = int(400 * share)
        sets = [np.unique(np.array(x, dtype=np.uint64)) for x in (base, base[:cut] + [rng.getrandbits(63) for _ in range(400 - cut)])]
        truth = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        a, b = near_dup.odd_sketches(near_dup.min_hashes(sets)).view(np.uint64)
        assert abs(float(near_dup.sketch_similarity(np.bitwise_count(a ^ b).sum())) - truth) < 0.15


def test_cuts_don_t_shift():
    rng = random.Random(2)
    text = " ".join(words(rng, 2000)).encode()
    one, two = substring_dedup.cuts([text, b"inserted " + text])
    assert len(set(one) & {c - 9 for c in two}) > 0.98 * len(one)
    assert substring_dedup.cuts([b""]) == [[]]
    long = substring_dedup.cuts([b"a" * 20_000, "é".encode() * 9_000])
    assert all(max(b - a for a, b in zip(m, m[1:], strict=False)) <= substring_dedup.LONGEST for m in long)


def test_cuts_byte_by_byte():
    rng = random.Random(12)
    texts = [b"", b"a", b"short", "é ü — ".encode() * 90, b"a" * 9_000, "é".encode() * 5_000, b"\0" * 60]
    texts += [" ".join(words(rng, rng.randint(1, 300))).encode() for _ in range(12)]
    texts += [rng.randbytes(700).decode("latin-1").encode() for _ in range(4)]
    assert substring_dedup.cuts(texts) == [gear_cuts(t) for t in texts]


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_substrings_by_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(substring_dedup, "BITS", bits)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    out = {r.doc_id: (r.text or "").encode() for r in substring_dedup.deduplicated(docs).collect()}
    assert out == cut(rows, substring_dedup.RUN)


def test_whole_copies_go_however_short(spark):
    rows = [(i, t) for k, t in enumerate(["a text of nineteen b", "one of fifty-nine bytes, which is two chunks or so, at most", "x"]) for i in (10 * k, 10 * k + 1)]
    out = {r.doc_id: (r.text, r.n_removed) for r in substring_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {i: (t, 0) if i % 10 == 0 else ("", len(t)) for i, t in rows}


def test_rows_that_share_a_name(spark):
    """Texts that share a doc_id are cut each by its own places; rows without one by their text."""
    rng = random.Random(8)
    passage, one, two = (" ".join(words(rng, 90)) for _ in range(3))
    rows = [(1, passage), (2, one + " " + passage), (2, two + " " + passage + " é"), (2, one + " " + passage), (3, two), (None, passage), (None, passage + " " + one), (None, passage)]
    out = substring_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        text = (r.text or "").encode()
        got.setdefault((r.doc_id, r.n_bytes), set()).add(text)
    size = lambda t: len(t.encode())
    assert got[1, size(passage)] == {passage.encode()}
    (first,) = got[2, size(rows[1][1])]
    (second,) = got[2, size(rows[2][1])]
    assert first.startswith(one[: size(one) - 60].encode()) and len(first) < size(one) + 120
    assert second.startswith(two[: size(two) - 60].encode()) and second.endswith("é".encode()) and len(second) < size(two) + 120
    assert got[None, size(passage)] == {b""}


def test_passages_go_and_other_text_stays(spark):
    rng = random.Random(4)
    passage = " ".join(words(rng, 60))
    clean = [(i, " ".join(words(rng, 200))) for i in range(20)]
    dirty = [(100 + i, " ".join(words(rng, rng.randint(20, 90))) + " " + passage + " " + " ".join(words(rng, 80))) for i in range(10)]
    rows = clean + dirty
    out = {r.doc_id: r for r in substring_dedup.deduplicated(clashing(spark.createDataFrame(rows, DOCS))).collect()}
    assert all(out[i].text == t and out[i].n_removed == 0 for i, t in clean + dirty[:1])
    for i, t in dirty[1:]:
        assert out[i].n_removed > 0.4 * len(passage) and passage not in out[i].text
        left, at = b"", 0
        for s in out[i].spans:
            left += t.encode()[at : s.start]
            at = s.end
        assert (left + t.encode()[at:]).decode() == out[i].text


def test_passages_edges(spark):
    assert substring_dedup.deduplicated(spark.createDataFrame([], DOCS)).collect() == []
    long = "word " * 200 + "end"
    rows = edge_rows() + [(1, long), (1, long), (2, long)]
    out = substring_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    assert {r.text for r in out if r.doc_id == 900} == {None}
    assert len({r.text for r in out if r.doc_id == 1}) == 1
    df = spark.createDataFrame([(1, long, "x"), (2, long, None)], DOCS + ", lang string")
    assert substring_dedup.with_cut_texts(df).columns == df.columns


def removed(rows, length=400):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        count.update(t[k : k + length] for k in range(len(t) - length + 1))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [1024, 5])
def test_repeated_strings_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(6)
    passage = " ".join(words(rng, 120))
    rows = [(i, " ".join(words(rng, rng.randint(0, 60))) + passage[: rng.randint(300, len(passage))] + " ".join(words(rng, rng.randint(0, 60)))) for i in range(30)]
    rows += [(50, passage), (51, passage), (52, "ab" * 1000), (53, "z" * 450), (54, "z" * 399), (55, passage + "|" + passage), (60, None), (61, ""), (62, "é" * 700)]
    out = suffix_dedup.deduplicated(clashing(spark.createDataFrame(rows, DOCS))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == removed(rows)


def test_repeated_strings_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = suffix_dedup.deduplicated(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == removed([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_strings_edges(spark):
    assert suffix_dedup.deduplicated(spark.createDataFrame([], DOCS)).collect() == []
    rows = edge_rows() + [(1, "q w e " * 100), (1, "q w e " * 100)]
    out = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows) and {r.n_removed for r in out if r.doc_id == 1} == {600}


@pytest.mark.parametrize("block", [1024, 3])
def test_repeated_strings_of_rows_that_share_names(spark, monkeypatch, block):
    """Every row is a text: shared ids with different texts, no ids, rows that repeat each other."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(9)
    texts = [" ".join(words(rng, 150)) for _ in range(4)]
    passage = " ".join(words(rng, 110))
    rows = [(1, texts[0]), (1, texts[1] + passage), (1, passage + texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[3]), (None, "é" + passage), (2, texts[0]), (2, texts[0]), (3, None), (None, None)]
    rows += [(10 + i, passage[:-40] + f"{i:04d}" * 12 + " ".join(words(rng, 9))) for i in range(12)]
    want = removed([(k, t) for k, (_, t) in enumerate(rows)])
    out = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == collections.Counter((i, *want[k]) for k, (i, _) in enumerate(rows))


def test_hot_keys_are_cut_again(spark, monkeypatch):
    """Many different segments of one key, at every level and down to single windows."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2)
    rng = random.Random(10)
    core = "".join(rng.choices("abcdefghij ", k=405))
    rows = [(i, "".join(rng.choices("klmnop", k=rng.randint(0, 60))) + core[rng.randint(0, 30) : 405 - rng.randint(0, 30)] + "".join(rng.choices("qrstuv", k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(100 + i, core + str(i)) for i in range(3)]
    out = suffix_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == removed(rows)


def test_column_wise_construction():
    rng = random.Random(7)
    for trial in range(60):
        texts = [bytes(rng.choices(b"ab" if trial % 2 else b"abcde", k=rng.randint(1, 90))) for _ in range(rng.randint(1, 12))]
        symbols, shared = suffix_dedup.construct(texts)
        letters = sorted({b for t in texts for b in t})
        suffixes = sorted(([b + 1 for b in t[i:]] + [j - 1000], letters.index(t[i - 1]) + 1 if i else 0) for j, t in enumerate(texts) for i in range(len(t) + 1))
        assert [s for _, s in suffixes] == symbols.tolist()

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
                n += 1
            return n

        assert shared.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
