"""op2, op4, op6, op8, op9: scores, languages, contamination, tokens and main text."""

import collections
import hashlib
import math
import random
import re
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import contamination

from tidegate.llm import bpe, decontaminate, html_text, language_id, language_model, shared

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "1 2 $"), (904, "x" * 30_000), (905, "é ü " * 3_000), (None, "one two"), (906, "one two"), (906, "one two")]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("block", "range", "words", "score", "spans", "items", "ids", "host", "template", "lang_pred")})


def fold(i):
    return zlib.crc32(str(i).encode()) % 7


@pytest.mark.parametrize("bounds", [None, (20_000, 40_000)])
def test_base_scores_by_definition(spark, monkeypatch, bounds):
    if bounds:
        monkeypatch.setattr(language_model, "BLOCK_BYTES", bounds)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in language_model.scored(clashing(docs)).collect()}
    texts = {r.doc_id: [w for w in re.split(rb"[ \t-\r]+", r.text.encode().translate(LOWER)) if w] + [None] for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if fold(i) != 2 for w in t)
    total, types = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 2, len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_by_definition(spark, monkeypatch):
    weights = np.tile([0.6, 0.3, 0.1], (language_model.BUCKETS, 1))
    weights[0] = [0, 0.8, 0.2]
    monkeypatch.setattr(language_model, "mixture", lambda cells, types: weights)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randint(0, 12)))) for i in range(60)]
    out = {r.doc_id: r.score for r in language_model.scored(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {i: ["</s>", *t.split(), "</s>"] for i, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        if fold(i) != 2:
            one.update(t[1:])
            two.update(zip(t, t[1:], strict=False))
    total, types = sum(one.values()), len(one)
    for i, t in texts.items():
        want = 0.0
        for v, w in zip(t, t[1:], strict=False):
            a = weights[1] if one[v] else weights[0]
            want += math.log10(a[0] * two[v, w] / max(1, one[v]) + a[1] * one[w] / total + a[2] / (types + 1))
        assert math.isclose(out[i], want, rel_tol=1e-9)


def test_learned_scores_by_plain_em(spark):
    """The whole model by dictionaries: counts, deleted counts, buckets, expectation-maximisation and scores."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(names, weights=range(1, 31), k=rng.randint(0, 25)))) for i in range(150)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w4 w3")]
    out = collections.defaultdict(set)
    for r in language_model.scored(spark.createDataFrame(rows, DOCS)).collect():
        out[r.doc_id, r.n_tokens].add(round(r.score, 9))
    part = lambda i: 0 if i is None else fold(i)
    texts = [(i, ["</s>", *t.split(), "</s>"]) for i, t in rows]

    def counts(keep):
        one, two = collections.Counter(), collections.Counter()
        for i, t in texts:
            if keep(part(i)):
                one.update(t[1:])
                two.update(zip(t, t[1:], strict=False))
        return one, two, sum(one.values())

    one, two, total = counts(lambda k: k != 2)
    rest_one, rest_two, rest_total = counts(lambda k: k not in (2, 3))
    types = len(one)
    bucket = lambda c: 0 if c == 0 else min(math.ceil(math.log2(c)) + 1, language_model.BUCKETS - 1)
    rounded = lambda p: 2.0 ** (round(4 * math.log2(p)) / 4) if p else 0.0
    tokens = collections.defaultdict(list)
    for i, t in texts:
        if part(i) == 3:
            for v, w in zip(t, t[1:], strict=False):
                c = rest_one[v]
                tokens[bucket(c)].append((rounded(rest_two[v, w] / max(1, c)), rounded(rest_one[w] / rest_total), 1 / (types + 1)))
    weights = {}
    for b in range(language_model.BUCKETS):
        a = [0.0, 0.9, 0.1] if b == 0 else [0.4, 0.5, 0.1]
        for _ in range(60 if tokens[b] else 0):
            share = [0.0 if b == 0 else 1.0, 1.0, 1.0]
            for p in tokens[b]:
                whole = sum(x * y for x, y in zip(a, p, strict=True))
                share = [s + x * y / whole for s, x, y in zip(share, a, p, strict=True)]
            a = [s / sum(share) for s in share]
        weights[b] = a
    assert len([b for b in tokens if tokens[b]]) > 3
    for i, t in texts:
        want = 0.0
        for v, w in zip(t, t[1:], strict=False):
            a = weights[bucket(one[v])]
            want += math.log10(a[0] * two[v, w] / max(1, one[v]) + a[1] * one[w] / total + a[2] / (types + 1))
        assert any(math.isclose(got, want, rel_tol=1e-7, abs_tol=1e-7) for got in out[i, len(t) - 1])


def test_mixture_learns():
    cells = [(3, -4, -20, 900), (3, -1000, -20, 100)]
    weights = language_model.mixture(cells, 1000)
    assert weights[3][0] > 0.8 and math.isclose(weights[3].sum(), 1)


def test_scores_edges(spark):
    assert language_model.scored(spark.createDataFrame([], DOCS)).collect() == []
    out = language_model.scored(spark.createDataFrame(EDGES, DOCS)).collect()
    assert len(out) == len(EDGES) and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in out)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.evaluated(clashing(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.02
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def plain_subwords(text, buckets):
    """The buckets of a text's subwords, byte by byte."""
    letters = [b | 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 0 for b in b" " + text + b" " * 5]
    out = []
    for at in range(len(text) + 1):
        for order in language_id.ORDERS:
            own = letters[at : at + order]
            # A gap stands at the first or the last place only; two letters at least, or one beside a gap.
            if any(x == 0 for x in own[1:-1]) or order == 2 and own == [0, 0] or order > 2 and own[1] == 0:
                continue
            h = int(language_id._SPREAD[0][own[0]])
            for j, x in enumerate(own[1:], 1):
                h = (h * 0x01000193 + int(language_id._SPREAD[j][x])) % 2**32
            h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
            out.append(h >> (32 - (buckets.bit_length() - 1)))
    return out


def test_language_by_plain_loops(spark):
    """Features, logits, scores and rejection of a trained model, one subword at a time."""
    texts = ["the cat and the dog", "Der Hund, und die Katze!", "le chien; et le chat", "a", "x9y", "", "é", "12 34", "zzz qqq vvv kkk jjj"] + [f"the {w} of it" for w in ("tree", "house", "river", "stone")] + [f"der {w} ist" for w in ("baum", "haus", "fluss", "stein")]
    langs = ["en", "de", "fr"] + ["en"] * 6 + ["en"] * 4 + ["de"] * 4
    model = language_id.train([t.encode() for t in texts], langs)
    buckets = len(model.rows) - 1
    rows = language_id.predict(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    got = language_id.features([t.encode() for t in texts], buckets)
    for i, text in enumerate(texts):
        grams = plain_subwords(text.encode(), buckets)
        counts = collections.Counter(grams)
        assert {b: n / len(grams) for b, n in counts.items()} == pytest.approx({int(b): float(got[i, b]) for b in np.flatnonzero(got[i])}, rel=1e-5)
        logits = [sum(float(model.rows[b, k]) for b in grams) / max(1, len(grams)) + float(model.bias[k]) for k in range(len(model.langs))]
        weights = [math.exp((x - max(logits)) / model.temperature) for x in logits]
        best = max(weights) / sum(weights)
        r = next(r for r in rows if r.doc_id == i)
        if any(c.isalpha() for c in text):
            assert r.lang_pred == model.langs[weights.index(max(weights))] and math.isclose(r.score, best, rel_tol=1e-4) and r.rejected == (best < model.threshold)
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


def test_language_sample_is_bounded_by_language(spark):
    rows = [(f"the thing number {i} " + "very " * (i % 7) + "long", "en") for i in range(300)] + [(f"das ding nummer {i}", "de") for i in range(4)] + [("le mot " * 50_000, "fr"), ("le mot", None), (None, "fr"), ("x", "")]
    seen = []
    real = language_id.train_on
    try:
        language_id.train_on = lambda x, langs: seen.append(collections.Counter(langs)) or real(x, langs)
        model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    finally:
        language_id.train_on = real
    assert seen == [{"en": 20, "de": 4, "fr": 1}] and model.langs == ("de", "en", "fr")


def test_recognised_rows(spark):
    rows = [(1, "the cat and the dog", None, 5), (2, "the cat and the dog", "xx", 5), (3, "12", None, 5), (None, None, None, 5), (4, "the of and", None, 5)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, score int")
    model = language_id.train([b"the cat and the dog", b"der hund und die katze"] * 9, ["en", "de"] * 9)
    kept = {r.doc_id: r.lang for r in language_id.recognised(docs, model).collect()}
    assert kept.items() >= {1: "en", 2: "xx"}.items() and 3 not in kept and None not in kept
    assert language_id.recognised(docs, model, 1.1).count() == 0


def test_language_edges(spark):
    schema = DOCS + ", lang string"
    assert language_id.evaluated(spark.createDataFrame([], schema)).collect() == []
    rows = [(*r, None) for r in EDGES] + [(i, "the of and", "en") for i in range(9)]
    out = language_id.evaluated(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902, 903)} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id in (904, 906)} == {"en"} and all(0 <= r.score <= 1 for r in out)
    unlabelled = language_id.evaluated(spark.createDataFrame([(*r, None) for r in EDGES], schema)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_contamination_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 40])))) for i in range(25)] + [(99, None), (7, "w1 w2")]
    rows = []
    for i in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        source = rng.choice(items)[1] or ""
        text[5:5] = source.upper().split()[rng.randint(0, 3) :]
        rows.append((i, "-".join(text) if i % 2 else " ".join(text)))
    rows += [r for r in EDGES if r[0] is not None and r[0] != 906]
    docs, bench = clashing(spark.createDataFrame(rows, DOCS)), spark.createDataFrame(items, "item_id bigint, text string")
    out = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, bench).collect()}
    raw = [(i, t and t.encode()) for i, t in items]
    assert out == {i: contamination((t or "").encode(), raw) for i, t in rows}
    clean = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert clean == {i for i, v in out.items() if not v[1]}


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_contamination_of_repeated_rows(spark, monkeypatch, bits):
    """Rows stay rows, whatever they share; a bit map that is full changes nothing."""
    monkeypatch.setattr(decontaminate, "BITS", bits)
    item = " ".join(f"item{k}" for k in range(14))
    items = [(1, item), (1, item), (2, "tiny phrase"), (None, " ".join(f"other{k}" for k in range(11))), (3, None)]
    rows = [(5, "x " + item), (5, "x " + item), (5, "clean"), (None, "a tiny phrase"), (None, "a tiny phrase"), (6, "y other0 other1 " + " ".join(f"other{k}" for k in range(11))), (7, item[: item.rindex(" ")])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    out = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.contamination(docs, bench).collect()))
    named, nameless = [(i, t and t.encode()) for i, t in items if i], [(0, t.encode()) for i, t in items if i is None]
    want = []
    for i, t in rows:
        a, b = contamination(t.encode(), named), contamination(t.encode(), nameless)
        want.append((i or 0, a[0], a[1] + b[1], *a[2:]))
    assert out == sorted(want) and sum(r[2] for r in out) == 14 + 14 + 2 + 2 + 11 + 13
    kept = sorted((r.doc_id or 0, r.text) for r in decontaminate.clean(docs, bench).collect())
    assert kept == [(5, "clean")]


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 20])
def test_bit_maps(spark, bits):
    rng = random.Random(bits)
    keys = [rng.getrandbits(64) for _ in range(500)] + [0, 2**64 - 1, 2**63]
    rows = spark.createDataFrame([(k - (k >> 63 << 64),) for k in keys * 2], "key bigint")
    got = shared.bit_map(rows, bits)
    assert len(got) == bits // 64 and sum(int(x).bit_count() for x in got) == len({k % bits for k in keys})
    asked = np.array(keys + [rng.getrandbits(64) for _ in range(500)], dtype=np.uint64)
    assert shared.in_bits(got, asked).tolist() == [int(k) % bits in {x % bits for x in keys} for k in asked]
    assert not shared.bit_map(rows.limit(0), bits).any()


def test_contamination_edges(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), bench).collect() == []
    out = decontaminate.contamination(spark.createDataFrame(EDGES, DOCS), bench).collect()
    assert len(out) == len(EDGES) and not any(r.contaminated for r in out)
    assert {r.items_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}


@pytest.fixture(scope="module")
def encoders():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, PATTERN)


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_tokens_of_any_text(encoders, text):
    theirs, ours = encoders
    ids = ours.encode(text)
    assert ids == packed(theirs.encode_ordinary(text)) and ours.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ab" * 3000, "é" * 3000, "  \n\n  x", "it's  they'll 123456 ---", "\x1c\x85  ", "日本語" * 200, "𐻅𠀀" * 40, "!" * 700])
def test_tokens_of_hard_texts(encoders, text):
    theirs, ours = encoders
    assert ours.encode(text) == packed(theirs.encode_ordinary(text))


def test_trees_agree(encoders):
    ours = encoders[1]
    rng = random.Random(1)
    raws = [bytes(rng.choices(b"etaoin shrdlu", k=rng.randint(1, 16))) for _ in range(500)]
    assert bpe.merge_rows(raws, 16, ours.pieces.pairs) == [packed(bpe.merge(r, ours.pieces.ranks)) for r in raws]


def test_round_trip_on_documents(spark, encoders):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(EDGES, DOCS))
    texts = [t for (t,) in docs.select("text").collect()]
    out = bpe.round_trip(clashing(docs), PATH, PATTERN).collect()
    want = [packed(encoders[0].encode_ordinary(t or "")) for t in texts]
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out] == [(len(w) // 4, hashlib.sha256(w).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for w, t in zip(want, texts, strict=True)]
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r.data).decode() for r in back] == [t or "" for t in texts]
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_vocabulary_leaves_workers_with_other_operators():
    """A worker that encoded keeps the vocabulary for its next task, but not beside those of another operator."""
    ranks = type("Held", (), {"value": bpe.read_ranks(PATH)})()
    codec = bpe._codec(ranks, PATTERN)
    assert bpe._codec(ranks, PATTERN) is codec
    held = weakref.ref(codec.pieces)
    del codec
    other = pa.record_batch([pa.array([1]), pa.array(["some text"])], names=["doc_id", "text"])
    runs = []
    frame = type("Frame", (), {"sparkSession": type("S", (), {"conf": {}})(), "select": lambda self, *c: self, "__getitem__": lambda self, n: n, "mapInArrow": lambda self, run, schema: runs.append(run)})()
    shared.mapped(frame, ["doc_id", "text"], "", lambda batch: iter([batch]))
    assert list(runs[0](iter([other]))) == [other]
    assert not bpe._codecs and held() is None


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body>
<header class="site">Our site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div id="left"><div>Same box</div></div>
<div id="c"><h1>{title}</h1><p>First &amp; <b>bold<br>line {n}</p><p>Second&nbsp;para {n}<ul><li>item {n}<li>more {n}</ul><div>Same box</div></div>
<aside>side</aside><div class="ads">Buy {n}</div><form>Search {n}</form><section id="comments"><p>Comment {n}</p></section><footer>Foot</footer></body></html>"""


def test_main_text_of_a_host(spark):
    rows = [(i, f"http://User@Host.example:80/{i}", PAGE.format(title=f"Title {i}", n=i * 7919)) for i in range(12)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://lone.example/", "<p>Only &lt;text&gt;"), (93, None, "plain words"), (0, *rows[0][1:])]
    out = html_text.extracted(clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"))).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id < 12:
            n = r.page_id * 7919
            assert r.text == f"Title {r.page_id}\nFirst & bold line {n}\nSecond para {n}\nitem {n}\nmore {n}"
        assert r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in out if r.page_id >= 90} == {90: "", 91: "", 92: "Only <text>", 93: "plain words"}
    assert html_text.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_main_text_of_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    import html

    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert out[r.page_id] == "\n".join(b for b in blocks if b)


def test_broken_pages_don_t_crash():
    for page in ("<", "<p", "<!--", "</p>", "<p><b></i></p>", "<script>", "<a href='", "<div>" * 3000 + "deep", "<p>a<table><tr><td>b<td>c</table>d", "\x00<p>&#0;&#xD800;&bogus;"):
        assert isinstance(html_text.main_text(page, None), str)
    tree, _ = html_text.parse("<div><p>a</p></div><ul><li>b</ul>")
    other, _ = html_text.parse("<ul><li>b</ul>")
    assert html_text.matching(tree, other)[0] == 3
