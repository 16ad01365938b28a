"""Byte-level BPE with the ranks of a public vocabulary, by a segment tree over byte positions.

Texts are cut by the vocabulary's pattern. For each piece, the leaves of a segment tree
hold the rank of the pair that starts at each live byte position; inner nodes hold the
leftmost smallest. The root names the next merge, which updates three leaves: the merged
place, its live left neighbour and the place that is gone. So a piece of n bytes takes
O(n log n), however long it is.

Short pieces, nearly all of them, go through their trees side by side: the trees of all
new pieces of a batch are rows of one array, and each round merges the root's pair in
every row. Encodings of pieces are remembered, up to a bound; then the memory starts anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import byte_rows, doc_columns, worker_tables

#: Pieces whose encodings are remembered, and the longest piece that is.
MEMORY = 400_000
LONGEST_KEPT = 64
#: Trees side by side.
ROWS = 4096
#: Bytes of text whose new pieces are encoded together.
TOGETHER = 1 << 20
_FAR = 1 << 62

# Letters and numbers that the installed `regex` knows from a newer
# Unicode version than the tokenizer library's pattern engine; that engine takes them
# for neither. Ranges of code points, in hexadecimal, both ends included.
NEWER_LETTERS = """558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff
18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
NEWER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _span(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


def _narrow(cls: str, without: str = "") -> str:
    """The code points of a class below 0x10000, as ranges."""
    found: list[list[int]] = []
    rx = regex.compile(f"[{cls}--[{without}]]" if without else cls, regex.V1)
    for m in rx.finditer("".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000)):
        c = ord(m[0])
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)


def compiled(pattern: str):
    """findall over the letters and numbers that the tokenizer library's engine knows: a fast one for texts without characters from 0x10000 up, and one for all."""
    letters, numbers = _span(NEWER_LETTERS), _span(NEWER_NUMBERS)
    every = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--[{letters}]]").replace(r"\p{N}", rf"[\p{{N}}--[{numbers}]]"), regex.V1)
    own = {r"\p{L}": _narrow(r"\p{L}", letters), r"\p{N}": _narrow(r"\p{N}", numbers), r"\s": _narrow(r"\s")}
    out, inside = "", False
    for part in re.split(r"(\\p\{L\}|\\p\{N\}|\\[sS]|\\.|[\[\]])", pattern):
        if part in own:
            out += own[part] if inside else f"[{own[part]}]"
        elif part == r"\S" and not inside:
            out += f"[^{own[r'\s']}]"
        else:
            inside = part == "[" or inside and part != "]"
            out += part
    narrow = every if re.search(r"\\[pPS]", out) else re.compile(out)
    return narrow.findall, every.findall


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """Encodings by piece, as little-endian unsigned 32-bit ids; an absent one is made."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.pairs = _Pairs(ranks)

    def __missing__(self, piece: str) -> bytes:
        return np.array(merge(piece.encode("utf-8"), self.ranks), dtype="<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode the short ones among new pieces, in bulk."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = list(pieces)
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                self[p] = whole.to_bytes(4, "little")
            elif len(raw) <= LONGEST_KEPT:
                by_size.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for size, own in by_size.items():
            for k in range(0, len(own), ROWS):
                part = own[k : k + ROWS]
                for (p, _), ids in zip(part, merge_rows([raw for _, raw in part], size, self.pairs), strict=True):
                    self[p] = ids


class _Pairs:
    """The rank of every pair of ids whose bytes together are a token, and the ids of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(found, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank for each pair, or -1."""
        if not len(self.keys):
            return np.full(a.shape, -1, dtype=np.int64)
        wanted = a << 32 | b
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def merge_rows(raws: list[bytes], size: int, pairs: _Pairs) -> list[bytes]:
    """The packed ids of pieces of at most `size` bytes: `merge` for all of them at once, a tree in each row."""
    w = len(raws)
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=w)
    padded = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raws), dtype=np.uint8).reshape(w, size)
    ids = pairs.of_byte[padded]
    place = np.arange(size)
    value = pairs.rank(ids[:, :-1], ids[:, 1:])
    leaf = np.full((w, size), _FAR, dtype=np.int64)
    leaf[:, :-1] = np.where((value >= 0) & (place[1:] < sizes[:, None]), value * size + place[:-1], _FAR)
    tree = np.empty((w, 2 * size), dtype=np.int64)
    tree[:, 0] = _FAR
    tree[:, size:] = leaf
    low = size
    while low > 1:
        tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
        low //= 2
    after = np.tile(place + 1, (w, 1))
    before = np.tile(place - 1, (w, 1))
    live = place < sizes[:, None]
    tree1, ids1, after1, before1, live1 = (x.reshape(-1) for x in (tree, ids, after, before, live))
    rows = np.flatnonzero(tree[:, 1] < _FAR)
    while len(rows):
        root = tree[rows, 1]
        i, base = root % size, rows * size
        gone = after1[base + i]
        right = after1[base + gone]
        ids1[base + i] = root // size
        after1[base + i] = right
        live1[base + gone] = False
        n = sizes[rows]
        has_right = right < n
        before1[(base + right)[has_right]] = i[has_right]
        left = before1[base + i]
        has_left = left >= 0
        r = np.where(has_right, pairs.rank(ids1[base + i], ids1[base + np.where(has_right, right, 0)]), -1)
        l = np.where(has_left, pairs.rank(ids1[base + np.where(has_left, left, 0)], ids1[base + i]), -1)  # noqa: E741
        top = rows * 2 * size
        nodes = [top + size + gone, top + size + i, (top + size + left)[has_left]]
        tree1[nodes[0]] = _FAR
        tree1[nodes[1]] = np.where(r >= 0, r * size + i, _FAR)
        tree1[nodes[2]] = np.where(l >= 0, l * size + left, _FAR)[has_left]
        tops = [top, top, top[has_left]]
        half = size
        while half > 1:
            half //= 2
            for k in range(3):
                node = tops[k] + ((nodes[k] - tops[k]) >> 1)
                under = 2 * node - tops[k]
                tree1[node] = np.minimum(tree1[under], tree1[under + 1])
                nodes[k] = node
        rows = rows[tree[rows, 1] < _FAR]
    flat = ids[live].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    n = len(raw)
    parts: list[bytes] = [raw[i : i + 1] for i in range(n)]
    if n < 2:
        return [ranks[p] for p in parts]
    get = ranks.get
    size = 1 << (n - 1).bit_length()
    # A node holds rank * size + position, so that the smaller value is the smaller rank, then the one further left.
    tree = [_FAR] * (2 * size)
    for i in range(n - 1):
        r = get(raw[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] < _FAR:
        i = tree[1] % size
        gone = after[i]
        parts[i] += parts[gone]
        right = after[gone]
        after[i] = right
        if right < n:
            before[right] = i
            r = get(parts[i] + parts[right])
        else:
            r = None
        changed = [(gone, _FAR), (i, _FAR if r is None else r * size + i)]
        left = before[i]
        if left >= 0:
            r = get(parts[left] + parts[i])
            changed.append((left, _FAR if r is None else r * size + left))
        for place, value in changed:
            node = size + place
            if tree[node] == value:
                continue
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Codec:
    """Encodes texts to packed ids and decodes them again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = _Pieces(ranks)
        self.narrow, self.every = compiled(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def split(self, text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.narrow(text)
        return self.every(text)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.split(text) if text else [])
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[str]]) -> Iterator[bytes]:
        self.pieces.learn(set().union(*held))
        get = self.pieces.__getitem__
        for pieces in held:
            yield b"".join(map(get, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs: dict[tuple, Codec] = {}
worker_tables.append(_codecs.clear)


def _codec(ranks, pattern: str) -> Codec:
    """The codec of a broadcast vocabulary; a Python worker makes it once, and again after tasks of other operators."""
    key = (ranks._jid if hasattr(ranks, "_jid") else id(ranks), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def _run(df: DataFrame, column: str, ranks_path: str, pattern: str, schema: str, each) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file

    def run(batches: Iterable[pa.RecordBatch]):
        codec = _codec(ranks, pattern)
        for batch in batches:
            if batch.num_rows:
                yield each(codec, batch)

    return doc_columns(df, "doc_id", column).mapInArrow(run, schema)


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) for every row of `documents` (doc_id, text).

    Null and empty texts have no ids. Repeated rows and a null doc_id are kept as they
    are; other columns are ignored; an empty table gives no rows.
    """

    def each(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(list(codec.encode_all(batch.column(1).to_pylist())), type=pa.binary())], names=["doc_id", "ids"])

    return _run(documents, "text", ranks_path, pattern, "doc_id long, ids binary", each)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data (the decoded bytes) for every row of `encoded` (doc_id, ids); null ids give empty bytes."""

    def each(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([codec.decode(b) for b in byte_rows(batch.column(1))], type=pa.binary())], names=["doc_id", "data"])

    return _run(encoded, "ids", ranks_path, pattern, "doc_id long, data binary", each)


def round_trip(documents: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: digests of what `encode` and then `decode` give, in one pass; with the packed ids too, if asked for."""

    def each(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, of_ids, of_bytes, kept = [], [], [], []
        for ids in codec.encode_all(batch.column(1).to_pylist()):
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            if with_ids:
                kept.append(ids)
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, type=pa.int64()), "ids_sha256": pa.array(of_ids, type=pa.string()), "decoded_sha256": pa.array(of_bytes, type=pa.string())}
        if with_ids:
            columns["ids"] = pa.array(kept, type=pa.binary())
        return pa.record_batch(list(columns.values()), names=list(columns))

    return _run(documents, "text", ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids, each)
