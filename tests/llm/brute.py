"""Plain versions of operators, for small tables."""

import hashlib
import re

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def classes(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = re.split(rb"[ \t-\r]+", (text or "").encode().translate(LOWER))
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def gear_cuts(text):
    """Where a text is cut, byte by byte, from the gear table alone."""
    from tidegate.llm.substring_dedup import _GEAR

    space, far, n = {0, 9, 10, 11, 12, 13, 32}, 0xFFFF, len(text)
    padded = bytes(32) + text + bytes(32)
    keys = []
    for p in range(len(padded)):
        h = 0
        for q in range(max(0, p - 15), p + 1):
            h = (2 * h + int(_GEAR[padded[q]])) % 65536
        after_space = p == 0 or padded[p - 1] in space
        keys.append(far if padded[p] & 0xC0 == 0x80 else h // 2 + (0 if after_space else 0x8000))
    marks = [0]
    for p in range(1, n):
        at = p + 32
        if keys[at] < min(keys[at - 24 : at]) and keys[at] <= min(keys[at + 1 : at + 25]) and keys[at] < far:
            marks.append(p)
    out = [0]
    for y in [*marks[1:], len(text)]:
        while y - out[-1] > 4096:
            p = out[-1] + 4096
            while text[p] & 0xC0 == 0x80 and p > out[-1] + 4092:
                p -= 1
            out.append(p)
        out.append(y)
    return out if text else []


def cut(rows, run):
    """Texts without the chunks that an earlier document has; rows are (doc_id, bytes) with distinct ids."""
    chunks, first = {}, {}
    for i, text in sorted(rows):
        marks = gear_cuts(text)
        chunks[i] = [text[a:b] for a, b in zip(marks, marks[1:], strict=False)]
        for chunk in chunks[i]:
            first.setdefault(chunk, i)
    out = {}
    for i, text in rows:
        seen, copy = set(), []
        for chunk in chunks[i]:
            copy.append(first[chunk] != i or chunk in seen)
            seen.add(chunk)
        left, held = b"", b""
        for chunk, gone in [*zip(chunks[i], copy, strict=True), (b"", False)]:
            if gone:
                held += chunk
            else:
                left += (held if len(held) < min(run, len(text)) else b"") + chunk
                held = b""
        out[i] = left
    return out


def contamination(text: bytes | None, items: list[tuple[int, bytes | None]]) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items and items_sha256 by definition."""
    split = lambda t: [bytes(w).lower() for w in bytes(t or b"").translate(bytes(b if (48 <= b < 58 or 97 <= b | 32 < 123 or b >= 128) else 32 for b in range(256))).split()]
    words, hit, got = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in windows:
                hit |= {*range(p, p + n)}
                got.add(item)
    return len(words), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest()
