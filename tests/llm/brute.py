"""Plain versions of what the operators must give: whole tables in memory, all pairs, no hashing tricks."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def base_spans(text):
    """(start, kind, end) of the three base kinds, straight from their patterns."""
    text = text or ""
    out = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(out, key=lambda x: (x[0], order[x[1]]))


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def fingerprint(text, n=3):
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=2):
    """(doc_id, fp) rows to the smallest doc_id reachable, by all pairs of distinct fingerprints."""
    distinct = sorted(set(f for _, f in fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for d, f in fps:
        r = root(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in fps]


def warc(pages):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html)."""
    by = defaultdict(list)
    for p, html in pages:
        by[html or ""].append(p)
    out = []
    for p, html in pages:
        raw = (html or "").encode()
        first = min((x for x in by[html or ""] if x is not None), default=None)
        again = first is not None and p != first
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return out


def letter_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def containment(docs, items, n=5, threshold=0.8):
    """{(doc_id, item_id): (shingles, matched)}; texts of letters and digits that Python and Java see alike."""
    out = {}
    held = {d: letter_words(t) for d, t in docs if d is not None}
    for item, text in items:
        w = letter_words(text)
        if item is None or not w:
            continue
        k = min(len(w), n)
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for d, dw in held.items():
            m = len(own & {tuple(dw[i : i + k]) for i in range(len(dw) - k + 1)})
            if m >= math.ceil(round(threshold * len(own), 6)):
                out[d, item] = (len(own), m)
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} of {source: size}, pouring the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = share * sum(sizes.values()), set(), {}
    while True:
        open_w = sum(w[s] for s in order if s not in full)
        left = total - sum(cap * sizes[s] for s in full)
        out = {s: cap * sizes[s] if s in full else left * w[s] / open_w for s in order}
        over = {s for s in order if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def exact_groups(docs):
    """(doc_id, keep_id, size, kept, digest) per row."""
    norm = [ascii_lower(t or "") for _, t in docs]
    last, n = {}, Counter(norm)
    for (d, _), t in zip(docs, norm, strict=True):
        last[t] = max(d, last.get(t, d))
    return [(d, last[t], n[t], d == last[t], hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(docs, norm, strict=True)]


def without_repeats(docs, width=35):
    """(doc_id, words, removed, digest): windows of words that start at two places or more."""
    ws = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(docs, ws, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def without_matches(docs, width=50):
    """(doc_id, bytes, removed, spans, digest): strings that start in a document with a smaller id; a null id is the largest."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    rank = lambda d: math.inf if d is None else d
    least = {}
    for d, b in raw:
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            least[s] = min(rank(d), least.get(s, math.inf))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < rank(d):
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def token_rows(docs, tokenizer, end=2):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, unique ids."""
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
