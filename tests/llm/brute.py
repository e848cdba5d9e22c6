"""Plain versions of the contracts, for small tables. Each takes lists of
rows and follows the contract's words; nothing here is shared with the library."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = rb"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def classes(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def smallest(ids, roots):
    best = {}
    for i, r in zip(ids, roots):
        if i is not None:
            best[r] = min(best.get(r, i), i)
    return [best.get(r) for r in roots]


def op1(rows, threshold=0.9):
    """rows: (vec_id, vector) -> (vec_id, n_links, component_id, kept)"""
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links, count = len(rows), [], [0] * len(rows)
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                cos = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
                if cos >= threshold:
                    links.append((i, j))
                    count[i] += 1
                    count[j] += 1
    comp = smallest([r[0] for r in rows], classes(n, links))
    return [(r[0], count[i], comp[i], r[0] == comp[i]) for i, r in enumerate(rows)]


def op2(rows, k=35):
    """rows: (doc_id, text) -> (doc_id, n_words, n_removed, kept_sha256)"""
    docs = [re.findall(SPACE, (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i:i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def op5(rows, n=3, radius=3):
    """rows: (doc_id, text) -> (doc_id, fingerprint, component_id)"""
    prints = []
    for _, t in rows:
        w = re.findall(SPACE, (t or "").encode().translate(LOWER))
        sh = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        prints.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(sh)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    comp = smallest([r[0] for r in rows], classes(len(rows), links))
    return [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comp)]


def op7(rows, k=200):
    """rows: (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)"""
    docs = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(b[i:i + k]) for b in docs for i in range(len(b) - k + 1))
    exact = Counter(b[i:i + k] for b in docs for i in range(len(b) - k + 1) if seen[hash(b[i:i + k])] > 1)
    out = []
    for (d, _), b in zip(rows, docs):
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if exact.get(b[i:i + k], 0) > 1:
                gone[i:i + k] = b"\1" * k
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def op9(rows, items, k=13):
    """rows: (doc_id, text), items: (item_id, text) ->
    (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER))

    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - k + 1) if w else 0):
            phrases[tuple(w[a:a + k])].add("" if i is None else str(i))
    lengths = {len(p) for p in phrases}
    out = []
    for d, t in rows:
        w = words(t)
        hit, got = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if (p := tuple(w[a:a + n])) in phrases:
                    hit.update(range(a, a + n))
                    got |= phrases[p]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(got)).encode()),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def auc(scores, y):
    pairs = sorted(zip(scores, y))
    rank, ties, total, pos = 0, 0, 0.0, sum(y)
    i = 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        total += sum(v for _, v in pairs[i:j]) * (i + j + 1) / 2
        i = j
    neg = len(y) - pos
    return (total - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else 0.5


def op11(rows, k=20, every=20):
    """rows: (vec_id, vector) -> (query_id, rank, vec_id, score)"""
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if usable(v)]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j is None, j) for b, (j, w) in enumerate(whole)
                  if a != b and len(v) == len(w)]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def op12(rows, least=10, longest=3, top=2000, share=50):
    """rows: (lang, text) -> (lang, rank, phrase, a, l, r, n, score)"""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + m])) for i in range(len(words) - m + 1))
    cands = {c: a for c, a in f.items() if len(c[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, p), a in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                covered[lang, p[i:i + m]] = max(covered[lang, p[i:i + m]], a)
    per = defaultdict(list)
    for (lang, p), a in cands.items():
        if 100 * covered[lang, p] >= share * a and covered[lang, p]:
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        per[lang].append((-score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in per.items()
            for r, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1)]


def op13(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text) -> (item_id, rank, doc_id, score)"""
    term = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    counts = [(i, Counter(re.findall(term, (t or "").encode().translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(re.findall(term, (text or "").encode().translate(LOWER))) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out
