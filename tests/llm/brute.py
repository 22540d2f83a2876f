"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def shingles(text):
    w = SPACED.findall(fold(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(rows):
    sets = {d: shingles(t) for d, t in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in by[x] if e < d).items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                links[d] += 1
                links[e] += 1
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d), links[d]) for d, s in sets.items()}


def contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(fold(text or ""))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].update([] if item is None else [str(item)])
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in rows:
        w = word.findall(fold(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def secrets(text):
    text = text or ""
    out = []
    kinds = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    for rank, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), rank, kind, m.end()))
    out.sort()
    n = Counter(x[2] for x in out)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in out))


def repeats(rows):
    """Op 6 for (key, text) pairs."""
    data = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(x[i : i + 200] for _, x in data for i in range(len(x) - 199))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if n[x[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone) if not g))))
    return out


def rules(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def passages(rows):
    docs = [(d, SPACED.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    import xxhash

    w = words(fold(text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash_classes(rows):
    """(doc_id, text) to {doc_id: (fingerprint, component)}; every pair is compared."""
    fp = [simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((-1 if d is None else d, f"{f:016x}", least.get(find(i), -1)) for i, ((d, _), f) in enumerate(zip(rows, fp, strict=True))))


def audit(docs, labels):
    """(doc_id, text, source) and (doc_id, quality, toxic): filters applied one after the other, for each order."""
    from itertools import permutations

    far = 1 << 63
    first = {}
    for d, t, _ in docs:
        first[t or ""] = min(first.get(t or "", far), far if d is None else d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = []
    for part in {s or "" for _, _, s in docs}:
        own = []
        for d, t, s in docs:
            if (s or "") == part:
                t, w = t or "", words(t)
                own.append((d, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (far if d is None else d) > first[t]}))
        rows, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                all_fail = sum(x[1][f] for x in own)
                shapley[f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), all_fail - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def search(docs, items, top=10):
    """Ranks of (item, text) over (doc_id, text), each score by the formula."""
    import math

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = [(d, Counter(term.findall(fold(t or "")))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(x for _, c in split for x in c)
    out = []
    for item, text in items:
        asked = Counter(term.findall(fold(text or "")))
        scores = []
        for d, c in split:
            if c:
                m = 100 - 75 + 75 * sum(c.values()) * n_docs // n_terms
                s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, q in asked.items() if x in c)
                if s > 0:
                    scores.append((-s, 1 << 63 if d is None else d))
        out += [(-1 if item is None else item, k, -1 if d == 1 << 63 else d, -s) for k, (s, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)
