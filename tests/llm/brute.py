"""Brute-force versions of the operators, row by row in plain Python."""
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def contamination(docs, items, k=10):
    owners = defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        if w:
            for j in range(max(1, len(w) - k + 1)):
                owners[tuple(w[j:j + k])].add("" if i is None else str(i))
    lengths = sorted({len(x) for x in owners})
    out = []
    for d, t in docs:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                who = owners.get(tuple(w[j:j + n]))
                if who:
                    hit.update(range(j, j + n))
                    found |= who
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def bytes_dedup(docs, width=100):
    """docs in any order; (did None last); equal rows count once."""
    seen, marks = {}, {}
    order = sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0))
    for d, t in order:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i:i + width]
            if w in seen:
                gone[i:i + width] = b"\x01" * width
            else:
                seen[w] = True
        marks[(d, t)] = gone
    out = []
    for d, t in docs:
        b, gone = (t or "").encode(), marks[(d, t)]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(kept)))
    return out


def words_dedup(docs, width=50):
    key = lambda d: (d is None, d or 0)
    least = {}
    for d, t in docs:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if g not in least or key(d) < key(least[g]):
                least[g] = d
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if key(least[tuple(w[i:i + width])]) < key(d):
                gone[i:i + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), sha(" ".join(kept).encode())))
    return out


def text_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i:i + 8])] > 1:
            rep.update(range(i, i + 8))
    n_rep = len(rep)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), n_rep,
            len(w) < 20 or 100 * n_rep > 30 * len(w))


def near_duplicates(docs, k=4, percent=80):
    """[(did, n, component)] with all pairs compared; ids unique."""
    sets = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((d, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(n)
    common = Counter()
    for v in index.values():
        for i, a in enumerate(v):
            for b in v[i + 1:]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for d, s in sets]


def host_path(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)((?:/[^?#]*)?)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def judge(url, rules):
    h, p = host_path(url)
    fits = [(len(rh) + len(rp), len(rh), rh + rp, v) for rh, rp, v in rules
            if h and (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return (h, p, *((max(fits)[2], max(fits)[3]) if fits else (None, None)))


def boilerplate(docs, min_sites):
    """docs: (did, text, site), ids unique -> {did: text after removal}."""
    sites, first = defaultdict(set), {}
    blank = " \t\r\x0b\x0c"
    for d, t, s in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, x in enumerate(t.split("\n") if t is not None else []):
            x = x.strip(blank)
            if x:
                sites[x].add(s)
                first.setdefault(x, (d, i))
    out = {}
    for d, t, _ in docs:
        if t is None:
            out[d] = None
            continue
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if not (
            x.strip(blank) and len(sites[x.strip(blank)]) >= min_sites and first[x.strip(blank)] != (d, i)))
    return out
