"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def linked(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def n_links(rows, percent=85):
    """How many other rows each (id, text) row is linked with."""
    sets = [shingles(t) for _, t in rows]
    return [sum(linked(a, b, percent) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]


def groups(rows, percent):
    """Places of (id, text) rows that links join."""
    sets, out = [shingles(t) for _, t in rows], []
    for i, a in enumerate(sets):
        met = [g for g in out if any(linked(a, sets[j], percent) for j in g)]
        out = [g for g in out if g not in met] + [[i, *(j for g in met for j in g)]]
    return out


def components(rows, percent=85):
    """component by place of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if linked(a, sets[j], percent):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (id_, _) in enumerate(rows):
        r = find(k)
        if id_ is not None:
            least[r] = min(least.get(r, id_), id_)
    return [least.get(find(k)) if sets[k] else rows[k][0] for k in range(len(rows))], [len(s) for s in sets]


def measures(text):
    t = text or ""
    w, places = WORD.findall(t), collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    full = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def contaminated(text, items, window=13):
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for id_, item in items:
        x = ALNUM.findall((item or "").translate(LOWER))
        n = min(window, len(x))
        for s in range(len(x) - n + 1 if x else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == x[s : s + n]:
                    hit.update(range(k, k + n))
                    found.add(str(id_))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


KINDS = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def secrets(text):
    spans = sorted((m.start(), k, m.end(), name) for k, (name, find, fits) in enumerate(KINDS) for m in find.finditer(text or "") if fits(m))
    return [f"{n}:{a}:{e}" for a, _, e, n in spans]


def unigram(rows):
    """(n_tokens, n_known, N, base score) of (held out, text) rows."""
    docs = [(h, [*WORD.findall((t or "").translate(LOWER)), ""]) for h, t in rows]
    c = collections.Counter(w for h, ws in docs if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for _, ws in docs]


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
