"""Plain Python versions of the operators' results, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

from quarry.llm.secrets import ASSIGN

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def norm(t):
    return SPACE.sub(" ", t or "")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def dedup(rows):
    """[(doc_id, text)] -> {doc_id: (keep_id, size, sha)}; unique ids."""
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    return {d: (min(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for d in g}


def simhash(t):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(ids, fps, bits=3):
    fp = np.array(fps, dtype=np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for k, i in enumerate(order):
        near = np.bitwise_count(fp ^ fp[i]) <= bits
        for j in np.flatnonzero(near).tolist():
            p, q = root(i), root(j)
            if p != q:
                p, q = sorted((p, q), key=lambda x: ids[x])
                parent[q] = p
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, t, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [(len(r), r, a) for a, r in rules
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def edited(rows):
    """[(doc_id, text)], unique ids -> {doc_id: edited text}."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (d, t) in enumerate(rows):
        k = len(t) // 4
        out[d] = t[:len(t) - k] + rows[(i + 1) % len(rows)][1][:k]
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
