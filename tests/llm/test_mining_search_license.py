"""Operators 11 to 13 against plain Python versions, and their edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import hard_negatives as hn
from quarry.llm import lexical_search as ls
from quarry.llm import licenses as lic

DOCS = "doc_id long, text string"


# ---- operator 11 ----

def plain_negatives(rows, k=10, positives=5):
    """rows: (id, label, ints); unique ids."""
    out = []
    for a, la, va in rows:
        if a is None or a % 100:
            continue
        dot = {b: sum(x * y for x, y in zip(va, vb)) for b, _, vb in rows}
        label = {b: lb for b, lb, _ in rows}
        by = sorted((b for b in dot if b != a), key=lambda b: (-dot[b], b))
        for p in [b for b in by if label[b] == la][:positives]:
            fit = [b for b in by if label[b] != la and 30 * dot[p] <= 100 * dot[b] <= 90 * dot[p]][:k]
            out += [(a, p, r, n, dot[p], dot[n]) for r, n in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<bigint>")
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(n, dims, seed, scale=40):
    """Vectors around a few far directions, so that bounds cut lists short."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    v = centres[rng.integers(0, 6, n)] * 3 + rng.normal(0, .3, (n, dims))
    return [(i, int(rng.integers(0, 3)), [int(x) for x in np.floor(v[i] * scale)]) for i in range(n)]


def test_negatives_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("ANCHORS", 4), ("HEAD", 2), ("SECTION", 2), ("CHUNK", 8), ("MEMBERS", 2)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(hn.fit_clusters, "__defaults__", (2, 12))
    rows = clustered(700, 6, 1)
    assert mined(spark, rows) == plain_negatives(rows)


def test_walk_ends_early_and_stays_exact():
    """Most members leave a list whose bounds fall, and lose nothing."""
    rng = np.random.default_rng(3)
    centre = np.zeros(8)
    centre[0] = 1
    a = (rng.normal(0, .05, (5, 8)) + centre) * 1000
    b = np.concatenate([(rng.normal(0, .05, (60, 8)) + centre), -(rng.normal(0, .05, (4000, 8)) + centre)]) * 1000
    a, b = a.astype(np.int64), b.astype(np.int64)
    width = hn.angles(a, centre[None])[1].max()
    scored = []
    real = hn.exact_scores
    try:
        hn.exact_scores = lambda x, y: scored.append(len(x) * len(y)) or real(x, y)
        one = lambda v, labels: {"n": len(v), "d": 8, "uids": np.arange(len(v)).tobytes(), "ids": np.arange(len(v)).tobytes(),
                                 "labels": labels.tobytes(), "v": v.tobytes()}
        row = {f"a_{k}": x for k, x in one(a, np.zeros(5, dtype=np.int64)).items()}
        row |= {"a_lo": np.full((5, 1), hn._MIN).tobytes(), "a_hi": np.full((5, 1), hn._MAX).tobytes()}
        m = hn._Members(row, 10, False)
        m.visit({f"b_{k}": x for k, x in one(b, np.ones(len(b), dtype=np.int64)).items()}, centre, width)
    finally:
        hn.exact_scores = real
    assert sum(scored) <= 5 * 2 * hn.CHUNK
    want = np.sort(a @ b.T, axis=1)[:, ::-1][:, :10]
    assert (m.best[0, :, 0] == want).all()


def test_bound_holds():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (3, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    a, b = (rng.integers(-300, 300, (200, 16)) for _ in range(2))
    _, angle = hn.angles(a, centres)
    norm_b, angle_b = hn.angles(b, centres)
    cell = angle.argmin(1)
    width = np.array([angle[cell == c, c].max() for c in range(3)])
    bound = hn.reach(norm_b, angle_b, width)
    for i in range(len(a)):
        assert (a[i] @ b.T <= bound[:, cell[i]] * np.linalg.norm(a[i]) + 1e-6).all()


def test_negatives_edges(spark):
    rows = [(0, 1, [5, 5]), (100, 1, [5, 5]), (3, 1, [5, 5]), (4, 2, [3, 3]), (5, 2, [3, 3]), (6, 2, [0, 0]),
            (200, 9, [1, 1]), (7, 2, []), (8, 1, [10, 10, 4])]
    assert mined(spark, rows) == plain_negatives([(i, y, (v + [0, 0, 0])[:3]) for i, y, v in rows])
    # repeated and null ids are rows of their own; a null id comes last among equals
    out = mined(spark, [(0, 1, [10]), (1, 1, [10]), (2, 2, [5]), (None, 2, [5]), (2, 2, [5])])
    assert [(r[2], r[3]) for r in out] == [(1, 2), (2, 2), (3, None)]
    twice = mined(spark, [(0, 1, [10]), (0, 1, [10]), (2, 2, [5])])
    assert twice == [(0, 0, 1, 2, 100, 50)] * 2
    assert mined(spark, []) == []


def test_negatives_big_scores_are_exact(spark):
    big = 1 << 29
    rows = [(0, 1, [big, 1]), (1, 1, [big, 3]), (2, 2, [big // 2, 5]), (3, 2, [big // 2, 6])]
    assert mined(spark, rows) == plain_negatives(rows)


def test_integer_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, -0.001], 3), (2, None, 3), (3, [1.0, None], 3), (4, [nan], 3), (5, [inf], 3),
                                (6, [1.0], None), (None, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    df = df.withColumns({"v": F.lit("clash"), "uid": F.lit(1), "cell": F.lit(2)})
    got = {r.vec_id: r.v for r in hn.integer_vectors(df).collect()}
    assert got == {1: [128, -1], None: [256]}


# ---- operator 12 ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_search(docs, items, k=10):
    tf = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in tf:
            n = sum(c.values())
            if n:
                m = 100 - 90 + (90 * n * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(plain_terms(text)) if c[t])
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **kw):
    got = ls.lexical_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def random_docs(n, seed=1, words=60):
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, words + 1)
    return [(i, " ".join(f"W{w}é" if w % 3 else f"w{w}" for w in rng.choice(words, rng.integers(1, 40), p=p / p.sum())))
            for i in range(n)]


def test_search_small_trees(spark, monkeypatch):
    monkeypatch.setattr(ls, "GROVE", 100)
    docs = random_docs(400)
    items = [(i, docs[i * 7][1]) for i in range(20)]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, most=25) == want  # several blocks of queries


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(20 * (i % 8), 20 * (i % 8) + 20, 12)) for i in range(1024)]
    val = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree = ls.BallTree(indptr, np.concatenate(rows), np.concatenate(val), 160, leaf=16)
    q = np.zeros(160, dtype=np.int64)
    q[[3, 5, 9, 45]] = [9000, 4000, 800, 50]
    scores = tree._dots(np.arange(1024), q)
    for node, (_, _, _, below) in enumerate(tree.nodes):
        if not isinstance(below, tuple):
            assert tree.bound(node, q) >= scores[below].max()
    seen = []
    real = tree._dots
    tree._dots = lambda r, d: seen.append(len(r)) or real(r, d)
    best = []
    tree.search(q, np.arange(1024), best, 10)
    want = sorted(((int(s), -i) for i, s in enumerate(scores) if s), reverse=True)[:10]
    assert sorted(best, reverse=True) == want
    assert sum(seen) < 512


def test_search_edges(spark):
    docs = [(2, "b a!"), (1, "B a?"), (None, "a b"), (3, None), (4, ""), (5, "..."), (6, "z " * 5000), (2, "b a!"), (7, "c")]
    items = [(1, "A b"), (1, "z"), (None, "nothing here"), (9, None), (10, "..."), (11, "C c c")]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    assert searched(spark, [(1, None)], items) == []
    ties = [(i, "same text") for i in range(30, 0, -1)]
    assert [r[2] for r in sorted(searched(spark, ties, [(1, "text")]), key=lambda r: r[1])] == list(range(1, 11))


def test_search_clashing_columns(spark):
    extra = {c: F.lit("x") for c in ("uid", "n", "at", "val", "k0", "query", "term", "block", "score", "rank")}
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], DOCS).withColumns(extra)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string").withColumns(extra)
    assert [tuple(r)[:3] for r in ls.lexical_search(docs, items).collect()] == [(1, 1, 1)]


# ---- operator 13 ----

def plain_words(t):
    return re.findall(lic.WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_licenses(text):
    w = plain_words(text)
    places = sorted(i for _, p in lic.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    own = {y for y, p in lic.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()}
    labels, score = set(own), 1.0 if places else 0.0
    for label, notice in lic.NOTICES:
        t = plain_words(notice)
        k = min(len(t), lic.GRAM)
        hit = [(p - a, a, p) for a in range(len(t) - k + 1) for p in range(len(w) - k + 1) if w[p:p + k] == t[a:a + k]]
        groups, last = [], None
        for d in sorted({h[0] for h in hit}):
            if last is None or d - last > lic.SLACK:
                groups.append(set())
            groups[-1].add(d)
            last = d
        for g in groups:
            mine = [h for h in hit if h[0] in g]
            share = len({a + j for _, a, _ in mine for j in range(k)}) / len(t)
            in_text = {p + j for _, _, p in mine for j in range(k)}
            if share >= lic.LEAST and len(in_text) >= lic.LEAST * (max(in_text) + 1 - min(in_text)):
                labels.add(label)
                score = max(score, share)
    return (len(w), len(places), places[0] if places else None, places[-1] if places else None,
            ",".join(sorted(own)), ",".join(sorted(labels)), score)


CASES = ["Released under the MIT License.", "mit\nLICENSE and again: Mit-License", "the MIT-licence", None, "", "...",
         "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0", "x " * 3000 + "Licensed under the Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.",
         "Redistribution and use in source and also binary forms, with or without any modification, are permitted provided "
         "that the following conditions are met", "redistribution and use in source",
         "MIT License " * 50, "a general public license of the general public, license: general  public; license",
         "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "mit", "license mit"]


def scanned(spark, texts):
    df = lic.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS))
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_licenses(spark):
    got = scanned(spark, CASES)
    assert got == {i: plain_licenses(t) for i, t in enumerate(CASES)}
    assert got[6][5] == "cc-by-nc" and got[7][5] == "cc-by" and got[8][5] == "apache" and got[10][5] == "bsd" and got[11][5] == ""


def test_license_edges(spark):
    df = spark.createDataFrame([(None, CASES[0]), (7, CASES[0]), (7, CASES[0]), (7, None)], DOCS)
    df = df.withColumns({c: F.lit("x") for c in ("uid", "n", "words", "h", "k", "at", "place", "label", "base", "gram")})
    rows = sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in lic.scan_licenses(df).collect())
    assert rows == [(0, 5, 1, "mit"), (7, 0, 0, ""), (7, 5, 1, "mit"), (7, 5, 1, "mit")]
    assert lic.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("edit", range(4))
def test_license_notice_with_edits(spark, edit):
    notice = dict(lic.NOTICES[::-1])["bsd"].split()
    words = notice[:edit * 4] + ["extra"] + notice[edit * 4:]
    assert scanned(spark, ["word " * edit + " ".join(words) + " end"])[0][5] == "bsd"
