"""Pair tiles, similarity edges and connected components (CLU-3, JOIN-5).

Quadratic comparisons run on *tile pairs*: inside each bucket, points are
hashed into tiles of about ``tile_size`` rows; each tile is packed into one
row, and the tile pairs (s <= t) are generated per
bucket and equi-joined to the packed tiles.  A pandas task computes one
distance block with a matrix product and emits only what the operator needs
(edges over a cut, per-component minimum edges, per-cluster sums): never the
full pair list.  A big bucket spreads over (tiles^2)/2 tasks.

A tile grows with its bucket up to ``GROWTH`` times ``tile_size``, so fewer copies of
the vectors travel; tasks work through a pair in blocks of ``BLOCK`` rows.

Where only components matter, a tile pair returns a spanning forest of its edges
(``forest=True``), fewer edges than it has points, however dense it is.

Components: min-label propagation with pointer jumping, L(u) <- min(L(u),
min L(v) over neighbours), then L(u) <- L(L(u)).  L only decreases and always
names a node of u's component, so the fixed point is the component minimum;
jumping halves label chains each round.  Every round is written as a table
in the shared checkpoint folder (lineage cut).  A round's labels are broadcast
while there are at most ``SMALL_ROWS`` of them, and so are the labels that a jump
changes; a node or component with a large share of the rows is then no hot key.
Beyond that Spark splits the skewed joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

#: Rows of labels (two ids each) that may be broadcast.
SMALL_ROWS = 500_000
#: Rows of a block of distances.
BLOCK = 2048
#: A tile grows up to so many times its least size; smaller buckets are cut into ``TILES``.
GROWTH, TILES = 8, 16


def _keys(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def tile_pairs(df: DataFrame, id_col: str, vec: str, by=None, tile_size: int = 2048,
               extra: list[str] | None = None) -> DataFrame:
    """Packed tile pairs: (by..., _tiles, s_tile, t_tile, a_id, a_v, [a_<extra>], b_id, b_v, ...)."""
    keys = _keys(by)
    extra = extra or []
    base = df.select(*keys, F.col(id_col).cast("long").alias("id"),
                     F.col(vec).cast("array<double>").alias("v"), *extra)
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.greatest(F.lit(tile_size), F.least(F.lit(GROWTH * tile_size), F.ceil(F.col("_n") / TILES)))
    sizes = sizes.withColumn("_tiles", F.greatest(F.ceil(F.col("_n") / size), F.lit(1)).cast("long"))
    from quarry.operators.indexing import join_null_safe
    t = (join_null_safe(base, sizes, keys) if keys else base.crossJoin(F.broadcast(sizes)))  # no keys: one row
    t = t.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("_tiles")))
    packed = t.groupBy(*keys, "tile", "_tiles").agg(
        F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"),
        *[F.collect_list(c).alias(f"x_{c}") for c in extra])
    pairs = packed.select(*keys, "_tiles", F.col("tile").alias("s_tile"),
                          F.explode(F.sequence(F.col("tile"), F.col("_tiles") - 1)).alias("t_tile"))
    a = packed.select(*keys, F.col("tile").alias("s_tile"), F.col("ids").alias("a_id"),
                      F.col("vs").alias("a_v"), *[F.col(f"x_{c}").alias(f"a_{c}") for c in extra])
    b = packed.select(*keys, F.col("tile").alias("t_tile"), F.col("ids").alias("b_id"),
                      F.col("vs").alias("b_v"), *[F.col(f"x_{c}").alias(f"b_{c}") for c in extra])
    # inner joins drop tile pairs whose far tile is empty
    return join_null_safe(join_null_safe(pairs, a, keys + ["s_tile"]), b, keys + ["t_tile"])


def block(av: np.ndarray, bv: np.ndarray, metric: str) -> np.ndarray:
    """Similarity (cosine) or distance (euclidean) block."""
    if metric == "cosine":
        na = np.linalg.norm(av, axis=1)
        nb = np.linalg.norm(bv, axis=1)
        den = na[:, None] * nb[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = np.where(den > 0, (av @ bv.T) / den, 0.0)
        return s
    d2 = (av * av).sum(1)[:, None] + (bv * bv).sum(1)[None, :] - 2.0 * (av @ bv.T)
    return np.sqrt(np.maximum(d2, 0.0))


def spanning_forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the bipartite graph ``hit``."""
    rows, cols = np.ones(hit.shape[0], dtype=bool), np.ones(hit.shape[1], dtype=bool)  # not reached yet
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(len(rows)):
        if not rows[start]:
            continue
        rows[start] = False
        front = np.array([start])
        while len(front):
            seen = hit[front]
            c = np.flatnonzero(seen.any(0) & cols)
            cols[c] = False
            out.append((front[seen[:, c].argmax(0)], c))
            seen = hit[:, c]
            front = np.flatnonzero(seen.any(1) & rows) if len(c) else c
            rows[front] = False
            out.append((front, c[seen[front].argmax(1)] if len(front) else front))
    if not out:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def blocks(n: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]


class Forest:
    """Union and find over points 0..n-1 with everybody's component as an array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Which of the edges connect components, taken one after the other."""
        new = np.zeros(len(xs), dtype=bool)
        for i, (x, y) in enumerate(zip(xs.tolist(), ys.tolist())):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                new[i] = True
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return new
            self.parent = up


def _exact(av: np.ndarray, bv: np.ndarray, metric: str) -> np.ndarray:
    """The measure of single pairs (row i of both), in double precision."""
    if metric != "cosine":
        return np.sqrt(((av - bv) ** 2).sum(1))
    den = np.linalg.norm(av, axis=1) * np.linalg.norm(bv, axis=1)
    return np.divide((av * bv).sum(1), den, out=np.zeros(len(den)), where=den > 0)


def _near(av: np.ndarray, bv: np.ndarray, threshold: float) -> np.ndarray:
    """cosine >= threshold: single precision screens, pairs close to the
    threshold are decided in double precision."""
    unit = []
    for x in (av, bv):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        unit.append(np.divide(x, n, out=np.zeros_like(x), where=n > 0).astype(np.float32))
    s = unit[0] @ unit[1].T
    hit = s >= threshold + 1e-5
    x, y = np.nonzero((s >= threshold - 1e-5) & ~hit)
    for i in range(0, len(x), 1 << 16):
        u, v = x[i:i + (1 << 16)], y[i:i + (1 << 16)]
        hit[u, v] = _exact(av[u], bv[v], "cosine") >= threshold
    return hit


def pair_forest(ai, av, bi, bv, threshold: float, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (lo, hi, w) that span the components of the graph between two tiles.
    Points that are already in one component are not compared: with the most
    frequent component of a block, only points outside it meet the others."""
    ids, inv = np.unique(np.concatenate([ai, bi]), return_inverse=True)
    pa, pb = inv[:len(ai)], inv[len(ai):]
    forest = Forest(len(ids))
    out = []
    for r in blocks(len(ai)):
        for c in blocks(len(bi)):
            ca, cb = forest.parent[pa[r]], forest.parent[pb[c]]
            names, counts = np.unique(np.concatenate([ca, cb]), return_counts=True)
            most = names[counts.argmax()]
            for rows, cols in ((np.flatnonzero(ca != most), np.arange(len(cb))), (np.flatnonzero(ca == most), np.flatnonzero(cb != most))):
                if not len(rows) or not len(cols):
                    continue
                x, y = av[r][rows], bv[c][cols]
                hit = _near(x, y, threshold) if metric == "cosine" else block(x, y, metric) <= threshold
                hit &= ca[rows][:, None] != cb[cols][None, :]  # a point and itself are one component, too
                u, v = spanning_forest(hit)
                u, v = rows[u] + r.start, cols[v] + c.start
                new = forest.join(pa[u], pb[v])
                out.append((u[new], v[new]))
    u, v = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=int) for k in (0, 1))
    return np.minimum(ai[u], bi[v]), np.maximum(ai[u], bi[v]), _exact(av[u], bv[v], metric)


def _edges_fn(keys, threshold, metric, forest):
    def found(s, ai, bi):
        hit = s >= threshold if metric == "cosine" else s <= threshold
        return np.nonzero(hit & (ai[:, None] < bi[None, :]))

    def fn(it):
        for pdf in it:
            for _, r in pdf.iterrows():
                ai, bi = np.asarray(r["a_id"], dtype=np.int64), np.asarray(r["b_id"], dtype=np.int64)
                av, bv = np.stack(r["a_v"]), np.stack(r["b_v"])
                outs = []
                if forest:
                    lo, hi, w = pair_forest(ai, av, bi, bv, threshold, metric)
                    outs.append(pd.DataFrame({"src": lo, "dst": hi, "w": w}))
                for x in blocks(len(ai)) if not forest else ():
                    for y in blocks(len(bi)):
                        s = block(av[x], bv[y], metric)
                        i, j = found(s, ai[x], bi[y])
                        outs.append(pd.DataFrame({"src": ai[x][i], "dst": bi[y][j], "w": s[i, j]}))
                        if r["s_tile"] != r["t_tile"]:
                            j, i = found(s.T, bi[y], ai[x])
                            outs.append(pd.DataFrame({"src": bi[y][j], "dst": ai[x][i], "w": s[i, j]}))
                for o in outs:
                    if len(o):
                        for k in keys:
                            o.insert(0, k, r[k])
                        yield o
    return fn


def similarity_edges(df: DataFrame, id_col: str, vec: str, threshold: float, by=None,
                     metric: str = "cosine", tile_size: int = 2048, forest: bool = False) -> DataFrame:
    """JOIN-5: all pairs (src < dst) in the same bucket with cosine >= cut
    (or euclidean <= cut), as an edge table (by..., src, dst, w).  With
    ``forest`` only edges that keep the same components, at most the points of
    a tile pair for each of them."""
    keys = _keys(by)
    work = tile_pairs(df, id_col, vec, keys, tile_size)
    kschema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                        for f in df.select(*keys).schema.fields)
    schema = (kschema + ", " if kschema else "") + "src long, dst long, w double"
    return work.mapInPandas(_edges_fn(keys, threshold, metric, forest), schema)


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", src: str = "src",
               dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """CLU-3: (node, comp) with comp = smallest node id of the component.

    ``nodes`` lists every node (isolated ones become singletons); edges are
    undirected.  Stops at the fixed point, or raises after ``max_rounds``.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    und = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    und = materialize(und)
    lab = nodes.select(F.col(node).alias("u")).distinct().withColumn("c", F.col("u"))
    lab = materialize(lab)
    small = lab.count() <= SMALL_ROWS
    for _ in range(max_rounds):
        far = lab.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        nb = und.join(F.broadcast(far) if small else far, "v").groupBy("u").agg(F.min("cv").alias("m"))
        prop = materialize(lab.join(F.broadcast(nb) if small else nb, "u", "left")
                           .select("u", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
        # only labels that have moved on themselves can change others
        moved = materialize(prop.select("c").distinct().join(prop.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c")
                            .where("cc < c"))
        moved = F.broadcast(moved) if moved.count() <= SMALL_ROWS else moved
        jump = prop.join(moved, "c", "left").select("u", F.coalesce("cc", "c").alias("c"), "old")
        # the previous label rides along, so the convergence test is a scan
        new = materialize(jump)
        lab = new.select("u", "c")
        if new.filter(F.col("c") != F.col("old")).limit(1).count() == 0:
            return lab.select(F.col("u").alias(node), F.col("c").alias("comp"))
    raise RuntimeError("components did not converge")
