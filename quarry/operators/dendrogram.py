"""Cluster trees from minimum spanning trees, in slices (CLU-2, CLU-8).

The single-linkage tree of a bucket has a node per MST edge, in the order of
(d, u, v): an edge joins the two components that the edges before it have made.
The edges of a bucket are ranked and cut into slices of ``SLICE``.  A slice needs
to know of the earlier ones only which components its own endpoints lie in, so

1. **contraction**: slice after slice, a task finds the components that the slice
   makes, by union and find; in all later slices (last edge, size) of a component
   replaces the endpoints in it.  That is a turn of two tables per slice, whatever
   the shape of the tree: passing labels along the edges instead takes as many
   rounds as a component is long.  After the last turn every slice stands alone;
2. **slices**: each builds its part of the tree in one task, by union and find.
   Links between slices are few and are followed by pointer jumping;
3. **condensing**: an edge with at least ``min_cluster_size`` points on both
   sides splits its cluster in two; a smaller side drops out of it.  A cluster's
   stability, the sum over points that leave it of (1 / d - its birth), comes
   from partial sums per cluster;
4. **selection** by excess of mass: a cluster stays if its stability reaches the
   sum of its children's best.  Clusters lie in blocks by their edge rank; a round
   works out all of a block that depends on nothing outside, upwards and then
   downwards.  Children have lower ranks than parents, so there are at most as
   many rounds as blocks, and one where a bucket fits a slice.

No task sees more than a slice of a bucket, however large the bucket is.  A bucket
that fits one slice needs none of the joins above: its task goes through all steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.indexing import join_null_safe
from quarry.operators.sampling import group_rank
from quarry.session import materialize

#: Edges (and clusters) that one task holds.
SLICE = 200_000


def _numbered(mst: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The edges with a bucket number ``g``, and the buckets' keys."""
    if not keys:
        return mst.select(F.lit(0).cast("long").alias("g"), "u", "v", "d"), None
    buckets = materialize(mst.select(*keys).distinct().withColumn("g", F.monotonically_increasing_id()))
    return join_null_safe(mst, buckets, keys).select("g", "u", "v", "d"), buckets


def _contract(edges: DataFrame, size: int, slices: int) -> DataFrame:
    """Endpoints in components that earlier slices have made become (last edge, size)."""
    done, rest = [], edges.withColumn("s", F.floor((F.col("r") - 1) / size))
    for k in range(slices - 1):
        now, rest = rest.where(F.col("s") == k), rest.where(F.col("s") > k)
        done.append(now)
        to = materialize(now.groupBy("g").applyInPandas(_slice_ends, "g long, at long, top long, size long"))
        for end, n in (("a", "sa"), ("b", "sb")):
            rest = (rest.join(to.withColumnRenamed("at", end), ["g", end], "left")
                    .withColumns({end: F.coalesce("top", end), n: F.coalesce("size", n)}).drop("top", "size"))
        rest = materialize(rest)
    for now in done:
        rest = rest.unionByName(now)
    return materialize(rest.select(*edges.columns))


class _Joined:
    """A slice's edges taken one after the other: the components they join (named by
    their last edge, or the endpoint) and the edge of the slice above each."""

    def __init__(self, pdf: pd.DataFrame):
        n = len(pdf)
        self.labels, inv = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        top, size = self.labels.copy(), np.zeros(len(self.labels), dtype=np.int64)
        size[inv] = np.concatenate([pdf["sa"].to_numpy(), pdf["sb"].to_numpy()])
        parent = np.arange(len(self.labels))
        self.left, self.right, self.nl, self.nr = (np.zeros(n, dtype=np.int64) for _ in range(4))
        self.above = np.full(n, -1)
        rank = pdf["r"].to_numpy()
        local: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in range(n):
            x, y = find(inv[i]), find(inv[n + i])
            self.left[i], self.right[i], self.nl[i], self.nr[i] = top[x], top[y], size[x], size[y]
            for child in (int(top[x]), int(top[y])):
                if child in local:
                    self.above[local[child]] = i
            small, big = (x, y) if size[x] < size[y] else (y, x)
            parent[small] = big
            top[big], size[big] = rank[i], self.nl[i] + self.nr[i]
            local[int(rank[i])] = i
        roots = [find(x) for x in range(len(self.labels))]
        self.top, self.size = top[roots], size[roots]


def _slice_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """What becomes of a slice's endpoints."""
    done = _Joined(pdf.sort_values("r", ignore_index=True))
    return pd.DataFrame({"g": pdf["g"].iloc[0], "at": done.labels, "top": done.top, "size": done.size})


def _slice_tree(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """The tree nodes of one slice: children, sizes, and how far up inside the
    slice a node's cluster reaches (``done``: a split ends it there)."""
    pdf = pdf.sort_values("r", ignore_index=True)
    n, rank = len(pdf), pdf["r"].to_numpy()
    t = _Joined(pdf)
    split = (t.nl >= least) & (t.nr >= least)
    up, done = rank.copy(), np.zeros(n, dtype=bool)
    for i in range(n - 1, -1, -1):
        p = t.above[i]
        if p >= 0:
            up[i], done[i] = (rank[i], True) if split[p] else (up[p], done[p])
    return pd.DataFrame({"g": pdf["g"], "r": rank, "d": pdf["d"], "lft": t.left, "rgt": t.right, "nl": t.nl, "nr": t.nr,
                         "up": up, "done": done, "split": split})


def _tree(edges: DataFrame, least: int, size: int) -> DataFrame:
    """Tree nodes with the cluster ``cl`` they belong to, named by its top node."""
    nodes = materialize(edges.withColumn("s", F.floor((F.col("r") - 1) / size)).groupBy("g", "s").applyInPandas(
        lambda p: _slice_tree(p, least), "g long, r long, d double, lft long, rgt long, nl long, nr long, "
                                         "up long, done boolean, split boolean"))
    child = nodes.select("g", F.col("r").alias("p"), "up", "done", "split", F.explode(F.array("lft", "rgt")).alias("c"))
    other = (F.col("c") > 0) & (F.floor((F.col("c") - 1) / size) != F.floor((F.col("p") - 1) / size))
    jump = child.where(other).select("g", "c", F.when(F.col("split"), F.col("c")).otherwise(F.col("up")).alias("to"),
                                     (F.col("split") | F.col("done")).alias("fin"))
    root = nodes.groupBy("g").agg(F.max("r").alias("c")).select("g", "c", F.col("c").alias("to"), F.lit(True).alias("fin"))
    jump = materialize(jump.unionByName(root))
    while not jump.where(~F.col("fin")).isEmpty():  # each turn doubles the way: log2(slices) turns
        far = jump.select("g", F.col("c").alias("to"), F.col("to").alias("to2"), F.col("fin").alias("fin2"))
        jump = materialize(jump.where("fin").unionByName(
            jump.where(~F.col("fin")).join(far, ["g", "to"]).select("g", "c", F.col("to2").alias("to"), F.col("fin2").alias("fin"))))
    found = jump.select("g", F.col("c").alias("up"), "to")
    return materialize(nodes.join(found, ["g", "up"], "left").withColumn(
        "cl", F.when(F.col("done"), F.col("up")).otherwise(F.col("to"))).drop("up", "to", "done"))


def _clusters(nodes: DataFrame, least: int) -> DataFrame:
    """g, c, parent (null for the root), stab."""
    inf = F.lit(float("inf"))
    lam = F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(inf)
    out = F.when(F.col("split"), F.col("nl") + F.col("nr")).otherwise(
        F.when(F.col("nl") < least, F.col("nl")).otherwise(0) + F.when(F.col("nr") < least, F.col("nr")).otherwise(0))
    big = nodes.where(F.col("nl") + F.col("nr") >= least).select("g", "cl", lam.alias("lam"), out.alias("out"))
    sums = big.groupBy("g", F.col("cl").alias("c")).agg(
        F.sum(F.when(F.col("lam") < inf, F.col("lam") * F.col("out")).otherwise(0.0)).alias("mass"),
        F.sum(F.when(F.col("lam") < inf, F.col("out")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("lam") < inf, 0).otherwise(F.col("out"))).alias("never"))
    tops = nodes.where("split").select("g", F.explode(F.array("lft", "rgt")).alias("c"), lam.alias("birth"), F.col("cl").alias("parent"))
    root = nodes.groupBy("g").agg(F.max("r").alias("c")).select("g", "c", F.lit(0.0).alias("birth"),
                                                                F.lit(None).cast("long").alias("parent"))
    # points that leave at the distance 0 stay for ever; a cluster born there has no time of its own
    stab = F.when(F.col("birth") == inf, 0.0).otherwise(
        F.col("mass") - F.col("birth") * F.col("left") + F.when(F.col("never") > 0, inf).otherwise(0.0))
    return materialize(tops.unionByName(root).join(sums, ["g", "c"]).select("g", "c", "parent", stab.alias("stab")))


def _rounds(state: DataFrame, size: int, step, schema: str, link) -> DataFrame:
    """Block by block until every cluster is known; ``link`` carries what became
    known to the clusters that wait."""
    done = None
    while True:
        out = materialize(state.withColumn("blk", F.floor((F.col("c") - 1) / size)).groupBy("g", "blk")
                          .applyInPandas(step, schema))
        done = out.where("known") if done is None else done.unionByName(out.where("known"))
        wait = out.where(~F.col("known"))
        if wait.isEmpty():
            return done
        state = materialize(link(wait, out.where("known")))


def _select(clusters: DataFrame, size: int) -> DataFrame:
    """g, c, lab: the chosen cluster at or above each cluster (0 if none)."""
    kids = clusters.where("parent is not null").groupBy("g", F.col("parent").alias("c")).agg(F.count(F.lit(1)).alias("missing"))
    state = clusters.join(kids, ["g", "c"], "left").withColumn("missing", F.coalesce("missing", F.lit(0)))

    def link_up(wait: DataFrame, known: DataFrame) -> DataFrame:
        # a block passes on to its own clusters by itself
        new = (known.withColumn("own_blk", F.floor((F.col("c") - 1) / size) == F.floor((F.col("parent") - 1) / size))
               .where(~F.col("own_blk")).groupBy("g", F.col("parent").alias("c"))
               .agg(F.sum("best").alias("more"), F.count(F.lit(1)).alias("n")))
        return (wait.join(new, ["g", "c"], "left")
                .withColumns({"below": F.col("below") + F.coalesce("more", F.lit(0.0)),
                              "missing": F.col("missing") - F.coalesce("n", F.lit(0))}).select(*state.columns, "below"))

    schema = "g long, c long, parent long, stab double, missing long, below double, best double, own boolean, known boolean"
    up = _rounds(state.withColumn("below", F.lit(0.0)), size, _up_step, schema, link_up)
    down = up.select("g", "c", "parent", "own", F.when(F.col("parent").isNull(), 0).cast("long").alias("above"))
    down = materialize(down)

    def link_down(wait: DataFrame, known: DataFrame) -> DataFrame:
        new = known.select("g", F.col("c").alias("parent"), F.col("lab").alias("new"))
        return (wait.join(new, ["g", "parent"], "left").withColumn("above", F.coalesce("above", "new"))
                .select("g", "c", "parent", "own", "above"))

    return materialize(_rounds(down, size, _down_step, "g long, c long, parent long, own boolean, above long, lab long, known boolean",
                               link_down).select("g", "c", "lab"))


def _up_step(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c", ignore_index=True)
    at = {c: i for i, c in enumerate(pdf["c"].tolist())}
    below, missing, stab = (pdf[c].to_numpy().copy() for c in ("below", "missing", "stab"))
    best = np.zeros(len(pdf))
    for i, p in enumerate(pdf["parent"].tolist()):  # children come before their parents
        if missing[i] == 0:
            best[i] = max(stab[i], below[i])
            j = at.get(p)
            if j is not None:
                below[j] += best[i]
                missing[j] -= 1
    return pdf.drop(columns="blk").assign(below=below, missing=missing, best=best, own=~(below > stab), known=missing == 0)[
        ["g", "c", "parent", "stab", "missing", "below", "best", "own", "known"]]


def _down_step(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("c", ascending=False, ignore_index=True)
    lab: dict[int, int] = {}
    out = np.full(len(pdf), -1)
    rows = zip(pdf["c"].tolist(), pdf["parent"].tolist(), pdf["own"].tolist(), pdf["above"].tolist())
    for i, (c, parent, own, above) in enumerate(rows):
        known = lab.get(parent, above)
        if known is None or known != known:  # null arrives as NaN
            continue
        root = parent is None or parent != parent
        out[i] = lab[c] = int(known) or (c if own and not root else 0)
    return pdf.drop(columns="blk").assign(lab=out, known=out >= 0)[["g", "c", "parent", "own", "above", "lab", "known"]]


def bucket_labels(u: np.ndarray, v: np.ndarray, d: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of one bucket's MST and their clusters, all steps in one go; none
    where there is one cluster at most."""
    order = np.lexsort((v, u, d))
    u, v, d = u[order], v[order], d[order]
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    n = len(d)
    tree = _slice_tree(pd.DataFrame({"g": 0, "r": np.arange(1, n + 1), "d": d, "a": -1 - ends[:n], "b": -1 - ends[n:],
                                     "sa": 1, "sb": 1}), least)
    lft, rgt, nl, nr, cl, split = (tree[c].to_numpy() for c in ("lft", "rgt", "nl", "nr", "up", "split"))
    lam = np.divide(1.0, d, out=np.full(n, np.inf), where=d > 0)
    out = np.where(split, nl + nr, np.where(nl < least, nl, 0) + np.where(nr < least, nr, 0))
    ends_ = np.isfinite(lam) & (nl + nr >= least)
    mass = np.bincount(cl[ends_], lam[ends_] * out[ends_], n + 1)
    left = np.bincount(cl[ends_], out[ends_], n + 1)
    never = np.bincount(cl[np.isinf(lam)], out[np.isinf(lam)], n + 1)
    birth, parent = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    for side in (lft, rgt):
        birth[side[split]], parent[side[split]] = lam[split], cl[split]
    with np.errstate(invalid="ignore"):
        stab = np.where(np.isinf(birth), 0.0, mass - birth * left + np.where(never > 0, np.inf, 0.0))
    clusters = np.unique(cl)  # children come before their parents
    below, own = np.zeros(n + 1), np.zeros(n + 1, dtype=bool)
    for c in clusters.tolist():
        own[c] = not below[c] > stab[c]
        below[parent[c]] += max(stab[c], below[c])
    lab = np.zeros(n + 1, dtype=np.int64)
    for c in clusters[-2::-1].tolist():  # without the root
        lab[c] = lab[parent[c]] or (c if own[c] else 0)
    placed = np.zeros(len(ids), dtype=np.int64)
    for side in (lft, rgt):
        placed[-1 - side[side < 0]] = lab[cl[side < 0]]
    chosen, first = np.unique(placed, return_index=True)
    first = first[chosen > 0]
    if len(first) < 2:
        return ids[:0], placed[:0]
    number = np.full(n + 1, -1)
    number[placed[np.sort(first)]] = np.arange(len(first))
    return ids, number[placed]


def _labels_at_once(mst: DataFrame, keys: list[str], least: int) -> DataFrame:
    schema = mst.select(*keys, F.col("u").alias("id"), F.lit(0).cast("long").alias("cluster")).schema

    def fn(t: pa.Table) -> pa.Table:
        ids, cluster = bucket_labels(*(t.column(c).to_numpy() for c in ("u", "v", "d")), least)
        return pa.Table.from_arrays([pa.repeat(t.column(k)[0], len(ids)) for k in keys] + [pa.array(ids), pa.array(cluster)],
                                    names=[*keys, "id", "cluster"])

    return mst.groupBy(*keys).applyInArrow(fn, schema)


def density_labels(mst: DataFrame, keys: list[str], min_cluster_size: int = 2, size: int = SLICE) -> DataFrame:
    """(keys..., id, cluster) of every point of the MSTs (keys..., u, v, d); -1 is
    noise.  Clusters are numbered within a bucket by their smallest id.  Buckets
    with one cluster or none return no rows."""
    least = max(2, min_cluster_size)
    mst = materialize(mst.select(*keys, "u", "v", "d"))
    sizes = materialize(mst.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0"))
    low, high = sizes.agg(F.min("_n"), F.max("_n")).first()
    if high is None or high <= size:
        return _labels_at_once(mst, keys, least)
    wide = sizes.where(F.col("_n") > size).drop("_n")
    sliced = _labels_in_slices(join_null_safe(mst, wide, keys, "left_semi") if keys else mst, keys, least, size)
    if low > size:
        return sliced
    return sliced.unionByName(_labels_at_once(join_null_safe(mst, wide, keys, "left_anti"), keys, least))


def _labels_in_slices(mst: DataFrame, keys: list[str], least: int, size: int) -> DataFrame:
    edges, buckets = _numbered(mst, keys)
    edges = materialize(edges)
    points = edges.select("g", F.col("u").alias("id")).unionByName(edges.select("g", F.col("v").alias("id"))).distinct()
    points = materialize(group_rank(points, "g", ["id"], "ix"))
    one = F.lit(1).cast("long")
    ranked = group_rank(edges, "g", ["d", "u", "v"], "r")
    for end, name in (("u", "a"), ("v", "b")):
        ranked = ranked.join(points.select("g", F.col("id").alias(end), (-F.col("ix")).alias(name)), ["g", end])
    edges = materialize(ranked.select("g", "r", "d", "a", "b", one.alias("sa"), one.alias("sb")))
    last = edges.agg(F.max("r")).first()[0] or 0
    edges = _contract(edges, size, -(-last // size))
    nodes = _tree(edges, least, size)
    labels = _select(_clusters(nodes, least), size)
    fell = nodes.select("g", F.col("cl").alias("c"), F.explode(F.array("lft", "rgt")).alias("p")).where("p < 0")
    placed = materialize(fell.join(labels, ["g", "c"]).select("g", (-F.col("p")).alias("ix"), "lab").join(points, ["g", "ix"]))
    chosen = placed.where("lab > 0").groupBy("g", "lab").agg(F.min("id").alias("first"))
    numbers = group_rank(chosen, "g", ["first"], "no", "of").where("of > 1")
    numbers = materialize(numbers.select("g", "lab", (F.col("no") - 1).alias("cluster")))
    out = (placed.join(numbers.select("g").distinct(), "g", "left_semi").join(numbers, ["g", "lab"], "left")
           .select("g", "id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster")))
    return out.drop("g") if buckets is None else out.join(buckets, "g").select(*keys, "id", "cluster")
