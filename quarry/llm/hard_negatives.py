"""Hard-negative mining over anchor-clustered shared lists (operator 11).

Anchors are grouped by direction (spherical k-means over a bounded sample of
them).  For a row at angle t from a cluster's centre, and a cluster whose
members lie within w of it, no member's inner product with the row passes

    |member| * |row| * cos(max(0, t - w)),

so each cluster has one candidate list in the order of |row| cos(max(0, t - w)),
and every member walks that same list until the bound cannot reach the worst
result it still needs: a certified end.  The list is kept in blocks: rows of one
cell and at most ``BLOCK`` of them make a block, a cluster's blocks are ordered
by their largest bound, and the rows of a block by their own.

A search runs twice over the list: the first ``HEAD`` blocks give every anchor a
floor, then only blocks that can reach the least floor of an anchor block are
joined, in sections of ``SECTION`` blocks that run in parallel.  There is no
limit on how far a walk goes, so results are exact.  Mining needs two searches:
same-label rows for the positives, then rows of other labels inside the score
window of each positive.

Bounds get a slack over the rounding of their doubles.  Scores are exact: in
doubles while they stay under 2^52, else in Python integers, saturating at the
range of a 64-bit integer.

Defined cases: rows with a null label, a null vector, or a null, NaN or infinite
component take no part.  Shorter vectors count as padded with zeros.  Rows that
repeat are rows of their own: each is an anchor, a positive or a negative.  A row
with a null id is no anchor; it comes last among equal scores.  An anchor without
another row of its label, or without a row in a window, gives no rows.  An empty
table gives none.  Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialize
from quarry.operators.sampling import group_rank

#: Anchors that the clusters are fitted on, and anchors per cluster among them.
SAMPLE = 4096
MEMBERS = 256
BLOCK = 2048
ANCHORS = 1024
HEAD = 8
SECTION = 8
CHUNK = 512
_MAX, _MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_SLACK = 1e-6
_BLOCK_SCHEMA = ("cell int, blk long, n int, d int, uids binary, ids binary, labels binary, v binary, "
                 "label_lo long, label_hi long, ")


def _matrix(col: pa.Array) -> np.ndarray:
    """list<long> -> (rows, longest) int64, padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_clusters(sample: list[list[int]], members: int = MEMBERS, rounds: int = 12) -> np.ndarray:
    """Unit centres of the sampled anchors' directions, one per ``members`` of
    them and at least one."""
    if not sample:
        return np.zeros((1, 1))
    x = _matrix(pa.array(sample, pa.list_(pa.int64()))).astype(np.float64)
    if not x.shape[1]:
        return np.zeros((1, 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = max(1, len(x) // members)
    centres = x[:: max(1, len(x) // k)][:k]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[near == c].sum(0) for c in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), centres)
    return centres


def angles(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angle to each centre); a zero vector lies at angle 0."""
    f = v.astype(np.float64)
    norm = np.linalg.norm(f, axis=1)
    d = min(f.shape[1], centres.shape[1])
    cos = f[:, :d] @ centres[:, :d].T / np.maximum(norm, 1e-300)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def reach(norm: np.ndarray, angle: np.ndarray, width) -> np.ndarray:
    """Upper bound of a row's inner product with a unit member."""
    return norm[:, None] * (np.cos(np.maximum(0.0, angle - width - _SLACK)) + 1e-9)


def _place(it, centres):
    for b in it:
        norm, angle = angles(_matrix(b.column("v")), centres)
        cell = np.argmin(angle, axis=1) if len(norm) else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell], pa.float64())],
            names=[*b.schema.names, "cell", "angle"])


def _packed(t: pa.Table) -> tuple[dict, np.ndarray]:
    """The columns of a block, and its vectors."""
    v = _matrix(t.column("v"))
    uids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("uid", "label"))
    ids = t.column("vec_id").fill_null(_MAX).to_numpy().astype(np.int64)
    small = v.size and v.min() >= -32768 and v.max() < 32768
    return {"cell": t.column("cell")[0].as_py(), "blk": t.column("blk")[0].as_py(), "n": len(v), "d": v.shape[1],
            "uids": uids.tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(),
            "v": (v.astype("<i2") if small else v).tobytes(),
            "label_lo": int(labels.min()), "label_hi": int(labels.max())}, v


def _unpacked(row: dict, p: str) -> tuple[np.ndarray, ...]:
    n, d = row[f"{p}n"], row[f"{p}d"]
    raw = row[f"{p}v"]
    kind = "<i2" if len(raw) == 2 * n * d else "<i8"
    return (*(np.frombuffer(row[p + c], dtype=np.int64) for c in ("uids", "ids", "labels")),
            np.frombuffer(raw, dtype=kind).reshape(n, d).astype(np.int64))


def _pack_rows(t: pa.Table, centres: np.ndarray, width: np.ndarray) -> pa.Table:
    cols, v = _packed(t)
    cols["reach"] = reach(*angles(v, centres), width).max(0).tolist()
    return pa.Table.from_pylist([cols], pa.schema([*_fields(), ("reach", pa.list_(pa.float64()))]))


def _fields():
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [(n, kinds[k]) for n, k in (c.split() for c in _BLOCK_SCHEMA.strip(", ").split(", "))]


def _windows(scores: list[list[int]], floors: list[list[int | None] | None], low: int, high: int, scale: int,
             wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score per anchor and positive, in Python integers; a
    missing positive has a window that nothing fits."""
    lo, hi = np.full((len(scores), wide), _MAX), np.full((len(scores), wide), _MIN)
    for i, ps in enumerate(scores):
        for w, s in enumerate(ps or ()):
            lo[i, w] = max(-((-low * s) // scale), _MIN)
            hi[i, w] = min((high * s) // scale, _MAX)
            floor = floors[i][w] if floors[i] else None
            if floor is not None:
                lo[i, w] = max(lo[i, w], floor)
    return lo, hi


def _pack_anchors(t: pa.Table, low: int, high: int, scale: int, wide: int | None) -> pa.Table:
    """``wide``: windows per anchor; None is a search without windows."""
    cols, v = _packed(t)
    floors = t.column("floors").to_pylist()
    if wide is None:
        lo = np.array([[_MIN if f is None or f[0] is None else f[0]] for f in floors], dtype=np.int64)
        hi = np.full_like(lo, _MAX)
    else:
        lo, hi = _windows(t.column("scores").to_pylist(), floors, low, high, scale, wide)
    norm = np.linalg.norm(v.astype(np.float64), axis=1)
    least = lo.min(1).astype(np.float64)
    need = np.where(norm > 0, least / np.maximum(norm, 1e-300), np.where(least <= 0, -np.inf, np.inf))
    cols |= {"lo": lo.tobytes(), "hi": hi.tobytes(), "need": float(need.min())}
    return pa.Table.from_pylist([cols], pa.schema([*_fields(), ("lo", pa.binary()), ("hi", pa.binary()),
                                                   ("need", pa.float64())]))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``b``."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if (x * x).sum(1).max() ** 0.5 * (y * y).sum(1).max() ** 0.5 < 2.0 ** 52:
        return (x @ y.T).astype(np.int64)
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -_MAX, _MAX).astype(np.int64)


class _Members:
    """The members of an anchor block on their way through a list."""

    def __init__(self, row: dict, k: int, same: bool):
        self.uids, _, self.labels, self.v = _unpacked(row, "a_")
        n = row["a_n"]
        self.lo, self.hi = (np.frombuffer(row[f"a_{c}"], dtype=np.int64).reshape(n, -1).copy() for c in ("lo", "hi"))
        self.norm = np.linalg.norm(self.v.astype(np.float64), axis=1)
        self.k, self.same, self.wide = k, same, self.lo.shape[1]
        self.count = np.zeros((n, self.wide), dtype=np.int64)
        self.best = np.full((3, n, self.wide, k), _MIN)  # score, id and uid of the results so far

    def visit(self, row: dict, centre: np.ndarray, width: float) -> None:
        uids, ids, labels, v = _unpacked(row, "b_")
        bound = reach(*angles(v, centre[None, :]), width)[:, 0]
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), CHUNK):
            live = np.flatnonzero(bound[order[at]] * self.norm >= self.lo.min(1).astype(np.float64))
            if not len(live):
                return
            pick = order[at: at + CHUNK]
            scores = exact_scores(self.v[live], v[pick])
            fits = (self.labels[live][:, None] == labels[pick]) == self.same
            if self.same:
                fits &= self.uids[live][:, None] != uids[pick]
            for w in range(self.wide):
                self.take(w, live, scores, fits & (scores >= self.lo[live, w][:, None])
                          & (scores <= self.hi[live, w][:, None]), ids[pick], uids[pick])

    def take(self, w, live, scores, fits, ids, uids) -> None:
        k = self.k
        if fits.sum() > 4 * k * len(live) and fits.shape[1] > k:
            seen = np.where(fits, scores, _MIN)
            fits &= seen >= np.partition(seen, -k, axis=1)[:, -k][:, None]
        r, c = np.nonzero(fits)
        if not len(r):
            return
        rows = np.unique(live[r])
        old = np.arange(k)[None, :] < self.count[rows, w][:, None]
        i, j = np.nonzero(old)
        row = np.concatenate([rows[i], live[r]])
        vals = np.concatenate([self.best[:, rows[i], w, j], np.stack([scores[r, c], ids[c], uids[c]])], axis=1)
        order = np.lexsort((vals[2], vals[1], -vals[0], row))
        row, vals = row[order], vals[:, order]
        first = np.searchsorted(row, row)
        rank = np.arange(len(row)) - first
        kept = rank < k
        row, rank, vals = row[kept], rank[kept], vals[:, kept]
        self.best[:, row, w, rank] = vals
        self.count[row, w] = np.maximum(self.count[row, w], 0)
        np.maximum.at(self.count, (row, w), rank + 1)
        full = rows[self.count[rows, w] == k]
        self.lo[full, w] = np.maximum(self.lo[full, w], self.best[0, full, w, k - 1])

    def results(self) -> pa.RecordBatch:
        n, w, j = np.nonzero(np.arange(self.k) < self.count[:, :, None])
        score, ids, uids = self.best[:, n, w, j]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.uids[n]), pa.array(w, pa.int32()), pa.array(score), pa.array(ids, mask=ids == _MAX), pa.array(uids)],
            names=["uid", "w", "score", "hit_id", "hit_uid"])


def _walk(it, centres: np.ndarray, width: np.ndarray, k: int, same: bool):
    key, members = None, None
    for batch in it:
        for row in batch.to_pylist():
            here = (row["a_cell"], row["a_blk"], row["section"])
            if here != key:
                if members:
                    yield members.results()
                key, members = here, _Members(row, k, same)
            members.visit(row, centres[row["a_cell"]], width[row["a_cell"]])
    if members:
        yield members.results()


class SharedLists:
    """The blocks of all rows, with their place in every cluster's list."""

    def __init__(self, rows: DataFrame, is_anchor: Column):
        """rows: vec_id long, label, v array<bigint>."""
        rows = materialize(rows.select("vec_id", F.col("label").cast("long").alias("label"), "v",
                                       F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
                                       F.monotonically_increasing_id().alias("uid")))
        sample = (rows.where("anchor").select("v", "vec_id", "uid").orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE))
        self.centres = centres = fit_clusters([r["v"] for r in sample.collect()])
        placed = materialize(map_batches(rows, partial(_place, centres=centres), "vec_id long, label long, "
                                         "v array<bigint>, anchor boolean, uid long, cell int, angle double"))
        widths = {r["cell"]: r["w"] for r in placed.where("anchor").groupBy("cell").agg(F.max("angle").alias("w")).collect()}
        self.width = width = np.array([widths.get(c, 0.0) for c in range(len(centres))])
        at = F.floor((F.col("rn") - 1) / BLOCK)
        ranked = group_rank(placed, "cell", ["label", "uid"], "rn").withColumn("blk", at)
        self.blocks = materialize(ranked.groupBy("cell", "blk").applyInArrow(
            lambda t: _pack_rows(t, centres, width), _BLOCK_SCHEMA + "reach array<double>"))
        self.anchors = (group_rank(placed.where("anchor").drop("angle"), "cell", ["label", "uid"], "rn")
                        .withColumn("blk", F.floor((F.col("rn") - 1) / ANCHORS)).drop("rn"))
        self.anchors = materialize(self.anchors)

    def search(self, k: int, same: bool, scores: DataFrame | None = None, wide: int | None = None,
               window: tuple[int, int, int] = (0, 0, 1)) -> DataFrame:
        """uid, w, score, hit_id, hit_uid, rank: the best ``k`` rows of each
        anchor and window.  scores: uid, scores (one window per score)."""
        anchors = self.anchors
        anchors = (anchors.join(scores, "uid") if scores is not None
                   else anchors.withColumn("scores", F.lit(None).cast("array<bigint>")))

        def packed(rows: DataFrame) -> DataFrame:
            return materialize(rows.groupBy("cell", "blk").applyInArrow(
                lambda t: _pack_anchors(t, *window, wide), _BLOCK_SCHEMA + "lo binary, hi binary, need double"))

        members = packed(anchors.withColumn("floors", F.lit(None).cast("array<bigint>")))
        lists = self.blocks.select(F.col("cell").alias("b_cell"), F.col("blk").alias("b_blk"), F.col("label_lo").alias("b_lo"),
                                   F.col("label_hi").alias("b_hi"), F.posexplode("reach").alias("a_cell", "bound"))
        heads = members.select(F.col("cell").alias("a_cell"), F.col("blk").alias("a_blk"), "need",
                               F.col("label_lo").alias("a_lo"), F.col("label_hi").alias("a_hi"))
        meet = (F.col("b_lo") <= F.col("a_hi")) & (F.col("a_lo") <= F.col("b_hi")) if same else F.lit(True)
        order = Window.partitionBy("a_cell", "a_blk").orderBy(F.desc("bound"), "b_cell", "b_blk")
        pairs = materialize(lists.join(heads, "a_cell").where(meet & (F.col("bound") >= F.col("need")))
                            .withColumn("at", F.row_number().over(order) - 1)
                            .select("a_cell", "a_blk", "b_cell", "b_blk", "bound", "at"))
        first = materialize(self._walked(pairs.where(F.col("at") < HEAD), members, k, same))
        floors = _best(first, k).where(F.col("rank") == k).groupBy("uid").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("f"))
        width = wide or 1
        floors = floors.select("uid", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.try_element_at("f", w))
                               .alias("floors"))
        members = packed(anchors.join(floors, "uid", "left"))
        left = pairs.where(F.col("at") >= HEAD).join(
            members.select(F.col("cell").alias("a_cell"), F.col("blk").alias("a_blk"), "need"), ["a_cell", "a_blk"])
        rest = self._walked(left.where(F.col("bound") >= F.col("need")).drop("need"), members, k, same)
        return _best(first.unionByName(rest), k)

    def _walked(self, pairs: DataFrame, members: DataFrame, k: int, same: bool) -> DataFrame:
        def named(df: DataFrame, p: str, cols) -> DataFrame:
            return df.select(*[F.col(c).alias(p + c) for c in cols])

        core = ["cell", "blk", "n", "d", "uids", "ids", "labels", "v"]
        work = (pairs.withColumn("section", F.floor(F.col("at") / SECTION))
                .join(named(self.blocks, "b_", core), ["b_cell", "b_blk"])
                .join(named(members, "a_", [*core, "lo", "hi"]), ["a_cell", "a_blk"])
                .repartition("a_cell", "a_blk", "section").sortWithinPartitions("a_cell", "a_blk", "section", "at"))
        return map_batches(work, partial(_walk, centres=self.centres, width=self.width, k=k, same=same),
                           "uid long, w int, score long, hit_id long, hit_uid long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), F.asc_nulls_last("hit_id"), "hit_uid")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    scale: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, components as floor(scale x)."""
    x = F.col(vec_col).cast("array<double>")
    label = F.col(label_col).cast("long")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return rows.where(label.isNotNull() & x.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), label.alias("label"),
        F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v.  A negative has another label than the anchor and
    low * positive_score <= scale * its score <= high * positive_score."""
    lists = SharedLists(rows, is_anchor)
    near = materialize(lists.search(positives, same=True))
    scores = near.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))),
                                                 lambda s: s["score"]).alias("scores"))
    hits = lists.search(negatives, same=False, scores=scores, wide=positives, window=(low, high, scale))
    near = near.select("uid", (F.col("rank") - 1).alias("w"), F.col("hit_id").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    ids = lists.anchors.select("uid", F.col("vec_id").alias("anchor_id"))
    return (hits.join(near, ["uid", "w"]).join(ids, "uid")
            .select("anchor_id", "positive_id", "rank", F.col("hit_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
