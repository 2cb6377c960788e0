"""Nearest cluster by blocks (JOIN-3, FN-20, FN-21).

Samples x clusters is never a table.  Clusters are packed into blocks of bounded
bytes (unit centroids, keyword postings, a centre and the widest angle to it);
samples are packed into tiles of ``TILE`` rows where they are, without a shuffle.
Keywords travel as 64-bit hashes, so tiles and blocks are plain numbers.
A tile meets the blocks of its bucket in an equi-join and each meeting is one
matrix product, which leaves a best cluster per sample; the partial bests meet in
one aggregation.  A block that cannot beat what a tile has found so far, by its
keyword overlaps and the angle between sample and block, is left out.

The blocks are broadcast while their measured bytes are under ``SMALL``; beyond
that the join is a shuffle on the bucket, of which Spark splits hot keys.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.operators.indexing import join_null_safe, running_total
from quarry.session import materialize

TILE = 512
BLOCK_BYTES = 4 << 20
SMALL = 32 << 20
#: Pairs of a row's word and a cluster that has it, held at once.
MATCHES = 1_000_000


def _unit(vectors: list, width: int) -> np.ndarray:
    """Unit rows; null or zero vectors become zeros, so their cosine is 0."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None:
            x[i, : len(v)] = [0.0 if e is None else e for e in v[:width]]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _pack_clusters(t: pa.Table, schema: pa.Schema) -> pa.Table:
    t = t.sort_by("cid")
    vectors = t.column("vec").to_pylist()
    width = max((len(v) for v in vectors if v is not None), default=0)
    x = _unit(vectors, width)
    centre = x.sum(0)
    centre /= max(np.linalg.norm(centre), 1e-300)
    wide = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) if width else np.pi
    if (np.linalg.norm(x, axis=1) == 0).any():
        wide = np.pi  # a cosine of 0 can lie anywhere
    hashes = [np.unique(np.array(w or [], dtype=np.int64)) for w in t.column("words").to_pylist()]
    sizes = [len(h) for h in hashes]
    words, owner = np.concatenate(hashes), np.repeat(np.arange(len(hashes), dtype=np.int32), sizes)
    order = np.argsort(words, kind="stable")
    row = {"by": t.column("by")[0], "n": len(vectors), "width": width, "cids": t.column("cid").to_numpy().astype(np.int64).tobytes(),
           "x": x.tobytes(), "centre": centre.tobytes(), "wide": wide, "sizes": np.array(sizes, dtype=np.int64).tobytes(),
           "words": words[order].tobytes(), "owner": owner[order].tobytes()}
    return pa.Table.from_arrays([pa.array([row[f.name].as_py() if f.name == "by" else row[f.name]], f.type) for f in schema], schema=schema)


def _pack_tiles(it, schema: pa.Schema):
    """Rows of a partition, in tiles of one bucket each."""
    from pyspark import TaskContext
    held: dict = {}
    made = 0

    def tile(by, rows):
        nonlocal made
        made += 1
        cols = [[by], [(TaskContext.get().partitionId() << 32) + made], [[r[0] for r in rows]], [[r[1] for r in rows]], [[r[2] for r in rows]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for b in it:
        for by, *row in zip(*(b.column(c).to_pylist() for c in ("by", "uid", "vec", "words"))):
            rows = held.setdefault(by, [])
            rows.append(row)
            if len(rows) == TILE:
                yield tile(by, held.pop(by))
            elif len(held) > 4096:  # many small buckets: hand them on as they are
                yield from (tile(k, v) for k, v in held.items())
                held = {}
    yield from (tile(k, v) for k, v in held.items())


def _match(it, w_cos: float, w_kw: float):
    tile = best = None
    block = ("n", "width", "cids", "x", "centre", "wide", "sizes", "words", "owner")
    for batch in it:
        for i in range(batch.num_rows):
            number = batch.column("tile")[i].as_py()
            if tile is None or tile["tile"] != number:
                if tile is not None:
                    yield _found(tile, best)
                kws = batch.column("kws")[i].values
                count = np.diff(kws.offsets.to_numpy())
                tile = {"tile": number, "uids": batch.column("uids")[i].as_py(), "vecs": batch.column("vecs")[i].as_py(), "unit": {},
                        "words": kws.flatten().to_numpy(), "row": np.repeat(np.arange(len(count)), count)}
                best = np.full(len(tile["uids"]), -np.inf), np.zeros(len(tile["uids"]), dtype=np.int64)
            _visit(tile, best, {c: batch.column(c)[i].as_py() for c in block}, w_cos, w_kw)
    if tile is not None:
        yield _found(tile, best)


def _visit(tile: dict, best, r: dict, w_cos: float, w_kw: float) -> None:
    n, width = r["n"], r["width"]
    cids, sizes = (np.frombuffer(r[c], dtype=np.int64) for c in ("cids", "sizes"))
    x = np.frombuffer(r["x"]).reshape(n, width)
    if width not in tile["unit"]:
        tile["unit"] = {width: _unit(tile["vecs"], width)}
    s = tile["unit"][width]
    words, owner = np.frombuffer(r["words"], dtype=np.int64), np.frombuffer(r["owner"], dtype=np.int32)
    lo, hi = (np.searchsorted(words, tile["words"], side) for side in ("left", "right"))
    many = hi - lo  # clusters that have each word
    hits = np.zeros((len(s), n))
    total = np.cumsum(many)
    start = 0
    while start < len(many):  # common words have many clusters: about MATCHES of them at a time
        stop = max(start + 1, int(np.searchsorted(total, total[start] + MATCHES)))
        k, rows = many[start:stop], tile["row"][start:stop]
        at = np.repeat(lo[start:stop] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        first, after = rows[0], rows[-1] + 1
        hits[first:after] += np.bincount(np.repeat(rows - first, k) * n + owner[at], minlength=(after - first) * n).reshape(-1, n)
        start = stop
    overlap = hits / np.maximum(sizes, 1)
    apart = np.arccos(np.clip(s @ np.frombuffer(r["centre"]), -1, 1))
    most = w_cos * np.cos(np.maximum(0.0, apart - r["wide"] - 1e-6)) + w_kw * overlap.max(1) + 1e-9
    live = np.flatnonzero(most >= best[0])
    if not len(live):
        return
    score = w_cos * (s[live] @ x.T) + w_kw * overlap[live]
    j = score.argmax(1)  # the first: clusters are in the order of their ids
    top, cid = score[np.arange(len(live)), j], cids[j]
    better = (top > best[0][live]) | ((top == best[0][live]) & (cid < best[1][live]))
    best[0][live[better]], best[1][live[better]] = top[better], cid[better]


def _found(tile: dict, best) -> pa.RecordBatch:
    known = np.array([v is not None for v in tile["vecs"]]) & np.isfinite(best[0])
    return pa.RecordBatch.from_arrays([pa.array(np.array(tile["uids"], dtype=np.int64)[known]), pa.array(best[0][known]),
                                       pa.array(best[1][known])], names=["uid", "score", "cid"])


def nearest_cluster(samples: DataFrame, clusters: DataFrame, words: DataFrame | None = None,
                    w_cos: float = 0.7, w_kw: float = 0.3) -> DataFrame:
    """uid, cid, score: the cluster with the largest w_cos cos + w_kw overlap;
    equal scores go to the smallest cluster id.

    samples: by, uid (unique), vec, words (array); clusters: by, cid, vec; words:
    by, cid, word.  Samples whose bucket has no cluster (a null bucket has none)
    or whose vector is null are absent."""
    from pyspark.sql.pandas.types import to_arrow_schema
    kind = clusters.schema["by"].dataType
    sets = clusters.select("by", "cid").distinct().withColumn("words", F.array().cast("array<bigint>")) if words is None else \
        words.where("word is not null").groupBy("by", "cid").agg(F.collect_set(F.xxhash64("word")).alias("words"))
    c = clusters.where("by is not null").select("by", F.col("cid").cast("long").alias("cid"), F.col("vec").cast("array<double>").alias("vec"))
    c = materialize(c.join(sets, ["by", "cid"], "left"))
    size = F.greatest(F.size("vec"), F.lit(0)) * 8 + F.greatest(F.size("words"), F.lit(0)) * 12 + 16
    sized = running_total(c.select("by", "cid", size.cast("long").alias("bytes")), ["cid"], ["bytes"], by="by")
    c = c.join(sized.select("by", "cid", F.floor((F.col("cum_bytes") - F.col("bytes")) / BLOCK_BYTES).alias("blk"), "bytes"), ["by", "cid"])
    out = StructType([StructField("by", kind), *StructType.fromDDL(
        "n int, width int, cids binary, x binary, centre binary, wide double, sizes binary, words binary, owner binary").fields])
    arrow = to_arrow_schema(out)
    blocks = materialize(c.groupBy("by", "blk").applyInArrow(lambda t: _pack_clusters(t, arrow), out))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    tiles = StructType([StructField("by", kind), *StructType.fromDDL(
        "tile long, uids array<long>, vecs array<array<double>>, kws array<array<bigint>>").fields])
    tile_arrow = to_arrow_schema(tiles)
    hashed = F.transform(F.array_distinct(F.array_compact(F.coalesce("words", F.array().cast("array<string>")))), lambda w: F.xxhash64(w))
    s = samples.where("by is not null").select("by", "uid", F.col("vec").cast("array<double>").alias("vec"), hashed.alias("words"))
    s = s.mapInArrow(partial(_pack_tiles, schema=tile_arrow), tiles)
    met = s.join(F.broadcast(blocks) if total <= SMALL else blocks, "by")
    parts = met.mapInArrow(partial(_match, w_cos=w_cos, w_kw=w_kw), "uid long, score double, cid long")
    key = F.struct("score", -F.col("cid"))
    return parts.groupBy("uid").agg(F.max_by("cid", key).alias("cid"), F.max("score").alias("score"))


def assign(samples: DataFrame, found: DataFrame, out: str, score: str) -> DataFrame:
    """``samples`` with their cluster and its score (null where there is none)."""
    return join_null_safe(samples, found.select("uid", F.col("cid").alias(out), F.col("score").alias(score)), "uid", "left")
