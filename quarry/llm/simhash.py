"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 6).

A fingerprint has 64 bits: a bit is set if it is set in over half of the
XXH64 hashes (seed 42) of the text's three-word shingles.  Documents whose
fingerprints differ in at most three bits are linked.

Candidates.  The fingerprint is cut into segments of 23, 23 and 18 bits (the
last padded with zeros).  The binary Golay code of length 23 is perfect: every
word lies within distance 3 of exactly one codeword c(x).  Let K(x) be the
codewords within distance 4 of x: c(x), and five more if x is at distance 3.
If d(x, y) <= 1 then c(x) is in K(y), since d(c(x), y) <= 3 + 1.  Of three bit
errors over three segments the two segments with the fewest have at most one
each (pigeonhole).  So for x, y linked, some pair (i, j) of segments has
c_i(x) in K_i(y) and c_j(y) in K_j(x): the key (i, j, c_i(x), c_j(y)) is among
x's keys {c_i(x)} x K_j(x) and among y's keys K_i(y) x {c_j(y)}.  Each distinct
fingerprint gives about 16 keys on either side; the equi-join on the key
verifies the distance of each candidate pair before it leaves the join.

Documents with equal fingerprints are one node.  A key that many fingerprints
share (near copies by the thousand) is not joined pair by pair: its
fingerprints are cut into blocks of at most ``BLOCK``, every pair of blocks is
compared in one bounded numpy task, and the task returns a spanning forest of
the links it found (fewer edges than the blocks have rows), which connects the
same documents as all of them.  No link between components is lost.

Components grow by label propagation with pointer jumping over the linked
fingerprints, a table in the checkpoint folder per round.  Documents join
their fingerprint's component by exchange, but for the fingerprints that hold
more than one in ``HOT_SHARE`` of the rows: there are fewer than ``HOT_SHARE``
of them at every input size, so they are broadcast and their rows stay put.

Defined cases: a null or empty text has no word and fingerprint zero, which
links like any other.  A null id never names a component that has an id.
Repeated rows fall into one component.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep_rows, map_batches, materialize, text_or_empty
from quarry.llm.exact_dedup import sha256
from quarry.operators.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 512
HOT_SHARE = 1024
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code (fixed value).
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASHES = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; shingles are hashed in blocks."""
    w = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(w) > words:
        starts, ends = starts[: 1 - words], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, dtype=np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        cut = zip(starts[at: at + _HASHES].tolist(), ends[at: at + _HASHES].tolist())
        got = np.array([h(line[a:b], SEED) for a, b in cut], dtype="<u8")
        ones += np.unpackbits(got.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE, **carried: Column) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the carried
    string columns."""
    names = ["doc_id", "fp", *carried]

    def run(it):
        for b in it:
            got = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64)), *b.columns[2:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *[c.alias(k) for k, c in carried.items()])
    return map_batches(rows, run, ", ".join(["doc_id long", "fp long", *[f"{k} string" for k in carried]]))


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word, leader weight and
    patterns per syndrome: (syndrome halves, at distance <= 3, at distance 4)."""
    unit = []
    for k in range(23):
        r = 1 << k
        for b in range(k, 10, -1):
            if r >> b & 1:
                r ^= GOLAY << (b - 11)
        unit.append(r)
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for table, first in ((low, 0), (high, 12)):
        for k in range(len(table).bit_length() - 1):
            table[1 << k: 2 << k] = table[: 1 << k] ^ unit[first + k]
    near = np.zeros(1 << 11, np.int32)
    far: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            pattern = sum(1 << b for b in bits)
            if weight <= 3:
                near[s] = pattern
            else:
                far[s].append(pattern)
    patterns = np.full((1 << 11, 6), -1, np.int32)
    patterns[:, 0] = near
    for s, p in enumerate(far):
        patterns[s, 1: 1 + len(p)] = p
    return low, high, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): the index of c(x) first, then those of the other codewords in
    K(x), -1 where there are none.  The upper 12 bits name a codeword."""
    low, high, patterns = golay_tables()
    p = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return np.where(p >= 0, (words[:, None] ^ p) >> 11, -1)


def _keys(it):
    """fp -> (side, key, fp) rows; side 0 holds its first segment's c, side 1 its second's."""
    for b in it:
        fp = b.column(0).to_numpy()
        u = fp.view(np.uint64)
        idx = [codeword_indices(((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64))
               for at, n in SEGMENTS]
        sides, keys, owner = [], [], []
        for n, (i, j) in enumerate(combinations(range(3), 2)):
            for side, fixed, spread in ((0, i, j), (1, j, i)):
                row, col = np.nonzero(idx[spread] >= 0)
                first, second = idx[fixed][row, 0], idx[spread][row, col]
                a, c = (first, second) if side == 0 else (second, first)
                keys.append((n << 24) | (a << 12) | c)
                owner.append(fp[row])
                sides.append(np.full(len(row), side, np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(sides)), pa.array(np.concatenate(keys).astype(np.int64)),
             pa.array(np.concatenate(owner))], names=["side", "key", "fp"])


def spanning_links(a: np.ndarray, b: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``a`` and ``b`` (either may
    repeat the other); fewer than len(a) + len(b) edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= max_bits
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(near))):
        p, q = root(int(at[x])), root(int(at[len(a) + y]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(a[x]), int(b[y])))
    return out


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (src, dst) that connect all that
    are within ``max_bits`` (at most 3) of each other."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with at most one error each need max_bits <= 3")
    keyed = materialize(map_batches(nodes.select("fp"), _keys, "side int, key long, fp long"))
    # key space: 3 x 2^24; keys beyond a block on either side are crowded
    sizes = keyed.groupBy("key").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("na"),
                                     F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("nb"))
    crowded = materialize(sizes.where((F.col("na") > block) | (F.col("nb") > block)))
    some = not crowded.isEmpty()
    plain = keyed.join(crowded.select("key"), "key", "left_anti") if some else keyed
    a = plain.where("side = 0").select("key", F.col("fp").alias("src"))
    b = plain.where("side = 1").select("key", F.col("fp").alias("dst"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits
    pairs = a.join(b.withColumnRenamed("key", "k2"),
                   (F.col("key") == F.col("k2")) & (F.col("src") != F.col("dst")) & close).select("src", "dst")
    if some:
        pairs = pairs.unionByName(_crowded_links(keyed, crowded, max_bits, block))
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _crowded_links(keyed: DataFrame, crowded: DataFrame, max_bits: int, block: int) -> DataFrame:
    """Block pairs of the crowded keys, compared in tasks of two blocks."""
    # a fingerprint's side does not matter here: the members of a key are compared all with all
    members = keyed.join(crowded.select("key"), "key").select("key", "fp").distinct()
    counts = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = members.join(counts, "key").withColumn("at", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    # a block meets itself and every later one; its rows are sent once per meeting
    left = placed.select("key", "fp", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("blocks") - 1)).alias("j"))
    right = placed.select("key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at"))).alias("i"),
                          F.col("at").alias("j"))
    met = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def compare(table: pa.Table) -> pa.Table:
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy()
        got = spanning_links(fp[side == 0], fp[side == 1], max_bits)
        return pa.table({"src": pa.array([x for x, _ in got], pa.int64()), "dst": pa.array([y for _, y in got], pa.int64())})

    return met.groupBy("key", "i", "j").applyInArrow(compare, "src long, dst long")


def linked(nodes: DataFrame, max_bits: int) -> DataFrame | None:
    """fp, comp of the fingerprints that have a link; comp is one of the
    component's fingerprints.  None if there is no link."""
    edges = materialize(links(nodes, max_bits))
    if edges.isEmpty():
        return None
    ends = edges.select(F.col("src").alias("fp")).unionByName(edges.select(F.col("dst").alias("fp"))).distinct()
    return components(ends, edges, node="fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over links."""
    marked = materialize(fingerprints(docs, id_col, text_col, words))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    group = linked(nodes, max_bits)
    if group is None:
        named = nodes.select("fp", "rows", F.col("first").alias("component_id"))
    else:
        # a component's fingerprints may be many: the smallest id by a partial aggregate, joined back
        first = group.join(nodes, "fp").groupBy("comp").agg(F.min("first").alias("component_id"))
        of = group.join(first, "comp").select("fp", F.col("component_id").alias("c"))
        named = materialize(nodes.join(of, "fp", "left").select("fp", "rows", F.coalesce("c", "first").alias("component_id")))
    hot = F.col("rows") > marked.count() // HOT_SHARE
    few, rest = named.where(hot).drop("rows"), named.where(~hot).drop("rows")
    found = marked.join(F.broadcast(few), "fp").unionByName(
        marked.join(F.broadcast(few.select("fp")), "fp", "left_anti").join(rest, "fp"))
    return found.select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: that of the
    smallest id (null last), then of the smallest text digest.  Components are
    those of the fingerprints, so unrelated texts that share an id, or have
    none, all stay."""
    digest = sha256(text_or_empty(text_col))
    marked = materialize(fingerprints(docs, id_col, text_col, words, digest=digest))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    nodes = materialize(marked.groupBy("fp").agg(first.alias("first")))
    group = linked(nodes, max_bits)
    if group is not None:
        nodes = (nodes.join(group, "fp", "left").groupBy(F.coalesce("comp", "fp").alias("comp"))
                 .agg(F.min("first").alias("first")))
    return keep_rows(docs, nodes.select("first.doc_id", "first.digest"), {"doc_id": F.col(id_col), "digest": digest})


__all__ = ["fingerprint", "fingerprints", "links", "near_duplicates", "one_of_each"]
