"""Ranked lexical search by a sparse ball tree (operator 12).

A document's vector holds, for each term t of some query, the integer
f = (10^9 tf) div (1000 tf + 8 m), where m grows with the document's length; a
query's vector holds the weight w of each of its terms.  A document's score is
their inner product, in whole numbers.

Queries come in blocks whose distinct terms stay under ``TERMS``, so a block's
dictionary has a known bound.  For each block:

1. One pass over the whole texts counts, per document, all terms and the block's
   terms (bytes in, a translation table and a split; nothing is shuffled), and
   writes a small table of sparse vectors.
2. Document frequencies, and N and L over all documents, are partial sums.
3. Documents without a term of the block score 0 and are left out.  The others
   are range-partitioned by their leading terms (then by row number, so equal
   texts spread), and every task builds ball trees over ``GROVE`` documents at
   a time: a node halves its documents by their projection on the line between
   two far documents, and keeps its centre and radius.
4. Every query searches the tree best-first.  A node's documents cannot pass

       q . centre + |q on the node's terms| * radius,

   rounded up with a slack over the error of its doubles; once the largest bound
   left is below the tenth score found, the search ends.  Leaves are scored
   exactly in 64-bit integers.  Scores of earlier trees of the task are carried
   over.
5. Each task returns at most ``k`` rows per query; a window ranks them.

Defined cases: a null or empty text has no term, scores nothing and counts
neither in N nor in L.  Each row of the queries is a query of its own, also when
ids repeat or are null; one without a term, or whose terms no document has, gives
no row.  Repeated documents are ranked each; equal scores go by ascending
document id, null last.  An empty table gives no row.  A text is one row and has
to fit a task.  Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialize, text_or_empty
from quarry.operators.indexing import running_total

TOP = 10
#: Distinct terms of a block of queries, at most (or those of one query).
TERMS = 100_000
GROVE = 16_384
LEAF = 64
#: Documents are dealt out by this many of their terms, the rarest first.
LEADING = 4
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes to those of terms: other ASCII becomes a space, A-Z lower case.
TABLE = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def query_blocks(queries: DataFrame, id_col: str, text_col: str, most: int = TERMS) -> tuple[DataFrame, int]:
    """(query, item_id, term, block), and the number of blocks."""
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    found = F.regexp_extract_all(text_or_empty(text_col), F.lit(pattern), F.lit(0))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = materialize(queries.select(
        F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"),
        F.array_distinct(F.transform(found, lambda t: F.translate(t, upper, upper.lower()))).alias("terms"))
        .withColumn("n", F.size("terms")).where("n > 0"))
    # the running total of all queries before this one decides its block
    placed = running_total(rows.select("query", "n"), ["query"], ["n"]).select(
        "query", F.floor((F.col("cum_n") - F.col("n")) / most).alias("block"))
    rows = materialize(rows.join(placed, "query").select("query", "item_id", "block", F.explode("terms").alias("term")))
    last = rows.agg(F.max("block")).first()[0]
    return rows, 0 if last is None else last + 1


def _vectors(it, code: dict[bytes, int]):
    """Per document: all its terms, and the counts of those in ``code``."""
    for b in it:
        sizes, at, tf = [], [], []
        for text in b.column("text").to_pylist():
            words = terms_of(text)
            sizes.append(len(words))
            seen = sorted((code[t], c) for t, c in Counter(words).items() if t in code)
            at.append([t for t, _ in seen])
            tf.append([c for _, c in seen])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("uid"), pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())),
             pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "uid", "n", "at", "tf"])


class BallTree:
    """Nodes over sparse rows (indptr, at, val); ``ids`` names the rows."""

    def __init__(self, indptr: np.ndarray, at: np.ndarray, val: np.ndarray, terms: int, leaf: int = LEAF):
        self.indptr, self.at, self.val = indptr, at, val
        self.sizes = np.diff(indptr)
        self.norm2 = self._dots(np.arange(len(self.sizes)), None)
        self.line = np.zeros(terms)
        self.nodes: list[tuple] = []  # (terms, centre there, radius, children or rows)
        self.root = self._build(np.arange(len(self.sizes)), leaf)

    def _flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and the first entry of each row."""
        sizes = self.sizes[rows]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.indptr[rows] - starts, sizes) + np.arange(sizes.sum()), starts

    def _dots(self, rows: np.ndarray, dense: np.ndarray | None) -> np.ndarray:
        """Inner products with a dense vector (None: with themselves)."""
        flat, starts = self._flat(rows)
        v = self.val[flat]
        v = v * (v.astype(np.float64) if dense is None else dense[self.at[flat]])
        return np.add.reduceat(v, starts) if len(starts) else v

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        flat, _ = self._flat(rows)
        sums = np.bincount(self.at[flat], weights=self.val[flat], minlength=len(self.line))
        terms = np.flatnonzero(sums)
        centre = sums[terms] / len(rows)
        self.line[terms] = centre
        far2 = self.norm2[rows] - 2 * self._dots(rows, self.line) + centre @ centre
        self.line[terms] = 0
        # the differences lose digits: allow for them
        radius = np.sqrt(max(far2.max(), 0.0) + 1e-9 * (self.norm2[rows].max() + centre @ centre))
        halves = None
        if len(rows) > leaf:
            halves = self._halves(rows, rows[int(far2.argmax())])
        at = len(self.nodes)
        self.nodes.append(None)
        below = rows if halves is None else tuple(self._build(h, leaf) for h in halves)
        self.nodes[at] = (terms, centre, radius, below)
        return at

    def _halves(self, rows: np.ndarray, one: int) -> tuple[np.ndarray, np.ndarray]:
        """Halves by the projection on the line from ``one`` to the row farthest from it."""
        def dots(row: int) -> np.ndarray:
            own = slice(self.indptr[row], self.indptr[row + 1])
            self.line[self.at[own]] = self.val[own]
            out = self._dots(rows, self.line)
            self.line[self.at[own]] = 0
            return out

        a = dots(one)
        other = rows[int((self.norm2[rows] - 2 * a).argmax())]
        order = np.argsort(dots(other) - a, kind="stable")
        return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]

    def bound(self, node: int, q: np.ndarray) -> float:
        terms, centre, radius, _ = self.nodes[node]
        own = q[terms].astype(np.float64)
        dot = own @ centre
        return (dot + np.sqrt(own @ own) * radius) * (1 + 1e-9) + 1.0

    def search(self, q: np.ndarray, ids: np.ndarray, best: list, k: int) -> None:
        """Best-first: ``best`` is a heap of (score, -id), worst first."""
        heap = [(-self.bound(self.root, q), self.root)]
        while heap:
            b, node = heapq.heappop(heap)
            if len(best) == k and -b < best[0][0]:
                return
            below = self.nodes[node][3]
            if isinstance(below, tuple):
                for child in below:
                    c = self.bound(child, q)
                    if c > 1.0 and (len(best) < k or c >= best[0][0]):
                        heapq.heappush(heap, (-c, child))
                continue
            scores = self._dots(below, q)
            hot = np.flatnonzero(scores > 0 if len(best) < k else scores >= max(best[0][0], 1))
            for s, i in zip(scores[hot].tolist(), ids[below[hot]].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))


_LAST = np.iinfo(np.int64).max  # stands for a null id, the last of all


def _search(it, queries: list[tuple[int, list[int], list[int]]], terms: int, k: int):
    """Trees over this task's documents, all queries on each."""
    best: dict[int, list] = {query: [] for query, _, _ in queries}
    held: list[pa.RecordBatch] = []

    def grove() -> None:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = t.column("doc_id").fill_null(_LAST).to_numpy()
        at, val = (t.column(c).combine_chunks() for c in ("at", "val"))
        indptr = np.concatenate([[0], np.cumsum(np.diff(at.offsets.to_numpy()))])
        tree = BallTree(indptr, at.flatten().to_numpy(), val.flatten().to_numpy(), terms)
        q = np.zeros(terms, dtype=np.int64)
        for query, where, weight in queries:
            q[where] = weight
            tree.search(q, ids, best[query], k)
            q[where] = 0

    for b in it:
        while b.num_rows:
            room = GROVE - sum(h.num_rows for h in held)
            held.append(b.slice(0, room))
            b = b.slice(min(room, b.num_rows))
            if sum(h.num_rows for h in held) == GROVE:
                grove()
    if held:
        grove()
    found = [(query, s, None if -i == _LAST else -i) for query, heap in best.items() for s, i in heap]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
         pa.array([f[2] for f in found], pa.int64())], names=["query", "score", "doc_id"])


def _weight(df: Column, n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2.0) / (F.lit(2.0) * df + F.lit(1.0))))


def _values(it, weights: np.ndarray, docs: int, length: int):
    """Sparse rows of the documents that hold a term, and their leading terms."""
    for b in it:
        b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column("at")), 0))
        vals, keys = [], []
        for n, at, tf in zip(*(b.column(c).to_pylist() for c in ("n", "at", "tf"))):
            m = 100 - 90 + (90 * n * docs) // length
            vals.append([(1_000_000_000 * c) // (1000 * c + 8 * m) for c in tf])
            lead = sorted(at, key=lambda t: (-weights[t], t))[:LEADING]
            keys.append(lead + [-1] * (LEADING - len(lead)))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("uid"), b.column("at"), pa.array(vals, pa.list_(pa.int64())),
             *[pa.array([k[j] for k in keys], pa.int32()) for j in range(LEADING)]],
            names=["doc_id", "uid", "at", "val", *[f"k{j}" for j in range(LEADING)]])


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """query, score, doc_id: the best rows of each task, for one block of
    queries.  terms: query, term."""
    pairs = terms.collect()  # under TERMS rows, but for the block's last query
    code = {t: i for i, t in enumerate(sorted({r["term"].encode("utf-8", "replace") for r in pairs}))}
    vectors = materialize(map_batches(docs, partial(_vectors, code=code),
                                      "doc_id long, uid long, n long, at array<int>, tf array<long>"))
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total["terms"]:
        return None
    seen = vectors.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(code), dtype=np.int64)
    for r in seen.select("at", _weight(F.col("df"), total["docs"]).alias("w")).collect():  # a row per term
        weights[r["at"]] = r["w"]
    asked: dict[int, list[int]] = {}
    for r in pairs:
        asked.setdefault(r["query"], []).append(code[r["term"].encode("utf-8", "replace")])
    queries = [(q, at, weights[at]) for q, at in sorted(asked.items())]
    lead = [f"k{j}" for j in range(LEADING)]
    index = map_batches(vectors, partial(_values, weights=weights, docs=total["docs"], length=total["terms"]),
                        "doc_id long, uid long, at array<int>, val array<long>, " + ", ".join(f"{c} int" for c in lead))
    dealt = (index.repartitionByRange(*lead, "uid").sortWithinPartitions(*lead, "uid").select("doc_id", "at", "val"))
    return map_batches(dealt, partial(_search, queries=queries, terms=len(code), k=k),
                       "query long, score long, doc_id long")


def lexical_search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   query_id: str = "item_id", query_text: str = "text", k: int = TOP, most: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each query."""
    asked, blocks = query_blocks(queries, query_id, query_text, most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.monotonically_increasing_id().alias("uid"))
    found = docs.sparkSession.createDataFrame([], "query long, score long, doc_id long")
    for block in range(blocks):
        part = _search_block(rows, asked.where(F.col("block") == block).select("query", "term"), k)
        if part is not None:
            found = found.unionByName(materialize(part))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select("query", "item_id").distinct()
    return best.join(names, "query").select("item_id", "rank", "doc_id", "score")
