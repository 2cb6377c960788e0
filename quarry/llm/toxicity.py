"""Toxicity by a factorization machine over hashed terms (operator 9).

Terms are the words of a text (letters, lower case) and their beginnings of 3
to 6 letters, hashed into ``DIMENSIONS`` slots; a text has a term or not.  The
machine scores

    w0 + sum_j w_j x_j + sum_{j<k} <v_j, v_k> x_j x_k,

so a pair such as an insult and the mention of a group weighs more, or less,
than its two terms do alone.  Training uses a bounded sample: the
``MAX_LABELLED`` labelled rows that come first in a hash order, joined to their
texts by broadcast (two or three numbers a row under that bound) and written
once.  A first pass over the sample counts term slots per label and keeps the
``FEATURES`` slots of the largest chi-square (equal ones in slot order); a second
pass returns each sample row's kept slots, which the driver fits by mini-batch
AdaGrad.  Scoring reads every whole text in Arrow batches, without a shuffle.

Defined cases: a null text counts as empty and scores as a text without known
terms.  Labels that are null, rows whose id is null and held-out rows teach
nothing; of several labels for one id the largest counts.  Without any label
to learn from, every score is 0.  Repeated rows get equal scores.  Only id and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, map_batches, materialize, may_learn, unused

DIMENSIONS = 1 << 20
FEATURES = 1024
MAX_LABELLED = 20_000
FACTORS = 8
EPOCHS = 12
THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+")
#: Bytes of the words and slots that a task keeps.
_CACHE_BYTES = 12 << 20


def word_slots(word: str) -> list[int]:
    """Hash slots of a word and of its beginnings."""
    terms = [word + "$", *(word[:k] for k in range(3, 7) if len(word) >= k)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % DIMENSIONS for t in terms]


class _Slots(dict):
    """word -> kept features, worked out once per word; emptied at a bound of
    bytes (objects and table entries counted roughly)."""

    def __init__(self, index: dict[int, int] | None):
        super().__init__()
        self.index, self.held = index, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        slots = word_slots(word)
        got = tuple(slots if self.index is None else (self.index[s] for s in slots if s in self.index))
        self.held += 160 + 2 * len(word) + (40 + 40 * len(got) if got else 0)
        if self.held > _CACHE_BYTES:
            self.clear()
            self.held = 0
        self[word] = got
        return got


def features_of(text: str | None, slots: _Slots) -> np.ndarray:
    found: set[int] = set()
    for w in set(_WORDS.findall((text or "").lower())):
        found.update(slots[w])
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


@dataclass
class Machine:
    index: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, f: np.ndarray) -> float:
        z = self.w0
        if len(f):
            v = self.v[f]
            s = v.sum(0)
            z += self.w[f].sum() + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, factors: int = FACTORS, epochs: int = EPOCHS,
        rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Mini-batch AdaGrad on the logistic loss; returns w0, w and v."""
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), n), dtype=np.uint8)
    for i, f in enumerate(rows):
        x[i, f] = 1
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w0, w = float(np.log(p / (1 - p))), np.zeros(n)
    v = rng.normal(0, 0.02, (n, factors))
    g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            pick = order[at: at + 256]
            b = x[pick].astype(np.float64)
            s = b @ v
            z = w0 + b @ w + 0.5 * ((s * s).sum(1) - b @ (v * v).sum(1))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            d0 = err.sum()
            dw = b.T @ err + l2 * w
            dv = b.T @ (err[:, None] * s) - v * (b.T @ err)[:, None] + l2 * v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            w0 -= rate * d0 / np.sqrt(g0)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return w0, w, v


def _counts(it):
    slots = _Slots(None)
    seen = np.zeros((2, DIMENSIONS), dtype=np.int32)  # rows of a bounded sample
    n = np.zeros(2, dtype=np.int64)
    for b in it:
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            seen[y, features_of(text, slots)] += 1
            n[y] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_pydict({
        "slot": pa.array(np.append(at, -1), pa.int64()),
        "neg": pa.array(np.append(seen[0, at], n[0]), pa.int64()),
        "pos": pa.array(np.append(seen[1, at], n[1]), pa.int64())})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = MAX_LABELLED,
          n_features: int = FEATURES) -> Machine | None:
    """Fit on at most ``max_labelled`` labelled rows; None without labels."""
    marks = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
             .where(may_learn("id") & F.col("y").isNotNull())
             .groupBy("id").agg(F.max("y").cast("int").alias("y"))
             .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(may_learn("id"))
              .join(F.broadcast(marks), "id").select("text", (F.col("y") > 0).cast("int").alias("y")))
    sample = materialize(sample)
    counts = (map_batches(sample, _counts, "slot long, neg long, pos long")
              .groupBy("slot").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")))
    total = counts.where("slot = -1").first()
    if total is None or total["neg"] + total["pos"] == 0:
        return None
    n0, n1 = float(total["neg"]), float(total["pos"])
    a, c = F.col("pos").cast("double"), F.col("neg").cast("double")
    n = F.lit(n0 + n1)
    chi = n * F.pow(a * (n0 - c) - (n1 - a) * c, 2) / (n1 * n0 * (a + c) * (n - a - c) + 1e-9)
    best = (counts.where("slot >= 0 and neg + pos >= 3").select("slot", chi.alias("chi"))
            .orderBy(F.desc("chi"), "slot").limit(n_features).collect())
    index = {r["slot"]: i for i, r in enumerate(best)}

    def kept(it):
        slots = _Slots(index)
        for b in it:
            yield pa.RecordBatch.from_pydict({
                "f": pa.array([features_of(t, slots) for t in b.column("text").to_pylist()], pa.list_(pa.int32())),
                "y": b.column("y").cast(pa.int32())})

    got = map_batches(sample, kept, "f array<int>, y int").collect()
    rows = sorted(((tuple(r["f"]), r["y"]) for r in got))  # the order of tasks must not matter
    w0, w, v = fit([np.array(f, dtype=np.int64) for f, _ in rows],
                   np.array([y for _, y in rows], dtype=np.float64), max(1, len(index)))
    return Machine(index, w0, w, v)


def scorer(machine: Machine | None):
    """A function from texts to scores, for use in one task."""
    slots = _Slots(machine.index) if machine else None
    return lambda texts: [machine.score(features_of(t, slots)) if machine else 0.0 for t in texts]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = learn(docs, labels, id_col, text_col)

    def score(it):
        run = scorer(machine)
        for b in it:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(run(b.column(2).to_pylist()), pa.float64())],
                names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    out = map_batches(rows, score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns."""
    machine = learn(docs, labels, id_col, text_col)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = scorer(machine)
        for s in batches:
            yield pd.Series(run(s), index=s.index)

    mark = unused(docs, "score")
    return docs.withColumn(mark, score(F.col(text_col))).where(F.col(mark) < threshold).drop(mark)

