"""Language identification by language-bitmask n-gram filters (operator 7).

A bit-sliced Bloom filter is a table of ``SLOTS`` bitmasks with one bit per
language.  An n-gram sets its languages' bits in ``HASHES`` slots; the bitwise
AND of those slots is the set of all languages that (seem to) contain it.  A
text's n-grams are looked up all at once, and each language gets a popcount:
how many n-grams name it.  A bit also comes up by chance, with the probability
f = product over the hashes of the share of slots that have it, so the count c
of n n-grams is corrected to (c - n f) / (1 - f).  The language with the
largest corrected count wins; the score is its share of all corrected counts.

Training reads at most ``MAX_DOCS`` documents per language in the expectation
(the rows whose hash falls under the share that gives that number; counts are
taken over all rows).  A language contains the ``GRAMS`` n-grams it has most
often, if no language has them more than ``RIVAL`` times as often.  At most
languages x GRAMS rows reach the driver, and the filter has a fixed size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing can be learned.  A text without a known n-gram
gets the language that most documents have, with score 0.  Ties go to the
language that sorts first.  Up to 64 languages (an error beyond).
Repeated rows get equal results.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, map_batches, materialize, may_learn

SLOTS = 1 << 18
HASHES = 3
GRAMS = 12_000
RIVAL = 4.0
MAX_DOCS = 1500
SIZES = (3, 4)
_PIECE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of the letter n-grams (lower case, words bounded by a space)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[code]
    # other characters become one space between words
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    if not letter.any():
        return np.zeros(0, np.uint64)
    code = np.concatenate((np.array([32], np.uint64), code, np.array([32], np.uint64)))
    out = []
    for n in SIZES:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ code[k: len(code) - n + 1 + k]) * _MIX
                h ^= h >> np.uint64(29)
            # a space may only bound an n-gram
            if n > 2:
                inner = np.zeros(len(h), bool)
                for k in range(1, n - 1):
                    inner |= code[k: len(code) - n + 1 + k] == 32
                h = h[~inner]
            out.append(h)
    return np.concatenate(out)


def slots(g: np.ndarray, k: int) -> np.ndarray:
    h = (g ^ np.uint64(k * 0x5851F42D)) * _MIX
    return (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


@dataclass
class Filters:
    langs: list[str]
    masks: np.ndarray
    chance: np.ndarray
    common: str = "und"

    @classmethod
    def build(cls, members: dict[str, np.ndarray]) -> "Filters":
        """``members``: the n-grams of each language, the most common language first."""
        langs = sorted(members)
        if len(langs) > 64:
            raise ValueError("a mask has 64 bits")
        # the narrowest mask keeps the tables in the processor's cache
        kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (64, np.uint64)) if len(langs) <= n)
        masks = np.zeros((HASHES, SLOTS), kind)
        for bit, lang in enumerate(langs):
            for k in range(HASHES):
                masks[k, slots(members[lang], k)] |= kind(1 << bit)
        chance = np.array([np.prod([(masks[k] & kind(1 << b) > 0).mean() for k in range(HASHES)])
                           for b in range(len(langs))])
        return cls(langs, masks, chance, next(iter(members)))

    def lookup(self, g: np.ndarray) -> np.ndarray:
        found = self.masks[0][slots(g, 0)]
        for k in range(1, HASHES):
            found = found & self.masks[k][slots(g, k)]
        return found

    def popcounts(self, found: np.ndarray) -> np.ndarray:
        """How many n-grams name each language."""
        bits = range(len(self.langs))
        if found.dtype == np.uint8:
            seen = np.bincount(found, minlength=256)
            return np.array([seen[(np.arange(256) >> b) & 1 == 1].sum() for b in bits], float)
        return np.array([np.count_nonzero(found & found.dtype.type(1 << b)) for b in bits], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        counts, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(text), _PIECE):  # a very long text in pieces; all of it counts
            g = grams(text[at: at + _PIECE])
            n += len(g)
            if len(g):
                counts += self.popcounts(self.lookup(g))
        if not n:
            return "und", 0.0
        likely = np.maximum(counts - n * self.chance, 0) / (1 - np.minimum(self.chance, 0.999))
        if not likely.any():
            return self.langs[int(counts.argmax())] if counts.any() else self.common, 0.0
        best = int(likely.argmax())
        return self.langs[best], float(likely[best] / likely.sum())


def _gram_counts(it):
    """(lang, text) batches -> (lang, gram, n) rows, summed per task as far as
    a bounded table goes."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()),
                                              "gram": pa.array(g.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for b in it:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for at in range(0, len(text), _PIECE):
                g = grams(text[at: at + _PIECE])
                if len(g):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
            if size > 4_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs: int = MAX_DOCS, n_grams: int = GRAMS) -> Filters:
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where(may_learn("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    if not sizes:
        return Filters([], np.zeros((HASHES, 1), np.uint64), np.zeros(0))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, max_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    counts = (map_batches(known.where(draw < share).select("lang", "text"), _gram_counts,
                          "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 2"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("all"))  # a row per language
    rate = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("all"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"),
                                   F.collect_list(F.struct("lang", "n", "rate")).alias("of"))  # a row per language at most
    good = materialize(top.select("gram", "top", F.explode("of").alias("o"))
                       .where(F.col("o.rate") * RIVAL >= F.col("top"))
                       .select(F.col("o.lang").alias("lang"), "gram", F.col("o.n").alias("n")))
    members: dict[str, np.ndarray] = {}
    for lang in sizes:  # at most 64 bounded lists
        rows = good.where(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(n_grams).select("gram").collect()
        if rows:
            members[lang] = np.array([r["gram"] for r in rows], dtype=np.int64).view(np.uint64)
    return Filters.build(members) if members else Filters([], np.zeros((HASHES, 1), np.uint64), np.zeros(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             model: Filters | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A model of another corpus may be given; else it is learned here."""
    model = model or learn(docs, id_col, text_col, lang_col)

    def run(it):
        for b in it:
            got = [model.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()),
                 pa.array([y for _, y in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
