"""Best-fit packing with large-item matching (operator 4).

Lengths are whole numbers up to the capacity, so the packing needs the table
of how many pieces have each length (at most ``capacity`` rows), not the
pieces.  ``plan_layout`` packs that table on the driver:

* pieces over a third of the capacity: at most two share a sequence, matched
  greedily, the longest with the longest that still fits beside it;
* shorter pieces, longest first, go to the sequences with the smallest gap
  that holds them; what fits nowhere opens new sequences.

Sequences with the same gap are handled as one run of consecutive numbers, so
the plan has a row per (length, run): each placement splits a run into three
at most, which bounds the runs by a few per length, and so the plan, whatever
the number of documents.  Pieces learn their place from their rank among the
pieces of their length: ranks are counted inside (length, salt) groups, so
a length that a third of all pieces have spreads over ``SALTS`` groups, and the
plan (broadcast, bounded as above) turns a rank into sequence and offset.

Defined cases: a null text is empty and gives the end token alone.  Repeated
rows are packed each.  An empty table gives an empty result.  A text longer
than the capacity is cut from its end into full pieces; the first piece holds
the rest.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, materialize

CAPACITY = 1024
END_ID = 2
SALTS = 64
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of texts that are encoded at once, and of ids that leave at once.
_SLICE_BYTES = 4 << 20
#: A space that does not open a word: such texts are encoded whole.
_OTHER_SPACE = (r"\x20(?:[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
                r"\x{3000}]|\z)")


def tokenizer_path(name: str = TOKENIZER, folder: str = TOKENIZERS) -> str:
    """Where the public tokenizers' own module says the file is."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{folder}/{name}"
    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others, in order, for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_pair_encoding(path: str):
    """The tokenizer file's vocabulary and merges behind a faster encoder.

    Merged tokens are numbered in the order of their merges, so ids are the
    ranks; tests hold its ids against the tokenizer's own.  Strings of special
    tokens in a text are ordinary text."""
    import json

    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    special = {"<|endoftext|>"}
    letter = byte_letters()
    ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts.

    The tokenizer splits before every space that a word follows, whatever
    stands before, so the ids of a text are those of its space-led words in
    turn.  ``batch`` encodes each different word of a batch once, all in one
    call, and puts the texts together from them; nothing is kept between
    batches.
    """

    def __init__(self, path: str):
        self.encoding = byte_pair_encoding(path)
        #: Whether a token starts with a space: the first of a space-led word does, no other.
        self.leads = np.zeros(self.encoding.n_vocab, bool)
        for token in self.encoding.token_byte_values():
            self.leads[self.encoding.encode_single_token(token)] = token[:1] == b" "

    def ids(self, text: str | None) -> bytes:
        """The ids of one text as packed unsigned 32-bit numbers."""
        return self._encode(text).tobytes() if text else b""

    def _encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, pa.Buffer]:
        """The texts' ids one after the other, each with ``end`` after it, and
        the number of ids up to the end of each text."""
        n = len(texts)
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _OTHER_SPACE)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        words, cuts = split.flatten(), np.asarray(split.offsets)
        cuts = cuts - cuts[0]
        led = np.ones(len(words), bool)
        led[cuts[:-1]] = False  # a text's first word has no space before it
        own = words.filter(pa.array(led)).dictionary_encode()
        different = own.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(different)], different), pa.scalar(" ", different.type))
        pool = self._encode(" " + joined[0].as_py()) if len(different) else np.zeros(0, "<u4")
        starts = np.flatnonzero(self.leads[pool])
        if len(starts) != len(different):
            raise ValueError("the tokenizer does not split before every space")
        heads = [np.array(self.encoding.encode_ordinary(t), "<u4") for t in words.filter(pa.array(~led)).to_pylist()]
        for i, t in zip(np.flatnonzero(odd), texts.filter(odd).to_pylist()):
            heads[i] = self._encode(t)
        # the ids of each different word, of each text's start and of the end, and which of them stand where
        sizes = np.concatenate((np.diff(starts, append=len(pool)), [len(h) for h in heads], [len(end) // 4])).astype(np.int64)
        bounds = 4 * np.concatenate(([0], np.cumsum(sizes)))
        pool = np.concatenate((pool, *heads, np.frombuffer(end, "<u4")))
        which = np.full(len(words) + n, len(sizes) - 1)
        part = np.empty(len(words), np.int64)
        part[led] = np.asarray(own.indices)
        part[~led] = len(different) + np.arange(n)
        which[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(cuts))] = part
        ends = np.cumsum(sizes[which])[cuts[1:] + np.arange(n)]
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(pool)])
        return ends, parts.take(pa.array(which)).buffers()[2]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  end_id: int | None = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    path = tokenizer or tokenizer_path()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(it):
        enc = encoder(path)
        for b in it:
            for lo, hi in _slices(b.column(1)):
                yield from _pieces(b.column(0).slice(lo, hi - lo), *enc.batch(b.column(1).slice(lo, hi - lo), end), capacity)
        pa.default_memory_pool().release_unused()  # the worker lives on

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, piece int, start long, length long, ids binary")


def _slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Rows first, last + 1 of runs of about ``_SLICE_BYTES`` (or one text)."""
    size = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    run = (np.cumsum(size) - size) // _SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(size)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def _pieces(docs: pa.Array, ends: np.ndarray, ids: pa.Buffer, capacity: int) -> Iterator[pa.RecordBatch]:
    """The pieces of texts whose ids follow each other in ``ids``."""
    total = np.diff(ends, prepend=0)
    first = np.where(total > 0, (total - 1) % capacity + 1, 0)
    many = 1 + (total - first) // capacity
    doc = np.repeat(np.arange(len(total)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
    length = np.where(piece > 0, capacity, first[doc])
    bounds = 4 * np.concatenate(([0], np.cumsum(length)))
    step = max(1, _SLICE_BYTES // (4 * capacity))
    for lo in range(0, len(doc), step):
        hi = min(lo + step, len(doc))
        at = (bounds[lo: hi + 1] - bounds[lo]).astype(np.int32)
        own = ids.slice(int(bounds[lo]), int(at[-1])) if ids is not None else pa.py_buffer(b"")
        cols = [docs.take(pa.array(doc[lo:hi])), pa.array(piece[lo:hi].astype(np.int32)), pa.array(start[lo:hi]),
                pa.array(length[lo:hi]), pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at), own])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids"])


def plan_layout(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces per
    sequence, offset) that place every piece of every length."""
    left = {s: c for s, c in counts.items() if c > 0}
    taken = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs [first, last + 1) of sequences
    made = 0

    def place(s: int, n: int, first: int, per: int, offset: int) -> None:
        plan.append((s, taken[s], taken[s] + n, first, per, offset))
        taken[s] += n
        left[s] -= n

    def leave(gap: int, lo: int, hi: int) -> None:
        if gap > 0 and hi > lo:
            gaps.setdefault(gap, []).append((lo, hi))

    large = [s for s in sorted(left, reverse=True) if 3 * s > capacity]
    for s in large:
        while left[s]:
            mate = next((t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)), None)
            n = left[s] if mate is None else left[s] // 2 if mate == s else min(left[s], left[mate])
            place(s, n, made, 1, 0)
            if mate is not None:
                place(mate, n, made, 1, s)
            leave(capacity - s - (mate or 0), made, made + n)
            made += n
    for s in sorted((s for s in left if 3 * s <= capacity and s > 0), reverse=True):
        while left[s]:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                gap, need = capacity, -(-left[s] // (capacity // s))
                lo, hi = made, made + need
                made = hi
            else:
                lo, hi = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            per = min(gap // s, left[s])
            full = min(hi - lo, left[s] // per)
            place(s, full * per, lo, per, capacity - gap)
            leave(gap - per * s, lo, lo + full)
            lo += full
            if lo < hi and 0 < left[s] < per:
                rest = left[s]
                place(s, rest, lo, rest, capacity - gap)
                leave(gap - rest * s, lo, lo + 1)
                lo += 1
            leave(gap, lo, hi)
    return plan


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset; all its columns ride along.

    ``pieces`` is written once in the shared checkpoint folder: the counts and
    the ranks have to see the same rows."""
    spark = pieces.sparkSession
    columns = pieces.columns
    order = [c for c in ("doc_id", "piece") if c in columns]
    rows = materialize(pieces.withColumn("_salt", F.pmod(F.xxhash64(*(order or columns)), F.lit(SALTS))))
    groups = rows.groupBy(F.col(length_col).alias("_len"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    # at most capacity x SALTS rows
    by_group = Window.partitionBy("_len").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(by_group), F.lit(0)))
    counts = {r["_len"]: r["n"] for r in groups.groupBy("_len").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_layout(counts, capacity)
    runs = spark.createDataFrame(plan or [(0, 0, 0, 0, 1, 0)],
                                 "_l long, _lo long, _hi long, _first long, _per long, _at long")
    nth = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*(order or columns))) - 1
    ranked = rows.withColumn("_nth", nth).join(
        F.broadcast(groups), (F.col(length_col) == F.col("_len")) & (F.col("_salt") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth"))
    placed = ranked.join(F.broadcast(runs), (F.col(length_col) == F.col("_l")) & (F.col("_rank") >= F.col("_lo"))
                         & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    return placed.select(*columns, (F.col("_first") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"),
                         (F.col("_at") + F.pmod(k, F.col("_per")) * F.col(length_col)).cast("long").alias("offset"))


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, digest: bool = False, **encode) -> DataFrame:
    """Pieces with their ids, sequence and offset; with ``digest``, the ids'
    crc32 in place of the ids."""
    pieces = encode_pieces(docs, capacity=capacity, **encode)
    if digest:
        pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign_sequences(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> one row per sequence: sequence_id, the ids in
    order, and the pieces' lengths (at most ``capacity`` tokens a row)."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids"),
                        F.col("p.length").alias("lengths"))

