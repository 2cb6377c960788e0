import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import packing
from quarry.llm.packing import (CAPACITY, Encoder, assign_sequences, best_fit_pack, encode_pieces, plan_layout,
                                sequences, tokenizer_path)

TRICKY = ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's 'tis don't 12a b34 <|endoftext|> x", " x y  z",
          "tab\there  two   three\n\n four", "über Öl, straße! ñandú 東京 🙂 ok.", "x\x1c y \x1f", "a  b",
          "line one.\nline two. ### token = \"x\"", " lead trail "]


def _own_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_are_the_tokenizers_own(spark):
    texts = TRICKY + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = Encoder(tokenizer_path())
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(enc.ids(t), "<u4").tolist() for t in texts] == _own_ids(texts)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once_without_overlap(seed):
    rng = np.random.default_rng(seed)
    top = [30, 100, 1024][seed % 3]
    counts = {int(s): int(c) for s, c in zip(rng.choice(np.arange(1, top + 1), size=min(top, 25), replace=False),
                                             rng.integers(1, 40, 25))}
    plan = plan_layout(counts, top)
    bins: dict[int, list] = {}
    for s, lo, hi, first, per, at in plan:
        for k in range(hi - lo):
            bins.setdefault(first + k // per, []).append((at + k % per * s, s))
    ranks = {s: sorted((lo, hi) for t, lo, hi, *_ in plan if t == s) for s in counts}
    for s, c in counts.items():
        edges = [0, *(hi for _, hi in ranks[s])]
        assert edges[-1] == c and [lo for lo, _ in ranks[s]] == edges[:-1]
    for items in bins.values():
        at = 0
        for off, s in sorted(items):
            assert off == at
            at += s
        assert at <= top
    words = sum(s * c for s, c in counts.items())
    assert len(bins) <= 1.25 * -(-words // top) + 2


def test_round_trip_and_odd_rows(spark):
    long = "word " * 3000
    rows = [(i, t, "x") for i, t in enumerate(TRICKY)] + [(90, None, "x"), (None, "no id", None), (91, long, "x"),
                                                         (91, long, "x"), (92, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = best_fit_pack(docs).collect()
    by_doc: dict = {}
    used: dict = {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in used.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= CAPACITY
    want = dict(zip([r[0] for r in rows], _own_ids([r[1] or "" for r in rows])))
    for doc, parts in by_doc.items():
        copies = 2 if doc == 91 else 1
        parts.sort(key=lambda r: r.piece)
        assert len({r.piece for r in parts}) * copies == len(parts)
        one = parts[::copies]
        assert np.frombuffer(b"".join(r.ids for r in one), "<u4").tolist() == want[doc] + [2]
        assert [r.start for r in one] == [sum(x.length for x in one[:k]) for k in range(len(one))]
        assert all(r.length == CAPACITY for r in one[1:])
    whole = sequences(best_fit_pack(docs)).collect()
    assert len(whole) == len(used) and sum(len(r.ids) for r in whole) == sum(4 * r.length for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit_pack(docs).count() == 0
    assert assign_sequences(encode_pieces(docs)).columns[-2:] == ["sequence_id", "offset"]


def test_batches_encode_each_different_word_once():
    """A batch's different words go through the tokenizer in one call; a word's repeats cost no more of it."""
    texts = [*TRICKY, None, " ".join(["word"] * 5000), *(f"\x85 a{s}b {s}c" for s in ("\x85", "\xa0", "\u3000", "\u2028"))] * 3
    enc, seen = Encoder(tokenizer_path()), []
    encode = enc.encoding.encode_to_numpy
    enc.encoding.encode_to_numpy = lambda text, **k: (seen.append(text), encode(text, **k))[1]
    for column in (pa.array(texts), pa.array(["cut off", *texts])[1:], pa.array(texts, pa.large_string())):
        seen.clear()
        ends, ids = enc.batch(column, b"\2\0\0\0")
        ids = np.split(np.frombuffer(ids, "<u4"), ends)[:-1]
        assert [x.tolist() for x in ids] == [x + [2] for x in _own_ids([t or "" for t in texts])]
        assert sum(s.count("word") for s in seen) == 1
    ends, ids = enc.batch(pa.array([None, ""], pa.string()))
    assert ends.tolist() == [0, 0]


def test_pieces_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "_SLICE_BYTES", 4096)
    docs = [(i, ("word " * n)[: -1 if n % 2 else None], "x") for i, n in enumerate([0, 1, 30, 4001, 2, 0, 900])]
    got = {}

    class Docs:
        def select(self, *_):
            return self

    monkeypatch.setattr(packing, "map_batches", lambda _, run, schema: run)
    run = encode_pieces(Docs(), capacity=100, tokenizer=tokenizer_path())
    column = pa.record_batch([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["doc_id", "text"])
    for b in run(iter([column, column.slice(0, 0)])):
        assert b.column(4).nbytes <= 2 * 4096
        for doc, piece, start, length, ids in zip(*(c.to_pylist() for c in b.columns)):
            assert len(ids) == 4 * length and start == sum(len(x) for x in got.get(doc, [])) // 4
            assert piece == len(got.setdefault(doc, []))
            got[doc].append(ids)
    assert [np.frombuffer(b"".join(got[i]), "<u4").tolist() for i in range(len(docs))] == \
        [x + [2] for x in _own_ids([t for _, t, _ in docs])]


def test_a_task_keeps_no_words(spark, monkeypatch):
    """Ever new words leave nothing behind them in a task, and its end gives Arrow's free memory back."""
    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    run, held = encode_pieces(Docs(), tokenizer=tokenizer_path()), []

    def texts():
        for k in range(6):
            held.append(tracemalloc.get_traced_memory()[0])
            words = (f"{(k * 30000 + i) * 7919:x}" for i in range(30000))
            yield pa.record_batch([pa.array([k]), pa.array([" ".join(words)])], names=["doc_id", "text"])

    tracemalloc.start()
    try:
        for b in run(texts()):
            del b
    finally:
        tracemalloc.stop()
    assert held[-1] - held[1] < 2 << 20
    pool = pa.default_memory_pool()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: given.append(1) or pool)
    given = []
    list(run(iter([])))
    assert given == [1]
