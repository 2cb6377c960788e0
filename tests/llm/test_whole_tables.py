"""op4, op5 and op9 on a whole table against plain versions."""

import struct
import zlib

import numpy as np
import pytest

import __spark_entry__ as se
from quarry.llm import toxicity
from quarry.llm.packing import tokenizer_path
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    return {d: tok.encode(t, add_special_tokens=False) for d, t in docs.items()}


def test_packing_of_a_whole_table(spark, docs, encoded):
    rows = se.queries()["op4_best_fit_packing"](spark, SF_SMALL).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for d, ps in pieces.items():
        ids, ps = [*encoded[d].ids, 2], sorted(ps, key=lambda r: r.piece)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        assert [(r.piece, r.start, r.length) for r in ps] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        for r in ps:
            own = ids[r.start: r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 1024) * 1.02 + 1


def test_token_counts_of_a_whole_table(spark, docs, encoded):
    got = {}
    for r in se.queries()["op5_token_counts"](spark, SF_SMALL).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens, r.n_crossing)
    for d, text in docs.items():
        bounds, at = [0], 0
        for line in text.split("\n")[:-1]:
            at += len(line) + 1
            bounds.append(at)
        if bounds[-1] < len(text) or len(bounds) == 1:
            bounds.append(len(text))
        tokens, crossing = [0] * (len(bounds) - 1), [0] * (len(bounds) - 1)
        for a, b in encoded[d].offsets:
            shares = [max(0, min(b, hi) - max(a, lo)) for lo, hi in zip(bounds, bounds[1:])]
            k = shares.index(max(shares))  # most characters, the first among equals
            tokens[k] += 1
            crossing[k] += sum(s > 0 for s in shares) > 1
        assert got[d] == {k: (bounds[k], bounds[k + 1], tokens[k], crossing[k]) for k in range(len(tokens))}, d


def test_pair_scores_are_a_plain_double_sum():
    rng = np.random.default_rng(1)
    m = toxicity.Machine({}, 0.3, rng.normal(0, 1, 30), rng.normal(0, .3, (30, 4)))
    for n in (0, 1, 2, 9):
        f = rng.choice(30, n, replace=False)
        z = m.w0 + sum(m.w[j] for j in f) + sum(float(m.v[j] @ m.v[k]) for i, j in enumerate(f) for k in f[i + 1:])
        assert m.score(f) == pytest.approx(1 / (1 + np.exp(-z)))


def test_held_out_toxicity_of_a_whole_table(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in se.queries()["op9_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in rows) / len(rows) > 0.9
    bad = [r for r in rows if marks[r.doc_id] == 1]
    mean = lambda xs: sum(r.score for r in xs) / len(xs)
    assert mean(bad) > 2 * mean([r for r in rows if marks[r.doc_id] == 0])
