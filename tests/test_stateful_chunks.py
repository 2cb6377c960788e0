"""A key's micro-batch is held as plain columns and handed back in chunks."""

import numpy as np
import pandas as pd

from quarry.streaming import stateful as ST


def _pieces(n=1000, seed=5):
    rng = np.random.default_rng(seed)
    whole = pd.DataFrame({"k": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 50, n), unit="s"),
                          "id": rng.permutation(n), "v": rng.normal(0, 1, n)})
    return whole, [whole[:300], whole[:0], whole[300:310], whole[310:]]


def test_rows_in_order_over_pieces():
    whole, pieces = _pieces()
    want = whole.sort_values(["ts", "id"])
    got = ST._ordered(pieces, ["ts", "id"], ["id", "v"])
    assert list(got) == ["id", "v"] and (got["id"] == want["id"]).all() and (got["v"] == want["v"]).all()
    text = [p.assign(ts=p["ts"].astype(str)) for p in pieces]
    assert (ST._ordered(text, ["ts", "id"], ["id"])["id"] == want["id"]).all()
    assert ST._ordered([whole[:0]], ["ts"], ["id"]) == {}


class _State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_windows_come_in_chunks(monkeypatch):
    monkeypatch.setattr(ST, "CHUNK", 64)
    fns = []

    class Frame:  # takes the function that Spark would call
        schema = {"k": None, "id": None}

        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, fn, *rest):
            fns.append(fn)
    kind = type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "string"})()})()
    Frame.schema = {"k": kind, "id": kind}
    ST.stream_count_windows(Frame(), "k", ["ts", "id"], "id", 200)
    whole, pieces = _pieces()
    state = _State()
    parts = list(fns[0](("a",), iter(pieces), state)) + list(fns[0](("a",), iter(pieces[:1]), state))
    assert max(map(len, parts)) <= 64 and state.get == (1300,)
    got = pd.concat(parts)
    want = whole.sort_values(["ts", "id"])["id"].tolist() + pieces[0].sort_values(["ts", "id"])["id"].tolist()
    assert got["id"].tolist() == want and got["position"].tolist() == list(range(1300)) and (got["k"] == "a").all()
    assert (got["window"] == got["position"] // 200).all()
