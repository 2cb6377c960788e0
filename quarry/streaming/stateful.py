"""Stateful streaming operators (STR-6, STR-7, STR-10, STR-11).

Per-key state lives in the state store (``applyInPandasWithState``); each
micro-batch hands a key's new rows to one pandas call, which orders them by
the arrival column and continues from the stored state.  Work per call is
bounded by the micro-batch, not by the key's history; of a key's rows a call holds
the ordering, id and value columns as arrays and hands results back in chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


#: Rows of a frame that a call hands back.
CHUNK = 65_536


def _ordered(it, order: list[str], cols: list[str]) -> dict[str, np.ndarray]:
    """The columns of a key's new rows as plain arrays, in ``order``.  Nothing else
    of the pieces is kept: the key is the same in all of them."""
    names = list(dict.fromkeys([*order, *cols]))
    held: dict[str, list] = {c: [] for c in names}
    for pdf in it:
        for c in names if len(pdf) else ():
            held[c].append(np.array(pdf[c]))
    if not held[names[0]]:
        return {}
    whole = {c: np.concatenate(held.pop(c)) for c in names}
    if any(whole[c].dtype == object for c in order):
        at = pd.DataFrame({c: whole[c] for c in order}).sort_values(order).index.to_numpy()
    else:
        at = np.lexsort([whole[c] for c in reversed(order)])
    return {c: whole[c][at] for c in cols}


def _chunks(n: int):
    return (slice(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK))


def stream_ema(sdf: DataFrame, key: str, order: list[str], value: str, id_col: str,
               alpha: float = 0.1, out: str = "ema_score") -> DataFrame:
    """STR-6: running EMA per key; the state is (last EMA, rows seen)."""
    order = list(order)

    def fn(k, it, state):
        rows = _ordered(it, order, [id_col, value])
        if not rows:
            return
        e, n = state.get if state.exists else (0.0, 0)
        vals = rows[value].astype(float)
        outv = np.empty(len(vals))
        for i, x in enumerate(vals):
            e = (1.0 - alpha) * e + alpha * x
            outv[i] = e
        state.update((float(e), int(n + len(vals))))
        for c in _chunks(len(vals)):
            yield pd.DataFrame({id_col: rows[id_col][c], key: [k[0]] * (c.stop - c.start), out: outv[c]})

    kt = sdf.schema[key].dataType.simpleString()
    it = sdf.schema[id_col].dataType.simpleString()
    return sdf.groupBy(key).applyInPandasWithState(
        fn, f"{id_col} {it}, {key} {kt}, {out} double", "ema double, n long", "append",
        GroupStateTimeout.NoTimeout)


def stream_count_windows(sdf: DataFrame, key: str, order: list[str], id_col: str,
                         size: int = 200) -> DataFrame:
    """STR-7: per-key arrival counter -> tumbling count window id."""
    order = list(order)

    def fn(k, it, state):
        rows = _ordered(it, order, [id_col])
        if not rows:
            return
        ids = rows[id_col]
        (n,) = state.get if state.exists else (0,)
        state.update((int(n + len(ids)),))
        for c in _chunks(len(ids)):
            pos = n + np.arange(c.start, c.stop)
            yield pd.DataFrame({id_col: ids[c], key: [k[0]] * len(pos),
                                "window": (pos // size).astype("int64"),
                                "position": pos.astype("int64")})

    kt = sdf.schema[key].dataType.simpleString()
    it = sdf.schema[id_col].dataType.simpleString()
    return sdf.groupBy(key).applyInPandasWithState(
        fn, f"{id_col} {it}, {key} {kt}, window long, position long", "n long", "append",
        GroupStateTimeout.NoTimeout)


def stream_latest(sdf: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """STR-11: the latest record per key by the numeric arrival column
    ``seq``, emitted whenever it changes; the state keeps the latest ``seq``
    so an older row arriving later does not replace it."""

    def fn(k, it, state):
        last = None
        for pdf in it:
            if len(pdf):
                row = pdf.sort_values(seq).iloc[-1]
                last = row if last is None or row[seq] >= last[seq] else last
        if last is None:
            return
        if state.exists and state.get[0] >= int(last[seq]):
            return
        state.update((int(last[seq]),))
        yield pd.DataFrame([{c: last[c] for c in [key, seq] + cols}])

    sch = ", ".join(f"{c} {sdf.schema[c].dataType.simpleString()}" for c in [key, seq] + cols)
    return sdf.groupBy(key).applyInPandasWithState(fn, sch, "seq long", "append",
                                                   GroupStateTimeout.NoTimeout)


def event_time_counts(sdf: DataFrame, ts: str, by: str, window: str = "1 hour",
                      watermark: str = "1 hour", flag: str | None = None,
                      slide: str | None = None) -> DataFrame:
    """STR-10: tumbling (or, with ``slide``, sliding) event-time counts per
    key with a watermark; a window is emitted once the watermark passes its
    end (append mode), rows later than the watermark are dropped.  ``flag``
    also counts rows where it is true (e.g. triggers)."""
    s = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    aggs = [F.count(F.lit(1)).alias("n")]
    if flag:
        aggs.append(F.sum(F.col(flag).cast("long")).alias("n_flagged"))
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = s.groupBy(w.alias("w"), by).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    by, *[a.split(" AS ")[-1] for a in ["n"] + (["n_flagged"] if flag else [])])
