"""The batch monitor as a stream: one row in per batch, one row out with its alerts, and the means and trends of the window that it ends.

The state of a key is its last WINDOW batches and its last ERRORS errors; both are bounded
whatever the stream brings. Rows of a trigger are put in order before the state
takes them, however many chunks they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.monitor import AVERAGED, TRENDS, alerts

WINDOW, ERRORS = 100, 1000
OUT = "epoch string, batch_id long, alerts string, window_size long, kept_errors long, " + ", ".join([*[f"mean_{c} double" for c in AVERAGED], *[f"trend_{t} string" for t in TRENDS]])
NAMES = [f.split()[0] for f in OUT.split(", ")]


def _direction(new: list[float], old: list[float]) -> str:
    d = round(sum(new) / len(new) - sum(old) / len(old), 9)
    return "stable" if abs(d) < 0.01 else "increasing" if d > 0 else "decreasing"


def _trend(values: list[float], up: bool) -> str:
    new, old = values[-10:], values[-20:-10]
    if not old:
        return "insufficient_data"
    return _direction(new, old) if up else _direction(old, new)


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    width = len(AVERAGED)
    flat, errors = (list(x) for x in state.get) if state.exists else ([], [])
    held = [flat[k : k + width] for k in range(0, len(flat), width)]
    out = []
    for r in pd.concat(list(frames)).sort_values("batch_id").to_dict("records"):  # a trigger's rows of one key
        held = [*held, [float(r[c]) for c in AVERAGED]][-WINDOW:]
        errors = [*errors, *[int(r["batch_id"])] * int(r["error_count"])][-ERRORS:]
        means = [sum(h[k] for h in held) / len(held) for k in range(width)]
        ways = [_trend([h[AVERAGED.index(c)] for h in held], up) for c, up in TRENDS.values()]
        out.append((key[0], r["batch_id"], r["alerts"], len(held), len(errors), *means, *ways))
    state.update(([v for h in held for v in h], errors))
    yield pd.DataFrame(out, columns=NAMES)


def monitored(batches: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Of a stream of batches (epoch, batch_id, and the columns that ``alerts`` and the summary need): each with its alerts, means and trends."""
    from ..operators.tokenizers import _package_path

    _package_path(batches.sparkSession)
    rows = batches.select("epoch", "batch_id", *[F.col(c).cast("double").alias(c) for c in AVERAGED], F.array_join(alerts(thresholds), ",").alias("alerts"))
    return rows.groupBy("epoch").applyInPandasWithState(_step, OUT, "held array<double>, errors array<long>", "append", GroupStateTimeout.NoTimeout)


def run(batches: DataFrame, state: str, out: str, thresholds: dict | None = None) -> None:
    """Take in all that the stream has, and stop. State, progress and output are in two folders: the next run with the same ones goes on where this one ended."""
    query = monitored(batches, thresholds).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", state).format("parquet").option("path", out).start()
    query.awaitTermination()
