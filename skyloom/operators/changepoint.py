"""Exact penalised changepoint search over binned histories.

A history is first reduced, JVM-side and with map-side combine, to sufficient
statistics per time bin (count, sum, sum of squares of log values), so that a
source that holds a third of all rows costs one row per bin like any other.
The optimal partitioning with PELT pruning then runs per history over its bins,
whose number is bounded by the calendar and the number of releases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def optimal_segments(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """Half-open segments of bins that minimise squared error plus ``penalty`` per segment.

    Exact: the pruning rule only discards starts that can never become optimal.
    """
    m = len(n)
    cn, cs, cq = (np.concatenate(([0.0], np.cumsum(x, dtype=float))) for x in (n, s, q))
    best = np.full(m + 1, np.inf)
    best[0] = -penalty
    prev = np.zeros(m + 1, dtype=int)
    starts = np.array([0])
    for end in range(1, m + 1):
        size = cn[end] - cn[starts]
        total = cs[end] - cs[starts]
        cost = np.maximum(cq[end] - cq[starts] - np.where(size > 0, total * total / np.maximum(size, 1), 0.0), 0.0)
        value = best[starts] + cost
        k = int(np.argmin(value))
        best[end] = value[k] + penalty
        prev[end] = starts[k]
        starts = np.append(starts[value <= best[end]], end)
    out, end = [], m
    while end > 0:
        out.append((int(prev[end]), end))
        end = int(prev[end])
    return out[::-1]


def noise(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float:
    """The variance of one row about its level: that within bins or that between neighbouring bins, whichever is larger.

    Between bins it is the median of the scaled squared differences, which
    level shifts, being few, do not move.
    """
    within = float((q - s * s / n).sum()) / max(n.sum() - len(n), 1.0)
    if len(n) < 3:
        return max(within, 1e-6)
    d = np.diff(s / n) ** 2 / (1 / n[1:] + 1 / n[:-1])
    return max(within, float(np.median(d)) / 0.4549, 1e-6)  # 0.4549: the median of a squared standard normal


@dataclass(frozen=True)
class Level:
    """Where log10 of a value recorded in one unit lies: mean and spread, and the known factor to the common unit."""

    unit: str
    mean: float
    spread: float
    factor_log10: float | None


#: Decades by which a level, and by which a shift, may miss the known one at one unit of cost.
LEVEL_TOLERANCE, SHIFT_TOLERANCE = 0.35, 0.15
#: A unit is taken if the best sequence without it costs this much more.
MARGIN = 1.0


def unit_path(levels: list[float], spreads: list[float], units: list[Level]) -> list[tuple[str | None, float]]:
    """The unit of each segment of a history and its margin; None where no unit fits or two fit alike.

    The cheapest sequence of units is sought exactly (forward and backward): a
    segment pays for the distance of its level and spread from those of its unit,
    a shift for its distance from the known step between the two units, so that a
    step as large as a known factor marks a change of that unit.
    """
    if not units:
        return [(None, 0.0)] * len(levels)
    mean, spread = (np.array([getattr(u, a) for u in units]) for a in ("mean", "spread"))
    at = np.array(levels)[:, None]
    own = ((at - mean) / LEVEL_TOLERANCE) ** 2 + np.log(np.maximum(np.array(spreads)[:, None], 1e-3) / np.maximum(spread, 1e-3)) ** 2
    step = np.minimum(((np.diff(np.array(levels))[:, None, None] - (mean[None, :] - mean[:, None])[None]) / SHIFT_TOLERANCE) ** 2, 50.0)
    forward, backward = own.copy(), np.zeros_like(own)
    for i in range(1, len(levels)):
        forward[i] += (forward[i - 1][:, None] + step[i - 1]).min(axis=0)
    for i in range(len(levels) - 2, -1, -1):
        backward[i] = (step[i] + (own[i + 1] + backward[i + 1])[None, :]).min(axis=1)
    out = []
    for cost, fits in zip(forward + backward, own):
        k = int(np.argmin(cost))
        others = np.delete(cost, k)
        margin = float(others.min() - cost[k]) if len(others) else np.inf
        out.append((units[k].unit if margin >= MARGIN and fits[k] <= 4.0 else None, min(margin, 1e6)))
    return out


def time_bin(when: Column, bin_days: int) -> Column:
    return F.floor(F.unix_seconds(when.cast("timestamp")) / (bin_days * 86400))


def history_segments(
    df: DataFrame,
    history: list[str],
    when: str,
    value: str,
    bin_days: int = 1,
    penalty: float = 3.0,
    epoch: str | None = None,
    units: tuple[str, dict[str, list[Level]]] | None = None,
) -> DataFrame:
    """The bins of each history with their segment of constant level of ``log10 |value|``.

    ``df`` has the history's key columns, a timestamp ``when`` and a double
    ``value``; rows with a null time, a null or a zero value carry no level and
    are left out of the statistics. A history runs in order of ``epoch`` (a text
    column, such as a release; null first) and then of time, in bins of
    ``bin_days``; a change within a bin is placed at its border. The penalty is
    ``penalty * noise * ln(rows)``, the noise that of the noisiest epoch. ``units`` names the key column whose value
    picks the known levels of ``unit_path``.

    Result, one row per bin: the history, ``epoch``, ``bin``, ``segment``
    (0-based), ``starts_at``, ``ends_at`` (of the bin), ``n_rows`` (of the bin),
    and of the segment ``segment_rows``, ``level`` and ``spread`` (mean and
    deviation of log10), ``shift`` (level less that of the segment before, null
    for the first), ``unit_key``, ``margin``. An empty input gives no rows.
    """
    level = F.log10(F.abs(F.col(value)))
    era = F.coalesce(F.col(epoch).cast("string"), F.lit("")) if epoch else F.lit("")
    bins = (
        df.where(F.col(when).isNotNull() & (F.abs(F.col(value)) > 0))
        .select(*history, era.alias("epoch"), time_bin(F.col(when), bin_days).alias("bin"), level.alias("_y"))
        .groupBy(*history, "epoch", "bin")
        .agg(F.count("*").cast("double").alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))
    )
    keys = ", ".join(f"`{h}` string" for h in history)
    schema = f"{keys}, epoch string, bin long, segment int, n_rows long, segment_rows long, level double, spread double, shift double, unit_key string, margin double"
    column, known = units or ("", {})
    at = history.index(column) if units else 0

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["epoch", "bin"])
        n, s, q = (pdf[c].to_numpy(float) for c in ("_n", "_s", "_q"))
        # Logarithms of a logarithm scatter little: the noisiest epoch sets the penalty of the whole history.
        eras = [i.to_numpy() for i in pd.Series(np.arange(len(n))).groupby(pdf["epoch"].to_numpy()).groups.values()]
        parts = optimal_segments(n, s, q, penalty * max(noise(n[i], s[i], q[i]) for i in eras) * np.log(max(n.sum(), 2.0)))
        rows = [n[a:b].sum() for a, b in parts]
        levels = [float(s[a:b].sum() / r) for (a, b), r in zip(parts, rows)]
        spreads = [float(np.sqrt(max(q[a:b].sum() / r - m * m, 0.0))) for (a, b), r, m in zip(parts, rows, levels)]
        path = unit_path(levels, spreads, known.get(key[at], []))
        size = [b - a for a, b in parts]
        out = pdf[[*history, "epoch", "bin"]].copy()
        out["segment"] = np.repeat(np.arange(len(parts)), size)
        out["n_rows"] = n.astype("int64")
        out["segment_rows"] = np.repeat(np.array(rows).astype("int64"), size)
        out["level"], out["spread"] = np.repeat(levels, size), np.repeat(spreads, size)
        out["shift"] = np.repeat(np.diff(levels, prepend=np.nan), size)
        out["unit_key"] = np.repeat(np.array([u for u, _ in path], dtype=object), size)
        out["margin"] = np.repeat(np.array([m for _, m in path]), size)
        return out

    out = bins.select(*[F.col(h).cast("string").alias(h) for h in history], "epoch", "bin", "_n", "_s", "_q").groupBy(*history).applyInPandas(solve, schema)
    day = bin_days * 86400
    return out.select(
        *history, "epoch", "bin", "segment", F.timestamp_seconds(F.col("bin") * day).alias("starts_at"), F.timestamp_seconds((F.col("bin") + 1) * day).alias("ends_at"),
        "n_rows", "segment_rows", "level", "spread", F.nanvl("shift", F.lit(None).cast("double")).alias("shift"), "unit_key", "margin",
    )
