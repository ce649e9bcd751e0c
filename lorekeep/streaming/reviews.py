"""Streaming twins: the review fold with keyed state, log lines, first-seen labels, windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.study import DECAY, FACTOR, LONGEST_DAYS, RETENTION, WEIGHTS

OUTPUT = "item string, stability double, difficulty double, reps int, lapses int, due_days int, day int"
STATE = "s double, d double, state int, reps int, lapses int, day int"


def _bound(x: float, lo: float, hi: float) -> float:
    return max(lo, min(hi, x))


def review(card: tuple, grade: int, day: int) -> tuple:
    """The scheduler's step on (s, d, state, reps, lapses, day); the same formulas as the column form in ``operators.study``."""
    s, d, state, reps, lapses, last = card
    w, g = WEIGHTS, int(_bound(grade, 1, 4))
    if state == 0 or s <= 0:
        return max(w[g - 1], 0.1), _bound(w[4] - (g - 3) * w[5], 1, 10), 1, 1, 0, day
    r = (1 + FACTOR * max(day - last, 0) / s) ** DECAY
    easiest = _bound(w[4] - w[5], 1, 10)
    d = _bound(w[7] * easiest + (1 - w[7]) * (d - w[6] * (g - 3)), 1, 10)
    if g == 1:
        new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - r) * w[14]), s)
    else:
        bonus = (w[15] if g == 2 else 1.0) * (w[16] if g == 4 else 1.0)
        new = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - r) * w[10]) - 1) * bonus)
    return max(new, 0.1), d, 1, reps + 1, lapses + (g == 1), day


def days_until(stability: float) -> int:
    return int(_bound(round(stability / FACTOR * (RETENTION ** (1 / DECAY) - 1)), 1, LONGEST_DAYS))


def fold_reviews(log: DataFrame) -> DataFrame:
    """State of each item after every micro-batch in which it was reviewed.

    log: (item string, ts timestamp, seq long, grade int); reviews of a batch are
    applied by (ts, seq).  State is six numbers an item.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        card = state.get if state.exists else (0.0, 0.0, 0, 0, 0, 0)
        for ts, grade in zip(rows["ts"], rows["grade"]):
            card = review(tuple(card), int(grade), (ts.normalize() - pd.Timestamp("1970-01-01")).days)
        state.update(tuple(card))
        s, d, _, reps, lapses, day = card
        yield pd.DataFrame([(key[0], s, d, reps, lapses, 0 if _bound(int(rows["grade"].iloc[-1]), 1, 4) == 1 else days_until(s), day)], columns=["item", "stability", "difficulty", "reps", "lapses", "due_days", "day"])

    return log.groupBy("item").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


LOG_LINE = r"^(\S+)  (\S+?)(?:#(.*?))?  pages: (.*)$"


def parse_log(lines: DataFrame) -> DataFrame:
    """(at, source_id, label, pages array) of ingest-log lines; other lines are dropped.  Batch or stream."""
    part = lambda i: F.regexp_extract("value", LOG_LINE, i)
    out = lines.filter(F.col("value").rlike(LOG_LINE)).select(
        part(1).try_cast("timestamp").alias("at"), part(2).alias("source_id"), F.nullif(part(3), F.lit("")).alias("label"), F.split(part(4), r",\s*").alias("pages")
    )
    return out


def first_done(log: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Each (source, label) once, however often it is logged; keys are kept for ``horizon`` of event time."""
    return log.withWatermark("at", horizon).dropDuplicatesWithinWatermark(["source_id", "label"])


def windowed_counts(events: DataFrame, ts: str, key: str, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, ts: str, key: str, idle: str = "35 minutes", late: str = "1 hour") -> DataFrame:
    """Jobs: runs of a key's lines without a silence of ``idle``."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, idle), key).agg(F.count("*").alias("lines"))
