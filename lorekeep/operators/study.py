"""Spaced repetition: the scheduler's formulas as columns, the fold over a review log, queue, forecast, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published scheduler, version 4.5: default weights, forgetting curve, target, longest interval.
WEIGHTS = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)
DECAY = -0.5
FACTOR = 0.9 ** (1 / DECAY) - 1
RETENTION = 0.9
LONGEST_DAYS = 3650

#: Fixed value: an interval of so many days makes an item known.
KNOWN_DAYS = 21
STATE = "struct<s:double,d:double,state:int,reps:int,lapses:int,last:date,grade:int>"


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def first_difficulty(grade: Column) -> Column:
    return clamp(WEIGHTS[4] - (grade - 3) * WEIGHTS[5], 1.0, 10.0)


def first_stability(grade: Column) -> Column:
    return F.greatest(F.element_at(F.array(*[F.lit(w) for w in WEIGHTS[:4]]), grade.cast("int")), F.lit(0.1))


def retrievability(days: Column, stability: Column) -> Column:
    return F.pow(1 + FACTOR * days / stability, F.lit(DECAY))


def interval(stability: Column, retention: float = RETENTION) -> Column:
    """Whole days until recall falls to ``retention``; halves go to the even day."""
    days = F.bround(stability / FACTOR * (retention ** (1 / DECAY) - 1), 0)
    return clamp(days, 1.0, float(LONGEST_DAYS)).cast("int")


def next_difficulty(d: Column, grade: Column) -> Column:
    return clamp(WEIGHTS[7] * first_difficulty(F.lit(4)) + (1 - WEIGHTS[7]) * (d - WEIGHTS[6] * (grade - 3)), 1.0, 10.0)


def stability_recalled(d: Column, s: Column, r: Column, grade: Column) -> Column:
    w = WEIGHTS
    bonus = F.when(grade == 2, w[15]).otherwise(1.0) * F.when(grade == 4, w[16]).otherwise(1.0)
    return s * (1 + F.exp(F.lit(w[8])) * (11 - d) * F.pow(s, F.lit(-w[9])) * (F.exp((1 - r) * w[10]) - 1) * bonus)


def stability_forgotten(d: Column, s: Column, r: Column) -> Column:
    w = WEIGHTS
    return w[11] * F.pow(d, F.lit(-w[12])) * (F.pow(s + 1, F.lit(w[13])) - 1) * F.exp((1 - r) * w[14])


def _step(acc: Column, review: Column) -> Column:
    """State after one review: a new card starts over, others move difficulty first and then stability."""
    grade = clamp(review["grade"].cast("double"), 1.0, 4.0)
    days = F.greatest(F.datediff(review["day"], acc["last"]), F.lit(0)).cast("double")
    new = (acc["state"] == 0) | (acc["s"] <= 0)
    r, d = retrievability(days, acc["s"]), next_difficulty(acc["d"], grade)
    again = grade == 1
    s = F.when(again, F.least(stability_forgotten(d, acc["s"], r), acc["s"])).otherwise(stability_recalled(d, acc["s"], r, grade))
    return F.struct(
        F.when(new, first_stability(grade)).otherwise(F.greatest(s, F.lit(0.1))).alias("s"),
        F.when(new, first_difficulty(grade)).otherwise(d).alias("d"),
        F.lit(1).alias("state"),
        F.when(new, F.lit(1)).otherwise(acc["reps"] + 1).alias("reps"),
        F.when(new, F.lit(0)).otherwise(acc["lapses"] + F.when(again, 1).otherwise(0)).alias("lapses"),
        review["day"].alias("last"),
        grade.cast("int").alias("grade"),
    )


def fold(log: DataFrame, key: str, day: str, grade: str, order: list[str]) -> DataFrame:
    """Scheduler state of every item after its reviews in order.

    An item forgotten last (grade 1) is due the same day; one whose interval reaches
    ``KNOWN_DAYS`` is known, any other is being learned.  The fold is sequential
    within an item by its nature: an item's reviews meet in one row, a few bytes
    each; items are independent.
    """
    review = F.struct(F.struct(*order).alias("at"), F.col(day).cast("date").alias("day"), F.col(grade).cast("int").alias("grade"))
    start = F.from_json(F.lit('{"s":0.0,"d":0.0,"state":0,"reps":0,"lapses":0}'), STATE)
    lists = log.groupBy(key).agg(F.sort_array(F.collect_list(review)).alias("_r"))
    state = F.aggregate("_r", start, lambda acc, x: _step(acc, x).cast(STATE))
    out = lists.select(key, state.alias("c")).select(key, "c.*")
    days = F.when(F.col("grade") == 1, 0).otherwise(interval(F.col("s")))
    status = F.when(days >= KNOWN_DAYS, "known").otherwise("learning")
    return out.withColumns({"due": F.date_add("last", days), "status": status}).drop("grade")


def queue(items: DataFrame, today: str, limit: int) -> DataFrame:
    """New items and items due by ``today``; no due date first, then by date and id."""
    ready = items.filter((F.col("state") == 0) | (F.col("due").isNotNull() & (F.col("due") <= F.lit(today).cast("date"))))
    return ready.orderBy(F.asc_nulls_first("due"), items.columns[0]).limit(limit)


def forecast(items: DataFrame, today: str, days: int) -> DataFrame:
    """(day, due): items due on each of the next days; overdue and undated ones count today."""
    start = F.lit(today).cast("date")
    day = F.greatest(F.coalesce(F.col("due"), start), start)
    return items.select(day.alias("day")).filter(F.col("day") < F.date_add(start, days)).groupBy("day").agg(F.count("*").alias("due"))


def keep_old_on_empty(log: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Upsert in order: the last non-empty value of each field wins, empty values change nothing."""
    place = F.struct(*order)
    return log.groupBy(*keys).agg(*[F.max_by(F.nullif(F.col(f), F.lit("")), F.when(F.coalesce(F.col(f), F.lit("")) != "", place)).alias(f) for f in fields])


def last_write(log: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The row written last for each key."""
    latest = F.max_by(F.struct(*fields), F.struct(*order)).alias("_v")
    return log.groupBy(*keys).agg(latest).select(*keys, "_v.*")


def reset(items: DataFrame, status: str) -> DataFrame:
    """Items set by hand.

    ``known``: no longer due, reviewed today, stability as it is, so that an item
    never reviewed takes the first-review path next time.  ``new``: everything
    cleared and due today.  ``learning``: nothing but the status.
    """
    if status not in ("known", "new", "learning"):
        raise ValueError(f"no such status: {status}")
    values = {"status": F.lit(status)}
    if status == "known":
        values |= {"state": F.lit(1), "due": F.lit(None), "last": F.current_date()}
    elif status == "new":
        values |= {k: F.lit(0) for k in ("s", "d", "state", "reps", "lapses")} | {"due": F.current_date(), "last": F.lit(None)}
    types = {f.name: f.dataType for f in items.schema} | {"status": "string"}
    return items.withColumns({k: v.cast(types.get(k, "date")) for k, v in values.items()})


def session_percent(reviewed: Column, queued: Column) -> Column:
    """Whole percent of a session that is done, halves up; a session of nothing is at 0."""
    total = reviewed + queued
    return F.when(total > 0, F.floor(100.0 * reviewed / total + 0.5)).otherwise(F.lit(0)).cast("long")


def due_in(due: Column, today: Column) -> Column:
    """Days until an item is due; 0 is today, late or undated."""
    return F.greatest(F.coalesce(F.date_diff(due, today), F.lit(0)), F.lit(0))


def scroll_percent(top: Column, height: Column, window: Column) -> Column:
    """Share of a page that was read, 0 to 100."""
    return F.least(F.greatest(100.0 * top / F.greatest(height - window, F.lit(1)), F.lit(0.0)), F.lit(100.0))
