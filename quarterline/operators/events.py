"""Event detection, shocks and mapping onto a trading calendar.

A calendar has one row per day, so windows over it and lookup tables made from it are
bounded by the days it spans; those lookups are broadcast. Events may be many: they are
matched by equality on the day, never by a range or cross join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions.ranks import with_value_bucket
from quarterline.functions.scale import zscore
from quarterline.profiles import ANNOUNCEMENT_MARKS


def flagged_dates(df: DataFrame, flags: Mapping[str, str], date: str = "date") -> DataFrame:
    """Rows ``event_type, date`` for every flag column that equals 1."""
    cells = [F.struct(F.lit(t).alias("event_type"), F.col(c).alias("flag")) for c, t in flags.items()]
    long = df.select(F.col(date).alias("date"), F.inline(F.array(*cells)))
    return long.where("flag = 1 AND date IS NOT NULL").select("event_type", "date")


def collapse_consecutive_days(events: DataFrame, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """First day of each run of consecutive dates."""
    days = events.select(*by, "date").distinct()
    before = F.lag("date").over(W.partitionBy(*by).orderBy("date"))
    return days.withColumn("__p", before).where(
        "__p IS NULL OR datediff(date, __p) > 1"
    ).drop("__p")


def sparse_row_events(long: DataFrame) -> DataFrame:
    """Every non-null cell of an indicator is an event."""
    return long.where("value IS NOT NULL").select("indicator", "date")


def change_points(
    long: DataFrame, by: Sequence[str] = ("indicator",), tolerance: float = 1e-12
) -> DataFrame:
    """Dates where an indicator's value differs from its value before; never the first."""
    known = long.where("value IS NOT NULL")
    before = F.lag("value").over(W.partitionBy(*by).orderBy("date"))
    moved = known.withColumn("__p", before)
    return moved.where(F.abs(F.col("value") - F.col("__p")) > tolerance).drop("__p")


def is_announcement(name: Column, marks: Sequence[str] = ANNOUNCEMENT_MARKS) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | name.contains(m)
    return hit


def indicator_event_dates(
    long: DataFrame, marks: Sequence[str] = ANNOUNCEMENT_MARKS, dense: int = 500
) -> DataFrame:
    """Event dates per ``event_type`` from its candidate indicators.

    Input: ``event_type, indicator, row, date, value`` with NULL cells kept. Any announcement
    indicator: the dates of all of them. Otherwise the indicator with the fewest cells (first
    row on a tie): its change points when it has more than ``dense`` cells, else its dates.
    """
    stats = long.groupBy("event_type", "indicator").agg(
        F.count("value").alias("cells"), F.min("row").alias("row")
    )
    stats = stats.withColumn("announced", is_announcement(F.col("indicator"), marks))
    pick = stats.groupBy("event_type").agg(
        F.max("announced").alias("any_announced"),
        F.min_by("indicator", F.struct("cells", "row")).alias("sparsest"),
        F.min("cells").alias("fewest"),
    )
    # one small row per event type
    chosen = stats.join(pick, "event_type").select(
        "event_type",
        "indicator",
        F.when(F.col("any_announced") & F.col("announced"), "announcement")
        .when(~F.col("any_announced") & (F.col("indicator") == F.col("sparsest")),
              F.when(F.col("fewest") > dense, "change_points").otherwise("sparse_row"))
        .alias("how"),
    ).where("how IS NOT NULL")
    before = F.lag("value").over(W.partitionBy("event_type", "indicator").orderBy("date"))
    cells = long.where("value IS NOT NULL").withColumn("step", F.col("value") - before)
    hits = cells.join(chosen, ["event_type", "indicator"]).where(
        (F.col("how") != "change_points") | (F.abs("step") > 1e-12)
    )
    return hits.select("event_type", "date", "how").distinct()


def event_union_dummies(
    events: DataFrame, types: Sequence[str], any_name: str = "D_any"
) -> DataFrame:
    """One row per date with a 0/1 column per event type and one for any of them."""
    cols = {t: f"D_{t}" for t in types}
    parts = [F.max(F.when(F.col("event_type") == t, 1).otherwise(0)).alias(c) for t, c in cols.items()]
    out = events.where(F.col("event_type").isin(*types)).groupBy("date").agg(*parts)
    return out.withColumn(any_name, F.greatest(*cols.values(), F.lit(0)))


def with_position(calendar: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number the days of a calendar from 1."""
    return calendar.withColumn("ord", F.row_number().over(W.partitionBy(*by).orderBy("date")))


def _next_days(calendar: DataFrame, strict: bool) -> DataFrame:
    """Every day between the first and last calendar day with the calendar day it maps to."""
    step = calendar.select("date", F.lead("date").over(W.orderBy("date")).alias("mapped"))
    if strict:
        span = F.sequence(F.col("date"), F.date_sub("mapped", 1))
    else:
        span = F.sequence(F.date_add("date", 1), F.col("mapped"))
    return step.where("mapped IS NOT NULL").select(F.explode(span).alias("__day"), "mapped")


def _ends(calendar: DataFrame) -> tuple[Column, Column]:
    """First and last calendar day, both from one subquery."""
    ends = calendar.agg(F.struct(F.min("date").alias("first"), F.max("date").alias("last")).alias("e"))
    both = ends.scalar()
    return both["first"], both["last"]


def _map_to_calendar(
    events: DataFrame, calendar: DataFrame, date: str, out: str, strict: bool
) -> DataFrame:
    days = calendar.select("date").where("date IS NOT NULL").distinct()
    first, last = _ends(days)
    lookup = F.broadcast(_next_days(days, strict))
    joined = events.join(lookup, events[date] == F.col("__day"), "left")
    day = F.col(date)
    if strict:
        mapped = F.when(day < first, first).otherwise(F.col("mapped"))
    else:
        mapped = F.when(day <= first, first).when(day > last, last).otherwise(F.col("mapped"))
    return joined.withColumn(out, mapped).drop("__day", "mapped")


def map_on_or_after(
    events: DataFrame, calendar: DataFrame, date: str = "event_date", out: str = "date_used"
) -> DataFrame:
    """First calendar day on or after the event, else the last day; NULL without a calendar."""
    return _map_to_calendar(events, calendar, date, out, strict=False)


def map_strict_next(
    events: DataFrame, calendar: DataFrame, date: str = "event_date", out: str = "date_mapped"
) -> DataFrame:
    """First calendar day strictly after the event; NULL past the end."""
    return _map_to_calendar(events, calendar, date, out, strict=True)


def asof_next(
    events: DataFrame, calendar: DataFrame, by: Sequence[str], date: str = "event_date",
    day: str = "date", out: str = "date_used", strict: bool = False,
) -> DataFrame:
    """Per series the first calendar stamp at or after (``strict``: after) the event's, at any resolution.

    Past the end of its calendar an event gets the last stamp (``strict``: NULL); without a calendar
    NULL. The distinct stamps of events and calendars are cut into ranges holding about equal row
    counts; the next calendar stamp is found inside a range, or carried over from the ranges after
    it. Neither side is broadcast, and gaps cost nothing.
    """
    by = list(by)
    stamp = lambda df, c, kind: df.where(F.col(c).isNotNull()).select(*by, F.col(c).cast("timestamp").alias("__t")).distinct().withColumn("__k", F.lit(kind))
    rows = stamp(calendar, day, 0).unionByName(stamp(events, date, 1))
    rows = with_value_bucket(rows.withColumn("__m", F.unix_micros("__t")), "__m", "__b")
    rows = rows.withColumn("__c", F.when(F.col("__k") == 0, F.col("__t")))
    kind = F.desc("__k") if strict else F.asc("__k")  # a calendar row serves its own stamp unless strict
    inside = W.partitionBy(*by, "__b").orderBy(F.desc("__m"), kind).rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    firsts = rows.groupBy(*by, "__b").agg(F.min("__c").alias("__f"))
    carried = firsts.select(*by, "__b", F.last("__f", ignorenulls=True).over(later).alias("__n"))
    found = rows.withColumn("__i", F.last("__c", ignorenulls=True).over(inside)).where("__k = 1").join(carried, [*by, "__b"])
    mapped = F.coalesce("__i", "__n")
    if not strict:
        ends = calendar.groupBy(*by).agg(F.max(F.col(day).cast("timestamp")).alias("__e"))
        found, mapped = found.join(ends, by, "left"), F.coalesce(mapped, "__e")
    kept_type = calendar.schema[day].dataType
    found = found.select(*by, F.col("__t"), mapped.cast(kept_type).alias(out))
    joined = events.withColumn("__t", F.col(date).cast("timestamp")).join(found, [*by, "__t"], "left")
    return joined.select(*events.columns, out)


def centered_change(
    events: DataFrame, series: DataFrame, date: str = "event_date", value: str = "value",
    out: str = "S_policy", available: str = "S_policy_available", used: str = "date_used",
) -> DataFrame:
    """Next minus previous observation around the mapped day; 0 and not available at the
    edges of the series."""
    known = series.where(F.col(value).isNotNull()).select("date", value)
    order = W.orderBy("date")
    steps = known.select(
        F.col("date").alias(used),
        (F.lead(value).over(order) - F.lag(value).over(order)).alias("__step"),
    )
    mapped = map_on_or_after(events, known, date, used)
    joined = mapped.join(steps, used, "left")
    return joined.withColumns(
        {
            out: F.coalesce("__step", F.lit(0.0)),
            available: F.col("__step").isNotNull().cast("int"),
        }
    ).drop("__step")


def forecast_surprise(
    df: DataFrame, actual: str = "actual", forecasts: Sequence[str] = ("median", "mean"),
    out: str = "S_gdp", flag: str = "D_gdp",
) -> DataFrame:
    """Actual minus the first available forecast; 0 without a forecast."""
    df = df.withColumn("forecast", F.coalesce(*forecasts))
    has = F.col("forecast").isNotNull()
    return df.withColumns(
        {
            "forecast_available": has.cast("int"),
            out: F.when(has, F.col(actual) - F.col("forecast")).otherwise(0.0),
            flag: F.lit(1),
        }
    )


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row per key, found by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")
    grouped = df.groupBy(*keys).agg(last)
    return grouped.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)


def within_sample(events: DataFrame, calendar: DataFrame, date: str, upper: bool = True) -> DataFrame:
    """Events between the first and last calendar day, both included."""
    first, last = _ends(calendar)
    kept = events.where(F.col(date) >= first)
    return kept.where(F.col(date) <= last) if upper else kept


def aggregate_mapped(
    events: DataFrame, date: str = "date_mapped", sums: Sequence[str] = (),
    maxes: Sequence[str] = (), means: Sequence[str] = (),
) -> DataFrame:
    """Combine events that share a mapped day: shocks add, dummies take the maximum,
    attributes average."""
    parts = (
        [F.sum(c).alias(c) for c in sums]
        + [F.max(c).alias(c) for c in maxes]
        + [F.avg(c).alias(c) for c in means]
    )
    return events.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(*parts)


def left_join_default(
    calendar: DataFrame, events: DataFrame, columns: Sequence[str], default: float = 0.0
) -> DataFrame:
    """Left join on the day; the event's value, else the column already there, else the
    default. ``events`` has one row per day."""
    marked = events.select("date", *[F.col(c).alias(f"__{c}") for c in columns])
    out = calendar.join(marked, "date", "left")
    held = {
        c: F.coalesce(f"__{c}", c if c in calendar.columns else F.lit(default), F.lit(default))
        for c in columns
    }
    return out.withColumns(held).drop(*[f"__{c}" for c in columns])


def quarter_attributes(
    reports: DataFrame, quarterly: DataFrame, plain: Sequence[str], scored: Mapping[str, str]
) -> DataFrame:
    """Report calendar with quarterly attributes; those in ``scored`` (source to name) are
    z-scored first; missing values are 0."""
    sources = list(scored)
    table = zscore(quarterly, sources).select(
        "year", "quarter", *plain, *[F.col(f"{s}_z").alias(n) for s, n in scored.items()]
    )
    out = reports.join(table, ["year", "quarter"], "left")
    return out.fillna(0.0, subset=[*plain, *scored.values()])


def spread_event_window(
    calendar: DataFrame, events: DataFrame, columns: Sequence[str], window: int = 0,
    scale: str = "equal", date: str = "date_mapped",
) -> DataFrame:
    """Add each event's values to its day and the next ``window`` calendar days.

    ``equal`` divides by window+1, ``none`` gives every day the full value. Days past the end
    are dropped, contributions add up, days without any get 0.
    """
    if scale not in ("equal", "none"):
        raise ValueError("scale is 'equal' or 'none'")
    share = 1.0 / (window + 1.0) if scale == "equal" else 1.0
    days = with_position(calendar)
    daily = events.where(F.col(date).isNotNull()).groupBy(F.col(date).alias("date")).agg(
        *[F.sum(c).alias(c) for c in columns]
    )
    placed = daily.join(days.select("date", "ord"), "date")
    offsets = F.explode(F.sequence(F.lit(0), F.lit(window)))
    spread = (
        placed.select("ord", *columns, offsets.alias("k"))
        .groupBy((F.col("ord") + F.col("k")).alias("ord"))
        .agg(*[F.sum(F.col(c) * F.lit(share)).alias(f"__{c}") for c in columns])
    )
    out = days.join(spread, "ord", "left")
    return out.withColumns({c: F.coalesce(f"__{c}", F.lit(0.0)) for c in columns}).drop(
        "ord", *[f"__{c}" for c in columns]
    )


def event_delta_shock(
    panel: DataFrame, levels: Mapping[str, str], is_event: str, standardize: bool = True
) -> DataFrame:
    """Change of a level from one event day to the next, z-scored; 0 on the first event day
    and on all other days. ``levels`` maps level column to shock column."""
    order = W.orderBy("date")
    days = panel.where(F.col(is_event) != 0).select(
        "date",
        *[F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0.0)).alias(s) for c, s in levels.items()],
    )
    shocks = list(levels.values())
    if standardize:
        scored = zscore(days, shocks)
        days = scored.select("date", *[F.col(f"{s}_z").alias(s) for s in shocks])
    return left_join_default(panel, days, shocks)
