"""Daily panel: returns, controls, event shocks and report attributes on one calendar."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterline.operators import events as ev
from quarterline.session import checkpoint
from quarterline.sources.columns import require_columns


def with_event_family(
    panel: DataFrame, calendar: DataFrame, events: DataFrame | None, shock: str, dummy: str,
    date: str = "event_date",
) -> DataFrame:
    """Events in the sample mapped to the next trading day; shocks add, dummies take the
    maximum. Without events both columns are 0."""
    if events is None:
        return panel.withColumns({shock: F.lit(0.0), dummy: F.lit(0.0)})
    require_columns(events, [date, shock, dummy], "events")
    inside = ev.within_sample(events, calendar, date)
    # many events share a day: combine them before they meet the calendar
    daily = inside.groupBy(date).agg(F.sum(shock).alias(shock), F.max(dummy).alias(dummy))
    mapped = ev.map_strict_next(daily, calendar, date)
    merged = ev.aggregate_mapped(mapped, sums=[shock], maxes=[dummy])
    return ev.left_join_default(panel, merged, [shock, dummy])


def daily_panel(
    returns: DataFrame,
    reports: DataFrame,
    quarterly: DataFrame,
    plain: Sequence[str],
    scored: Mapping[str, str],
    families: Mapping[tuple[str, str], DataFrame | None],
    controls: DataFrame | None = None,
    window: int = 0,
    scale: str = "equal",
) -> DataFrame:
    """One row per trading day.

    ``families`` maps (shock, dummy) column names to event tables or ``None``. ``plain`` and
    ``scored`` name the quarterly attributes that follow a report onto its reaction days.
    """
    require_columns(returns, ["date"], "returns")
    require_columns(reports, ["year", "quarter", "report_date"], "reports")
    require_columns(quarterly, ["year", "quarter", *plain, *scored], "quarterly attributes")
    # the calendar is read by every mapping: keep its few thousand days instead of deriving them
    calendar = checkpoint(returns.select("date"))
    panel = returns
    if controls is not None:
        panel = panel.join(controls, "date", "left")
    for (shock, dummy), events in families.items():
        panel = with_event_family(panel, calendar, events, shock, dummy)
    inside = ev.within_sample(reports, calendar, "report_date")
    mapped = ev.map_strict_next(inside, calendar, "report_date").where("date_mapped IS NOT NULL")
    attributes = ev.quarter_attributes(mapped, quarterly, plain, scored)
    attributes = attributes.withColumn("D_report", F.lit(1.0))
    columns = ["D_report", *scored.values(), *plain]
    spread = ev.spread_event_window(calendar, attributes, columns, window, scale)
    panel = panel.join(spread, "date")
    core = [
        *[c for c in returns.columns],
        *[c for pair in families for c in pair],
        *columns,
    ]
    return panel.select(*core, *[c for c in panel.columns if c not in core])


def panel_checks(panel: DataFrame, columns: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Non-zero counts and standard deviations used to eyeball a finished panel."""
    counts = [F.count_if(F.col(c) != 0).alias(f"nonzero_{c}") for c in columns]
    return panel.agg(*counts, *[F.stddev_samp(c).alias(f"sd_{c}") for c in spread])


def report_event_columns(
    daily: DataFrame, tone: DataFrame, reports: DataFrame, columns: Mapping[str, str],
    candidates: Sequence[str] = ("tone_all_z", "tone_guid_z", "Neg_net_z", "tone_real_z"),
) -> DataFrame:
    """Older panel: attribute means of the reports that map to a day, 0 on other days.

    ``columns`` maps attribute to event column. The attribute ``tone_z`` is the first candidate
    column present; attributes that are absent give a column of zeros.
    """
    pick = next((c for c in candidates if c in tone.columns), None)
    if pick is not None:
        tone = tone.withColumn("tone_z", F.col(pick))
    have = [c for c in columns if c in tone.columns]
    calendar = checkpoint(daily.select("date"))
    dated = ev.within_sample(reports, calendar, "report_date", upper=False)
    joined = dated.join(tone.select("year", "quarter", *have), ["year", "quarter"])
    mapped = ev.map_strict_next(joined, calendar, "report_date")
    means = ev.aggregate_mapped(mapped, means=have).withColumnsRenamed({c: columns[c] for c in have})
    out = ev.left_join_default(daily, means, [columns[c] for c in have])
    return out.withColumns({n: F.lit(0.0) for c, n in columns.items() if c not in have})
