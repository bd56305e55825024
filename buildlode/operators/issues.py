"""Issues introduced, removed and currently present, per analysis."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    CLOSED_STATUSES,
    CURRENT,
    FLOW_COUNTS,
    INTRODUCED,
    ISSUE_TYPES,
    OPEN_STATUSES,
    REMOVED,
    SEVERITIES,
)
from ..session import cut_lineage
from .filters import closed_issues, open_issues


# Wide lists of near-equal columns are given as SQL expressions: one call into the
# JVM per column, where chained Column objects would take a dozen.


def _cell() -> str:
    """Number of an issue's type and severity bucket; NULL for an unlisted one."""
    kinds = " ".join(f"WHEN '{t}' THEN {len(SEVERITIES) * i}" for i, t in enumerate(ISSUE_TYPES))
    named = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES) if s)
    missing = SEVERITIES.index(None)
    return f"CASE type {kinds} END + CASE WHEN severity IS NULL THEN {missing} ELSE CASE severity {named} END END"


def with_cell(issues: DataFrame) -> DataFrame:
    """Adds ``cell``: the texts are compared once per issue, the 24 counts then
    compare a small integer. An issue without a cell is counted nowhere."""
    return issues.selectExpr("*", f"{_cell()} AS cell")


def _cells(names: list[str]) -> list[Column]:
    """One conditional count per issue type and severity bucket."""
    return [F.expr(f"count_if(cell = {i}) AS {name}") for i, name in enumerate(names)]


def introduced_counts(issues: DataFrame, *extra: Column, keys: list[str] = ()) -> DataFrame:
    """Open issues counted at the analysis that created them."""
    return with_cell(open_issues(issues)).groupBy(*keys, "project", "creation_analysis_key").agg(
        F.max("creation_date").alias("creation_date"), *_cells(INTRODUCED), *extra
    )


def removed_counts(issues: DataFrame, *extra: Column, keys: list[str] = ()) -> DataFrame:
    """Closed issues counted at the analysis that last saw them."""
    return with_cell(closed_issues(issues)).groupBy(*keys, "project", "current_analysis_key").agg(
        F.max("update_date").alias("update_date"), *_cells(REMOVED), *extra
    )


def _events(issues: DataFrame, keys: list[str], with_new_flag: bool) -> DataFrame:
    """Open and closed issues, each at the analysis it counts for: one scan, two sides."""
    listed = lambda statuses: ", ".join(f"'{s}'" for s in statuses)
    is_open = f"status IN ({listed(OPEN_STATUSES)})"
    return with_cell(issues).where(f"{is_open} OR status IN ({listed(CLOSED_STATUSES)})").selectExpr(
        *keys,
        "project",
        f"{is_open} AS is_open",
        f"CASE WHEN {is_open} THEN creation_analysis_key ELSE current_analysis_key END AS analysis_key",
        f"CASE WHEN {is_open} THEN creation_date END AS creation_date",
        f"CASE WHEN NOT {is_open} THEN update_date END AS update_date",
        f"cell + CASE WHEN {is_open} THEN 0 ELSE {len(INTRODUCED)} END AS cell",
        *(["processed"] if with_new_flag else []),
    )


def issue_flow_counts(issues: DataFrame, with_new_flag: bool = False, keys: list[str] = ()) -> DataFrame:
    """Introduced and removed counts side by side, one row per analysis.

    The sides meet on the analysis key only and a NULL key meets nothing. Issues are read
    once and counted per key and project, in buffers of fixed width that are combined
    before the shuffle; what is gathered by key afterwards is one row per project that has
    it, and only for keys of several projects are their sides paired. ``with_new_flag``
    adds ``has_new``: whether any unprocessed issue went into the row. ``keys`` (never
    NULL, such as a batch number) keep groups of issues apart.
    """
    return paired_flows(_counted(issues, with_new_flag, keys), with_new_flag, keys)


def stored_flow_counts(issues: DataFrame, with_new_flag: bool = False, keys: list[str] = ()) -> DataFrame:
    """The rows of ``issue_flow_counts``, counted once and read from the shared folder.

    A row of a key that lies in one project is a flow row as it was counted. Keys of
    several projects are looked for among the stored rows by a few narrow columns, and
    only their rows, if there are any, are gathered and paired.
    """
    counted = cut_lineage(_counted(issues, with_new_flag, keys), "flow-counts")
    named = counted.where("analysis_key IS NOT NULL")
    several = named.groupBy(*keys, "analysis_key").agg(
        F.count("*").alias("projects"), F.max("opened").alias("opened"), F.max("closed").alias("closed")
    )
    several = several.where("projects > 1 AND opened > 0 AND closed > 0").select(*keys, "analysis_key")
    several = cut_lineage(several, "several-projects")
    if several.isEmpty():
        return _flow_rows(counted, with_new_flag, keys)
    on = [*keys, "analysis_key"]
    paired = paired_flows(counted.join(several, on, "left_semi"), with_new_flag, keys)
    return _flow_rows(counted.join(several, on, "left_anti"), with_new_flag, keys).unionByName(paired)


def _counted(issues: DataFrame, with_new_flag: bool, keys: list[str]) -> DataFrame:
    events = _events(issues, keys, with_new_flag)
    fresh = ["count_if(is_open AND NOT processed) AS new_open", "count_if(NOT is_open AND NOT processed) AS new_closed"]
    return events.groupBy(
        *keys,
        "analysis_key",
        "project",
        # A NULL key stands for itself: its rows stay apart by side and project.
        F.expr("CASE WHEN analysis_key IS NULL THEN is_open END").alias("side"),
    ).agg(
        F.expr("count_if(is_open) AS opened"),
        F.expr("count_if(NOT is_open) AS closed"),
        F.max("creation_date").alias("creation_date"),
        F.max("update_date").alias("update_date"),
        *_cells(FLOW_COUNTS),
        *(map(F.expr, fresh) if with_new_flag else ()),
    )


def paired_flows(counted: DataFrame, with_new_flag: bool = False, keys: list[str] = ()) -> DataFrame:
    """Flow rows from counts per analysis key and project.

    ``counted`` has keys, analysis_key, project, side (is_open where the key is NULL, else
    NULL), opened and closed (issues of either side), both dates and the counts.
    """
    flags = ["new_open", "new_closed"] if with_new_flag else []
    fields = ["project", "creation_date", "update_date", *FLOW_COUNTS, *flags]
    alone = F.expr("CASE WHEN analysis_key IS NULL THEN struct(side, project) END").alias("alone")
    sides = counted.groupBy(*keys, "analysis_key", alone).agg(F.collect_list(F.struct("opened", "closed", *fields)).alias("sides"))
    return _flow_rows(sides.selectExpr(*keys, "analysis_key", f"inline({_paired(fields)})"), with_new_flag, keys)


def _flow_rows(rows: DataFrame, with_new_flag: bool, keys: list[str]) -> DataFrame:
    has_new = ["new_open + new_closed > 0 AS has_new"] if with_new_flag else []
    return rows.selectExpr(
        *keys, "project", "analysis_key", "coalesce(creation_date, update_date) AS date", *FLOW_COUNTS, *has_new
    )


def _paired(fields: list[str]) -> str:
    """Rows of a key from its ``sides``, one per project: itself if the key has one project
    or one side, else every pair of an opening and a closing project."""
    of_closing = {"update_date", "new_closed", *REMOVED}
    pair = ", ".join(f"'{c}', {'r' if c in of_closing else 'i'}.{c}" for c in fields if c != "project")
    return f"""CASE WHEN size(sides) = 1 OR NOT exists(sides, s -> s.opened > 0) OR NOT exists(sides, s -> s.closed > 0) THEN sides
        ELSE flatten(transform(filter(sides, s -> s.opened > 0), i -> transform(filter(sides, s -> s.closed > 0), r ->
             named_struct('opened', i.opened, 'closed', r.closed, 'project', coalesce(i.project, r.project), {pair})))) END"""


def net_flows(factor: str = "1") -> list[str]:
    """Introduced less removed issues of a flow row, for each of the 24 totals."""
    return [f"cast({factor} AS bigint) * ({i} - {r}) AS {c}" for i, r, c in zip(INTRODUCED, REMOVED, CURRENT)]


def _net_flows() -> list[Column]:
    return [F.expr(f"sum({i} - {r}) AS {c}") for i, r, c in zip(INTRODUCED, REMOVED, CURRENT)]


def running_totals_by_date(flows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Net issues per (project, date), accumulated over all earlier dates.

    A project may hold a large part of all analyses, so no window runs over a project's
    raw rows. Flows are summed per date with map-side combine. Dates are dealt out by
    day and accumulate there. Days, one row each, accumulate within the project, and a
    date's total is its day's opening balance plus its running sum of the day. A window group is thus bounded by the distinct times
    of one day or the days of one project. NULL dates come first.
    """
    group = [*keys, "project"]
    names = ", ".join(group)
    by_date = flows.groupBy(*group, "date").agg(*_net_flows())
    # One shuffle serves the window of a day and the sums of the days.
    by_day = by_date.repartition(*group, F.expr("cast(date AS date)")).selectExpr("*", "cast(date AS date) AS day")
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    in_day = by_day.selectExpr(
        *group, "day", "date", *[f"sum({c}) OVER (PARTITION BY {names}, day ORDER BY date {rows}) AS {c}" for c in CURRENT]
    )
    days = by_day.groupBy(*group, "day").agg(*[F.expr(f"sum({c}) AS {c}") for c in CURRENT])
    earlier_days = f"(PARTITION BY {names} ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    opening = days.selectExpr(
        *[f"{k} AS opening_{k}" for k in [*group, "day"]],
        *[f"coalesce(sum({c}) OVER {earlier_days}, 0L) AS opening_{c}" for c in CURRENT],
    )
    return in_day.join(opening, _null_safe([*group, "day"], "opening_")).selectExpr(
        *group, "date", *[f"{c} + opening_{c} AS {c}" for c in CURRENT]
    )


def _null_safe(names: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(n).eqNullSafe(F.col(prefix + n)) for n in names])


def with_totals(flows: DataFrame, totals: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Flow rows with the totals (keys, project, date, totals) of their date."""
    group = [*keys, "project", "date"]
    totals = totals.withColumnsRenamed({k: f"total_{k}" for k in group})
    return flows.join(totals, _null_safe(group, "total_")).drop(*[f"total_{k}" for k in group])


def running_issue_totals(flows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Flow rows with the 24 current totals; rows of one date share a total."""
    return with_totals(flows, running_totals_by_date(flows, keys), keys)
