"""Repeating parts of the check SQL, written out from the domain lists."""

from __future__ import annotations

from .. import schemas


def strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


OPEN, CLOSED = strings(schemas.OPEN_STATUSES), strings(schemas.CLOSED_STATUSES)


def counts(prefix: str) -> str:
    lines = []
    for kind in schemas.ISSUE_TYPES:
        for severity in schemas.SEVERITIES:
            test = "severity IS NULL" if severity is None else f"severity = '{severity}'"
            name = f"{prefix}_{severity or 'null_severity'}_{kind}".lower()
            lines.append(f"CAST(SUM(CASE WHEN type = '{kind}' AND {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}")
    return ",\n".join(lines)


INTRODUCED_SQL = f"""SELECT project, creation_analysis_key, MAX(creation_date) AS creation_date,
{counts('introduced')}
FROM sonar_issues WHERE status IN ({OPEN}) GROUP BY project, creation_analysis_key"""

REMOVED_SQL = f"""SELECT project, current_analysis_key, MAX(update_date) AS update_date,
{counts('removed')}
FROM sonar_issues WHERE status IN ({CLOSED}) GROUP BY project, current_analysis_key"""

FLOWS_SQL = f"""SELECT COALESCE(t1.project, t2.project) AS project,
COALESCE(creation_analysis_key, current_analysis_key) AS analysis_key,
COALESCE(creation_date, update_date) AS date,
{", ".join(f"COALESCE({c}, 0) AS {c}" for c in schemas.FLOW_COUNTS)}
FROM ({INTRODUCED_SQL}) t1 FULL OUTER JOIN ({REMOVED_SQL}) t2
ON t1.creation_analysis_key = t2.current_analysis_key"""

TOTALS_SQL = "SELECT f.*, " + ",\n".join(
    f"CAST(SUM({i} - {r}) OVER (PARTITION BY project ORDER BY date NULLS FIRST) AS BIGINT) AS {c}"
    for i, r, c in zip(schemas.INTRODUCED, schemas.REMOVED, schemas.CURRENT)
) + f"\nFROM ({FLOWS_SQL}) f"


def columns(names, prefix: str = "") -> str:
    return ", ".join(prefix + n for n in names)


def pairs_union(table: str, keep: str, name: str, value: str, out_name: str) -> str:
    """UNION over ten (name, value) column pairs."""
    return "\nUNION\n".join(
        f"SELECT {keep}, {n} AS {out_name}, {v} AS importance_value FROM {table}"
        for n, v in schemas.ranked_pairs(name, value)
    )


def metrics_union(table: str, keep: str, prefix: str = "") -> str:
    return "\nUNION\n".join(
        f"SELECT {keep}, '{m.lower()}' AS metric, {prefix}{m} AS measure FROM {table}" for m in schemas.METRICS
    )
