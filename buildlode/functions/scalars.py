"""Scalar expressions over CI and quality columns; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FAIL, FOLDER_KINDS, NULL_SEVERITY_LABEL, SUCCESS


def binary_result(result: Column) -> Column:
    """SUCCESS stays, anything else and NULL become FAIL."""
    return F.when(result == SUCCESS, F.lit(SUCCESS)).otherwise(F.lit(FAIL))


def fail_label(result: Column) -> Column:
    """1.0 for a failed build, 0.0 for a successful one."""
    return F.when(result == SUCCESS, F.lit(0.0)).otherwise(F.lit(1.0))


def rounded(value: str, digits: int) -> str:
    """SQL text of ``round(value, digits)`` of a double, the same to the last bit.

    Away from a tie the product with the power of ten is off by less than its distance to
    the tie, so plain arithmetic finds the same number of last digits; ties, large values
    and NaN go through ``round``, which prints and parses every value it is given.
    """
    scaled = f"({value} * 1e{digits}D)"
    plain = f"abs({scaled}) < 1e12D AND abs({scaled} - floor({scaled}) - 0.5D) > 1e-3D"
    return f"CASE WHEN {plain} THEN floor({scaled} + 0.5D) / 1e{digits}D ELSE round({value}, {digits}) END"


def severity_bucket(severity: Column) -> Column:
    return F.coalesce(severity, F.lit(NULL_SEVERITY_LABEL))


def slug(name: Column) -> Column:
    """File-name form of a job name."""
    return F.regexp_replace(F.lower(name), "[^0-9a-z_-]", "_")


def commit_timestamp(text: Column) -> Column:
    """Commit time in UTC, without zone, from either of the two landed formats.

    ``yyyy-MM-dd HH:mm:ss +hhmm`` is shifted to UTC; otherwise the first 19
    characters are read as an ISO time. The offset is applied by hand, so the
    result does not depend on the session time zone.
    """
    parts = F.split(text, " ")
    zone = F.element_at(parts, 3)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    shift = F.when(zone.startswith("-"), minutes).otherwise(-minutes)
    local = F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, 2)).try_cast("timestamp_ntz")
    shifted = local + F.make_dt_interval(F.lit(0), F.lit(0), shift)
    iso = F.substring(text, 1, 19).try_cast("timestamp_ntz")
    return F.when(F.size(parts) == 3, shifted).otherwise(iso)


def class_tail(name: Column) -> Column:
    """Last dotted token of a class name."""
    return F.substring_index(name, ".", -1)


def package_of(suite: Column) -> Column:
    """All dotted tokens of a suite name but the last; empty if there is one."""
    return F.regexp_replace(suite, r"\.?[^.]*$", "")


def clean_case_name(name: Column) -> Column:
    return F.translate(name, "\n\r", "__")


def pass_count(passed: Column, total: Column, failed: Column, skipped: Column) -> Column:
    """A total wins over a stated pass count."""
    return F.coalesce(total - failed - skipped, passed)


def build_number(identifier: Column, number: Column) -> Column:
    """Numeric id, else the number; NULL where neither is a whole number that fits."""
    return F.coalesce(identifier.try_cast("int"), number.try_cast("int")).cast("bigint")


def server_host(url: Column) -> Column:
    """Third ``/`` token of a server address."""
    return F.split_part(url, F.lit("/"), F.lit(3))


def name_matches(job: Column, name: str) -> Column:
    """Case-insensitive "contains this pattern" on a job name."""
    return job.rlike(f"(?i)^.*{name}.*$")


def is_folder(class_name: Column) -> Column:
    return class_tail(class_name).isin(FOLDER_KINDS)
