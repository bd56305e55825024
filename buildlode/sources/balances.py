"""Running issue totals kept step by step.

Net issues per project and date are stored as steps that add up, and the closing balance
of every project and day as versions of which the latest holds. A step recomputes a
project from its earliest touched day on, starting at the balance before it; projects and
days it does not reach are not read. Both tables lie in year folders, sorted by day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.issues import net_flows, with_totals
from ..schemas import CURRENT
from ..session import is_small
from .files import exists

YEAR = "coalesce(year(day), 0)"
#: Sorts days with NULL first.
ORDER = "struct(day IS NOT NULL, day)"


class BalanceStore:
    """Totals per (project, date) below ``path``; NULL dates come before all others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        path = f"{self.path}/{name}"
        return self.spark.read.parquet(path) if exists(self.spark, f"{path}/step=*/year=*") else None

    def _write(self, name: str, step: int, rows: DataFrame) -> None:
        placed = rows.withColumn("year", F.expr(YEAR)).hint("rebalance", "year").sortWithinPartitions("year", "day")
        placed.write.mode("overwrite").partitionBy("year").parquet(f"{self.path}/{name}/step={step}")

    def step(self, changes: DataFrame, step: int) -> None:
        """Add flow rows; with a column ``sign`` of -1 a row takes back an earlier one.

        A flow row whose counts or date changed comes twice, as it was and as it is now.
        Steps are numbered from 0 upwards; the last one may be repeated.
        """
        sign = "sign" if "sign" in changes.columns else "1"
        signed = changes.selectExpr("project", "date", "cast(date AS date) AS day", *net_flows(sign))
        nets = signed.groupBy("project", "date", "day").agg(*[F.sum(c).alias(c) for c in CURRENT])
        self._write("nets", step, nets)
        every = self._read("nets")
        if every is None:
            return
        own = every.where(F.col("step") == step)
        touched = own.groupBy(F.col("project").alias("in_project")).agg(F.expr(f"min({ORDER})").alias("first"))
        since = own.agg(F.min("year").alias("year")).first()
        touched = F.broadcast(touched) if is_small(touched) else touched
        reached = F.col("project").eqNullSafe(F.col("in_project"))

        # The first touched year is a constant: earlier folders are not listed.
        later = every.where((F.col("step") <= step) & (F.col("year") >= F.lit(since.year)))
        later = later.join(touched, reached & (F.expr(ORDER) >= F.col("first")))
        days = later.groupBy("project", "day").agg(*[F.sum(c).alias(c) for c in CURRENT])
        before = self._read("days")
        up_to = "PARTITION BY project ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        closing = days.selectExpr("project", "day", *[f"sum({c}) OVER ({up_to}) AS {c}" for c in CURRENT])
        if before is not None:
            earlier = before.where(F.col("step") < step).join(touched, reached & (F.expr(ORDER) < F.col("first")))
            version = f"struct({ORDER}, step)"
            opening = earlier.groupBy(F.col("project").alias("of_project")).agg(
                *[F.expr(f"max_by({c}, {version}) AS opening_{c}") for c in CURRENT]
            )
            closing = closing.join(opening, F.col("project").eqNullSafe(F.col("of_project")), "left").selectExpr(
                "project", "day", *[f"{c} + coalesce(opening_{c}, 0L) AS {c}" for c in CURRENT]
            )
        self._write("days", step, closing)

    def totals(self) -> DataFrame:
        """(project, date, the 24 current totals) of all dates stored so far."""
        nets, days = self._read("nets"), self._read("days")
        if nets is None:
            raise ValueError(f"no step is stored below {self.path}")
        by_date = nets.groupBy("project", "date", "day").agg(*[F.sum(c).alias(c) for c in CURRENT])
        latest = days.groupBy(F.col("project").alias("of_project"), F.col("day").alias("of_day")).agg(
            *[F.expr(f"max_by({c}, step) AS closing_{c}") for c in CURRENT]
        )
        # What a day's later dates add is not yet in an earlier date's total.
        after = "PARTITION BY project, day ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
        in_day = by_date.selectExpr("project", "date", "day", *[f"coalesce(sum({c}) OVER ({after}), 0L) AS {c}" for c in CURRENT])
        same = F.col("project").eqNullSafe(F.col("of_project")) & F.col("day").eqNullSafe(F.col("of_day"))
        return in_day.join(latest, same).selectExpr("project", "date", *[f"closing_{c} - {c} AS {c}" for c in CURRENT])

    def running_issue_totals(self, flows: DataFrame) -> DataFrame:
        """Flow rows with their totals, as the operator of that name gives them."""
        return with_totals(flows, self.totals())
