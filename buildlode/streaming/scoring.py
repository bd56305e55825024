"""New builds scored as their loads are entered, by the saved classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import jobs
from ..sources.ledger import LOADS, LoadLedger
from ..sources.store import LAYOUT
from ..session import intermediates


def entered_loads(ledger: LoadLedger) -> DataFrame:
    """The loads of a study as a stream: one row per load, once its rows are complete."""
    return ledger.spark.readStream.schema(LOADS).parquet(f"{ledger.root}/_ledger/loads")


def score_loads(ledger: LoadLedger, study: jobs.Study, loads: list[str], path: str, batch_id: int) -> None:
    """Scores of the builds of these loads, as one batch; a repeat replaces it."""
    builds = ledger.spark.read.parquet(f"{ledger.root}/jenkins_builds").where(F.col("load_id").isin(loads)).drop(*LAYOUT)
    with intermediates(ledger.spark):
        jobs.quality_scores(study, builds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_scores(ledger: LoadLedger, study: jobs.Study, path: str, checkpoint: str) -> StreamingQuery:
    """Score all builds entered since the last run, then stop.

    The stream carries the names of loads. Each batch joins the builds of its loads with
    the stored analyses and measures and writes (row_key, label, model, prediction, score)
    into a folder of its own, so a batch repeated after a failure adds nothing. Loads that
    were never entered are not seen. A build whose measures come later is not scored again
    here; the incremental job does that.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        named = batch.where(F.col("table_name") == "jenkins_builds").select("load_id").distinct()
        loads = sorted(r.load_id for r in named.collect())
        if loads:
            score_loads(ledger, study, loads, path, batch_id)

    return (
        entered_loads(ledger)
        .writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
