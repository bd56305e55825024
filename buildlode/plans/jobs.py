"""End-to-end jobs: three platform-wide studies and the per-project ranking.

A job reads the stored tables, builds its samples, writes them once to the shared
folder and trains or scores from there. In ``first`` mode it fits everything and
saves it; in ``incremental`` mode it scores rows that touch unprocessed data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce, wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import chi2, issues, rules, trees
from ..operators.delta import incremental_delta, is_new
from ..operators.features import label_indexer
from ..operators.filters import cast_double, drop_sparse_measures
from ..operators.quality import builds_x_flows, builds_x_measures, by_batch, label_builds
from ..session import at_once, cut_lineage, intermediates
from ..sources.sinks import LABEL_INDEXER, Artefacts, pipeline_name, result_rows
from ..sources.tables import scan_table
from . import pipelines, training

BATCH = ["batch_number"]
PROJECT_DEPTH, PROJECT_TREES = 3, 10
# Up to so many samples, of about 1 KB each in a fit, both sets of models are trained at once.
SIDE_BY_SIDE_ROWS = 4_000_000


@dataclass
class Study:
    """Where a run reads its tables, keeps its models and puts its results.

    ``tables`` has ``table(name)``; ``results`` has ``append(table, df)``.
    """

    spark: SparkSession
    tables: Any
    artefacts: Artefacts
    results: Any

    def scan(self, table: str) -> DataFrame:
        key = schemas.KEY_COLUMN.get(table)
        where = [F.col(key).isNotNull()] if key else []
        return scan_table(self.tables, table, where=where, all_columns=True)

    def by_batch(self, table: str) -> DataFrame:
        return by_batch(self.scan(table), self.tables.table("source"), table)


def _row_key() -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("server", "job", "build_number", "commit_id")]
    return F.concat_ws("|", *parts).alias("row_key")


def quality_rows(study: Study, mode: str) -> DataFrame:
    """Builds with quality measures of their revision, over all batches."""
    builds, analyses = study.by_batch("jenkins_builds"), study.by_batch("sonar_analyses")
    measures = drop_sparse_measures(study.by_batch("sonar_measures"))
    if mode == "incremental":
        joined = incremental_delta(builds, measures, analyses, on=BATCH)
    else:
        joined = builds_x_measures(label_builds(builds), measures, analyses, on=BATCH)
    rows = joined.select(_row_key(), "result", *schemas.QUALITY_NUMERICS, *schemas.MEASURE_CATEGORIES)
    return cast_double(rows, schemas.QUALITY_NUMERICS)


def quality_scores(study: Study, builds: DataFrame) -> DataFrame:
    """Scores of the saved quality classifiers for the given builds of the study."""
    joined = builds_x_measures(
        label_builds(by_batch(builds, study.tables.table("source"), "jenkins_builds")),
        drop_sparse_measures(study.by_batch("sonar_measures")),
        study.by_batch("sonar_analyses"),
        on=BATCH,
    )
    rows = joined.select(_row_key(), "result", *schemas.QUALITY_NUMERICS, *schemas.MEASURE_CATEGORIES)
    model = study.artefacts.load(pipeline_name(1), pipelines.PipelineModel)
    samples = model.transform(cast_double(rows, schemas.QUALITY_NUMERICS)).select("row_key", "label", "features")
    return training.score_rows(samples, 1, study.artefacts)


def issue_flow_rows(study: Study, mode: str) -> DataFrame:
    """Builds with the issue flow of their revision, over all batches.

    Totals always run over the whole history; an incremental run then keeps the rows
    in which the build, the analysis or any of the counted issues is new.
    """
    # The totals read the flows several times; they are small next to the issues.
    flows = issues.stored_flow_counts(study.by_batch("sonar_issues"), with_new_flag=True, keys=BATCH)
    totals = issues.running_totals_by_date(flows, keys=BATCH)
    builds = label_builds(study.by_batch("jenkins_builds"))
    builds = builds.select(*BATCH, "revision_number", "result", _row_key(), is_new(builds).alias("build_new"))
    analyses = study.by_batch("sonar_analyses")
    analyses = analyses.select(*BATCH, "analysis_key", "revision", is_new(analyses).alias("analysis_new"))
    joined = builds_x_flows(builds, flows, analyses, ["row_key", "build_new"], BATCH, ["analysis_new"], totals)
    if mode == "incremental":
        joined = joined.where(F.col("build_new") | F.col("analysis_new") | F.col("has_new"))
    return cast_double(joined.select("row_key", "result", *schemas.FLOW_FEATURES), schemas.FLOW_FEATURES)


def _finish(study: Study, number: int, mode: str, samples: DataFrame, names: list[str], tests) -> DataFrame | None:
    """Select, then train or score on all and on the ten best features.

    ``samples`` is written out already; ``tests`` gives the chi-square table and is
    only called in a first run. Returns the ``model_performance`` rows.
    """
    rows = samples.count()
    if rows == 0:
        return None
    if mode == "first":
        selector, best, info = training.chi2_select(tests(), names, rows, number, study.artefacts)
        study.results.append("model_info", result_rows(study.spark, "model_info", [info]))
    else:
        selector, best = training.load_selector(number, names, study.artefacts)

    def report(table: DataFrame, columns: list[str], top10: bool):
        if mode == "first":
            return training.train(table, columns, number, study.artefacts, top10)
        return training.score_incremental(table, number, study.artefacts, top10), None

    sides = [partial(report, samples, names, False), partial(report, training.selected(samples, selector), best, True)]
    # Both read the same samples; large ones are kept in memory by one fit at a time.
    reports = at_once(study.spark, *sides) if rows <= SIDE_BY_SIDE_ROWS else [side() for side in sides]
    for _, info in reports:
        if info is not None:
            study.results.append("model_info", info)
    out = cut_lineage(reports[0][0].unionByName(reports[1][0]), "performance")
    study.results.append("model_performance", out)
    return out


def stored_job(keep: str):
    """A job whose tables in the shared folder go when it is done, but for its result."""

    def decorate(job):
        @wraps(job)
        def run(study: Study, *args, **options):
            with intermediates(study.spark, keep):
                return job(study, *args, **options)

        return run

    return decorate


@stored_job("performance")
def job_ml1(study: Study, mode: str = "first") -> DataFrame | None:
    """Quality measures against build outcome."""
    rows = cut_lineage(quality_rows(study, mode), "quality")
    if rows.isEmpty():
        return None
    fitted = pipelines.quality_features(rows, mode, study.artefacts)
    samples = cut_lineage(fitted.model.transform(rows).select("row_key", "label", "features"), "samples")
    return _finish(study, 1, mode, samples, fitted.names, lambda: training.dense_tests(samples))


@stored_job("performance")
def job_ml2(study: Study, mode: str = "first") -> DataFrame | None:
    """Issue flow against build outcome."""
    rows = cut_lineage(issue_flow_rows(study, mode), "flows")
    if rows.isEmpty():
        return None
    fitted = pipelines.issue_flow_features(rows, mode, study.artefacts)
    samples = cut_lineage(fitted.model.transform(rows).select("row_key", "label", "features"), "samples")
    return _finish(study, 2, mode, samples, fitted.names, lambda: training.dense_tests(samples))


def _outcomes(study: Study, builds: DataFrame, analyses: DataFrame, on: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """(on, keys, analysis_key, row_key, label, is_new) of builds with an analysed revision."""
    b = label_builds(builds)
    b = b.select(*on, F.col("revision_number").alias("revision"), "result", _row_key(), is_new(b).alias("build_new"))
    a = analyses.select(*on, *keys, "analysis_key", "revision", is_new(analyses).alias("analysis_new"))
    labelled = study.artefacts.load(LABEL_INDEXER, type(label_indexer())).transform(b)
    return labelled.join(a, [*on, "revision"]).select(
        *on, *keys, "analysis_key", "row_key", "label", (F.col("build_new") | F.col("analysis_new")).alias("is_new")
    )


def rule_vocabulary(study: Study, issues_table: DataFrame, mode: str) -> list[str]:
    if mode == "first":
        study.artefacts.save(LABEL_INDEXER, label_indexer())
    model = pipelines.fit_or_load(issues_table.select("rule").where(F.col("rule").isNotNull()), 3, mode, study.artefacts)
    return pipelines.vocabulary(model)


def rule_samples(study: Study, mode: str):
    """(cells, outcomes, samples, names) of the rule study."""
    table = study.scan("sonar_issues")
    vocabulary = rule_vocabulary(study, table, mode)
    names = rules.feature_names(vocabulary)
    counts = rules.rule_counts(table, with_new_flag=True)
    cells = cut_lineage(rules.rule_cells(counts, vocabulary), "rule-cells")
    outcomes = cut_lineage(_outcomes(study, study.scan("jenkins_builds"), study.scan("sonar_analyses")), "outcomes")
    vectors = rules.rule_vectors(cells, len(names))
    samples = outcomes.join(vectors, "analysis_key")
    if mode == "incremental":
        samples = samples.where(F.col("is_new") | F.col("has_new"))
    return cells, outcomes, samples.select("row_key", "label", "features"), names


@stored_job("performance")
def job_ml3(study: Study, mode: str = "first") -> DataFrame | None:
    """Rule occurrences against build outcome."""
    cells, outcomes, samples, names = rule_samples(study, mode)
    if not names:
        return None
    samples = cut_lineage(samples, "samples")
    known = cells.select("analysis_key").distinct()
    tests = lambda: training.count_tests(cells, outcomes.join(known, "analysis_key", "left_semi"))
    return _finish(study, 3, mode, samples, names, tests)


def run_all(study: Study, mode: str = "incremental") -> dict[str, DataFrame | None]:
    """All three studies; an incremental run without its artefacts becomes a first one."""
    mode = study.artefacts.usable_mode(mode)
    return {name: job(study, mode) for name, job in (("ml1", job_ml1), ("ml2", job_ml2), ("ml3", job_ml3))}


@stored_job("top-issues")
def issue_impact_by_project(study: Study) -> DataFrame:
    """Issues that matter most per project, as ``top_issues`` rows; all projects at once.

    Needs the rule vocabulary of a finished rule study. A project is an organization
    and a project name. The chi-square ranking is left out where even the best
    feature tells nothing, a tree ranking where fewer than two features matter.
    """
    keys = [*BATCH, "organization", "project"]
    vocabulary = pipelines.vocabulary(study.artefacts.load(pipeline_name(3), pipelines.PipelineModel))
    names = rules.feature_names(vocabulary)
    counts = rules.rule_counts(study.by_batch("sonar_issues").drop("processed"), keys)
    cells = cut_lineage(rules.rule_cells(counts, vocabulary), "project-cells")
    outcomes = _outcomes(
        study, study.by_batch("jenkins_builds"), study.by_batch("sonar_analyses"), BATCH, ["organization", "project"]
    )
    # Only analyses that have both rule counts and builds are samples.
    known = cells.select(*keys, "analysis_key").distinct()
    outcomes = cut_lineage(outcomes.join(known, [*keys, "analysis_key"], "left_semi"), "project-outcomes")

    best = chi2.top10_chi2(training.count_tests(cells, outcomes, keys), keys)
    telling = best.where((F.col("rank") == 1) & (F.col("statistic") != 0)).select(*keys)
    ranked = {"ChiSquareSelectorModel": best.join(telling, keys, "left_semi").withColumnRenamed("statistic", "value")}

    # The single tree grows in the same passes as the forest; it may use every feature.
    single = trees.single_tree_weights(outcomes, keys).withColumn("tree", F.lit(trees.SINGLE))
    drawn = trees.bootstrap_weights(outcomes, keys, PROJECT_TREES, "row_key", training.SEED)
    subsets = trees.feature_subsets(study.spark, len(names), PROJECT_TREES, PROJECT_DEPTH, training.SEED)
    subsets = subsets.unionByName(trees.all_features(study.spark, len(names), PROJECT_DEPTH))
    grown = trees.grow(single.unionByName(drawn), cells, keys, PROJECT_DEPTH, subsets)
    alone = F.col("tree") == trees.SINGLE
    single, forest = grown.where(alone), grown.where(~alone)
    for model, splits in (("DecisionTreeModel", single), ("RandomForestModel", forest)):
        shares = trees.importances(splits, keys).withColumnRenamed("slot", "feature")
        top = chi2.top_ranked(shares, keys, [F.desc("importance"), F.asc("feature")])
        several = top.where(F.col("rank") == 2).select(*keys)
        ranked[model] = top.join(several, keys, "left_semi").withColumnRenamed("importance", "value")

    slots = study.spark.createDataFrame(list(enumerate(names)), "feature int, issue string")
    amounts = outcomes.groupBy(*keys).agg(F.count("*").cast("int").alias("input_data_amount"))
    long = reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(m).alias("model"), "rank", F.col("feature").cast("int").alias("feature"), "value") for m, df in ranked.items()],
    ).join(slots, "feature")
    wide = chi2.widen_ranked(long, [*keys, "model"], "issue", "value", "issue", "issue_importance")
    out = wide.join(amounts, keys).select(*schemas.TOP_ISSUES.names)
    out = cut_lineage(out, "top-issues")
    study.results.append("top_issues", out)
    return out
