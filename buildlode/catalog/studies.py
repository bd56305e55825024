"""Feature pipelines, saved models and end-to-end jobs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import functions as F

from .. import schemas
from ..domain import Domain, cte
from ..operators.balance import TRAIN_SHARE
from ..operators import features, issues, quality, rules
from ..plans import jobs, pipelines, training
from ..session import cut_lineage, shared_dir
from ..sources import staging
from ..sources.ledger import LoadLedger
from ..sources.sinks import CLASSIFIERS, LABEL_INDEXER, Artefacts, ParquetResults, classifier_name, selector_name
from ..streaming import scoring
from .learning import CATEGORY_INDEX, IMPUTED, KEYS, ML1_VIEWS, SCALED, TAIL, quality_table, rounded
from .registry import ORACLES, query
from .relational import RULE_EVENTS
from .sqltext import CLOSED, OPEN, TOTALS_SQL, columns, strings


class _DomainTables:
    def __init__(self, d: Domain):
        self.d = d

    def table(self, name: str):
        return self.d.view(name)


def study(d: Domain) -> jobs.Study:
    """A study over the derived tables with its own artefact and result folders."""
    return jobs.Study(
        d.spark,
        _DomainTables(d),
        Artefacts(d.spark, shared_dir(d.spark, "artefacts")),
        ParquetResults(d.spark, shared_dir(d.spark, "results")),
    )


LABEL = "CASE WHEN result = 'SUCCESS' THEN 0.0 ELSE 1.0 END::DOUBLE AS label"
NUMERICS = schemas.QUALITY_NUMERICS
ALERTS = [f"alert_status_index_{i}" for i in range(3)]


QUALITY_SQL = f"""SELECT {columns(KEYS)}, {LABEL},
        {', '.join(f"CASE WHEN COALESCE(i, 2) = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS {a}" for i, a in enumerate(ALERTS))},
        {', '.join(f'ROUND({c}, 6) AS {c}' for c in NUMERICS)}
        FROM (SELECT {columns(KEYS)}, result, alert_status, {SCALED} FROM ({IMPUTED}) i) s
        LEFT JOIN {CATEGORY_INDEX.replace('FROM sonar_measures', f'FROM ({IMPUTED}) m')} c ON alert_status = s.s""".replace(
        "ON alert_status = s.s", "ON s.alert_status = c.s"
    )


@query("quality_features", QUALITY_SQL, ML1_VIEWS)
def quality_features(d: Domain):
    table = quality_table(d)
    fitted = pipelines.quality_features(table, "first", study(d).artefacts)
    packed = fitted.model.transform(table).select(*KEYS, "label", "features")
    return rounded(features.spread(packed, "features", fitted.names), NUMERICS)


FLOW_ROWS = f"""SELECT b.job, b.build_number, CASE WHEN b.result = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAIL' END AS result,
    {columns(schemas.FLOW_FEATURES, 't.')} FROM ({TOTALS_SQL}) t
    JOIN sonar_analyses a ON t.analysis_key = a.analysis_key JOIN jenkins_builds b ON a.revision = b.revision_number"""
FLOW_SCALED = ", ".join(
    f"""ROUND(CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 0.5
        ELSE CAST({c} - MIN({c}) OVER () AS DOUBLE) / (MAX({c}) OVER () - MIN({c}) OVER ()) END, 9) AS {c}"""
    for c in schemas.FLOW_FEATURES
)


@query(
    "issue_flow_features",
    f"SELECT {columns(KEYS)}, {LABEL}, {FLOW_SCALED} FROM ({FLOW_ROWS}) f",
    "sonar_issues sonar_analyses jenkins_builds",
)
def issue_flow_features(d: Domain):
    flows = issues.stored_flow_counts(d.sonar_issues)
    totals = issues.running_totals_by_date(flows)
    rows = quality.builds_x_flows(quality.label_builds(d.jenkins_builds), flows, d.sonar_analyses, KEYS, totals=totals)
    table = cut_lineage(rows, "flows")
    fitted = pipelines.issue_flow_features(table, "first", study(d).artefacts)
    packed = fitted.model.transform(table).select(*KEYS, "label", "features")
    return rounded(features.spread(packed, "features", fitted.names), fitted.names, 9)


@query(
    "rule_vector_features",
    f"""SELECT analysis_key, concat(direction, '_', rule) AS feature, CAST(COUNT(*) AS DOUBLE) AS value
        FROM ({RULE_EVENTS}) e GROUP BY ALL""",
    "sonar_issues",
)
def rule_vector_features(d: Domain):
    """Vectors taken apart again: every non-zero slot with its name."""
    s = study(d)
    vocabulary = jobs.rule_vocabulary(s, d.sonar_issues, "first")
    names = rules.feature_names(vocabulary)
    vectors = rules.rule_vectors(rules.rule_cells(rules.rule_counts(d.sonar_issues), vocabulary), len(names))
    slots = vectors.select("analysis_key", F.posexplode(features.vector_to_array("features")).alias("slot", "value"))
    named = d.spark.createDataFrame(list(enumerate(names)), "slot int, feature string")
    return slots.where("value > 0").join(named, "slot").select("analysis_key", "feature", "value")


@query(
    "rule_index",
    """SELECT rule, COUNT(*) AS frequency, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, rule) - 1 AS INT) AS slot
       FROM sonar_issues GROUP BY rule""",
    "sonar_issues",
)
def rule_index(d: Domain):
    vocabulary = jobs.rule_vocabulary(study(d), d.sonar_issues, "first")
    slots = d.spark.createDataFrame([(r, i) for i, r in enumerate(vocabulary)], "rule string, slot int")
    return rules.rule_index(d.sonar_issues).join(slots, "rule")


@query(
    "artefact_store",
    """SELECT result, label, COUNT(*) AS builds FROM
       (SELECT CASE WHEN result = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAIL' END AS result,
               CASE WHEN result = 'SUCCESS' THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM jenkins_builds) b
       GROUP BY result, label""",
    "jenkins_builds",
)
def artefact_store(d: Domain):
    """A saved label indexer, overwritten once, loaded and applied."""
    artefacts = study(d).artefacts
    for _ in range(2):
        artefacts.save(LABEL_INDEXER, features.label_indexer())
    model = artefacts.load(LABEL_INDEXER, StringIndexerModel)
    return model.transform(quality.label_builds(d.jenkins_builds)).groupBy("result", "label").agg(F.count("*").alias("builds"))


@query("fit_or_load", QUALITY_SQL, ML1_VIEWS)
def fit_or_load(d: Domain):
    """Features of the loaded pipeline, row by row equal to those of the fitted one."""
    artefacts, table = study(d).artefacts, quality_table(d)
    pipelines.quality_features(table, "first", artefacts)
    loaded = pipelines.quality_features(table, "incremental", artefacts)
    packed = loaded.model.transform(table).select(*KEYS, "label", "features")
    return rounded(features.spread(packed, "features", loaded.names), NUMERICS)


DENSE_NAMES = [*NUMERICS, *ALERTS]
_DENSE_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS feature, CAST(least(floor({n} * 10), 9) AS INT) AS v, label FROM ({{rows}}) q" for n in DENSE_NAMES
)
_EXACT_ROWS = QUALITY_SQL.replace(", 6)", ", 9)")


@query(
    "dense_tests",
    f"""SELECT feature, ROUND(SUM((o - e) * (o - e) / e), 6) AS statistic, CAST(COUNT(DISTINCT v) - 1 AS INT) AS dof FROM (
          SELECT c.feature, c.v, n AS o, CAST(rows_v AS DOUBLE) * rows_y / total AS e FROM (
            SELECT f.feature, f.v, l.label, COUNT(x.label) AS n, MAX(f.rows_v) AS rows_v, MAX(l.rows_y) AS rows_y, MAX(l.total) AS total
            FROM (SELECT feature, v, COUNT(*) AS rows_v FROM bins GROUP BY ALL) f
            CROSS JOIN (SELECT label, COUNT(*) AS rows_y, (SELECT COUNT(*) FROM quality_rows) AS total FROM quality_rows GROUP BY label) l
            LEFT JOIN bins x ON x.feature = f.feature AND x.v = f.v AND x.label = l.label GROUP BY f.feature, f.v, l.label) c) t
        GROUP BY feature""",
    ML1_VIEWS,
)
def dense_tests(d: Domain):
    """Chi-square of every quality feature, cut into ten equal steps."""
    s = study(d)
    table = quality_table(d)
    fitted = pipelines.quality_features(table, "first", s.artefacts)
    samples = cut_lineage(fitted.model.transform(table).select("label", "features"), "samples")
    names = F.array(*[F.lit(n) for n in fitted.names])
    tests = training.dense_tests(samples)
    return tests.select(names[F.col("feature")].alias("feature"), F.round("statistic", 6).alias("statistic"), "dof")


ORACLES["dense_tests"] = (
    ORACLES["dense_tests"]
    .replace("FROM bins", f"FROM ({_DENSE_ROWS.replace('{rows}', _EXACT_ROWS)})")
    .replace("JOIN bins", f"JOIN ({_DENSE_ROWS.replace('{rows}', _EXACT_ROWS)})")
    .replace("FROM quality_rows", f"FROM ({_EXACT_ROWS}) q")
)


# The statistics unrounded, then ranked as the operator does: p-value and statistic to
# twelve decimals, slots in the order of the features.
_SELECT_SQL = f"""SELECT CAST(rank AS INT) AS rank, feature, ROUND(statistic, 6) AS statistic, dof, ROUND(p, 8) AS p_value
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(p, 12), ROUND(statistic, 12) DESC, list_position([{strings(DENSE_NAMES)}], feature)) AS rank
          FROM (SELECT *, {TAIL} AS p FROM (__TESTS__) s) t) r WHERE rank <= 10"""


@query("chi2_select", _SELECT_SQL, ML1_VIEWS)
def chi2_select(d: Domain):
    """The ten quality features that tell most about the outcome."""
    s = study(d)
    table = quality_table(d)
    fitted = pipelines.quality_features(table, "first", s.artefacts)
    samples = cut_lineage(fitted.model.transform(table).select("label", "features"), "samples")
    tests = training.chi2.top10_chi2(training.dense_tests(samples), [])
    names = F.array(*[F.lit(n) for n in fitted.names])
    named = tests.select("rank", names[F.col("feature")].alias("feature"), "statistic", "dof", "p_value")
    return rounded(rounded(named, ["statistic"]), ["p_value"], 8)


_TESTS = ORACLES["dense_tests"][len(cte(*ML1_VIEWS.split())) :].replace("ROUND(SUM((o - e) * (o - e) / e), 6)", "SUM((o - e) * (o - e) / e)")
ORACLES["chi2_select"] = ORACLES["chi2_select"].replace("__TESTS__", _TESTS)


# Jobs are checked on what is exact: their models, how many rows each saw by the md5
# split, and that every metric is a share. Models themselves depend on float sums.
_ROW_KEY = "concat_ws('|', COALESCE(b.server, ''), COALESCE(b.job, ''), COALESCE(CAST(b.build_number AS VARCHAR), ''), COALESCE(b.commit_id, ''))"
_IN_TRAIN = f"substr(md5(concat_ws('|', 'split-1', row_key)), 1, 8) < '{round(TRAIN_SHARE * 16**8):08x}'"
_FAILED = "CASE WHEN b.result = 'SUCCESS' THEN 0 ELSE 1 END AS failed"
_BATCHED = """jenkins_builds b JOIN (SELECT DISTINCT batch_number, jenkins_server FROM source) sb ON b.server = sb.jenkins_server
    JOIN sonar_analyses a ON a.revision = b.revision_number
    JOIN (SELECT DISTINCT batch_number, sonar_org_key FROM source) sa ON sa.sonar_org_key = a.organization AND sa.batch_number = sb.batch_number"""
_EVENTS = f"""SELECT CASE WHEN status IN ({OPEN}) THEN creation_analysis_key ELSE current_analysis_key END AS analysis_key,
    organization, rule, processed FROM sonar_issues WHERE status IN ({OPEN}, {CLOSED})"""
JOB_ROWS = {
    1: f"""SELECT {_ROW_KEY} AS row_key, {_FAILED} FROM {_BATCHED}
        JOIN sonar_measures m ON m.analysis_key = a.analysis_key
        JOIN (SELECT DISTINCT batch_number, sonar_org_key FROM source) sm
          ON sm.sonar_org_key = m.organization AND sm.batch_number = sb.batch_number""",
    2: f"""SELECT {_ROW_KEY} AS row_key, {_FAILED},
          (b.processed IS NOT DISTINCT FROM FALSE OR a.processed IS NOT DISTINCT FROM FALSE OR e.has_new) AS is_new FROM {_BATCHED}
        JOIN (SELECT analysis_key, batch_number, bool_or(NOT processed) AS has_new FROM ({_EVENTS}) i
              JOIN (SELECT DISTINCT batch_number, sonar_org_key FROM source) s ON s.sonar_org_key = i.organization
              WHERE analysis_key IS NOT NULL GROUP BY ALL) e
          ON e.analysis_key = a.analysis_key AND e.batch_number = sb.batch_number""",
    3: f"""SELECT {_ROW_KEY} AS row_key, {_FAILED} FROM jenkins_builds b JOIN sonar_analyses a ON a.revision = b.revision_number
        JOIN (SELECT DISTINCT analysis_key FROM ({_EVENTS}) i WHERE rule IS NOT NULL) e ON e.analysis_key = a.analysis_key""",
}


def _models(number: int) -> str:
    names = [classifier_name(kind, number, top10) for kind in CLASSIFIERS for top10 in (False, True)]
    return " UNION ALL ".join(f"SELECT '{n}' AS model" for n in names)


def job_sql(number: int, amount: str = "COUNT(*)", rows: str = f"NOT {_IN_TRAIN}") -> str:
    return f"""SELECT model, CAST((SELECT {amount} FROM ({JOB_ROWS[number]}) r WHERE {rows}) AS INT) AS data_amount, TRUE AS in_range
        FROM ({_models(number)}) m"""


JOB_VIEWS = "source jenkins_builds sonar_analyses sonar_measures sonar_issues"


def _checked(report, amount: str = "data_amount", prefix: str = ""):
    """Model and rows seen of a job's report, and whether every metric is a share."""
    shares = reduce(and_, [F.coalesce(F.col(prefix + m).between(0, 1), F.lit(True)) for m in schemas.METRICS])
    return report.select("model", F.col(amount).alias("data_amount"), shares.alias("in_range"))


@query("job_ml1", job_sql(1), JOB_VIEWS)
def job_ml1(d: Domain):
    return _checked(jobs.job_ml1(study(d)))


@query("job_ml2", job_sql(2), JOB_VIEWS)
def job_ml2(d: Domain):
    return _checked(jobs.job_ml2(study(d)))


@query("job_ml3", job_sql(3), JOB_VIEWS)
def job_ml3(d: Domain):
    return _checked(jobs.job_ml3(study(d)))


@query(
    "train_classifiers",
    job_sql(2, "SUM(CASE WHEN failed = 1 THEN 11 ELSE 1 END)", _IN_TRAIN)
    + f""" UNION ALL SELECT '{selector_name(2)}', CAST(COUNT(*) AS INT), TRUE FROM ({JOB_ROWS[2]}) r""",
    JOB_VIEWS,
)
def train_classifiers(d: Domain):
    """Training rows, with their weights, of the issue flow classifiers and the selector."""
    s = study(d)
    jobs.job_ml2(s)
    return _checked(s.results.table("model_info"), "train_data_amount", "train_")


@query("score_incremental", job_sql(2, rows="is_new"), JOB_VIEWS)
def score_incremental(d: Domain):
    """Saved issue flow classifiers on the rows that touch unprocessed data."""
    s = study(d)
    jobs.job_ml2(s)
    return _checked(jobs.job_ml2(s, "incremental"))


@query("run_all", " UNION ALL ".join(f"({job_sql(n)})" for n in (1, 2, 3)), JOB_VIEWS)
def run_all(d: Domain):
    """All studies; without saved artefacts the incremental run becomes a first one."""
    s = study(d)
    jobs.run_all(s, "incremental")
    return _checked(s.results.table("model_performance"))


_NEW_ROWS = JOB_ROWS[1] + " WHERE b.processed IS NOT DISTINCT FROM FALSE"


@query(
    "stream_scores",
    f"SELECT model, (SELECT COUNT(*) FROM ({_NEW_ROWS}) r) AS scored, 0 AS differing FROM ({_models(1)}) m",
    JOB_VIEWS,
)
def stream_scores(d: Domain):
    """Streamed scores of new builds against the scores of the same builds in one batch.

    Two loads of unprocessed builds arrive one after the other; a third run finds no load
    and the last batch is repeated. ``differing`` counts rows on one side only.
    """
    s, spark = study(d), d.spark
    jobs.job_ml1(s)
    root, path, state = (shared_dir(spark, n) for n in ("tables", "scores", "state"))
    ledger = LoadLedger(spark, root)
    new = d.jenkins_builds.where(~F.col("processed"))
    for part in (0, 1, None):
        if part is not None:
            load = staging.append_load(new.where(F.col("build_number") % 2 == part), f"{root}/jenkins_builds", "jenkins_builds", ledger)
        scoring.stream_scores(ledger, s, path, state).awaitTermination()
    scoring.score_loads(ledger, s, [load], path, 1)
    streamed = cut_lineage(spark.read.parquet(path).drop("batch"), "streamed")
    whole = cut_lineage(jobs.quality_scores(s, new).select(*streamed.columns), "whole")
    apart = streamed.exceptAll(whole).unionAll(whole.exceptAll(streamed)).groupBy("model").agg(F.count("*").alias("n"))
    counts = streamed.groupBy("model").agg(F.count("*").alias("scored"))
    return counts.join(apart, "model", "left").select("model", "scored", F.coalesce("n", F.lit(0)).cast("int").alias("differing"))


# The reports themselves, with every metric and importance: no SQL trains models.
@query("job_ml1_report")
def job_ml1_report(d: Domain):
    return jobs.job_ml1(study(d))


@query("job_ml2_report")
def job_ml2_report(d: Domain):
    return jobs.job_ml2(study(d))


@query("job_ml3_report")
def job_ml3_report(d: Domain):
    return jobs.job_ml3(study(d))


@query("train_classifiers_report")
def train_classifiers_report(d: Domain):
    """Training metrics and ranked importances of the issue flow models."""
    s = study(d)
    jobs.job_ml2(s)
    return s.results.table("model_info")


@query("score_incremental_report")
def score_incremental_report(d: Domain):
    s = study(d)
    jobs.job_ml2(s)
    return jobs.job_ml2(s, "incremental")


@query("run_all_report")
def run_all_report(d: Domain):
    s = study(d)
    jobs.run_all(s, "incremental")
    return s.results.table("model_performance")


@query(
    "feature_names",
    """SELECT CAST(slot AS INT) AS slot, concat('removed_', rule) AS feature
       FROM (SELECT rule, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, rule) - 1 AS slot FROM sonar_issues WHERE rule IS NOT NULL GROUP BY rule) v
       UNION ALL SELECT CAST(slot + size AS INT), concat('introduced_', rule)
       FROM (SELECT rule, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, rule) - 1 AS slot, COUNT(*) OVER () AS size
             FROM sonar_issues WHERE rule IS NOT NULL GROUP BY rule) w""",
    "sonar_issues",
)
def feature_names(d: Domain):
    """Name of every slot of the rule vectors, from the fitted vocabulary."""
    names = rules.feature_names(jobs.rule_vocabulary(study(d), d.sonar_issues, "first"))
    return d.spark.createDataFrame(list(enumerate(names)), "slot int, feature string")


@query("issue_impact_by_project")
def issue_impact_by_project(d: Domain):
    s = study(d)
    jobs.rule_vocabulary(s, d.sonar_issues, "first")
    return jobs.issue_impact_by_project(s)
