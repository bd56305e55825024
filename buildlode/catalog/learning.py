"""Feature steps, balancing, metrics and chi-square."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..domain import Domain
from ..functions import scalars
from ..operators import balance, chi2, features, issues, metrics, quality, reports, rules
from ..operators.filters import cast_double
from ..plans.training import count_tests
from ..session import cut_lineage
from .registry import query
from .relational import FEATURES_SQL, ML1_JOIN, RULE_EVENTS
from .sqltext import FLOWS_SQL, columns

ML1_VIEWS = "jenkins_builds sonar_analyses sonar_measures"
KEYS = ["job", "build_number"]
KEYS_SQL = columns(KEYS, "b.")
NUMERICS = schemas.QUALITY_NUMERICS
FULL_ML1 = f"""SELECT {KEYS_SQL}, CASE WHEN b.result = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAIL' END AS result,
    {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in NUMERICS)}, alert_status {ML1_JOIN}"""


def quality_table(d: Domain):
    joined = quality.builds_x_measures(quality.label_builds(d.jenkins_builds), d.sonar_measures, d.sonar_analyses)
    rows = cast_double(joined.select(*KEYS, "result", *NUMERICS, "alert_status"), NUMERICS)
    return cut_lineage(rows, "quality")


def rounded(df, names, digits: int = 6):
    names = set(names)
    return df.selectExpr(*[f"{scalars.rounded(c, digits)} AS {c}" if c in names else c for c in df.columns])


IMPUTED = f"""SELECT {columns(KEYS)}, result, alert_status,
    {', '.join(f'COALESCE({c}, AVG({c}) OVER ()) AS {c}' for c in NUMERICS)} FROM ({FULL_ML1}) q"""
SCALED = ", ".join(
    f"""CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 0.5
        ELSE ({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ()) END AS {c}"""
    for c in NUMERICS
)


@query(
    "impute_mean",
    f"SELECT {columns(KEYS)}, {', '.join(f'ROUND({c}, 6) AS {c}' for c in NUMERICS)} FROM ({IMPUTED}) i",
    ML1_VIEWS,
)
def impute_mean(d: Domain):
    return rounded(features.impute_mean(quality_table(d), NUMERICS).select(*KEYS, *NUMERICS), NUMERICS)


CATEGORY_INDEX = """(SELECT alert_status AS s, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, alert_status) - 1 AS DOUBLE) AS i
    FROM sonar_measures WHERE alert_status IS NOT NULL GROUP BY alert_status)"""
CATEGORY = f"COALESCE(i, (SELECT CAST(COUNT(DISTINCT alert_status) AS DOUBLE) FROM sonar_measures))"


@query(
    "index_category",
    f"""SELECT analysis_key, alert_status, {CATEGORY} AS alert_status_index
        FROM sonar_measures LEFT JOIN {CATEGORY_INDEX} c ON alert_status = s""",
    "sonar_measures",
)
def index_category(d: Domain):
    measures = d.sonar_measures.select("analysis_key", "alert_status")
    return features.category_indexer("alert_status").fit(measures).transform(measures)


@query(
    "one_hot",
    f"""SELECT analysis_key, {', '.join(f'CASE WHEN {CATEGORY} = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS alert_status_index_{i}' for i in range(3))}
        FROM sonar_measures LEFT JOIN {CATEGORY_INDEX} c ON alert_status = s""",
    "sonar_measures",
)
def one_hot(d: Domain):
    indexed = index_category(d)
    encoder = features.one_hot(["alert_status"]).fit(indexed)
    coded = encoder.transform(indexed).select("analysis_key", "alert_status_class_vec")
    names = features.category_names(["alert_status"], encoder.categorySizes)
    return features.spread(coded, "alert_status_class_vec", names)


@query(
    "assemble",
    f"SELECT analysis_key, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in schemas.FLOW_COUNTS)} FROM ({FLOWS_SQL}) f",
    "sonar_issues",
)
def assemble(d: Domain):
    flows = issues.issue_flow_counts(d.sonar_issues).select("analysis_key", *schemas.FLOW_COUNTS)
    packed = features.numeric_assembler(schemas.FLOW_COUNTS, "vec").transform(flows).select("analysis_key", "vec")
    return features.spread(packed, "vec", schemas.FLOW_COUNTS)


@query(
    "min_max_scale",
    f"""SELECT analysis_key, {', '.join(
        f'''ROUND(CASE WHEN MAX({c}) OVER () = MIN({c}) OVER () THEN 0.5
        ELSE CAST({c} - MIN({c}) OVER () AS DOUBLE) / (MAX({c}) OVER () - MIN({c}) OVER ()) END, 9) AS {c}'''
        for c in schemas.FLOW_COUNTS)} FROM ({FLOWS_SQL}) f""",
    "sonar_issues",
)
def min_max_scale(d: Domain):
    flows = issues.issue_flow_counts(d.sonar_issues).select("analysis_key", *schemas.FLOW_COUNTS)
    return rounded(features.min_max_scale(flows, schemas.FLOW_COUNTS), schemas.FLOW_COUNTS, 9)


@query(
    "index_label",
    """SELECT server, job, build_number, CAST(CASE WHEN result = 'SUCCESS' THEN 0 ELSE 1 END AS DOUBLE) AS label
       FROM jenkins_builds""",
    "jenkins_builds",
)
def index_label(d: Domain):
    builds = quality.label_builds(d.jenkins_builds).select("server", "job", "build_number", "result")
    return features.label_indexer().transform(builds).drop("result")


@query(
    "split_train_test",
    """SELECT server, job, build_number,
              substr(md5(concat('split-1|', server, '|', job, '|', CAST(build_number AS VARCHAR))), 1, 8) < 'b3333333' AS is_train
       FROM jenkins_builds""",
    "jenkins_builds",
)
def split_train_test(d: Domain):
    keys = ["server", "job", "build_number"]
    return d.jenkins_builds.select(*keys, balance.train_flag(keys).alias("is_train"))


@query(
    "oversample_minority",
    """SELECT job, build_number, label FROM
       (SELECT job, build_number, CAST(CASE WHEN result = 'SUCCESS' THEN 0 ELSE 1 END AS DOUBLE) AS label FROM jenkins_builds) b
       JOIN (SELECT UNNEST(generate_series(1, 11)) AS copy) c ON copy = 1 OR label = 1""",
    "jenkins_builds",
)
def oversample_minority(d: Domain):
    labelled = features.label_indexer().transform(quality.label_builds(d.jenkins_builds))
    return balance.oversample_minority(labelled.select("job", "build_number", "label"))


# ------------------------------------------------------------------ metrics

CONFUSION = """SELECT model, COUNT(*) AS n,
    COUNT(*) FILTER (label = 0) AS actual_ok, COUNT(*) FILTER (label = 1) AS actual_failed,
    COUNT(*) FILTER (prediction = 0) AS predicted_ok, COUNT(*) FILTER (prediction = 1) AS predicted_failed,
    COUNT(*) FILTER (label = 0 AND prediction = 0) AS hit_ok,
    COUNT(*) FILTER (label = 1 AND prediction = 1) AS hit_failed
    FROM predictions GROUP BY model"""


@query("confusion_counts", CONFUSION, "predictions")
def confusion_counts(d: Domain):
    return metrics.confusion_counts(d.predictions, ["model"])


MULTI = ["f1", "weighted_precision", "weighted_recall", "accuracy"]


@query(
    "evaluate_multiclass",
    f"""SELECT model, n,
        ROUND((CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END * actual_ok
             + CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END * actual_failed) / n, 9) AS f1,
        ROUND((p0 * actual_ok + p1 * actual_failed) / n, 9) AS weighted_precision,
        ROUND((r0 * actual_ok + r1 * actual_failed) / n, 9) AS weighted_recall,
        ROUND(CAST(hit_ok + hit_failed AS DOUBLE) / n, 9) AS accuracy
        FROM (SELECT *, COALESCE(hit_ok / NULLIF(CAST(predicted_ok AS DOUBLE), 0), 0) AS p0,
                        COALESCE(hit_failed / NULLIF(CAST(predicted_failed AS DOUBLE), 0), 0) AS p1,
                        COALESCE(hit_ok / NULLIF(CAST(actual_ok AS DOUBLE), 0), 0) AS r0,
                        COALESCE(hit_failed / NULLIF(CAST(actual_failed AS DOUBLE), 0), 0) AS r1
              FROM ({CONFUSION}) c) t""",
    "predictions",
)
def evaluate_multiclass(d: Domain):
    measured = metrics.multiclass_metrics(metrics.confusion_counts(d.predictions, ["model"]), ["model"])
    return rounded(measured.select("model", "n", *MULTI), MULTI, 9)


@query(
    "predicted_negative_rate",
    f"""SELECT model, ROUND(hit_failed / NULLIF(CAST(actual_failed AS DOUBLE), 0), 9) AS predicted_negative_rate
        FROM ({CONFUSION}) c""",
    "predictions",
)
def predicted_negative_rate(d: Domain):
    counts = metrics.confusion_counts(d.predictions, ["model"])
    return counts.select("model", F.round(metrics.predicted_negative_rate(), 9).alias("predicted_negative_rate"))


@query(
    "evaluate_binary",
    """SELECT ROUND(SUM((fpr - prev_fpr) * (tpr + prev_tpr) / 2), 6) AS area_under_ROC,
              ROUND(SUM((tpr - prev_tpr) * (prec + prev_prec) / 2), 6) AS area_under_PR
       FROM (SELECT tpr, fpr, prec, LAG(tpr, 1, 0) OVER w AS prev_tpr, LAG(fpr, 1, 0) OVER w AS prev_fpr,
                    COALESCE(LAG(prec) OVER w, prec) AS prev_prec
             FROM (SELECT score, CAST(tp AS DOUBLE) / pos AS tpr, CAST(fp AS DOUBLE) / neg AS fpr, CAST(tp AS DOUBLE) / (tp + fp) AS prec
                   FROM (SELECT score, SUM(SUM(label)) OVER o AS tp, SUM(SUM(1 - label)) OVER o AS fp,
                                SUM(SUM(label)) OVER () AS pos, SUM(SUM(1 - label)) OVER () AS neg
                         FROM predictions GROUP BY score WINDOW o AS (ORDER BY score DESC)) c) r
             WINDOW w AS (ORDER BY score DESC)) t""",
    "predictions",
)
def evaluate_binary(d: Domain):
    scored = d.predictions.select(F.lit("all").alias("model"), "label", "prediction", "score")
    report = metrics.binary_areas(cut_lineage(metrics.score_table(scored, ["model"]), "scores"), ["model"])
    return rounded(report.drop("model"), ["area_under_ROC", "area_under_PR"])


# ------------------------------------------------------------ top-k rankings


@query(
    "top10_importances",
    f"""SELECT model, {', '.join(f"MAX(CASE WHEN r = {i} THEN feature END) AS {n}, MAX(CASE WHEN r = {i} THEN importance_value END) AS {v}"
        for i, (n, v) in enumerate(schemas.ranked_pairs('feature', 'feature_importance'), 1))}
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY importance_value DESC, feature) AS r
              FROM (SELECT DISTINCT * FROM ({FEATURES_SQL}) u WHERE feature IS NOT NULL) s) t
        WHERE r <= 10 GROUP BY model""",
    "model_info",
)
def top10_importances(d: Domain):
    long = reports.feature_importance_report(d.model_info).where(F.col("feature").isNotNull())
    ranked = chi2.top_ranked(long, ["model"], [F.desc("importance_value"), F.asc("feature")])
    return chi2.widen_ranked(ranked, ["model"], "feature", "importance_value", "feature", "feature_importance")


CHI_FEATURES = ["test_pass_count", "test_fail_count", "test_skip_count"]
CHI_ROWS = "\nUNION ALL\n".join(
    f"SELECT job, '{f}' AS feature, CAST(COALESCE({f}, -1) AS DOUBLE) AS v, CASE WHEN result = 'SUCCESS' THEN 0 ELSE 1 END AS y FROM jenkins_builds"
    for f in CHI_FEATURES
)
CHI_SQL = f"""SELECT job, feature, ROUND(SUM((o - e) * (o - e) / e), 6) AS statistic,
    CAST(COUNT(DISTINCT v) - 1 AS INT) AS dof
    FROM (SELECT g.job, g.feature, g.v, COALESCE(n, 0) AS o, CAST(rows_v AS DOUBLE) * rows_y / total AS e
          FROM (SELECT job, feature, v, COUNT(*) AS rows_v FROM ({CHI_ROWS}) a GROUP BY ALL) g
          JOIN (SELECT job, feature, y, COUNT(*) AS rows_y FROM ({CHI_ROWS}) b GROUP BY ALL) l ON g.job = l.job AND g.feature = l.feature
          JOIN (SELECT job, feature, COUNT(*) AS total FROM ({CHI_ROWS}) t GROUP BY ALL) t ON g.job = t.job AND g.feature = t.feature
          LEFT JOIN (SELECT job, feature, v, y, COUNT(*) AS n FROM ({CHI_ROWS}) c GROUP BY ALL) c
            ON g.job = c.job AND g.feature = c.feature AND g.v = c.v AND l.y = c.y) x
    GROUP BY job, feature"""


def _chi_by_job(d: Domain):
    labelled = features.label_indexer().transform(quality.label_builds(d.jenkins_builds))
    samples = labelled.select("job", "label", *[F.coalesce(f, F.lit(-1)).alias(f) for f in CHI_FEATURES])
    totals = samples.groupBy("job").agg(*chi2.outcome_counts())
    return chi2.chi_square(chi2.value_cells(samples, CHI_FEATURES, ["job"]), totals, ["job"])


@query("chi2_by_group", CHI_SQL, "jenkins_builds")
def chi2_by_group(d: Domain):
    return rounded(_chi_by_job(d), ["statistic"])


# Upper tail of chi-square as 1 - sum over n of e^-x x^(a+n) / gamma(a+n+1).
TAIL = """CASE WHEN dof = 0 OR statistic <= 0 THEN 1.0 ELSE GREATEST(0.0, 1.0 - list_sum(list_transform(generate_series(0, 2000),
    lambda k: exp((dof / 2.0 + k) * ln(statistic / 2.0) - statistic / 2.0 - lgamma(dof / 2.0 + k + 1))))) END"""


@query(
    "top10_chi2",
    f"""SELECT job, feature, ROUND(statistic, 6) AS statistic, dof, ROUND(p, 8) AS p_value, CAST(rank AS INT) AS rank
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job ORDER BY p, statistic DESC, feature) AS rank
              FROM (SELECT *, {TAIL} AS p FROM ({CHI_SQL.replace('ROUND(SUM((o - e) * (o - e) / e), 6)', 'SUM((o - e) * (o - e) / e)')}) c) t) r
        WHERE rank <= 10""",
    "jenkins_builds",
)
def top10_chi2(d: Domain):
    return rounded(rounded(chi2.top10_chi2(_chi_by_job(d), ["job"]), ["statistic"]), ["p_value"], 8)


PROJECT_CELLS = f"""SELECT organization, project, analysis_key, concat(direction, '_', rule) AS feature, COUNT(*) AS n
    FROM (SELECT organization, project, {RULE_EVENTS.split('SELECT', 1)[1]}) e GROUP BY ALL"""


@query(
    "issue_impact_chi2",
    f"""WITH cells AS MATERIALIZED ({PROJECT_CELLS}),
        outcomes AS MATERIALIZED (SELECT a.organization, a.project, a.analysis_key, CASE WHEN b.result = 'SUCCESS' THEN 0 ELSE 1 END AS y
            FROM jenkins_builds b JOIN sonar_analyses a ON b.revision_number = a.revision
            WHERE (a.organization, a.project, a.analysis_key) IN (SELECT (organization, project, analysis_key) FROM cells)),
        features AS (SELECT DISTINCT organization, project, feature FROM cells SEMI JOIN outcomes USING (organization, project, analysis_key)),
        rated AS MATERIALIZED (SELECT o.organization, o.project, f.feature, COALESCE(c.n, 0) AS v, y, COUNT(*) AS o
            FROM outcomes o JOIN features f USING (organization, project)
            LEFT JOIN cells c ON c.organization = o.organization AND c.project = o.project
              AND c.analysis_key = o.analysis_key AND c.feature = f.feature GROUP BY ALL),
        grid AS (SELECT g.organization, g.project, g.feature, g.v, l.y, CAST(rv AS DOUBLE) * ry / total AS e
            FROM (SELECT organization, project, feature, v, SUM(o) AS rv FROM rated GROUP BY ALL) g
            JOIN (SELECT organization, project, feature, y, SUM(o) AS ry FROM rated GROUP BY ALL) l USING (organization, project, feature)
            JOIN (SELECT organization, project, feature, SUM(o) AS total FROM rated GROUP BY ALL) t USING (organization, project, feature))
        SELECT organization, project, feature,
            ROUND(CASE WHEN COUNT(DISTINCT v) > 1 AND COUNT(DISTINCT y) > 1 THEN SUM((COALESCE(o, 0) - e) * (COALESCE(o, 0) - e) / e) ELSE 0 END, 6) AS statistic,
            CAST(CASE WHEN COUNT(DISTINCT y) > 1 THEN COUNT(DISTINCT v) - 1 ELSE 0 END AS INT) AS dof
        FROM grid LEFT JOIN rated USING (organization, project, feature, v, y) GROUP BY organization, project, feature""".replace("WITH cells", ", cells", 1),
    "sonar_issues sonar_analyses jenkins_builds",
)
def issue_impact_chi2(d: Domain):
    keys = ["organization", "project"]
    counts = rules.rule_counts(d.sonar_issues.drop("processed"), keys)
    cells = counts.select(*keys, "analysis_key", F.concat_ws("_", "direction", "rule").alias("slot"), "n")
    labelled = features.label_indexer().transform(quality.label_builds(d.jenkins_builds))
    outcomes = labelled.select("label", F.col("revision_number").alias("revision")).join(d.sonar_analyses, "revision")
    known = cells.select(*keys, "analysis_key").distinct()
    outcomes = outcomes.select(*keys, "analysis_key", "label").join(known, [*keys, "analysis_key"], "left_semi")
    return rounded(count_tests(cells, outcomes, keys), ["statistic"])
