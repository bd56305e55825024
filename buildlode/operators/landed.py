"""Landed CI payloads (build and test report JSON) to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S
from ..session import cut_lineage

ACTION_COUNTS = "TestResultAction"
ACTION_REVISION = "BuildData"


def parse_payloads(landed: DataFrame) -> DataFrame:
    """Text columns ``payload`` and ``report`` to the structs ``build`` and ``tests``."""
    return landed.withColumns(
        {
            "build": F.from_json("payload", schemas.BUILD_PAYLOAD),
            "tests": F.from_json("report", schemas.TEST_REPORT),
        }
    ).drop("payload", "report")


def _last_action(kind: str, usable=lambda a: F.lit(True)) -> Column:
    """Last action of a class; NULL if there is none."""
    hits = F.filter("build.actions", lambda a: (S.class_tail(a["_class"]) == kind) & usable(a))
    return F.try_element_at(hits, F.lit(-1))


def revision() -> Column:
    """Revision of the last build-data action that names one."""
    hit = _last_action(ACTION_REVISION, lambda a: a["lastBuiltRevision"]["SHA1"].isNotNull())
    return hit["lastBuiltRevision"]["SHA1"]


def _pass_from(source: Column) -> Column:
    return S.pass_count(source["passCount"], source["totalCount"], source["failCount"], source["skipCount"])


def suite_duration() -> Column:
    """Report duration; over child reports the sum of those known, NULL if none is."""
    known = F.filter(
        F.transform("tests.childReports", lambda c: c["result"]["duration"]), lambda d: d.isNotNull()
    )
    summed = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, d: acc + d))
    kind = S.class_tail(F.col("tests._class"))
    return F.when(kind.isin(schemas.AGGREGATED_REPORT_KINDS), summed).when(
        kind == schemas.PLAIN_REPORT_KIND, F.col("tests.duration")
    )


def build_facts(parsed: DataFrame) -> DataFrame:
    """One row per build: number, outcome, revision and test counts.

    A test report wins over the counts in the build's actions; a report without a
    pass or total count leaves the pass count to the action.
    """
    action = _last_action(ACTION_COUNTS)
    has_report = F.col("tests").isNotNull()

    def pick(name: str) -> Column:
        return F.when(has_report, F.col(f"tests.{name}")).otherwise(action[name])

    return parsed.select(
        "*",
        S.build_number(F.col("build.id"), F.col("build.number")).alias("build_number"),
        revision().alias("revision_number"),
        F.coalesce(F.when(has_report, _pass_from(F.col("tests"))), _pass_from(action)).alias("test_pass_count"),
        pick("failCount").alias("test_fail_count"),
        pick("skipCount").alias("test_skip_count"),
        suite_duration().alias("total_test_duration"),
    )


def numbered(facts: DataFrame) -> DataFrame:
    """Builds with a number; the others cannot be stored."""
    return facts.where(F.col("build_number").isNotNull())


def _commits(items: str) -> str:
    """Commits of a build, each once. Mentions are sorted by id and place; where the id
    changes a run ends and the next begins, so the work is that of the sort."""
    mentions = f"transform({items}, (x, i) -> struct(x.commitId AS id, i AS at, x.date AS date))"
    ordered = f"array_sort(filter({mentions}, x -> x.id IS NOT NULL))"
    # Neighbours side by side; the list is named once per use, never inside a lambda.
    beside = "(x, y) -> struct(x AS a, y AS b)"
    after = f"filter(zip_with({ordered}, slice({ordered}, 2, greatest(size({items}), 1)), {beside}), z -> z.b IS NULL OR z.a.id <> z.b.id)"
    before = f"filter(zip_with({ordered}, concat(slice(transform({ordered}, x -> CAST(NULL AS STRING)), 1, 1), transform({ordered}, x -> x.id)), {beside}), z -> z.a IS NOT NULL AND (z.b IS NULL OR z.a.id <> z.b))"
    runs = f"zip_with({before}, {after}, (x, y) -> struct(x AS first, y AS last))"
    placed = f"array_sort(transform({runs}, r -> struct(r.first.a.at AS at, r.last.a.id AS id, r.last.a.date AS date)))"
    return f"transform({placed}, c -> struct(c.id AS commitId, c.date AS date))"


def explode_commits(facts: DataFrame, last_only: bool = False) -> DataFrame:
    """One row per commit of a numbered build; without commits one row of NULLs.

    A commit listed several times is one row with its last date, at the place of its first
    mention. ``last_only`` keeps only the last of them. A build without number gets no
    array, and its row is dropped after the explode: a filter before it would be pushed
    down and parse every payload twice.
    """
    commits = F.expr(_commits("build.changeSet.items"))
    if last_only:
        commits = F.slice(commits, F.greatest(F.size(commits), F.lit(1)), F.lit(1))
    none = F.array(F.struct(F.lit(None).cast("string").alias("commitId"), F.lit(None).cast("string").alias("date")))
    items = F.when(F.size(commits) > 0, commits).otherwise(none)
    exploded = facts.withColumn("item", F.explode_outer(F.when(F.col("build_number").isNotNull(), items)))
    return exploded.where(F.col("item").isNotNull()).withColumns(
        {"commit_id": F.col("item.commitId"), "commit_ts": S.commit_timestamp(F.col("item.date"))}
    ).drop("item")


def flatten_builds(landed: DataFrame, last_only: bool = False) -> DataFrame:
    """Landed payloads to rows of ``jenkins_builds``."""
    rows = explode_commits(build_facts(parse_payloads(landed)), last_only)
    return rows.select(
        "server",
        "job",
        F.col("build_number").cast("int").alias("build_number"),
        F.col("build.result").alias("result"),
        F.col("build.duration").alias("duration"),
        F.col("build.estimatedDuration").alias("estimated_duration"),
        "revision_number",
        "commit_id",
        "commit_ts",
        "test_pass_count",
        "test_fail_count",
        "test_skip_count",
        "total_test_duration",
    )


def flatten_tests(landed: DataFrame) -> DataFrame:
    """Landed test reports to rows of ``jenkins_tests``; unknown report kinds give none."""
    kind = S.class_tail(F.col("tests._class"))
    suites = F.when(
        kind.isin(schemas.AGGREGATED_REPORT_KINDS),
        F.flatten(F.transform("tests.childReports", lambda c: F.coalesce(c["result"]["suites"], F.array()))),
    ).when(kind == schemas.PLAIN_REPORT_KIND, F.col("tests.suites"))
    number = S.build_number(F.col("build.id"), F.col("build.number"))
    # The number is tested inside what is exploded: a filter on it would be pushed down
    # and parse the build a second time.
    rows = (
        parse_payloads(landed)
        .select("job", number.alias("build_number"), suites.alias("suites"))
        .select("job", "build_number", F.explode_outer(F.when(F.col("build_number").isNotNull(), F.col("suites"))).alias("suite"))
        .where(F.col("suite").isNotNull())
        .select("job", "build_number", F.col("suite.name").alias("suite"), F.explode("suite.cases").alias("case"))
    )
    return rows.select(
        "job",
        "build_number",
        S.package_of(F.col("suite")).alias("package"),
        S.class_tail(F.col("suite")).alias("class"),
        S.clean_case_name(F.col("case.name")).alias("name"),
        F.col("case.duration").alias("duration"),
        F.col("case.status").alias("status"),
    )


def unnumbered(landed: DataFrame) -> DataFrame:
    """How many landed builds have no usable number and are left out by the others."""
    facts = parse_payloads(landed).select(S.build_number(F.col("build.id"), F.col("build.number")).alias("n"))
    return facts.agg(F.count_if(F.col("n").isNull()).alias("unnumbered"), F.count("*").alias("landed"))


def flatten_job_tree(nodes: DataFrame) -> DataFrame:
    """One level of a CI job tree: folders give their children, jobs themselves.

    A child without a full name gets ``parent/name``. Deeper folders come out as rows
    flagged ``is_folder`` and go through the next pass once their node was landed.
    """
    parsed = nodes.select(F.from_json("node", schemas.JOB_NODE).alias("node"))
    children = F.transform(
        F.coalesce(F.col("node.jobs"), F.array()),
        lambda j: F.struct(
            F.coalesce(j["fullName"], F.concat_ws("/", F.col("node.fullName"), j["name"])).alias("job"),
            j["_class"].alias("kind"),
        ),
    )
    itself = F.array(F.struct(F.col("node.fullName").alias("job"), F.col("node._class").alias("kind")))
    rows = parsed.select(F.explode(F.when(S.is_folder(F.col("node._class")), children).otherwise(itself)).alias("j"))
    return rows.select("j.job", S.class_tail(F.col("j.kind")).alias("kind"), S.is_folder(F.col("j.kind")).alias("is_folder"))


def job_tree(nodes: DataFrame, roots: DataFrame | None = None, max_level: int = 100) -> DataFrame:
    """The whole tree below the roots: job, kind, is_folder, is_landed, level.

    Every landed node is followed from folder to folder until no folder is left. A folder
    whose node was not landed comes out with ``is_landed`` false, to be fetched. Without
    ``roots`` (column ``job``) the tree starts from landed nodes that no other node lists.
    A node may be landed in parts; a folder that lists one of its own ancestors is not
    followed there again. ``level`` is the shortest way.
    """
    parsed = nodes.select(F.from_json("node", schemas.JOB_NODE).alias("node"))
    known = parsed.select(F.col("node.fullName").alias("job"), F.col("node._class").alias("kind")).where("job IS NOT NULL").distinct()
    folders = parsed.where(S.is_folder(F.col("node._class"))).select(F.col("node.fullName").alias("parent"), F.explode("node.jobs").alias("j"))
    listed = folders.select(
        "parent", F.coalesce("j.fullName", F.concat_ws("/", "parent", "j.name")).alias("job"), F.col("j._class").alias("kind")
    ).distinct()
    # Every level of the recursion reads what was listed: it is parsed once, not once a level.
    known, listed = cut_lineage(known, "landed-nodes"), cut_lineage(listed, "listed-nodes")
    start = known.join(listed.select("job"), "job", "left_anti") if roots is None else known.join(roots.select("job"), "job", "left_semi")
    start = cut_lineage(start, "tree-roots")
    found = nodes.sparkSession.sql(
        f"""WITH RECURSIVE tree(job, kind, level, path) MAX RECURSION LEVEL {max_level} AS (
              SELECT job, kind, 0, array(job) FROM {{start}}
              UNION ALL
              SELECT l.job, l.kind, t.level + 1, array_append(t.path, l.job)
              FROM tree t JOIN {{listed}} l ON l.parent = t.job WHERE NOT array_contains(t.path, l.job))
            SELECT job, kind, min(level) AS level FROM tree GROUP BY job, kind""",
        start=start,
        listed=listed,
    )
    landed = known.select("job", F.lit(True).alias("landed")).distinct()
    return found.join(landed, "job", "left").select(
        "job",
        S.class_tail(F.col("kind")).alias("kind"),
        S.is_folder(F.col("kind")).alias("is_folder"),
        F.coalesce("landed", F.lit(False)).alias("is_landed"),
        "level",
    )


def exclude_folders(jobs: DataFrame, class_column: str = "kind") -> DataFrame:
    return jobs.where(~S.is_folder(F.col(class_column)))
