"""Commit lists, job trees and high-water marks."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from buildlode.operators import landed
from buildlode.sources.marks import MarkTable

LANDED = "server string, job string, payload string, report string"


def landed_builds(spark, lists):
    rows = [("s", "j", json.dumps({"id": str(n), "number": n, "changeSet": {"items": i}}), None) for n, i in enumerate(lists, 1)]
    return spark.createDataFrame(rows, LANDED)


def plain(items):
    listed = [(i["commitId"], i.get("date")) for i in items if i.get("commitId") is not None]
    last = dict(listed)
    return [(c, last[c]) for c in dict.fromkeys(c for c, _ in listed)] or [(None, None)]


def test_commits_equal_a_plain_merge(spark):
    rnd = random.Random(2)
    date = lambda: rnd.choice([None, f"2020-01-{rnd.randrange(10, 20)}T00:00:00.000Z"])
    lists = [
        [{"commitId": rnd.choice("abcde"), "date": date()} if rnd.random() < 0.9 else {"x": "y"} for _ in range(rnd.randrange(9))]
        for _ in range(200)
    ]
    got = defaultdict(list)
    for r in landed.flatten_builds(landed_builds(spark, lists)).collect():
        got[r.build_number].append((r.commit_id, r.commit_ts and r.commit_ts.strftime("%Y-%m-%dT%H:%M:%S.000Z")))
    last = {r.build_number: r.commit_id for r in landed.flatten_builds(landed_builds(spark, lists), last_only=True).collect()}
    for n, items in enumerate(lists, 1):
        assert sorted(got[n], key=str) == sorted(plain(items), key=str)
        assert last[n] == plain(items)[-1][0]


def test_a_build_of_very_many_commits(spark):
    items = [{"commitId": f"c{k % 30000}"} for k in range(60000)]
    assert landed.flatten_builds(landed_builds(spark, [items])).count() == 30000


FOLDER, JOB = "x.folder.Folder", "hudson.model.FreeStyleProject"


def tree(spark, *nodes):
    texts = [(json.dumps({"_class": kind, "fullName": name, "jobs": jobs}),) for kind, name, jobs in nodes]
    return spark.createDataFrame(texts, "node string")


def test_tree_follows_folders_in_parts_and_stops_in_cycles(spark):
    folder, job = (lambda n: {"_class": FOLDER, "name": n}), (lambda n: {"_class": JOB, "name": n})
    back = {"_class": FOLDER, "fullName": "a"}
    nodes = tree(
        spark,
        (FOLDER, "a", [folder("b")]), (FOLDER, "a", [job("one"), folder("lost")]),
        (FOLDER, "a/b", [folder("c")]), (FOLDER, "a/b/c", [job("two"), {"_class": JOB, "fullName": "a/one"}]),
        (JOB, "alone", None), (FOLDER, "r", []),
        (FOLDER, "x", [{"_class": FOLDER, "fullName": "y"}]), (FOLDER, "y", [{"_class": FOLDER, "fullName": "x"}, back]),
    )
    got = {r.job: (r.is_folder, r.is_landed, r.level) for r in landed.job_tree(nodes).collect()}
    # Only y lists a, so a is no root here; x and y list each other and are none either.
    assert got == {"alone": (False, True, 0), "r": (True, True, 0)}
    roots = spark.createDataFrame([("x",), ("unknown",)], "job string")
    got = {r.job: (r.is_folder, r.is_landed, r.level) for r in landed.job_tree(nodes, roots).collect()}
    assert got == {
        "x": (True, True, 0), "y": (True, True, 1), "a": (True, True, 2), "a/b": (True, True, 3), "a/one": (False, False, 3),
        "a/lost": (True, False, 3), "a/b/c": (True, True, 4), "a/b/c/two": (False, False, 5),
    }
    assert landed.job_tree(nodes.where(F.lit(False))).isEmpty()


def test_marks_rise_whatever_the_order_and_repeat(spark, folder):
    form = "server string, job string, build_number int"
    marks = MarkTable(spark, f"{folder}/m")
    fetched = spark.createDataFrame([("s", "j", 8), ("s", "j", 9), ("t", None, 0), ("n", "n", 1)], form)
    assert marks.new_builds(fetched).count() == 4
    for n, rows in enumerate([[("s", "j", 8)], [("s", "j", 3), ("t", None, 4)], [("s", "j", 1)]]):
        for _ in range(2):
            marks.merge(spark.createDataFrame(rows, form), f"load-{n}", folders=1)
    assert {tuple(r) for r in marks.latest().collect()} == {("s", "j", 8), ("t", None, 4)}
    assert {tuple(r) for r in marks.new_builds(fetched).collect()} == {("s", "j", 9), ("n", "n", 1)}
