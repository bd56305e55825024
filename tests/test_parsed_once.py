"""Tables that are read several times by one job are computed once."""

from buildlode.operators import landed


def test_a_tree_is_not_parsed_again_at_every_level(spark, capsys):
    folder = '{"_class":"com.cloudbees.hudson.plugins.folder.Folder","fullName":"%s","jobs":[{"_class":"com.cloudbees.hudson.plugins.folder.Folder","name":"%s"}]}'
    rows = [(folder % ("/".join("abcdef"[:n]), "abcdef"[n]),) for n in range(1, 6)]
    tree = landed.job_tree(spark.createDataFrame(rows, "node string"))
    tree.explain(True)
    assert "from_json" not in capsys.readouterr().out
    got = sorted((r.job, r.is_landed, r.level) for r in tree.collect())
    assert got == [("/".join("abcdef"[:n]), n < 6, n - 1) for n in range(1, 7)]
