"""End-to-end: analyse + hotfiles plans on the driver's sf0.001 tables,
writing every report format."""

import os

from pyspark.sql import functions as F

from logweave.operators import cluster as cl
from logweave.operators import labels as L
from logweave.plans import analyse as an
from logweave.sinks import reports as S
from logweave.sources import tables

SF = "/root/testdata/sf0.001"


def test_analyse_writes_reports(spark, tmp_path):
    commits = tables.commits_from_documents(spark, SF)
    t = an.analyse(commits, max_commits=None, threshold=0.2, min_size=2, k=8)
    kwl = cl.keyword_lists(t.keywords)
    labels = L.keyword_labels(cl.cluster_sizes(t.assignment, 2), kwl)
    total = commits.count()
    ranked = t.ranked.collect()
    assert len(ranked) == total
    clustered = sum(1 for r in ranked if r.cluster_id is not None)
    S.write_report_json(S.report_json_frame(commits, t.ranked, labels, "g"), str(tmp_path / "j"))
    S.write_report_markdown(S.report_markdown_lines(commits, t.ranked, labels, "g"), str(tmp_path / "m"))
    S.write_report_csv(S.report_csv_frame(commits, t.ranked, labels), str(tmp_path / "c"))
    csv = spark.read.options(**S.CSV_OPTIONS).csv(str(tmp_path / "c"))
    assert csv.count() == total
    assert csv.filter("theme = 'Unclustered'").count() == total - clustered
    md = spark.read.text(str(tmp_path / "m"))
    assert md.filter("value LIKE '# Commit Themes%'").count() == commits.select("repo").distinct().count()
    js = spark.read.json(str(tmp_path / "j"))
    assert js.groupBy().sum("commit_count").first()[0] == clustered
    assert js.filter("kind = 'commit'").count() == clustered


def test_greedy_analyse_window(spark):
    commits = tables.commits_from_documents(spark, SF)
    t = an.analyse(commits, max_commits=5, algorithm="greedy")
    per_repo = t.ranked.groupBy("repo").count().collect()
    assert all(r["count"] <= 5 for r in per_repo)


def test_hotfiles_plan(spark, tmp_path):
    numstat = tables.numstat_from_lineitem(spark, SF)
    commits = tables.commits_from_orders(spark, SF)
    hot = an.hotfiles(numstat, commits, since="1995-01-01", max_commits=None, top=5)
    rows = hot.collect()
    assert rows and all(r.rank <= 5 for r in rows)
    S.write_churn_csv(S.churn_csv_frame(hot), str(tmp_path / "h"))
    out = spark.read.options(**S.CSV_OPTIONS).csv(str(tmp_path / "h"))
    assert out.columns[:6] == ["rank", "path", "commit_count", "lines_added", "lines_deleted", "churn_score"]
    assert out.count() == len(rows)


def test_one_ref_is_analysed(spark):
    rows = [("r", ref, i, f"{ref}{i}", "a", "a@x", "2024-01-0%d 00:00:00" % (i + 1), "harbour lantern", "")
            for ref in ("HEAD", "side") for i in range(3)]
    commits = spark.createDataFrame(rows, "repo string, ref string, seq long, sha string, author string, email string, "
                                          "ts string, subject string, body string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in an.analyse(commits).ranked.select("seq", "cluster_id").collect()) == [(0, 1), (1, 1), (2, 1)]
    numstat = spark.createDataFrame([("r", ref, 0, 0, 1, 1, "f") for ref in ("HEAD", "side")],
                                    "repo string, ref string, commit_seq long, line_no long, added long, deleted long, path string")
    assert [r.commit_count for r in an.hotfiles(numstat, commits, min_commits=1).collect()] == [1]


def test_refs_are_logs_of_their_own(spark):
    words = {"main": ["harbour lantern", "harbour lantern", "copper kettle"], "dev": ["copper kettle", "harbour lantern", "copper kettle"],
             "old": ["harbour lantern"] * 3}
    rows = [(repo, ref, i, f"{ref}{i}", "a", "a@x", "2024-01-01 00:00:00", text, "")
            for repo in ("r", 'q"uo,te', None) for ref, texts in words.items() for i, text in enumerate(texts)]
    commits = spark.createDataFrame(rows, "repo string, ref string, seq long, sha string, author string, email string, "
                                          "ts string, subject string, body string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    t = an.analyse_refs(commits, ["main", "dev"])
    got = {(str(r.repo), r.ref, r.seq): r.cluster_id for r in t.ranked.collect()}
    assert got == {(str(repo), ref, i): {"main": [1, 1, None], "dev": [1, None, 1]}[ref][i]
                   for repo in ("r", 'q"uo,te', None) for ref in ("main", "dev") for i in range(3)}
    assert {(r.ref, r.term) for r in t.keywords.collect()} == {("main", "harbour"), ("main", "lantern"), ("dev", "copper"), ("dev", "kettle")}
    newest = an.analyse_refs(commits, max_commits=1)
    assert newest.docs.count() == 9 and all("ref" in getattr(newest, n).columns for n in ("docs", "postings", "assignment", "clusters"))


def test_report_goes_from_log_to_files(spark, tmp_path):
    from logweave.plans import catalog
    import json
    commits = tables.commits_from_documents(spark, SF).filter("repo IN ('src0', 'src1', 'src2')")
    args = dict(labeller=catalog.review_labeller, generated_at="g", min_size=1)
    r = an.report(commits, str(tmp_path / "out.json"), summariser=catalog.line_counter, **args)
    for repo in ("src0", "src1", "src2"):
        folder = tmp_path / "out.json" / f"repo={repo}"
        doc = json.loads("".join(f.read_text() for f in sorted(folder.iterdir()) if f.name.startswith("part-")))
        assert doc["themes_found"] == len(doc["themes"]) >= 2
        assert sum(t["commit_count"] for t in doc["themes"]) == doc["total_commits"] == 10
        assert doc["overall_summary"].startswith(f"{3 + len(doc['themes']) + 10} lines, first - ")
        assert all(t["action_items"].startswith("Check ") for t in doc["themes"])
    assert r.overall.count() == 3
    md = an.report(commits, str(tmp_path / "out.md"), summariser=catalog.line_counter, **args)
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "out.md")).collect())
    assert "## Executive Summary" in text and "> **Action:** Check " in text and md.overall is not None
    plain = an.report(commits, str(tmp_path / "out.csv"), min_size=1)
    assert plain.overall is None and spark.read.options(**S.CSV_OPTIONS).csv(str(tmp_path / "out.csv")).count() == commits.count()
