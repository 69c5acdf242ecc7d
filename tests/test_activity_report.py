"""Activity (F-2, K-12..K-14), filters (F1-F4), report joins and sinks (F-6)."""

import datetime as dt
import json
import os

from conftest import commits_df
from pyspark.sql import functions as F

from logweave.operators import activity as A
from logweave.operators import filters as flt
from logweave.operators import labels as L
from logweave.operators import report as R
from logweave.sinks import reports as S


def test_author_counts_ties_first_seen(spark):
    c = commits_df(spark, [(0, "Alice", 1, "a"), (1, "Bob", 2, "b"), (2, "Alice", 3, "c")])
    top = {r.author: (r.n_commits, r.author_rank) for r in A.top_authors(c, 5).collect()}
    assert top == {"Alice": (2, 1), "Bob": (1, 2)}
    c2 = commits_df(spark, [(0, "Bob", 1, "a"), (1, "Carol", 2, "b"), (2, "Alice", 3, "c")])
    order = [r.author for r in sorted(A.top_authors(c2, 5).collect(), key=lambda r: r.author_rank)]
    assert order == ["Bob", "Carol", "Alice"]


def test_dates_and_velocity(spark):
    c = commits_df(spark, [(0, "Alice", 1700086400, "x"), (1, "Alice", 1700000000, "y")])
    days = [str(r.date) for r in A.commits_by_date(c).orderBy("date").collect()]
    assert days == ["2023-11-14", "2023-11-15"]
    v = A.author_velocity(c).collect()[0]
    assert v.span_days == 2 and abs(v.avg_per_week - 7.0) < 1e-12
    w = A.weekly_timeline(c).collect()
    assert len(w) == 1 and str(w[0].week_start) == "2023-11-13" and w[0].bar_cells == 32


def test_weekly_last_n_nonempty(spark):
    rows = [(i, "A", 1700000000 + i * 14 * 86400, "x") for i in range(30)]
    t = A.weekly_timeline(commits_df(spark, rows), max_weeks=26).collect()
    assert len(t) == 26 and max(r.week_back for r in t) == 26


def test_header_positional_dates(spark):
    c = commits_df(spark, [(0, "A", 1700000000, "new"), (1, "B", 1600000000, "old"),
                           (2, "A", 1650000000, "mid")])
    h = A.log_header(c).collect()[0]
    assert h.total_commits == 3 and str(h.newest_date) == "2023-11-14"
    assert str(h.oldest_date) == "2022-04-15" and h.top_authors == "A 2  B 1"


def test_filters(spark):
    c = commits_df(spark, [(0, "Alice", 1700000000, "a"), (1, "Bob", 1600000000, "b"),
                           (2, "Alice", 1500000000, "c")])
    assert flt.filter_log(c, since="2020-01-01").count() == 2
    assert flt.filter_log(c, until=dt.date(2020, 1, 1)).count() == 1
    assert flt.filter_log(c, author="^Ali").count() == 2
    assert flt.filter_log(c, author="bob@x").count() == 1
    assert [r.seq for r in flt.select_log(c, author="Alice", max_count=1).collect()] == [0]
    now = dt.datetime(2024, 3, 31)
    assert flt.parse_time_bound("1 month ago", now) == dt.datetime(2024, 2, 29)
    assert flt.parse_time_bound("2 weeks ago", now) == dt.datetime(2024, 3, 17)
    assert flt.parse_time_bound("2.weeks.ago", now) == dt.datetime(2024, 3, 17)
    late = dt.datetime(2024, 3, 31, 15, 30)
    assert flt.parse_time_bound("yesterday", late) == dt.datetime(2024, 3, 30, 15, 30)
    assert flt.parse_time_bound("Today", late) == dt.datetime(2024, 3, 31)
    assert flt.parse_time_bound("now", late) == late
    import pytest
    with pytest.raises(ValueError):
        flt.parse_time_bound("last tuesday")


def _report_inputs(spark):
    epoch = int(dt.datetime(2026, 1, 15, 12, 0).replace(tzinfo=dt.timezone.utc).timestamp())
    subjects = ["feat: add OAuth", "fix: token expiry", "feat: add dashboard", "chore: update deps"]
    commits = commits_df(spark, [(i, "Alice", epoch, s) for i, s in enumerate(subjects)])
    ranked = spark.createDataFrame([("r", 0, 0, 1, 2), ("r", 1, 0, 1, 2), ("r", 2, 2, 2, 1),
                                    ("r", 3, 3, None, None)],
                                   "repo string, seq long, seed_seq long, cluster_id int, size long")
    labels = spark.createDataFrame(
        [("r", 1, "Auth Work", "Moved auth to its own module.", "Review token expiry logic."),
         ("r", 2, "Frontend Work", "Moved auth to its own module.", "Review token expiry logic.")],
        "repo string, cluster_id int, title string, summary string, action_items string")
    return commits, ranked, labels


def test_report_json_and_csv(spark, tmp_path):
    commits, ranked, labels = _report_inputs(spark)
    rec = S.report_json_frame(commits, ranked, labels, "2026-01-01T00:00:00+00:00").collect()
    assert {r.theme: r.commit_count for r in rec if r.kind == "theme"} == {1: 2, 2: 1}
    assert [(r.total_commits, r.themes_found) for r in rec if r.kind == "repo"] == [(4, 2)]
    assert {(r.theme, r.seq) for r in rec if r.kind == "commit"} == {(1, 0), (1, 1), (2, 2)}
    assert all(len(r.sha) == 8 for r in rec if r.kind == "commit")
    lone = S.report_json_frame(commits, ranked.withColumn("cluster_id", F.lit(None).cast("int")), labels, "g").collect()
    assert [(r.kind, r.total_commits, r.themes_found) for r in lone] == [("repo", 4, 0)]  # a repo without themes
    out = str(tmp_path / "json")
    S.write_report_json(S.report_json_frame(commits, ranked, labels, "g"), out)
    lines = [json.loads(x) for f in sorted(os.listdir(out)) if f.endswith(".json")
             for x in open(os.path.join(out, f))]
    assert {d["title"] for d in lines if d["kind"] == "theme"} == {"Auth Work", "Frontend Work"}
    assert lines[0]["kind"] == "repo" and set(lines[0]) == {"repo", "kind", "generated_at", "total_commits",
                                                            "themes_found", "overall_summary"}
    assert set().union(*lines) >= {"title", "summary", "action_items", "commit_count", "earliest", "latest",
                                   "n_authors", "author", "sha", "date", "subject"}
    csv = S.report_csv_frame(commits, ranked, labels).orderBy("seq").collect()
    assert csv[3].theme == "Unclustered" and csv[0].theme == "Auth Work"
    path = str(tmp_path / "csv")
    S.write_report_csv(S.report_csv_frame(commits, ranked, labels), path)
    part = [f for f in os.listdir(os.path.join(path, "repo=r")) if f.endswith(".csv")][0]
    text = open(os.path.join(path, "repo=r", part)).read().splitlines()
    assert text[0] == "sha,date,author,theme,subject" and text[4].endswith("Unclustered,chore: update deps")


def test_report_markdown(spark):
    commits, ranked, labels = _report_inputs(spark)
    lines = S.report_markdown_lines(commits, ranked, labels, "2026-01-01 00:00 UTC")
    text = "\n".join(r.text for r in lines.orderBy("section", "line_no").collect())
    assert "### 1. Auth Work" in text and "### 2. Frontend Work" in text
    assert "> **Action:** Review token expiry logic." in text
    assert "## Unclustered Commits" in text and "*1 commits did not fit any theme.*" in text
    all_in = ranked.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(2)))
    text2 = "\n".join(r.text for r in S.report_markdown_lines(commits, all_in, labels, "g").collect())
    assert "Unclustered" not in text2


def test_rollup_summary_and_labels(spark):
    commits, ranked, labels = _report_inputs(spark)
    roll = {r.cluster_id: r for r in R.theme_rollup(ranked, commits, labels).collect()}
    assert roll[1].commit_count == 2 and roll[1].authors == "Alice"
    assert [r.seq for r in R.unclustered(commits, ranked).collect()] == [3]
    parsed = spark.createDataFrame([("  Title here \n\n Summary.\nNone\n",), ("",)], "t string") \
        .select(L.parse_label("t").alias("p")).collect()
    assert tuple(parsed[0].p) == ("Title here", "Summary.", "None")
    assert tuple(parsed[1].p) == ("Miscellaneous", "", "None")


def test_label_themes_fallback(spark):
    prompts = spark.createDataFrame([("r", 1, "p1"), ("r", 2, "p2")],
                                    "repo string, cluster_id int, prompt string")
    fallback = spark.createDataFrame([("r", 1, "A", "", "None"), ("r", 2, "B", "", "None")],
                                     "repo string, cluster_id int, title string, summary string, action_items string")
    ok = L.label_themes(prompts, lambda ps: [f"T {p}\nS\nAct" for p in ps], fallback, 2).collect()
    assert {r.title for r in ok} == {"T p1", "T p2"}

    def broken(ps):
        raise RuntimeError("service down")
    bad = L.label_themes(prompts, broken, fallback, 2).collect()
    assert {r.title for r in bad} == {"A", "B"}


def test_export_format():
    assert S.export_format("out.csv") == "csv" and S.export_format("r.md") == "markdown"
    assert S.export_format("r.txt") == "json" and S.export_format("r.csv", "json") == "json"


def test_label_function_called_once_per_prompt(spark, tmp_path):
    log = str(tmp_path / "calls.txt")
    prompts = spark.createDataFrame([("r", i, f"p{i}") for i in range(1, 7)],
                                    "repo string, cluster_id int, prompt string")
    fallback = prompts.selectExpr("repo", "cluster_id", "'x' AS title", "'' AS summary",
                                  "'None' AS action_items")

    def fn(ps):
        with open(log, "a") as f:
            for p in ps:
                f.write(p + "\n")
        return [f"T {p}" for p in ps]
    out = L.label_themes(prompts, fn, fallback, 3).collect()
    assert sorted(r.title for r in out) == [f"T p{i}" for i in range(1, 7)]
    calls = open(log).read().split()
    assert sorted(calls) == [f"p{i}" for i in range(1, 7)]


def _counting(log):
    def fn(ps):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in ps)
        return [f"T {p}\nS\nA" for p in ps]
    return fn


def test_journal_survives_a_lost_task(spark, tmp_path):
    """A task that dies behind its call: what it has got is not asked again."""
    import pytest
    log, folder = str(tmp_path / "calls.txt"), f"file://{tmp_path}/journal"
    prompts = spark.createDataFrame([("r", i, f"p{i % 4}") for i in range(1, 7)],
                                    "repo string, cluster_id int, prompt string")

    def lost(it):
        for _ in it:
            raise SystemError("executor lost")
        yield from ()
    with pytest.raises(Exception, match="executor lost"):
        L.responses(prompts, _counting(log), folder, 1).mapInPandas(lost, "x int").count()
    asked = open(log).read().split()
    assert sorted(asked) == ["p0", "p1", "p2", "p3"]  # equal prompts are asked once
    fallback = prompts.selectExpr("repo", "cluster_id", "'x' AS title", "'' AS summary", "'None' AS action_items")
    out = L.label_themes(prompts, _counting(log), fallback, 3, folder).collect()
    assert sorted(r.title for r in out) == sorted(f"T p{i % 4}" for i in range(1, 7))
    assert open(log).read().split() == asked


def test_summaries_stream_keep_chunks_and_journal(spark, tmp_path):
    log, folder = str(tmp_path / "calls.txt"), f"file://{tmp_path}/journal"
    rows = [("a", 5, "last"), ("a", 0, "first"), ("a", 3, "mid"), ("b", 0, "x"), ("c", 0, "broken"), ("c", 1, "y"), ("d", 0, "skips"), ("d", 1, "z")]
    lines = spark.createDataFrame(rows, "repo string, line_no long, text string")

    def fn(it):
        first = next(it)
        with open(log, "a") as f:
            f.write(first + "\n")
        if first == "skips":
            return "whole text"
        def chunks():
            yield first
            if first == "broken":
                raise ConnectionError("gone")
            for x in it:
                yield "+" + x
        return chunks()
    for n in (1, 3):
        got = {r.repo: r.overall_summary for r in L.summarise_repos(lines, fn, n, folder).collect()}
        assert got == {"a": "first+mid+last", "b": "x", "c": "broken", "d": "whole text"}
    assert sorted(open(log).read().split()) == sorted(["first", "x", "skips", "broken", "broken"])
    assert L.summarise_repos(lines.limit(0), fn).count() == 0


def _document(lines):
    order = sorted(lines, key=lambda r: (r.section, r.part, r.author is not None, r.author or "", r.seq is not None, r.seq or 0))
    return json.loads("\n".join(r.text for r in order))


def test_nested_documents_equal_flat_records(spark, tmp_path):
    commits, ranked, labels = _report_inputs(spark)
    commits = commits.withColumn("author", F.when(F.col("seq") == 1, 'B "q" \\ ü ').otherwise(F.col("author")))
    commits = commits.unionByName(commits.withColumn("repo", F.lit("other")))  # a repo without themes
    overall = spark.createDataFrame([("r", 'All "good"\nnow')], "repo string, overall_summary string")
    lines = S.report_json_lines(commits, ranked, labels, "g", overall)
    rows = lines.collect()
    doc = _document([r for r in rows if r.repo == "r"])
    assert _document([r for r in rows if r.repo == "other"]) == {
        "generated_at": "g", "repo": "other", "total_commits": 4, "themes_found": 0, "overall_summary": "", "themes": []}
    assert list(doc) == ["generated_at", "repo", "total_commits", "themes_found", "overall_summary", "themes"]
    assert doc["overall_summary"] == 'All "good"\nnow' and (doc["total_commits"], doc["themes_found"]) == (4, 2)
    flat = S.report_json_frame(commits, ranked, labels, "g", overall).collect()
    for k, theme in enumerate(doc["themes"], 1):
        row = next(r for r in flat if r.kind == "theme" and r.theme == k)
        assert {f: theme[f] for f in ("title", "summary", "action_items", "commit_count")} == \
            {f: row[f] for f in ("title", "summary", "action_items", "commit_count")}
        assert theme["date_range"] == {"earliest": row.earliest, "latest": row.latest}
        assert theme["authors"] == sorted(r.author for r in flat if r.kind == "author" and r.theme == k)
        assert theme["commits"] == [{f: r[f] for f in ("sha", "date", "author", "subject")}
                                    for r in sorted((r for r in flat if r.kind == "commit" and r.theme == k), key=lambda r: r.seq)]
    out = str(tmp_path / "docs")
    S.write_report_documents(lines, out)
    folder = os.path.join(out, "repo=r")
    text = "".join(open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert json.loads(text) == doc
