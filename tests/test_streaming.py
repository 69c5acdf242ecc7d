"""Streaming ingest of dump files into the Parquet store."""

import os

from logweave.streaming.ingest import ingest_commit_dumps, latest_commits

US, RS = "\x1f", "\x1e"


def rec(sha, subject, epoch=1700000000):
    return US.join([sha, "Alice", "a@x.org", str(epoch), subject, ""]) + RS


def test_ingest_appends_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "alpha.log").write_text(rec("a1", "one") + rec("a2", "two"))
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")
    ingest_commit_dumps(spark, str(src), store, ckpt).awaitTermination()
    assert spark.read.parquet(store).count() == 2
    (src / "beta.log").write_text(rec("b1", "three"))
    ingest_commit_dumps(spark, str(src), store, ckpt).awaitTermination()
    got = sorted((r.repo, r.seq, r.sha) for r in spark.read.parquet(store).collect())
    assert got == [("alpha", 0, "a1"), ("alpha", 1, "a2"), ("beta", 0, "b1")]


def test_a_newer_dump_replaces_the_older(spark, tmp_path):
    store, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")
    for day, shas in ((1, ["a1"]), (2, ["a2", "a1"])):
        folder = tmp_path / "in" / f"day{day}"
        folder.mkdir(parents=True)
        names = ["alpha"] if day == 2 else ["alpha", "beta"]
        for name in names:
            (folder / f"{name}.log").write_text("".join(rec(s, "one") for s in shas))
            os.utime(folder / f"{name}.log", (1_700_000_000 + day * 86_400,) * 2)
        ingest_commit_dumps(spark, str(tmp_path / "in" / "*"), store, ckpt).awaitTermination()
    kept = latest_commits(spark.read.parquet(store))
    assert sorted((r.repo, r.seq, r.sha) for r in kept.collect()) == [("alpha", 0, "a2"), ("alpha", 1, "a1"), ("beta", 0, "a1")]
    assert spark.read.parquet(store).count() == 4
