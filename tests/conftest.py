import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from logweave.session import build_session
    scratch = tempfile.mkdtemp(prefix="logweave-tests-")
    s = build_session("local[4]", app="logweave-tests", shuffle_partitions=8,
                      extra={"spark.local.dir": scratch})
    s.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    from logweave.session import ship_package
    ship_package(s)
    yield s
    s.stop()


def commits_df(spark, rows, repo="r"):
    """rows: list of (seq, author, epoch_seconds, subject[, body])."""
    import datetime as dt
    from logweave.schema import COMMITS
    out = []
    for r in rows:
        seq, author, epoch, subject = r[:4]
        body = r[4] if len(r) > 4 else ""
        ts = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=epoch)
        out.append((repo, "HEAD", seq, f"{seq:040d}", author, author.lower() + "@x.org",
                    ts, subject, body, True))
    return spark.createDataFrame(out, COMMITS)
