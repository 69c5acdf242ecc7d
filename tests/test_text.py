"""Scalar functions: tokenizer (F-4), titles, display helpers (K-6, K-11, K-15, K-16)."""

from pyspark.sql import functions as F

from logweave.functions import display as D
from logweave.functions import text as T


def one(spark, col, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(col.alias("o")).collect()[0].o


def test_tokenize_cases(spark):
    cases = {
        "RESOLVE NullPointer crash": ["resolve", "null", "pointer", "crash"],
        "fix the issue with a bad connection": ["issue", "bad", "connection"],
        "feat: add new login button": ["new", "login", "button"],
        "refactorUserService loginController": ["user", "service", "login", "controller"],
        "": [],
        "implement websocket authentication middleware":
            ["implement", "websocket", "authentication", "middleware"],
        "OAuthURLParser v2 2fa": ["oauth", "urlparser", "v2", "fa"],
        "café_überWidget": ["caf", "ber", "widget"],
    }
    for text, want in cases.items():
        assert one(spark, T.tokenize(F.col("v")), text) == want, text


def test_python_strip_set(spark):
    assert one(spark, T.py_strip(F.col("v")), "\x1f\x1e  hello 　\x85") == "hello"


def test_title_case(spark):
    for kws, want in [(["v2ray", "auth"], "V2Ray / Auth"), (["a2b3c"], "A2B3C"),
                      (["websocket", "auth", "token", "extra"], "Websocket / Auth / Token"),
                      ([], "Uncategorised")]:
        assert one(spark, T.keyword_title(F.col("v")), kws, "array<string>") == want


def test_display_path(spark):
    assert one(spark, D.display_path(F.col("v")), "b/c/d/e/f.py") == "b/…/e/f.py"
    assert one(spark, D.display_path(F.col("v")), "a/b/c/d") == "a/b/c/d"
    assert one(spark, D.display_path(F.col("v")), "/a/b/c/d") == "/…/c/d"


def test_bar_cells_half_even(spark):
    df = spark.createDataFrame([(1, 64), (3, 64), (1, 1000), (64, 64)], "c int, m int")
    got = [r.b for r in df.select(D.bar_cells("c", "m", 32).alias("b")).collect()]
    assert got == [max(1, round(1 / 64 * 32)), max(1, round(3 / 64 * 32)), 1, 32]
    assert round(1 / 64 * 32) == 0 and round(3 / 64 * 32) == 2  # half-even like Python


def test_heat_levels(spark):
    df = spark.createDataFrame([(8, 10), (5, 10), (4, 10), (7, 10)], "c int, m int")
    got = [r.h for r in df.select(D.heat_level("c", "m").alias("h")).collect()]
    assert got == ["hot", "warm", "cool", "warm"]


def test_small_scalars(spark):
    import datetime as dt
    assert one(spark, T.escape_pipe(F.col("v")), "a|b") == "a\\|b"
    assert one(spark, T.author_short(F.col("v")), "Bartholomew Longname-Smith") == "Bartholomew Long"
    assert one(spark, T.short_sha(F.col("v")), "0123456789abcdef") == "01234567"
    sunday = dt.datetime(2023, 11, 19, 23, 59)
    assert str(one(spark, D.week_start(F.col("v")), sunday, "timestamp_ntz")) == "2023-11-13"
    assert one(spark, T.message(F.col("v"), F.lit("")), "  subject only \x1f") == "subject only"
