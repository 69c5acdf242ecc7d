"""Scalar column functions on commit text (all JVM-side, no UDFs).

Every function takes and returns ``Column`` so it composes inside
``select``/``withColumn`` and stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Stop words (general English, then commit-message noise words):
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did "
    "will would could should may might shall can need must "
    "this that these those i we you he she it they "
    "to of in on at by for with from as into and or but not no "
    "s t re ve ll d m"
).split()
GIT_STOP_WORDS = (
    "feat fix chore docs style refactor test perf ci build revert merge "
    "update add remove change bump version release minor major patch "
    "pr pull request branch commit initial first"
).split()
# Characters Python's str.strip() removes (str.isspace() is true).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Token pattern, lower->UPPER camel-case boundary, short-sha length.
TOKEN_PATTERN = r"[a-z][a-z0-9]*"
CAMEL_BOUNDARY = r"([a-z])([A-Z])"
SHORT_SHA_LEN = 8
AUTHOR_SHORT_LEN = 16
# ---------------------------------------------------------------------------

ALL_STOP_WORDS = tuple(dict.fromkeys(STOP_WORDS + GIT_STOP_WORDS))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()`` with Python's whitespace set (trims \\x1c-\\x1f too)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def message(subject="subject", body="body") -> Column:
    """``(subject + "\\n\\n" + body).strip()``."""
    return py_strip(F.concat(_c(subject), F.lit("\n\n"), F.coalesce(_c(body), F.lit(""))))


def commit_date(ts="ts") -> Column:
    """UTC calendar day of a TIMESTAMP_NTZ commit time."""
    return F.to_date(_c(ts))


def date_str(date="date") -> Column:
    return F.date_format(_c(date), "yyyy-MM-dd")


def short_sha(sha="sha") -> Column:
    """First 8 characters of the hash."""
    return F.substring(_c(sha), 1, SHORT_SHA_LEN)


def author_short(author="author") -> Column:
    """Author name cut to 16 characters (terminal column width)."""
    return F.substring(_c(author), 1, AUTHOR_SHORT_LEN)


def escape_pipe(text="subject") -> Column:
    """Escape ``|`` for Markdown table cells."""
    return F.replace(_c(text), F.lit("|"), F.lit("\\|"))


def tokenize(text="message") -> Column:
    """Camel-case split, lower-case, ``[a-z][a-z0-9]*`` tokens, drop
    one-letter tokens and stop words.  Returns ``array<string>`` in text order.

    Pure Catalyst: regexp_replace -> lower -> regexp_extract_all -> filter.
    """
    split_camel = F.regexp_replace(_c(text), CAMEL_BOUNDARY, "$1 $2")
    toks = F.regexp_extract_all(F.lower(split_camel), F.lit(TOKEN_PATTERN), 0)
    return F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(*ALL_STOP_WORDS))


def title_case(text) -> Column:
    """Python ``str.title()`` for ASCII text: a letter is upper-cased when the
    character before it is not a letter (so ``v2ray`` -> ``V2Ray``).

    ``initcap`` only starts words after spaces, so a marker space is put
    between a digit and a following letter, ``initcap`` runs, and the marker
    is removed again.
    """
    marked = F.regexp_replace(_c(text), r"([0-9])([A-Za-z])", "$1\u0001 $2")
    # also start a word after any other non-letter, non-space character
    marked = F.regexp_replace(marked, r"([^A-Za-z0-9 \u0001])([A-Za-z])", "$1\u0001 $2")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def keyword_title(keywords) -> Column:
    """P10: ``" / ".join(kws[:3]).title()`` or ``"Uncategorised"`` when empty."""
    kws = _c(keywords)
    joined = F.array_join(F.slice(kws, 1, 3), " / ")
    return F.when(F.size(kws) > 0, title_case(joined)).otherwise(F.lit("Uncategorised"))
