"""Scalar column functions behind the charts and tables (values, not drawing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference:
TIMELINE_BAR_WIDTH = 32
HEAT_BAR_WIDTH = 18
HOT_RATIO = 0.7
WARM_RATIO = 0.4
ELLIPSIS = "…"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_start(ts="ts") -> Column:
    """P5: Monday of the (UTC) week, as DATE."""
    return F.to_date(F.date_trunc("week", _c(ts)))


def bar_cells(count, max_count, width: int) -> Column:
    """``max(1, round(count / max * width))`` with half-even rounding
    (Python ``round``); ``bround`` is half-even, ``round`` is not."""
    ratio = _c(count).cast("double") / _c(max_count).cast("double")
    return F.greatest(F.lit(1), F.bround(ratio * F.lit(float(width)), 0).cast("int"))


def heat_level(count, max_count) -> Column:
    """Ratio > 0.7 hot, > 0.4 warm, else cool."""
    r = _c(count).cast("double") / _c(max_count).cast("double")
    return (F.when(r > HOT_RATIO, F.lit("hot"))
            .when(r > WARM_RATIO, F.lit("warm"))
            .otherwise(F.lit("cool")))


def display_path(path="path") -> Column:
    """Paths with more than four parts shown as ``first/…/last2/last1``;
    others unchanged.  Parts follow ``pathlib``: empty and ``.`` segments
    vanish and a leading ``/`` is a part of its own.
    """
    p = _c(path)
    segs = F.filter(F.split(p, "/"), lambda s: (s != F.lit("")) & (s != F.lit(".")))
    absolute = p.startswith("/")
    n_parts = F.size(segs) + F.when(absolute, 1).otherwise(0)
    head = F.when(absolute, F.lit("/")).otherwise(F.element_at(segs, 1))
    sep = F.when(absolute, F.lit("")).otherwise(F.lit("/"))
    short = F.concat(head, sep, F.lit(ELLIPSIS), F.lit("/"),
                     F.element_at(segs, -2), F.lit("/"), F.element_at(segs, -1))
    return F.when(n_parts > 4, short).otherwise(p)
