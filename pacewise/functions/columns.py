"""Column-expression helpers shared by every layer.

All of these build JVM-side Catalyst expressions (no Python UDFs), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacewise.config import AS_OF


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def round_half_up(c, digits: int) -> Column:
    """Portable rounding: floor(x * 10^n + 0.5) / 10^n on doubles.

    Spark's ROUND on doubles goes through BigDecimal and rounds 1.005 up while
    other engines round the binary value down; this form gives the same double
    in every IEEE engine. It rounds ties toward +inf, so negative exact ties
    (e.g. -0.125 -> -0.12) differ from ROUND.
    """
    x = col_or_lit(c).cast("double")
    scale = float(10 ** digits)
    return (F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def as_of_ts(as_of: _dt.datetime = AS_OF) -> Column:
    return F.lit(as_of).cast("timestamp")


def as_of_date(as_of: _dt.datetime = AS_OF) -> Column:
    return F.lit(as_of.date()).cast("date")


def flag(cond: Column) -> Column:
    """CASE WHEN cond THEN true ELSE false: a NULL condition becomes false."""
    return F.coalesce(cond, F.lit(False))


def count_if(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as bigint."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct_text(c) -> Column:
    """CONCAT(CAST(x AS STRING), '%'); NULL stays NULL."""
    return F.concat(col_or_lit(c).cast("string"), F.lit("%"))


# ---------------------------------------------------------------------------
# Platform alias sets. They must equal the original pipeline's
# canonicalisation for results to match.
# Campaign platforms (union of the variants):
#   Meta: meta, facebook, instagram
#   TikTok: tiktok
#   CM360: cm360, dcm, campaign manager
#   DV360: dv360, display video 360
#   Amazon DSP: amazon dsp, amazon
#   Snapchat: snap, snapchat
# Ticket platforms (narrower list):
#   Meta: meta, facebook
#   TikTok: tiktok
#   CM360: cm360, dcm
# ---------------------------------------------------------------------------
CAMPAIGN_PLATFORM_ALIASES = [
    ("Meta", ["meta", "facebook", "instagram"]),
    ("TikTok", ["tiktok"]),
    ("CM360", ["cm360", "dcm", "campaign manager"]),
    ("DV360", ["dv360", "display video 360"]),
    ("Amazon DSP", ["amazon dsp", "amazon"]),
    ("Snapchat", ["snap", "snapchat"]),
]
TICKET_PLATFORM_ALIASES = [
    ("Meta", ["meta", "facebook"]),
    ("TikTok", ["tiktok"]),
    ("CM360", ["cm360", "dcm"]),
]


def canonical_platform(c, aliases=CAMPAIGN_PLATFORM_ALIASES) -> Column:
    """Ordered CASE over lower(trim(platform)); unknown values pass through trimmed."""
    raw = col_or_lit(c)
    key = F.lower(F.trim(raw))
    expr = None
    for name, names in aliases:
        cond = key.isin(*names)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.trim(raw))


def allowed_or_default(c, allowed: list[str], default: str) -> Column:
    t = F.trim(col_or_lit(c))
    return F.when(t.isin(*allowed), t).otherwise(F.lit(default))


def rank_of(c, ordered: list[str], other: int) -> Column:
    """CASE c WHEN v1 THEN 1 WHEN v2 THEN 2 ... ELSE other."""
    col = col_or_lit(c)
    expr = None
    for i, v in enumerate(ordered, start=1):
        expr = F.when(col == v, F.lit(i)) if expr is None else expr.when(col == v, F.lit(i))
    return expr.otherwise(F.lit(other))
