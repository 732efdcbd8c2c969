"""Scalar rules shared by the operators. Each takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Upper edges of the eight scale bins, right-closed; anything above is bin 7.
SCALE_EDGES = (2, 5, 10, 25, 50, 100, 250)
# The same for the back-off keys and for trend/uplift bins.
BACKOFF_EDGES = (5, 10, 25, 50, 100, 250, 600)
TREND_EDGES = (0.5, 0.75, 0.95, 1.15, 1.5)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def half_even(x: Column) -> Column:
    return F.bround(x, 0)


def div(num, den) -> Column:
    """Ratio that is NULL where the denominator is zero or unknown."""
    return F.try_divide(F.col(num) if isinstance(num, str) else num,
                        (F.col(den) if isinstance(den, str) else den).cast("double"))


def div_floor(num: Column, den: Column, floor: float) -> Column:
    """Ratio over a denominator that is never below ``floor``."""
    return num / F.greatest(den.cast("double"), F.lit(float(floor)))


def window_scale(t1="t1", t2="t2", t3="t3") -> Column:
    return F.greatest((F.col(t1) + F.col(t2) + F.col(t3)) / F.lit(3.0), F.lit(1.0))


def right_closed_bin(x: Column, edges) -> Column:
    """0 for x <= edges[0], 1 for x <= edges[1], ... len(edges) beyond the last edge."""
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(x <= F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return out


def tenth_bin(p: Column) -> Column:
    return F.greatest(F.least(F.floor(p * 10), F.lit(9)), F.lit(0)).cast("int")


def log_ratio(a: Column, b: Column) -> Column:
    return F.log1p(a) - F.log1p(b)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start <= hi) & (end >= lo)


def text_id(c: str) -> Column:
    return F.trim(F.col(c))


def text_class(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


# Words that name a screening format, not the item itself.
FORMAT_WORDS = (
    r"imax|4dx|4d|3d|2d|dolby|atmos|screenx|onyx|velvet|satin|deluxe|premiere|gold\s*class|"
    r"ultra\s*xd|laser|dub(?:bing|bed)?|sub(?:title|titled|s)?|indo(?:nesia|nesian)?|"
    r"english|mandarin|re\s*release|rerelease|encore|sing\s*along|special\s*screening"
)
# Patterns of dearer formats and of releases shown again.
PREMIUM_FORMATS = "4dx|4d|dolby|screenx|onyx|velvet|satin|deluxe|gold"
RERELEASES = r"re\s*-?\s*release|rerelease|encore"
# Bracketed tags taken off a title before the exact look-up.
TITLE_TAGS = ("(IMAX 2D)", "(IMAX)", "(3D)", "(2D)", "(DUB)", "(DUBBING)", "(RE-RELEASE)", "(PREMIUM)")
# A trailing bracket is kept when it names a part of a series.
FAMILY_SUFFIX = r"\s*\((?![^)]*\b(?:PART|CHAPTER|VOL)\b)[^)]*\)\s*$"


def title_key(title: Column) -> Column:
    """Join key of a title: no brackets, no punctuation, no format words, single blanks."""
    no_brackets = F.regexp_replace(F.lower(title), r"[\(\[\{][^\)\]\}]*[\)\]\}]", " ")
    words = F.regexp_replace(no_brackets, r"[^a-z0-9]+", " ")
    bare = F.regexp_replace(words, r"\b(?:" + FORMAT_WORDS + r")\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title_untagged(title: Column) -> Column:
    out = F.upper(title)
    for tag in TITLE_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def title_family(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, FAMILY_SUFFIX, ""))


def first_listed(text: Column, delims: str = ",") -> Column:
    return F.trim(F.element_at(F.split(text, delims), 1))


def listed_count(text: Column, delims: str = ",") -> Column:
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), delims), lambda x: F.trim(x) != "")
    return F.size(parts)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")
