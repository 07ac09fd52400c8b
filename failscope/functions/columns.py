"""Small column helpers shared by all operators. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java flags that make \w, \s Unicode-aware and let `.` stop at \n only.
UNICODE = "(?Ud)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(col(c), F.lit(""))


def first_filled(*candidates: str | Column, default=None) -> Column:
    """First candidate that is neither null nor the empty text."""
    picks = [blank_to_null(c) for c in candidates]
    if default is not None:
        picks.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*picks)


def strip(c: str | Column) -> Column:
    """Cut every kind of white space at both ends (``trim`` cuts blanks only)."""
    return F.regexp_replace(col(c), UNICODE + r"^\s+|\s+$", "")


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``key`` in a small fixed table, written as one CASE expression."""
    expr = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    if default is not None:
        expr = expr.otherwise(default if isinstance(default, Column) else F.lit(default))
    return expr


def title_case(c: str | Column) -> Column:
    """``network_api_error`` -> ``Network Api Error``: every run of letters gets a capital.

    ``initcap`` alone starts words at white space only.
    """
    text = F.lower(F.replace(col(c), F.lit("_"), F.lit(" ")))
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def percent_text(share: str | Column) -> Column:
    """0.8721 -> ``87%``; ties go to the even number."""
    return F.concat(F.bround(col(share) * F.lit(100.0), 0).cast("int").cast("string"), F.lit("%"))


def percent_text_cut(share: str | Column) -> Column:
    """0.29 -> ``28%`` (0.29 * 100 is 28.999...): the fraction is cut, not rounded."""
    return F.concat((col(share) * F.lit(100.0)).cast("int").cast("string"), F.lit("%"))


def draw(seed: str | int, key: str | Column) -> Column:
    """A reproducible draw per row: the md5 of seed and key as 32 hex digits.

    Unlike ``rand`` it does not depend on partitioning or on task retries.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def draw_below(seed: str | int, key: str | Column, share: float) -> Column:
    """True for about ``share`` of the keys."""
    return F.substring(draw(seed, key), 1, 6) < F.lit(hex_bound(share))


def draw_int(seed: str | int, key: str | Column) -> Column:
    """A draw as a number below 2**24, independent of ``draw_below``."""
    return F.conv(F.substring(draw(seed, key), 7, 6), 16, 10).cast("bigint")


def hex_bound(share: float, digits: int = 6) -> str:
    """Upper bound, as hex text, that a uniform hex prefix stays below with chance ``share``."""
    return format(min(int(share * 16**digits), 16**digits - 1), f"0{digits}x")


def make_id(prefix: str, key: str | Column, digits: int = 32) -> Column:
    """``H-`` + upper-case hash of the row's own key.

    A random id would change when a lost task is run again. Ids are unique keys of stored
    tables, so all 32 digits are the default; eight, the short display form, start to
    collide near 2**16 rows.
    """
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.md5(col(key).cast("string")), 1, digits)))


NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_or(c: str | Column, default: float) -> Column:
    """Text to double; anything that is not a number becomes ``default``.

    The pattern guards against forms only Java accepts, such as ``1d``.
    """
    text = col(c).cast("string")
    return F.coalesce(F.when(text.rlike(NUMBER), text.try_cast("double")), F.lit(float(default)))


def flag_or_zero(c: str | Column, digits: bool = False) -> Column:
    """Text "True" -> 1, everything else -> 0; ``digits`` also takes "1"."""
    return F.when(col(c).isin(["True"] + (["1"] if digits else [])), F.lit(1)).otherwise(F.lit(0))
