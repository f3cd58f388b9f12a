"""Column expressions with the arithmetic of the analysed R code, all JVM-side built-ins.

Spark 4 runs with ANSI mode on: division by zero and unparsable dates raise. The analysed
code instead yields IEEE results (x/0 = Inf, -x/0 = -Inf, 0/0 = NaN) and NA for an
unparsable date, so ``ratio`` produces the IEEE values explicitly for a zero denominator
and dates are parsed with ``try_to_date``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The practice-id format and the national organisation code.
PRACTICE_ID_PATTERN = r"^W[0-9]{5}$"
NATIONAL_CODE = "WAL"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_INF = float("inf")
_NAN = float("nan")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Real division as a double, with IEEE results for a zero denominator (x/0 = +-Inf,
    0/0 = NaN, as in R) instead of an ANSI error; NULL when either side is NULL."""
    n = _col(numerator).cast("double")
    d = _col(denominator).cast("double")
    by_zero = (F.when(F.isnan(n), F.lit(_NAN))
               .when(n > 0, F.lit(_INF))
               .when(n < 0, F.lit(-_INF))
               .when(n == 0, F.lit(_NAN)))
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def floor_div(numerator: Column | str, denominator: Column | str) -> Column:
    """R's ``%/%``: floor of the real quotient (not truncation), as a double.

    NaN, infinities and values already integral (|q| >= 2^52) pass through unchanged: Spark's
    ``floor`` of a double returns a long, which would turn Inf into 2^63 - 1.
    """
    q = ratio(numerator, denominator)
    return (F.when(F.isnan(q) | (F.abs(q) >= F.lit(float(2 ** 52))), q)
            .otherwise(F.floor(q).cast("double")))


def round_half_even(x: Column | str, digits: int = 1) -> Column:
    """R's ``round(x, d)``: ties go to the even digit (0.25 -> 0.2)."""
    return F.bround(_col(x), digits)


def percent(x: Column | str) -> Column:
    return _col(x) * F.lit(100.0)


# 201501, 2015-01, 2015/1, 2015.1 or 2015 1
YEAR_MONTH_PATTERN = r"^([0-9]{4})(?:[-/. ]([0-9]{1,2})|([0-9]{2}))$"


def year_month(period: Column | str, fmt: str | None = None) -> Column:
    """lubridate ``ym()``: year-month text -> first day of that month; NULL if unparsable.

    Without ``fmt`` the year and the month may be written together or with a separator, and
    blanks around them are ignored; ``fmt`` names one spelling.
    """
    text = F.trim(_col(period).cast("string"))
    if fmt is not None:
        return F.try_to_date(text, fmt)
    month = F.regexp_replace(text, YEAR_MONTH_PATTERN, "$1-$2$3")
    return F.when(text.rlike(YEAR_MONTH_PATTERN), F.try_to_date(month, "yyyy-M"))


def month_start(d: Column | str) -> Column:
    """lubridate ``floor_date(d, "month")``."""
    return F.trunc(_col(d), "MM")


def starts_with(x: Column | str, prefix: str) -> Column:
    """SQL ``x LIKE 'prefix%'`` / regex ``^prefix``; a plain prefix test is pushed to Parquet."""
    return _col(x).startswith(prefix)


def starts_with_ci(x: Column | str, prefix: str) -> Column:
    """``lower(x) LIKE 'prefix%'`` (prefix given in lower case)."""
    return F.lower(_col(x)).startswith(prefix.lower())


_QUANTIFIERS = "*?{"
_SPECIAL = ".[]()|^$+*?{}\\"


def literal_prefix(pattern: str) -> tuple[str, bool]:
    """The text every match of an anchored regex starts with, and whether that is the whole pattern.

    ``('', False)`` if there is none: the pattern is not anchored at the start of the value, or
    it has alternatives, whose beginnings can differ.
    """
    if not pattern.startswith("^"):
        return "", False
    out: list[str] = []
    at = 1
    while at < len(pattern):
        c, step = pattern[at], 1
        if c == "\\":
            c, step = pattern[at + 1:at + 2], 2
            if not c or c.isalnum():  # a class, a boundary, a quotation: not a literal
                break
        elif c in _SPECIAL:
            break
        if pattern[at + step:at + step + 1] in tuple(_QUANTIFIERS):  # may be absent
            break
        out.append(c)
        at += step
        if pattern[at:at + 1] == "+":  # once at least, then more of it
            break
    if _alternatives(pattern):
        return "", False
    return "".join(out), at == len(pattern)


def _alternatives(pattern: str) -> bool:
    """Whether a ``|`` stands outside all groups and classes (or may: quoted parts count)."""
    depth, inside, at = 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1:at + 2] == "Q":
                return True
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
        at += 1
    return False


def str_detect(x: Column | str, pattern: str) -> Column:
    """``str_detect(x, pattern)``: whether a regex matches somewhere in the value.

    What an anchored pattern must start with is tested as a plain prefix too, which is pushed to
    the Parquet scan and skips row groups; the regex itself stays as the residual filter unless
    the prefix says it all. Patterns are Java's.
    """
    c = _col(x)
    prefix, whole = literal_prefix(pattern)
    if whole and prefix:
        return c.startswith(prefix)
    return c.startswith(prefix) & c.rlike(pattern) if prefix else c.rlike(pattern)


def is_valid_practice_id(x: Column | str, pattern: str = PRACTICE_ID_PATTERN) -> Column:
    """Whole-value format check ``^W[0-9]{5}$``; NULL stays NULL."""
    return _col(x).rlike(pattern)


def postcode_area(postcode: Column | str, width: int = 2) -> Column:
    """The first ``width`` characters of the postcode (always two in the analysed code)."""
    return F.substring(_col(postcode), 1, width)


def sum_na(x: Column | str, na: str = "skip") -> Column:
    """``sum`` with a choice of NULL policy.

    ``skip`` (default): SQL semantics, NULLs ignored.
    ``propagate``: R semantics without ``na.rm`` — any NULL in the group makes it NULL.
    """
    c = _col(x)
    if na == "skip":
        return F.sum(c)
    if na == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))
    raise ValueError(f"unknown na policy {na!r}")


def sum_where(condition: Column, x: Column | str, na: str = "skip") -> Column:
    """:func:`sum_na` over the rows that meet ``condition`` only."""
    return _where(F.sum, condition, x, na)


def max_where(condition: Column, x: Column | str, na: str = "skip") -> Column:
    """:func:`max_na` over the rows that meet ``condition`` only."""
    return _where(F.max, condition, x, na)


def _where(aggregate, condition: Column, x: Column | str, na: str) -> Column:
    met = F.when(condition, _col(x))
    if na == "skip":
        return aggregate(met)
    if na == "propagate":
        return F.when(F.count_if(condition) == F.count(met), aggregate(met))
    raise ValueError(f"unknown na policy {na!r}")


def max_na(x: Column | str, na: str = "skip") -> Column:
    """``max`` with the same NULL policies as :func:`sum_na`."""
    c = _col(x)
    if na == "skip":
        return F.max(c)
    if na == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(c), F.max(c))
    raise ValueError(f"unknown na policy {na!r}")
