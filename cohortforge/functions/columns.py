"""Column expressions used throughout: coercion, guards, ranks' quantiles, special functions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean yes, no, and missing; fixed values of the data dictionaries.
YES = ("positive", "pos", "yes", "true", "1", "1.0", "present", "detected")
NO = ("negative", "neg", "no", "false", "0", "0.0", "absent", "not detected")
MISSING = ("", "na", "nan", "n/a", "[not available]", "[unknown]", "unknown", "none", "null")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: str | Column) -> Column:
    """The value as a double; what is no number, or NaN, becomes null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: str | Column) -> Column:
    """True where the value is there and finite."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clip(c: str | Column, low: float | None, high: float | None) -> Column:
    """The value held between two bounds; null stays null."""
    x = col(c)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or null."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def tidy(c: str | Column, digits: int = 6) -> Column:
    """A double rounded for comparison; minus zero becomes zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def tristate(c: str | Column) -> Column:
    """1, 0 or null: a number above one half is 1; the known texts override numbers."""
    text = F.lower(F.trim(col(c).cast("string")))
    x = numeric(c)
    return F.when(text.isin(*YES), 1).when(text.isin(*NO), 0).when(x.isNotNull(), (x > 0.5).cast("int"))


def normalise_id(c: str | Column, pattern: str) -> Column:
    """Trimmed upper case with hyphens, cut to the first match of ``pattern`` if there is one; null stays null."""
    text = F.upper(F.replace(F.trim(col(c).cast("string")), F.lit("_"), F.lit("-")))
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit).otherwise(text)


def first_family(text: str | Column, families: Iterable[tuple[str, str]], default: str = "other") -> Column:
    """Name of the first (name, pattern) that the lower-case text matches; null and empty: ``unknown``."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.when(F.trim(t) == "", "unknown")
    for name, pattern in families:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise(default)


def all_families(text: str | Column, families: Iterable[tuple[str, str]]) -> Column:
    """Names of all families that the text matches, joined by ``|`` in their order."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return F.concat_ws("|", *(F.when(t.rlike(pattern), F.lit(name)) for name, pattern in families))


def one_hot_ordinal(flags: Iterable[tuple[str, float]]) -> tuple[Column, Column]:
    """Largest severity among the flags above one half, and 1 if none is."""
    scored = [F.when(F.col(c).cast("double") > 0.5, F.lit(float(v))) for c, v in flags]
    top = F.array_max(F.array(*scored))
    return top, top.isNull().cast("int")


def in_range(c: str | Column, low: float, high: float) -> Column:
    """The value if it lies in [low, high], else null."""
    x = numeric(c)
    return F.when(x.between(low, high), x)


def close(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol |b|."""
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))


def logistic(c: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


# Rational approximation of the normal quantile (Acklam 2003), fixed values.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _horner(coefficients: Iterable[float], x: Column) -> Column:
    out = F.lit(0.0)
    for k in coefficients:
        out = out * x + F.lit(k)
    return out


def normal_quantile(p: str | Column) -> Column:
    """Quantile of the standard normal, relative error under 1.2e-9; null outside (0, 1)."""
    p = col(p)
    tail = F.sqrt(F.lit(-2.0) * F.ln(F.when(p < 0.5, p).otherwise(F.lit(1.0) - p)))
    outer = _horner(_C, tail) / _horner((*_D, 1.0), tail)
    q = p - F.lit(0.5)
    r = q * q
    inner = _horner(_A, r) * q / _horner((*_B, 1.0), r)
    return F.when((p > 0) & (p < _LOW), outer).when((p >= _LOW) & (p <= 1 - _LOW), inner).when((p > 1 - _LOW) & (p < 1), -outer)


# Lanczos approximation of the log-gamma function (g = 7, nine terms), fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(c: str | Column) -> Column:
    """ln of the gamma function for arguments of at least one half."""
    z = col(c).cast("double") - F.lit(1.0)
    total = F.lit(_LANCZOS[0])
    for i, k in enumerate(_LANCZOS[1:], start=1):
        total = total + F.lit(k) / (z + F.lit(float(i)))
    t = z + F.lit(7.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + F.lit(0.5)) * F.ln(t) - t + F.ln(total)


def log_choose(n: str | Column, k: str | Column) -> Column:
    n, k = col(n), col(k)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def _reach(n: Column, m: Column, d: Column) -> Column:
    """How far from a place of a hypergeometric tail its terms count: ten deviations and some."""
    size = n.cast("double")
    variance = d * m / size * (1 - m / size) * (size - d) / F.greatest(size - 1, F.lit(1.0))
    return F.ceil(10 * F.sqrt(F.greatest(variance, F.lit(0.0)))).cast("long") + 50


def _summed(low: Column, high: Column, term) -> Column:
    """Sum of the terms from ``low`` to ``high``; nothing if they are the wrong way round."""
    return F.when(low <= high, F.aggregate(F.sequence(low, F.greatest(low, high)), F.lit(0.0), lambda a, i: a + term(i))).otherwise(0.0)


def hypergeometric_tail(overlap: str | Column, population: str | Column, marked: str | Column, drawn: str | Column) -> Column:
    """P(X >= overlap) for X hypergeometric; 1 where the overlap is not above zero, 0 beyond the most.

    Only terms within ten deviations of the tail's greatest are summed, so the work grows with the root of the counts.
    """
    k, n, m, d = (col(c).cast("long") for c in (overlap, population, marked, drawn))
    top, least = F.least(m, d), F.greatest(F.lit(0).cast("long"), m + d - n)
    middle = F.floor(m.cast("double") * d / n).cast("long")
    reach = _reach(n, m, d)
    low, high = F.greatest(k, least, middle - reach), F.least(top, F.greatest(k, middle) + reach)
    chance = lambda i: F.exp(log_choose(m, i) + log_choose(n - m, d - i) - log_choose(n, d))
    return F.when(k <= least, F.lit(1.0)).when(k > top, F.lit(0.0)).otherwise(F.least(_summed(low, high, chance), F.lit(1.0)))


def fisher_exact(a: str | Column, b: str | Column, c: str | Column, d: str | Column) -> Column:
    """Two-sided p-value of the table [[a, b], [c, d]]: the chance of all tables with its margins that are no likelier; null without rows in a line.

    The far tail is found by bisection, as chances fall to both sides of the mode; either tail is summed over ten deviations.
    """
    a, b, c, d = (col(x).cast("long") for x in (a, b, c, d))
    n, row, column = a + b + c + d, a + b, a + c
    least, top = F.greatest(F.lit(0).cast("long"), row + column - n), F.least(row, column)
    chance = lambda i: F.exp(log_choose(row, i) + log_choose(n - row, column - i) - log_choose(n, column))
    limit = chance(a) * (1 + 1e-7)
    mode = F.greatest(least, F.least(top, F.floor((row + 1).cast("double") * (column + 1) / (n + 2)).cast("long")))
    left = a <= mode

    def bisected(low: Column, high: Column, step) -> Column:
        ends = F.struct(low.alias("low"), high.alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(62)), ends, lambda v, _: F.when(v["low"] < v["high"], step(v["low"], v["high"])).otherwise(v))["low"]

    def upward(low, high):  # the least place that is no likelier; high is one past the last
        mid = F.floor((low + high) / 2).cast("long")
        fits = chance(mid) <= limit
        return F.struct(F.when(fits, low).otherwise(mid + 1).alias("low"), F.when(fits, mid).otherwise(high).alias("high"))

    def downward(low, high):  # the greatest; low is one ahead of the first
        mid = F.floor((low + high + 1) / 2).cast("long")
        fits = chance(mid) <= limit
        return F.struct(F.when(fits, mid).otherwise(low).alias("low"), F.when(fits, high).otherwise(mid - 1).alias("high"))

    reach = _reach(n, row, column)
    above = bisected(F.greatest(mode, a + 1), top + 1, upward)
    below = bisected(least - 1, F.least(mode, a - 1), downward)
    own = F.when(left, _summed(F.greatest(least, a - reach), a, chance)).otherwise(_summed(a, F.least(top, a + reach), chance))
    other = F.when(left, _summed(above, F.least(top, above + reach), chance)).otherwise(_summed(F.greatest(least, below - reach), below, chance))
    return F.when((row > 0) & (c + d > 0), F.least(own + other, F.lit(1.0)))


def incomplete_beta(a: str | Column, b: str | Column, x: str | Column) -> Column:
    """Regularised incomplete beta function for a and b of at least one half, by its continued fraction."""
    a, b, x = (col(c).cast("double") for c in (a, b, x))
    tiny = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(F.lit(1e-300))

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def turn(v, k):
            d = F.lit(1.0) / tiny(1 + k * v["d"])
            c = tiny(1 + k / v["c"])
            return F.struct(c.alias("c"), d.alias("d"), (v["h"] * d * c).alias("h"))

        def both(v, m):
            m = m.cast("double")
            return turn(turn(v, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

        first = F.lit(1.0) / tiny(1 - (a + b) * x / (a + 1))
        steps = F.sequence(F.lit(1), (F.lit(40) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), both)["h"]

    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    near = x < (a + 1) / (a + b + 2)
    inside = F.when(near, front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inside)))


def t_two_sided(t: str | Column, df: str | Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom; null where these are not above zero."""
    t, df = col(t).cast("double"), col(df).cast("double")
    return F.when(df > 0, incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def correlation_p(r: str | Column, n: str | Column, given: int = 0) -> Column:
    """Two-sided p-value of a (partial) correlation over n rows, given so many others; null with too few rows, 0 for one of size 1."""
    r, dof = col(r).cast("double"), col(n).cast("double") - 2 - given
    return F.when(dof <= 0, F.lit(None).cast("double")).when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided(r * F.sqrt(dof / (1 - r * r)), dof))


def binary_smd(p1: str | Column, p0: str | Column) -> Column:
    """Difference of two shares over the root of the mean of p (1 - p); without variance 0 for equal shares, else infinity."""
    p1, p0 = col(p1), col(p0)
    variance = (p1 * (1 - p1) + p0 * (1 - p0)) / 2
    return F.when(variance > 0, (p1 - p0) / F.sqrt(variance)).when(p1 == p0, F.lit(0.0)).when(p1.isNotNull() & p0.isNotNull(), F.lit(float("inf")))


def joined_texts(*columns: str | Column, mark: str = " | ") -> Column:
    """The trimmed texts of the columns that are not empty, with a mark between them."""
    return F.concat_ws(mark, *(F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in columns))


def json_strings(c: str | Column) -> Column:
    """All string values of a JSON text, at any depth, in their order, with escapes resolved; keys and numbers are left out.

    Every string is read whole from its first quote on, so nothing inside one is taken for another; those in front of a colon are keys.
    """
    every = F.regexp_extract_all(col(c), F.lit(r'("(?:[^"\\]|\\.)*+")(\s*:)?'), F.lit(0))
    return F.transform(F.filter(every, lambda x: ~x.endswith(":")), lambda x: F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0])


def set_overlap(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """Jaccard index and overlap coefficient of two arrays as sets; two empty sets, or one: 1."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    both, either, least = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), F.least(F.size(a), F.size(b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.nullif(either, F.lit(0))), F.when(least == 0, F.lit(1.0)).otherwise(both / F.nullif(least, F.lit(0)))
