"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Trimmed, every run of white space made one blank, lower case. Null stays null."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " ")))


def finite(c: Column | str) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def tile(c: Column | str, size: float) -> Column:
    """Number of the half-open tile of this size; floor, so that -0.5 lies in tile -1."""
    return F.floor(_c(c) / F.lit(float(size))).cast("bigint")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null where b is 0 or null."""
    b = _c(b).cast("double")
    return F.when(b != 0, _c(a).cast("double") / b)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(_c(c), digits)


def uniform(*parts: Column | str) -> Column:
    """A repeatable number in (0, 1) made from the parts: it depends on neither partitioning nor row order.

    The first 13 hexadecimal digits of an md5, so that other SQL engines give the same number.
    """
    text = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    head = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Hart's rational approximation of the normal tail (numerator and denominator, highest power first).
_HART_UP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_DOWN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once: f names it many times, and Spark would write it out each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _normal_tail(z: Column) -> Column:
    a = F.abs(z)
    up, down = F.lit(_HART_UP[0]), F.lit(_HART_DOWN[0])
    for c in _HART_UP[1:]:
        up = up * a + c
    for c in _HART_DOWN[1:]:
        down = down * a + c
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.exp(-a * a / 2) * F.when(a < 7.07106781186547, up / down).otherwise(1 / (far * 2.506628274631))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def normal_tail(z: Column | str) -> Column:
    """P(N > z) of the standard normal distribution, to about 14 digits. Null stays null."""
    z = _c(z).cast("double")
    return F.when(z.isNotNull(), _once(z, _normal_tail))


def _chi2_tail(v: Column) -> Column:
    x, k = v["x"], v["k"]
    h = F.greatest(x / 2, F.lit(1e-300))
    odd = k % 2 == 1
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    first = F.when(odd, F.log(h) / 2 - h + F.lit(0.1207822376352452)).otherwise(-h)  # minus the log of Gamma(3 / 2), or of Gamma(1)
    zero = F.struct(first.alias("log"), F.lit(0.0).alias("sum"))
    step = lambda acc, i: F.struct((acc["log"] + F.log(h) - F.log(i + 1 + shift)).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))
    terms = F.floor(k / 2).cast("int")
    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(terms - 1, F.lit(0))), zero, step, lambda acc: acc["sum"])).otherwise(F.lit(0.0))
    total = total + F.when(odd, 2 * _once(F.sqrt(x), _normal_tail)).otherwise(F.lit(0.0))
    return F.when((k > 0) & (x > 0), F.least(F.lit(1.0), total)).when((k > 0) & (x == 0), F.lit(1.0))


def chi2_tail(x: Column | str, dof: Column | str) -> Column:
    """P(X > x) of the chi-square distribution with a whole number of degrees of freedom: a finite sum of Poisson-like
    terms, plus a normal tail where the number is odd. Null where x is null or dof is not above 0."""
    return _once(F.struct(_c(x).cast("double").alias("x"), _c(dof).cast("int").alias("k")), _chi2_tail)


def t_two_sided(t: Column | str, dof: int) -> Column:
    """P(|T| > |t|) of Student's t with a whole number of degrees of freedom, by its finite trigonometric sum."""
    odd = dof % 2 == 1

    def outside(a: Column) -> Column:
        c, total = 1.0, F.lit(0.0)
        for j in range((dof - 1) // 2 if odd else dof // 2):
            c = 1.0 if j == 0 else c * (2 * j / (2 * j + 1) if odd else (2 * j - 1) / (2 * j))
            total = total + c * F.pow(F.cos(a), F.lit(float(2 * j + (1 if odd else 0))))
        inside = F.lit(0.6366197723675814) * (a + F.sin(a) * total) if odd else F.sin(a) * total
        return F.greatest(F.lit(0.0), 1 - inside)

    t = _c(t).cast("double")
    return F.when(t.isNotNull(), _once(F.atan(F.abs(t) / F.sqrt(F.lit(float(dof)))), outside))
