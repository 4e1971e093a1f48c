"""Statistics, sorting and complex numbers of array cells, as expressions of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import whole


def sort(m: Column) -> Column:
    """Ascending; null last."""
    return F.array_sort(m)


def quantile(m: Column, *shares: float) -> Column:
    """The quantiles, by linear interpolation between the sorted elements (null elements left out)."""
    ordered = F.array_sort(F.filter(m, lambda x: x.isNotNull()))
    bound = F.transform(F.array(ordered), lambda s: F.transform(F.array(*[F.lit(float(q)) for q in shares]), lambda q: _interpolated(s, q)))
    return F.get(bound, F.lit(0))


def _interpolated(ordered: Column, q: Column) -> Column:
    place = q * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, low).cast("double"), F.get(ordered, F.least(low + 1, F.size(ordered) - 1)).cast("double")
    return a + (b - a) * (place - low)


def boxplot(m: Column) -> Column:
    """Minimum, quartiles, maximum."""
    return quantile(m, 0.0, 0.25, 0.5, 0.75, 1.0)


def sd(m: Column) -> Column:
    """The standard deviation of a sample, as an array of one."""
    return F.array(whole(m, "std"))


def _centred(m: Column, power: int) -> Column:
    """The mean of the centred elements' power."""
    mean = F.array(whole(m, "avg"))
    return F.get(F.transform(mean, lambda c: F.try_divide(F.aggregate(m, F.lit(0.0), lambda a, x: a + F.pow(x - c, F.lit(float(power)))), F.size(m))), F.lit(0))


def stats(m: Column) -> Column:
    """Mean, variance, standard deviation (of a sample), skewness, excess kurtosis, minimum, maximum."""
    second = _centred(m, 2)
    skew = F.try_divide(_centred(m, 3), F.pow(second, F.lit(1.5)))
    kurtosis = F.try_divide(_centred(m, 4), second * second) - 3
    return F.array(whole(m, "avg"), whole(m, "var"), whole(m, "std"), skew, kurtosis, whole(m, "min"), whole(m, "max"))


def histogram(m: Column, bins: int, low: float | None = None, high: float | None = None) -> Column:
    """Counts of ``bins`` equal bins between low and high (the array's own extremes without them); the last bin holds its upper edge."""
    a = F.lit(float(low)) if low is not None else F.array_min(m).cast("double")
    b = F.lit(float(high)) if high is not None else F.array_max(m).cast("double")
    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda r: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(m, lambda x: (x >= r["a"]) & (x <= r["b"]) & (F.coalesce(F.least(F.floor(F.try_divide((x - r["a"]) * bins, r["b"] - r["a"])).cast("int"), F.lit(bins - 1)), F.lit(0)) == k))).cast("double")))
    return F.get(bound, F.lit(0))


def _pair_sums(y: Column, x: Column) -> Column:
    names = ("n", "x", "y", "xx", "xy", "yy")
    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    return F.aggregate(pairs, zero, lambda a, p: F.struct((a["n"] + 1).alias("n"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y"), (a["xx"] + p["x"] * p["x"]).alias("xx"), (a["xy"] + p["x"] * p["y"]).alias("xy"), (a["yy"] + p["y"] * p["y"]).alias("yy")))


def _places(m: Column) -> Column:
    return F.transform(m, lambda _, i: (i + 1).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation, as an array of one; null if an array is constant."""
    bound = F.transform(F.array(_pair_sums(b, a)), lambda s: F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], F.sqrt(F.greatest((s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"]), F.lit(0.0)))))
    return bound


def fit_linear_coeff(y: Column, x: Column | None = None) -> Column:
    """Intercept and slope of the least-squares line over x (the positions without it)."""
    sums = _pair_sums(y, _places(y) if x is None else x)
    return F.get(F.transform(F.array(sums), lambda s: F.transform(F.array(F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"])), lambda slope: F.array((s["y"] - slope * s["x"]) / s["n"], slope))), F.lit(0))[0]


def fit_linear(y: Column, x: Column | None = None) -> Column:
    """The values of the least-squares line."""
    at = _places(y) if x is None else x
    return F.get(F.transform(F.array(fit_linear_coeff(y, x)), lambda c: F.transform(at, lambda v: F.get(c, F.lit(0)) + F.get(c, F.lit(1)) * v)), F.lit(0))


# Complex arrays: array<struct<re, im>>.


def complex_array(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda a, b: F.struct(a.cast("double").alias("re"), b.cast("double").alias("im")))


def complex_get_abs(m: Column) -> Column:
    return F.transform(m, lambda z: F.hypot(z["re"], z["im"]))


def complex_get_arg(m: Column) -> Column:
    return F.transform(m, lambda z: F.atan2(z["im"], z["re"]))


def complex_get_real(m: Column) -> Column:
    return F.transform(m, lambda z: z["re"])


def complex_get_imag(m: Column) -> Column:
    return F.transform(m, lambda z: z["im"])


def complex_to_polar(m: Column) -> Column:
    """(modulus, phase) in place of (re, im)."""
    return F.transform(m, lambda z: F.struct(F.hypot(z["re"], z["im"]).alias("re"), F.atan2(z["im"], z["re"]).alias("im")))


def complex_to_rect(m: Column) -> Column:
    """(re, im) of (modulus, phase)."""
    return F.transform(m, lambda z: F.struct((z["re"] * F.cos(z["im"])).alias("re"), (z["re"] * F.sin(z["im"])).alias("im")))
