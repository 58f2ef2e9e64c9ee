"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICRO = 1_000_000


def micro(x: Column) -> Column:
    """A real number on the grid of millionths, as a long; exact sums and ties from there on."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null, which greatest and least alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _horner(r: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * r + F.lit(c)
    return out


_CENTRAL = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
    [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0],
)
_MIDDLE = (
    [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0],
)
_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
    [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0],
)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile by Wichura's published rational approximations (AS 241), null outside (0, 1)."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    central = q * _horner(r, _CENTRAL[0]) / _horner(r, _CENTRAL[1])
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(t <= 5.0, _horner(t - 1.6, _MIDDLE[0]) / _horner(t - 1.6, _MIDDLE[1])).otherwise(_horner(t - 5.0, _FAR[0]) / _horner(t - 5.0, _FAR[1]))
    return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.425, central).when(q < 0, -tail).otherwise(tail)


def joined_key(*parts: Column | str) -> Column:
    """Readable composite keys: the parts with '|' between them."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def seed_of(material: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number, which Spark holds as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(material.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")



def utc_text(seconds: Column) -> Column:
    """Unix seconds as 'yyyy-MM-dd HH:mm:ss UTC', whatever the session's time zone; null stays null."""
    days = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3600), two(F.pmod(rest, F.lit(3600)) / 60), two(F.pmod(rest, F.lit(60))))
    return F.when(seconds.isNotNull(), F.concat(days.cast("string"), F.lit(" "), clock, F.lit(" UTC")))


def utc_seconds(text: Column) -> Column:
    """Unix seconds of an ISO text; blank and unreadable give null, a text without a zone is UTC."""
    clean = F.trim(text)
    zoned = clean.rlike("(Z|[+-][0-9]{2}:?[0-9]{2}|UTC)$")
    full = F.when(zoned, F.regexp_replace(clean, " ?UTC$", "Z")).otherwise(F.concat(clean, F.lit("Z")))
    return F.when(F.length(clean) > 0, F.unix_seconds(F.try_to_timestamp(full)))


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between their runs, for names of files."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def shortened(text: Column, head: int = 6, tail: int = 4) -> Column:
    """The first and last letters of a long name."""
    return F.when(F.length(text) <= head + tail + 1, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(tail))))


def hex_id(size: int, *address: Column | str) -> Column:
    """'0x' and `size` bytes in hexadecimal, at most 32, drawn from an address."""
    return F.concat(F.lit("0x"), F.substring(F.sha2(joined_key(*address).cast("binary"), 256), 1, 2 * size))


def decimal_id(*address: Column | str) -> Column:
    """A decimal number of up to 38 digits drawn from an address, as token names are written."""
    return F.conv(F.substring(F.sha2(joined_key(*address).cast("binary"), 256), 1, 15), 16, 10)


def log_factorial(n: Column) -> Column:
    """ln n! from sums of logarithms below 16 and Stirling's series above, to 1e-12; no table and no join."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(16)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.log(k.cast("double")))
    inv = F.lit(1.0) / x
    series = inv / 12 - inv * inv * inv / 360 + F.pow(inv, F.lit(5)) / 1260 - F.pow(inv, F.lit(7)) / 1680
    return F.when(n < 16, small).otherwise(x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)
