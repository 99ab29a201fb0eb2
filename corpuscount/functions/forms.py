"""Small scalar forms: hosts, numbers with a default, durations, rounding, load triples and scaling laws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the score of a machine whose figures can't be read.
UNREADABLE = 999.0


def plain_host(host: Column) -> Column:
    """An IPv4 address without the prefix of its IPv6 form."""
    return F.regexp_replace(host, "^::ffff:", "")


def numeric_or(value: Column, default: float = UNREADABLE) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def full_name(name: Column, domain: str) -> Column:
    return F.concat(name, F.lit(domain))


def human_duration(ns: Column) -> Column:
    """Nanoseconds in the largest unit that they fill, with three decimals; whole below a microsecond."""
    form = lambda size, unit: F.format_string(f"%.3f {unit}", ns / F.lit(size))
    return F.when(ns >= 1e9, form(1e9, "s")).when(ns >= 1e6, form(1e6, "ms")).when(ns >= 1e3, form(1e3, "µs")).otherwise(F.format_string("%d ns", ns.cast("long")))


def rounded(value: Column, digits: int = 3) -> Column:
    return F.round(value, digits)


def load_triple(line: Column) -> Column:
    """The first three numbers of a load average line; null for a line that has none."""
    parts = F.split(F.trim(line), r"\s+")
    at = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull(), F.struct(at(0).alias("l1"), at(1).alias("l5"), at(2).alias("l15")))


def amdahl(n: Column, serial: Column | float) -> Column:
    """Speedup of n workers with this serial fraction."""
    f = F.lit(serial) if isinstance(serial, (int, float)) else serial
    return 1.0 / (f + (1.0 - f) / n)


def karp_flatt(speedup: Column, n: Column) -> Column:
    """The serial fraction that a measured speedup of n > 1 workers shows; null for one worker."""
    return F.when(n > 1, (1.0 / speedup - 1.0 / n) / (1.0 - 1.0 / n))


def without_download(t_map: Column, t_download_max: Column) -> Column:
    return t_map - F.coalesce(t_download_max, F.lit(0.0))
