"""Column helpers that mean the same in Spark and in ANSI SQL, and the naming rules of runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    """Half-up at six digits in a form that every engine evaluates alike."""
    return (F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).cast("double")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, default: float = 0.0, least: float = 0.0) -> Column:
    """a / b where b exceeds ``least``, else ``default``; never divides by zero."""
    return F.when(b > F.lit(least), a / F.when(b > F.lit(least), b)).otherwise(F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def scale_rows(v: Column) -> Column:
    """L2-normalised; a zero row stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / F.when(norm > 0, norm))).otherwise(v)


def order_hash(*parts: Column | str, seed: str = "") -> Column:
    """A reproducible shuffle key: md5 of the parts and the seed."""
    return F.md5(F.encode(F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(seed)), "UTF-8"))


def run_tag(k, latent, epochs_global, epochs_cluster, lr, reg) -> Column:
    return F.format_string("k%d_ld%d_eg%d_ec%d_lr%s_r%s", *[c.cast("int") for c in (k, latent, epochs_global, epochs_cluster)], short_number(lr), short_number(reg))


def short_number(x: Column) -> Column:
    """Like %g for the magnitudes of hyper-parameters: no trailing zeros."""
    text = F.format_string("%.6f", x)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")


def sync_latent(suffix: Column, latent: Column) -> Column:
    """The first ``_wnmf<digits>`` gets the latent dimension; other text stays."""
    head = F.regexp_extract(suffix, r"^(.*?_wnmf)\d+(.*)$", 1)
    tail = F.regexp_extract(suffix, r"^(.*?_wnmf)\d+(.*)$", 2)
    return F.when(head != "", F.concat(head, latent.cast("string"), tail)).otherwise(suffix)


def dataset_name(x: Column) -> Column:
    """Names of one data set in one spelling: lower case, no blanks, dashes or underscores at its ends or inside."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "")


def algorithm_family(name: Column) -> Column:
    return F.when(name.contains("||"), "parallel hybrid").when(name.contains("+"), "sequential hybrid").when(F.upper(name).contains("KMEANS"), "k-means").otherwise("single")


def experiment_id(*parts: Column) -> Column:
    return F.concat_ws("__", *[p.cast("string") for p in parts])


def decode_unit(values: list[float], bounds: dict[str, tuple[float, float]], whole: tuple[str, ...] = ("n_components",)) -> dict[str, float]:
    """A point of the unit box as hyper-parameters, keys in sorted order; counts are rounded and at least 1."""
    out: dict[str, float] = {}
    for x, name in zip(values, sorted(bounds), strict=True):
        low, high = bounds[name]
        value = low + min(1.0, max(0.0, x)) * (high - low)
        out[name] = max(1, round(value)) if name in whole else value
    return out


def pair_epochs(first: list[int], second: list[int]) -> list[tuple[int, int]]:
    """Position by position; one value serves for all of the other side; other lengths are an error."""
    if len(first) == 1:
        first = first * len(second)
    if len(second) == 1:
        second = second * len(first)
    if len(first) != len(second):
        raise ValueError("epoch lists differ in length")
    return list(zip(first, second, strict=True))
