"""Scalar expressions: text, parsing that fails loudly, templates, rounding, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_case(text) -> Column:
    """First letter of every run of letters upper case, the rest lower case ("KULLINGS-SKÖVDE" gives "Kullings-Skövde")."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def without_prefix(text, prefix: str) -> Column:
    return F.when(_c(text).startswith(prefix), F.substring(_c(text), len(prefix) + 1, 1 << 30)).otherwise(_c(text))


def parsed(text, pattern: str, *kinds: str) -> list[Column]:
    """The groups of a pattern that must match the whole text, cast to ``kinds``; another text fails the query."""
    t = _c(text)
    good = F.when(t.rlike(f"^(?:{pattern})$"), t).otherwise(F.raise_error(F.concat(F.lit(f"does not match {pattern}: "), F.coalesce(t, F.lit("null")))))
    return [F.regexp_extract(good, f"^(?:{pattern})$", i + 1).cast(k) for i, k in enumerate(kinds)]


def strict_number(text, kind: str = "int") -> Column:
    """A number from text: empty is null, anything else that is no number fails the query."""
    return F.nullif(F.trim(_c(text)), F.lit("")).cast(kind)


def filled(template: str, values: dict[str, Column]) -> Column:
    """``template`` with every ``{KEY}`` replaced; null values leave the key's place empty."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def relative_path(path, root: str) -> Column:
    """``path`` below ``root``; other paths stay as they are."""
    return without_prefix(path, root.rstrip("/") + "/")


def half_even(x, decimals: int = 0) -> Column:
    """Rounded to decimals, ties to the even digit."""
    return F.bround(_c(x), decimals)


def finite(x) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    v = _c(x).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def unit_costs(n, per_unit: dict[str, float]) -> list[Column]:
    """Costs of ``n`` units: a column a rate."""
    return [(_c(n) * rate).alias(name) for name, rate in per_unit.items()]


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those of the least seeded hash, the same however the table is dealt out."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
