"""The selection grammars for menus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selection(text: Column, total: Column) -> Column:
    """Sorted numbers of ``1, 3-5; 8``: one bad token makes it null, numbers outside 1 to ``total`` are dropped, none left is null.

    Ranges are cut to 1 to ``total`` before they are spelled out.
    """
    tokens = F.filter(F.transform(F.split(F.translate(text, "; ", ",,"), ","), lambda t: F.trim(t)), lambda t: t != "")
    good = F.forall(tokens, lambda t: t.rlike(r"^[0-9]+\s*(-\s*[0-9]+)?$"))
    end = lambda t, n: F.get(F.split(t, "-"), F.lit(n))
    number = lambda s: F.coalesce(F.trim(s).try_cast("long"), F.lit(1 << 62))

    def spread(t: Column) -> Column:
        a = number(end(t, 0))
        b = F.when(F.contains(t, F.lit("-")), number(end(t, 1))).otherwise(a)
        low, high = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), total.cast("long"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, spread))))
    return F.when(good & (F.size(chosen) > 0), chosen)


def menu_selection(text: Column, total: Column) -> Column:
    """The batch menu's variant: blanks vanish instead of separating, ranges are clamped to 1 to ``total``, bad tokens are ignored."""
    tokens = F.filter(F.split(F.translate(F.replace(text, F.lit(" "), F.lit("")), ";", ","), ","), lambda t: t.rlike("^[0-9]+(-[0-9]+)?$"))
    number = lambda s: F.coalesce(s.try_cast("long"), F.lit(1 << 62))

    def spread(t: Column) -> Column:
        a = number(F.get(F.split(t, "-"), F.lit(0)))
        b = number(F.coalesce(F.get(F.split(t, "-"), F.lit(1)), F.get(F.split(t, "-"), F.lit(0))))
        clamp = lambda x: F.least(F.greatest(x, F.lit(1)), total.cast("long"))
        ranged = F.contains(t, F.lit("-"))
        within = a.between(1, total)
        return F.when(ranged & (total > 0), F.sequence(clamp(F.least(a, b)), clamp(F.greatest(a, b)))).when(~ranged & within, F.array(a)).otherwise(F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, spread))))


def pick_by_number(items: DataFrame, chosen: DataFrame, n: str = "n") -> DataFrame:
    """Items whose ordinal is in ``chosen`` (column n)."""
    return items.join(chosen.select(n).distinct(), n)


def pick_by_name(files: DataFrame, names: DataFrame, *, name: str = "name", wanted: str = "wanted") -> DataFrame:
    """Files picked by name without extension, in any case."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    return files.withColumn("_k", bare(F.col(name))).join(names.select(F.lower(F.trim(wanted)).alias("_k")).distinct(), "_k", "left_semi").drop("_k")
