"""Composite labels ('a_b'), composite feature names ('f+g') and names with parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "none"

# Combinations that are classes of their own, and single labels from rare to frequent.
COMBINATIONS = (("bedded", "chewing"), ("bedded", "foraging"), ("bedded", "grooming"), ("bedded", "looking around"))
PRIORITIES = ("lie down", "stand up", "neutral", "snow", "grooming", "looking around", "travel", "chewing", "foraging", "bedded")


def joined(labels: Column) -> Column:
    """Sorted distinct labels as a composite; 'none' without any."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), "_"), F.lit("")), F.lit(NONE))


def pieces(composite: Column) -> Column:
    return F.split(composite, "_")


def unique_class(composite: Column) -> Column:
    """FN21: a single label as it is, a frequent combination as its class, else the rarest label that the composite holds, else null."""
    parts = F.array_sort(F.array_distinct(pieces(composite)))
    out = F.when(~composite.contains("_"), composite)
    for combo in COMBINATIONS:
        out = out.when(parts == F.array_sort(F.array(*map(F.lit, combo))), F.lit("_".join(combo)))
    for label in PRIORITIES:
        out = out.when(composite.contains(label), F.lit(label))
    return out


def binarised(composite: Column, classes: list[str]) -> Column:
    """ML02: one 0/1 a class, classes sorted."""
    own = pieces(composite)
    return F.array(*[F.array_contains(own, F.lit(c)).cast("int") for c in sorted(classes)])


def feature_names(name: str | list[str]) -> list[str]:
    return name if isinstance(name, list) else name.split("+")


def feature_name(names: str | list[str]) -> str:
    """FN22: the composite of a list of names, which may not hold the separator themselves."""
    if isinstance(names, str):
        return names
    if any("+" in n for n in names):
        raise ValueError("a feature name may not hold '+'")
    return "+".join(names)


def name_number(name: Column, pattern: str) -> Column:
    """FN14: the number in a name, null if the pattern isn't in it."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("double")


def stride(fps: Column, n_frames: Column, by_fps: Column, per_video: Column, fixed: Column) -> Column:
    """FN15: frames from one sampled frame to the next, from the first parameter that is given: frames a second, frames a video, or the stride itself."""
    at_rate = F.ceil(fps / F.when(by_fps == 0, 1.0).otherwise(by_fps))
    return F.coalesce(at_rate, F.ceil(n_frames / per_video), fixed).cast("bigint")


def tester(name: Column) -> Column:
    """EX12: kind of uniformity test, pval (.001 where none is given) and m of an explorer's name."""
    kind = F.when(name.startswith("cvm"), "cvm").when(name.startswith("binom"), "binom").otherwise("aks")
    number = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("double")
    return F.struct(kind.alias("kind"), F.coalesce(number(r"pval(\d*\.?\d+)"), F.lit(0.001)).alias("pval"), number(r"_m(\d*\.?\d+)").alias("m"))


#: Feature name prefixes that name an extractor, tried in this order.
EXTRACTORS = ("clip", "r3d", "i3d", "mvit", "pot")


def extractor(name: Column) -> Column:
    """VX04: the extractor whose prefix a feature name has; null without one."""
    return F.coalesce(*[F.when(name.startswith(prefix), F.lit(prefix)) for prefix in EXTRACTORS])


def named(column: Column, name: str) -> Column:
    """FN10: whether a feature's name is this one, whatever the case of its letters."""
    return F.lower(column) == name.lower()
