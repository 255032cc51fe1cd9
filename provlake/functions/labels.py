"""The label lattice as Column expressions and aggregates.

A label set is a sorted ``array<string>``: at most one ordered sensitivity that matters (the
highest) plus any number of orthogonal flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.vocab import SENSITIVITY

CONFIDENTIAL = SENSITIVITY.index("confidential")


def label_rank(label: Column) -> Column:
    """0..3 for a sensitivity, -1 for a flag."""
    out = F.when(label == SENSITIVITY[0], 0)
    for i, name in enumerate(SENSITIVITY[1:], 1):
        out = out.when(label == name, i)
    return out.otherwise(-1)


def rank_name(rank: Column) -> Column:
    out = F.when(rank == 3, SENSITIVITY[3])
    for i in (2, 1):
        out = out.when(rank == i, SENSITIVITY[i])
    return out.otherwise(SENSITIVITY[0])


def sens_rank(labels: Column) -> Column:
    """Rank of the highest sensitivity present; ``public`` when none is."""
    return F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(labels, label_rank)), F.lit(0)))


def flags_of(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(
        F.filter(labels, lambda x: ~x.isin(*SENSITIVITY)), F.array().cast("array<string>"))))


def from_parts(rank: Column, flags: Column) -> Column:
    """The label set of a rank and a flag array."""
    flags = F.coalesce(flags, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(rank_name(rank)), flags)))


def join_sets(*sets: Column) -> Column:
    """Least upper bound of label sets (T-01, row form)."""
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(s, empty) for s in sets]) if sets else empty
    return from_parts(sens_rank(every), flags_of(every))


def join_agg(labels: Column) -> Column:
    """Least upper bound over a group (T-01, aggregate form).

    The flag side collects *distinct flag sets*, whose number is bounded by the vocabulary and not
    by the group, so a hot group stays small after the map-side combine.
    """
    flags = F.array_distinct(F.flatten(F.collect_set(flags_of(labels))))
    return from_parts(F.coalesce(F.max(sens_rank(labels)), F.lit(0)), flags)


def is_classified(labels: Column) -> Column:
    return (sens_rank(labels) >= CONFIDENTIAL) | (F.size(flags_of(labels)) > 0)


def dominates(a: Column, b: Column) -> Column:
    return (sens_rank(a) >= sens_rank(b)) & (
        F.size(F.array_except(flags_of(b), flags_of(a))) == 0)


def describe(labels: Column) -> Column:
    """Sensitivity first, then flags, each in name order."""
    sens = F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isin(*SENSITIVITY))))
    return F.array_join(F.concat(sens, flags_of(labels)), ",")


def text(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")
