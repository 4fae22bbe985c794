"""Premises as joins.

Atoms are joined in a greedy order: the one of the delta first, then always one that adds fewest new
variables and has most that are bound.  An atom that adds nothing later parts need is a semi-join; columns
that are not needed any more are dropped before the next join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ir import Atom

#: Tables of fewer bytes are scanned by few tasks.  So many matches at most are few enough for few tasks.
SMALL_BYTES, MANY_ROWS = 64 << 20, 10_000_000


def most_matches(sizes: list[int]) -> int:
    """Bound of the matches of tables of so many bytes, at 8 bytes a row or more."""
    return math.prod(max(1, s // 8) for s in sizes)


def order(premise: tuple[Atom, ...], first: int | None) -> list[int]:
    left = [i for i in range(len(premise)) if i != first]
    out = [] if first is None else [first]
    bound: set[int] = set(premise[first].vars) if first is not None else set()
    while left:
        best = min(left, key=lambda i: (not bound & set(premise[i].vars) if bound else False, len(set(premise[i].vars) - bound), -len(set(premise[i].vars) & bound), i))
        left.remove(best)
        out.append(best)
        bound |= set(premise[best].vars)
    return out


def columns_of(atom: Atom, table: DataFrame) -> DataFrame:
    """A table's rows as bindings: one column for each variable, equal where the atom repeats it."""
    first: dict[int, int] = {}
    for i, v in enumerate(atom.vars):
        if v in first:
            table = table.where(F.col(f"c{first[v]}") == F.col(f"c{i}"))
        else:
            first[v] = i
    if not first:
        return table.select(F.lit(1).alias("there")).limit(1)
    return table.select(*[F.col(f"c{i}").alias(f"v{v}") for v, i in first.items()])


def join(spark: SparkSession, premise: tuple[Atom, ...], first: int | None, table: Callable[[int], DataFrame], needed: set[int], size: Callable[[int], int] | None = None) -> DataFrame:
    """Bindings of the ``needed`` variables.  ``table(i)`` has the rows that atom ``i`` ranges over, in ``size(i)`` bytes.

    Small tables that can have very many matches are dealt to all cores before they meet: few tasks scan them,
    and a broadcast join would leave all matches to these.
    """
    if not premise:
        return spark.range(1).select(F.lit(1).alias("there"))
    plan = order(premise, first)
    out: DataFrame | None = None
    bound: set[int] = set()
    for at, i in enumerate(plan):
        atom = premise[i]
        own = set(atom.vars)
        later = needed | {v for j in plan[at + 1 :] for v in premise[j].vars}
        rows = columns_of(atom, table(i))
        if out is None:
            out = rows
        else:
            shared = sorted(own & bound)
            keys = [f"v{v}" for v in shared]
            new = (own - bound) & later
            if not own:
                out = out.crossJoin(rows.withColumnRenamed("there", "_there")).drop("_there")
            elif not shared:
                if new:
                    kept = [f"v{v}" for v in sorted(new)]
                    out = out.crossJoin(rows.select(*kept).distinct() if len(kept) < len(own) else rows)
                else:  # only whether there is any row
                    out = out.crossJoin(rows.select(F.lit(1).alias("_there")).limit(1)).drop("_there")
            elif not new:
                out = out.join(rows, keys, "left_semi")
            else:
                sizes = [size(j) for j in plan[: at + 1]] if size else []
                if sizes and sum(sizes) < SMALL_BYTES and most_matches(sizes) > MANY_ROWS:
                    out = out.repartition(4 * spark.sparkContext.defaultParallelism)
                out = out.join(rows.select(*keys, *[f"v{v}" for v in sorted(new)]), keys)
        bound |= own
        keep = [f"v{v}" for v in sorted(bound & later)]
        have = set(out.columns)
        keep = [c for c in keep if c in have]
        if set(keep) != have:
            out = out.select(*keep) if keep else out.select(F.lit(1).alias("there")).limit(1)
        bound &= later
    return out
