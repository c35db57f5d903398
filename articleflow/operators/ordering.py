"""Ordered work within groups when one group may hold a large part of the table.

A window puts a whole group into one task. Here a group above a size limit is cut into segments by
ranges of its sort key; windows run per segment, and a summary with one row per segment carries
values across the seams. The cut points come from a small sample, which affects only how even the
segments are: the result is exact for any cut points. Groups within the limit are left whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.session import cut_lineage

SEGMENT_ROWS = 2_000_000
SAMPLES_PER_SEGMENT = 60
_SEG = "_segment"


def _key_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])


def _same_group(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null keys form a group too, so they are equal here."""
    return all_of([left[k].eqNullSafe(right[f"_key_{k}"]) for k in keys])


def _cut_points(
    df: DataFrame, keys: list[str], order: list[str], segment_rows: int
) -> DataFrame | None:
    """Table (keys named ``_key_…``, cuts) of every group above the limit; None when there is none.

    The limit is the same for any table and any number of groups. Cut points stay in a stored table,
    one for about every ``segment_rows`` rows of a large group, and never pass through the driver.
    """
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    sizes = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(sizes.where(F.col("_n") > segment_rows))
    if hot.isEmpty():
        return None
    rows = df.select(*keys, *[c for c in order if c not in keys])
    share = F.lit(SAMPLES_PER_SEGMENT) * F.ceil(F.col("_n") / segment_rows) / F.col("_n")
    points = rows.join(hot, _same_group(rows, hot, keys)).where(F.rand(7) < share)
    names = [f"_key_{k}" for k in keys]
    sorted_points = F.array_sort(F.collect_list(_key_struct(order)))
    every = F.filter(sorted_points, lambda _, i: (i > 0) & (i % SAMPLES_PER_SEGMENT == 0))
    sampled = points.groupBy(*names).agg(F.array_distinct(every).alias("_cuts"))
    # A large group stays in the table even if its sample gives no cut.
    again = sampled.select(*[F.col(n).alias(n[len("_key_") :]) for n in names], "_cuts")
    joined = hot.join(again, _same_group(again, hot, keys), "left")
    return cut_lineage(joined.select(*names, F.coalesce("_cuts", F.array()).alias("_cuts")))


@dataclass
class OrderedGroups:
    """A table grouped by ``keys`` and ordered by ``order`` (ascending, without nulls) per group."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    segmented: bool = False
    steps: int = 0

    def _window(self):
        keys = [*self.keys, _SEG] if self.segmented else self.keys
        return Window.partitionBy(*keys).orderBy(*self.order)

    def _segments(self, *aggs: Column) -> DataFrame:
        """One row per segment."""
        return self.df.groupBy(*self.keys, _SEG).agg(*aggs)

    def with_rows(self, df: DataFrame) -> OrderedGroups:
        """The same groups with other columns; rows, keys and order stay."""
        return replace(self, df=df)

    def _ready(self, df: DataFrame) -> DataFrame:
        """Rows for a step that reads them twice; results of earlier steps are stored first."""
        return cut_lineage(df) if self.segmented and self.steps else df

    def _next(self, df: DataFrame) -> OrderedGroups:
        return replace(self, df=df, steps=self.steps + 1)

    def _join_seams(self, df: DataFrame, seams: DataFrame) -> DataFrame:
        """Spark broadcasts the seams if they are small enough; segments bound its partitions if not."""
        named = seams.withColumnsRenamed({c: f"_key_{c}" for c in (*self.keys, _SEG)})
        joined = df.join(named, _same_group(df, named, [*self.keys, _SEG]), "left")
        return joined.drop(*[f"_key_{c}" for c in (*self.keys, _SEG)])

    def neighbours(self, columns: dict[str, tuple[str, int]]) -> OrderedGroups:
        """Add columns holding a value of the previous (-1) or next (+1) row of the group."""
        w = self._window()
        before = {n: c for n, (c, step) in columns.items() if step < 0}
        after = {n: c for n, (c, step) in columns.items() if step > 0}
        shifted = {n: F.lag(c).over(w) for n, c in before.items()}
        shifted.update({n: F.lead(c).over(w) for n, c in after.items()})
        if not self.segmented:
            return self._next(self.df.withColumns(shifted))
        shifted["_segment_first"] = F.lag(F.lit(1)).over(w).isNull()
        shifted["_segment_last"] = F.lead(F.lit(1)).over(w).isNull()
        rows = self._ready(self.df)
        df = rows.withColumns(shifted)
        key = _key_struct(self.order)
        edge = self.with_rows(rows)._segments(
            F.max_by(F.struct(F.lit(1).alias("_"), *[F.col(c).alias(n) for n, c in before.items()]), key).alias("tail"),
            F.min_by(F.struct(F.lit(1).alias("_"), *[F.col(c).alias(n) for n, c in after.items()]), key).alias("head"),
        )
        ws = Window.partitionBy(*self.keys).orderBy(_SEG)
        edge = edge.select(
            *self.keys, _SEG, F.lag("tail").over(ws).alias("_segment_tail"), F.lead("head").over(ws).alias("_segment_head")
        )
        df = self._join_seams(df, edge)
        fixed = {n: F.when(F.col("_segment_first"), F.col("_segment_tail")[n]).otherwise(F.col(n)) for n in before}
        fixed.update(
            {n: F.when(F.col("_segment_last"), F.col("_segment_head")[n]).otherwise(F.col(n)) for n in after}
        )
        return self._next(df.withColumns(fixed).drop("_segment_first", "_segment_last", "_segment_tail", "_segment_head"))

    def running_sum(self, value: Column, out: str) -> OrderedGroups:
        """Add the sum of ``value`` over the group's rows up to and including this one."""
        df = self._ready(self.df.withColumn("_v", value.cast("bigint")))
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = F.sum("_v").over(w)
        if not self.segmented:
            return self._next(df.withColumn(out, local).drop("_v"))
        ws = Window.partitionBy(*self.keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
        totals = (
            self.with_rows(df)
            ._segments(F.sum("_v").alias("_t"))
            .select(*self.keys, _SEG, F.sum("_t").over(ws).alias("_base"))
        )
        df = self._join_seams(df.withColumn(out, local), totals)
        return self._next(
            df.withColumn(out, F.col(out) + F.coalesce(F.col("_base"), F.lit(0))).drop("_v", "_base")
        )

    def carry_last(self, value: Column, out: str) -> OrderedGroups:
        """Add the nearest non-null ``value`` among the group's rows before this one."""
        df = self._ready(self.df.withColumn("_v", value))
        w = self._window().rowsBetween(Window.unboundedPreceding, -1)
        df_local = df.withColumn(out, F.last("_v", ignorenulls=True).over(w))
        if not self.segmented:
            return self._next(df_local.drop("_v"))
        key = _key_struct(self.order)
        ws = Window.partitionBy(*self.keys).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
        tails = (
            self.with_rows(df)
            ._segments(F.max_by("_v", F.when(F.col("_v").isNotNull(), key)).alias("_t"))
            .select(*self.keys, _SEG, F.last("_t", ignorenulls=True).over(ws).alias("_base"))
        )
        out_df = self._join_seams(df_local, tails)
        return self._next(
            out_df.withColumn(out, F.coalesce(F.col(out), F.col("_base"))).drop("_v", "_base")
        )

    def result(self) -> DataFrame:
        return self.df.drop(_SEG)


def over_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[OrderedGroups], DataFrame],
    segment_rows: int | None = None,
) -> DataFrame:
    """Run ``work`` on the groups of a table.

    If every group is within the limit, that is one call. Otherwise the rows of the larger groups,
    however many, are stored once with their segment and worked on apart; the rest takes the plain
    way. A group of null keys is a group like others.
    """
    cuts = _cut_points(df, keys, order, segment_rows or SEGMENT_ROWS)
    if cuts is None:
        return work(OrderedGroups(df, keys, order))
    below = F.filter(F.col("_cuts"), lambda c: c < _key_struct(order))
    same = _same_group(df, cuts, keys)
    hot = df.join(cuts, same).withColumn(_SEG, F.size(below)).select(*df.columns, _SEG)
    large = work(OrderedGroups(cut_lineage(hot), keys, order, segmented=True))
    usual = work(OrderedGroups(df.join(cuts, same, "left_anti"), keys, order))
    return usual.unionByName(large)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: int = 1, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of every group.

    Each input task already reduces a group to ``k`` rows before the shuffle. ``spread`` > 1 adds a
    round in which the survivors of a hot group meet in that many tasks instead of one; use it for
    groups that cover many input files, such as feeds.
    """
    if spread > 1:
        w = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.spark_partition_id() % F.lit(spread))
            .withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= k)
            .drop("_slice", "_rank")
        )
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
