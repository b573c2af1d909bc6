"""Order-dependent work that no single task has to do alone.

A plain window over a hot key (or over no key) sorts all its rows in one task.
Here rows are range-partitioned by key and order, the slices are written once to
the shared folder, each slice is scanned on its own, and the totals of the
slices before it are added. A key that holds a third of all rows is thereby
spread over a third of the slices.

Order columns that come from floating-point aggregates should be stored before
(``stored_input``): a repeated task must find each row in the slice it had.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.session import materialise, working_path

_KEY, _SLICE, _LOCAL, _PLACE = "__key", "__slice", "__local", "__place"


def stored_input(df: DataFrame, stored: bool) -> DataFrame:
    """``df`` itself when its rows already come from a stored table, else a stored copy."""
    return df if stored else materialise(df, "ordered")


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows tagged with a struct key (null parts compare equal), their slice number and their place in the order of the slice."""
    tagged = df.withColumn(_KEY, F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all")))
    ranged = tagged.repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = ranged.sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return materialise(placed.withColumns({_SLICE: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id()}), "slices")


def _slice_totals(sliced: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    """Per key and slice: what lies in the earlier slices of the key, and the key's total.

    One row per (key, slice), so this window runs over aggregates only.
    """
    parts = sliced.groupBy(_KEY, _SLICE).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(_PLACE).alias("__first"), *[F.sum(c).alias(f"__sum_{o}") for o, c in sums.items()]
    )
    per_key = W.partitionBy(_KEY)
    before = per_key.orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    cols = [
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__rows").over(per_key).alias("__rows_total"),
    ]
    cols += [F.sum(f"__sum_{o}").over(before).alias(f"__before_{o}") for o in sums]
    return parts.select(_KEY, _SLICE, "__first", *cols)


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    position: str = "position",
    total: str | None = None,
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Number rows 1..n per key in ``order``, which must end in a unique column.

    ``total`` names an extra column with n; ``running`` maps output names to
    columns whose running sum (this row included) is wanted. Slices are stored in
    order with each row's place, so plain numbering needs no second sort.
    """
    running = dict(running or {})
    sliced = _slices(df, keys, order)
    upto = W.partitionBy(_KEY, _SLICE).orderBy(_PLACE).rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = sliced
    for out, col in running.items():
        numbered = numbered.withColumn(f"__run_{out}", F.sum(col).over(upto))
    joined = numbered.join(_slice_totals(sliced, running), [_KEY, _SLICE])
    extra = [(F.col("__rows_before") + F.col(_PLACE) - F.col("__first") + 1).cast("bigint").alias(position)]
    if total:
        extra.append(F.col("__rows_total").cast("bigint").alias(total))
    for out in running:
        earlier, here = F.col(f"__before_{out}"), F.col(f"__run_{out}")
        extra.append(
            F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(earlier + here).alias(out)
        )
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *extra)


def with_previous(
    df: DataFrame, order: Sequence[Column], values: Sequence[str], prefix: str = "prev_", keys: Sequence[str] = ()
) -> DataFrame:
    """Each row with the ``values`` of the row before it, per key or in one overall order.

    Only the first row of a slice looks beyond its slice, so the last rows of
    the slices, one per key and slice, are all that is exchanged.
    """
    sliced = _slices(df, keys, order)
    local = W.partitionBy(_KEY, _SLICE).orderBy(_PLACE)
    inner = [F.lag(v).over(local).alias(f"__in_{v}") for v in values]
    looked = sliced.select("*", *inner, F.row_number().over(local).alias(_LOCAL))
    per_slice = W.partitionBy(_KEY).orderBy(_SLICE)
    ends = (
        sliced.withColumn("__up", F.lead(F.lit(1)).over(local)).where(F.col("__up").isNull())
        .select(_KEY, _SLICE, *[F.lag(v).over(per_slice).alias(f"__out_{v}") for v in values])
    )
    joined = looked.join(ends, [_KEY, _SLICE])
    first = F.col(_LOCAL) == 1
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.when(first, F.col(f"__out_{v}")).otherwise(F.col(f"__in_{v}")).alias(prefix + v) for v in values],
    )


def discrete_place(total: str, share: float) -> Column:
    """Place, from 1, of the smallest of ``total`` ordered values that has at least ``share`` of them at or before it."""
    return F.greatest(F.lit(1), F.ceil(F.col(total) * F.lit(float(share))))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles per key from row positions; nulls are left out.

    No task ever holds the values of a whole key: rows are numbered slice-wise
    and only the one or two rows per quantile are joined out by position.
    """
    numbered = number_rows(
        df.where(F.col(value).isNotNull()).select(*keys, value), [F.col(value).asc()], keys, "__pos", "__n"
    )
    picks = []
    for name, p in probs.items():
        exact = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(exact)
        share = exact - low
        picks.append((name, F.col("__pos") == low + 1, F.lit(1.0) - share))
        picks.append((name, (F.col("__pos") == low + 2) & (share > 0), share))
    wanted = None
    for _, hit, _ in picks:
        wanted = hit if wanted is None else wanted | hit
    aggs = []
    for name in probs:
        total = None
        for n, hit, weight in picks:
            if n == name:
                part = F.sum(F.when(hit, F.col(value).cast("double") * weight).otherwise(0.0))
                total = part if total is None else total + part
        aggs.append(total.alias(name))
    return numbered.where(wanted).groupBy(*keys).agg(*aggs)


@dataclass(frozen=True)
class Pages:
    """A stored order that is read page by page: a page opens only the slices it lies in, wherever it is.

    ``slices`` holds, per slice, its number, the place of its first row, the rows of all
    slices before it and its own rows: one entry per task that wrote.
    """

    spark: SparkSession
    path: str
    schema: str
    columns: tuple[str, ...]
    slices: tuple[tuple[int, int, int, int], ...]

    @property
    def total(self) -> int:
        return self.slices[-1][2] + self.slices[-1][3] if self.slices else 0

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset+1 .. offset+limit in order; Parquet statistics on the place skip the row groups of the slice that are not needed."""
        wanted = F.lit(False)
        for number, first, before, rows in self.slices:
            a, b = max(0, offset - before), min(rows, offset + limit - before)
            if a < b:
                wanted = wanted | ((F.col(_SLICE) == number) & F.col(_PLACE).between(first + a, first + b - 1))
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        return stored.where(wanted).orderBy(_PLACE).select(*[F.col(f"`{c}`") for c in self.columns])


def store_pages(df: DataFrame, order: Sequence[Column]) -> Pages:
    """Writes ``df`` once as range slices in ``order``, which must end in a unique column, and counts their rows."""
    spark, path = df.sparkSession, working_path(df.sparkSession, "pages")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({_SLICE: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id()})
    placed.write.partitionBy(_SLICE).parquet(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    counts = spark.read.schema(schema).parquet(path).groupBy(_SLICE).agg(F.min(_PLACE).alias("first"), F.count(F.lit(1)).alias("n")).orderBy(_SLICE).collect()
    slices, before = [], 0
    for r in counts:
        slices.append((r[_SLICE], r["first"], before, r["n"]))
        before += r["n"]
    return Pages(spark, path, schema, tuple(df.columns), tuple(slices))
