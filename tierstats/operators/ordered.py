"""Ordered operations on families of any size.

A window over a family needs the family in one task. Here a table is cut by range into partitions in the order of (family,
order); a window runs inside each partition, and what a family has in the partitions before and after is added from a table
with a row for each partition that a family crosses into, of which there are at most two a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import staged

#: Up to so many rows a table is one partition a family: a window holds no more. Rows of a partition beyond that.
PLAIN_ROWS, PART_ROWS = 1_000_000, 1 << 18
#: Up to so many rows the table of what is carried over is broadcast.
MOST_CARRIED = 100_000


class Ordered:
    """The rows of ``df``, written, by ``family`` (column names) and, within one, by ``order`` (column names, nulls first).

    ``rows`` has a column _part. The methods take a table with the rows' columns and _part, ``rows`` or one made of it, and
    add a column. ``order`` should end in a unique key. Tables of at most ``plain_rows`` rows stay uncut, with the same
    result.
    """

    def __init__(self, df: DataFrame, family: Sequence[str], order: Sequence[str], plain_rows: int = PLAIN_ROWS, part_rows: int = PART_ROWS):
        rows = staged(df, "ordered")
        n = rows.count()  # from the files' footers
        self.family, self.order, self.plain = list(family), list(order), n <= plain_rows
        self.n_parts = 1 if self.plain else ceil(n / part_rows)
        if not self.plain:
            rows = staged(rows.repartitionByRange(self.n_parts, *self.family, *self.order).withColumn("_part", F.spark_partition_id()), "ordered")
        self.rows = rows.withColumn("_part", F.lit(0)) if self.plain else rows

    @property
    def _local(self):
        return W.partitionBy(*self.family, "_part")

    def settled(self, rows: DataFrame) -> DataFrame:
        """``rows`` written, if they are many: for columns that would be worked out twice."""
        return rows if self.plain else staged(rows, "ordered")

    def _carried(self, rows: DataFrame, value: Column, fold: Callable[[Column | str], Column], frame: tuple[int, int]) -> DataFrame:
        """``rows`` with _carry: ``fold`` of the value over the family's other partitions in ``frame``, else null."""
        if self.plain:
            return rows.withColumn("_carry", F.lit(None).cast(rows.select(fold(value)).schema[0].dataType))
        parts = rows.groupBy("_part", *self.family).agg(fold(value).alias("_x"))
        family = W.partitionBy(*(self.family or [F.lit(0)]))  # one row a partition
        crossing = parts.withColumn("_n", F.count(F.lit(1)).over(family)).withColumn("_carry", fold("_x").over(family.orderBy("_part").rowsBetween(*frame))).where("_n > 1")
        carry = staged(crossing.select(F.col("_part").alias("_p"), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(self.family)), "_carry"), "ordered-carry")
        on = F.col("_part") == F.col("_p")
        for i, f in enumerate(self.family):
            on = on & F.col(f).eqNullSafe(F.col(f"_f{i}"))
        carry = F.broadcast(carry) if 2 * self.n_parts <= MOST_CARRIED else carry.hint("merge")
        return rows.join(carry, on, "left").drop("_p", *(f"_f{i}" for i in range(len(self.family))))

    def running_sum(self, rows: DataFrame, value: Column, out: str) -> DataFrame:
        """The sum of ``value`` over the family's rows up to this one; of 1, the rank."""
        own = F.sum(value).over(self._local.orderBy(*self.order).rowsBetween(W.unboundedPreceding, W.currentRow))
        d = self._carried(rows.withColumn(out, own), value, F.sum, (W.unboundedPreceding, -1))
        return d.withColumn(out, F.when(F.col("_carry").isNull(), F.col(out)).otherwise(F.col(out) + F.col("_carry"))).drop("_carry")

    def total(self, rows: DataFrame, value: Column, out: str) -> DataFrame:
        """The sum of ``value`` over the family."""
        d = self._carried(rows.withColumn(out, F.sum(value).over(self._local)), value, F.sum, (W.unboundedPreceding, W.unboundedFollowing))
        return d.withColumn(out, F.coalesce("_carry", out)).drop("_carry")

    def preceding_max(self, rows: DataFrame, value: str, out: str) -> DataFrame:
        """The largest ``value`` of the family's rows before this one, null for the first."""
        own = F.max(value).over(self._local.orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1))
        d = self._carried(rows.withColumn(out, own), F.col(value), F.max, (W.unboundedPreceding, -1))
        return d.withColumn(out, F.greatest(out, "_carry")).drop("_carry")  # greatest skips nulls

    def following_min(self, rows: DataFrame, value: str, out: str) -> DataFrame:
        """The least ``value`` of the family's rows from this one on."""
        own = F.min(value).over(self._local.orderBy(*self.order).rowsBetween(W.currentRow, W.unboundedFollowing))
        d = self._carried(rows.withColumn(out, own), F.col(value), F.min, (1, W.unboundedFollowing))
        return d.withColumn(out, F.least(out, "_carry")).drop("_carry")  # least skips nulls


def at_rank(v: str, rank: str, n: str, share: float) -> Column:
    """Aggregate: the quantile ``share`` of v, between its two neighbours in line, of rows with their rank from 1 and their number."""
    place = F.lit(share) * (F.col(n) - 1)
    low = F.floor(place)
    pick = lambda r: F.max(F.when(F.col(rank) == r + 1, F.col(v)))
    part = F.max(place - low)
    return F.when(part > 0, (1 - part) * pick(low) + part * pick(low + 1)).otherwise(pick(low))
