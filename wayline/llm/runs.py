"""Running aggregates over groups of any size, in many tasks.

Rows are range-partitioned by group and order and written with their partition's number, so that one
group may fill many partitions. An aggregate runs within each (group, partition); the partitions' totals,
at most one row for each group and partition that has its rows, are run over in turn and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import keep


def running(df: DataFrame, group: str, order: list, totals: dict[str, tuple]) -> DataFrame:
    """Adds for each name in ``totals``, a pair (F.sum or F.bit_xor, a column of longs), the aggregate from the group's first row to each row by ``order``.

    Rows that are equal in ``group`` and ``order`` follow each other in any way; ``group`` is not null.
    """
    dealt = keep(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "runs")
    inner = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part", group).agg(*(f(c).alias(f"_{name}") for name, (f, c) in totals.items()))
    before = parts.select("_part", group, *(F.coalesce(f(f"_{name}").over(outer), F.lit(0).cast("long")).alias(f"_{name}") for name, (f, _) in totals.items()))
    out = dealt.withColumns({name: f(c).over(inner) for name, (f, c) in totals.items()}).join(before, ["_part", group])
    both = {name: F.col(f"_{name}").bitwiseXOR(F.col(name)) if f is F.bit_xor else F.col(f"_{name}") + F.col(name) for name, (f, _) in totals.items()}
    return out.select(*df.columns, *(c.alias(name) for name, c in both.items()))
