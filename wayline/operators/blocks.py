"""Row-count windows over series of any length: blocks of rows with the rows that their windows reach as a halo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of a chunk in which rows are numbered.
CHUNK_DAYS = 28


def in_blocks(df: DataFrame, group: list[str], order: list[str], low: int, high: int, rows: int):
    """Rows in blocks of ``rows`` of their group's series by ``order`` (its first column a time), and a window that reaches from ``low`` to ``high`` rows from each.

    A row's place is its number in its chunk of days and the sizes of the chunks before, which are counted
    first. It is then listed under every block with a row whose window reaches it. Gives the frame, with
    ``_own`` true where a row is in its own block, and the window; use the window, then keep the own rows.
    """
    if rows < high - low + 1:
        raise ValueError("a block holds a window at least")
    chunk = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / (CHUNK_DAYS * 86_400_000_000))
    dated = df.withColumn("_chunk", chunk)
    sizes = dated.groupBy(*group, "_chunk").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(c).alias(f"_key_{k}") for k, c in enumerate([*group, "_chunk"])), ahead.alias("_ahead"))
    same = F.lit(True)
    for k, c in enumerate([*group, "_chunk"]):
        same = same & dated[c].eqNullSafe(F.col(f"_key_{k}"))
    numbered = dated.join(sizes, same).drop(*(f"_key_{k}" for k in range(len(group) + 1)))
    numbered = numbered.withColumn("_place", F.col("_ahead") + F.row_number().over(Window.partitionBy(*group, "_chunk").orderBy(*order)) - 1)
    block = lambda shift: F.floor((F.col("_place") + shift) / rows)
    spread = numbered.withColumn("_block", F.explode(F.sequence(block(-high), block(-low)))).withColumn("_own", F.col("_block") == block(0))
    return spread.drop("_chunk", "_ahead"), Window.partitionBy(*group, "_block").orderBy("_place").rowsBetween(low, high)
