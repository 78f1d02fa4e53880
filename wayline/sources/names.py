"""Names files: a template seeded from metadata, and edited names, as one CSV part that load_names reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import seed_names
from ..schema import require


def write_names(df: DataFrame, path: str) -> None:
    """Writes segment_id, seed_label (blank if there is none) and the trimmed name, one row a segment by id; replaces what is there."""
    require(df, "segment_id", "name")
    label = F.coalesce(F.col("seed_label").cast("string"), F.lit("")) if "seed_label" in df.columns else F.lit("")
    rows = df.select(F.col("segment_id").cast("long").alias("Segment ID"), label.alias("seed_label"), F.trim(F.coalesce(F.col("name").cast("string"), F.lit(""))).alias("name"))
    rows.repartition(1).sortWithinPartitions("Segment ID").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_template(metadata: DataFrame, path: str) -> None:
    """Writes the seeded names of all segments, to be edited."""
    write_names(seed_names(metadata), path)
