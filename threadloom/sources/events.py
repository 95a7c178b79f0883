"""Event logs and text lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parsed_events(events: DataFrame) -> DataFrame:
    """Events whose ``props`` is JSON with a number k, with their step in their session; malformed ones keep no row but count as steps."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    stepped = events.select("user_id", "event_id", F.row_number().over(order).cast("long").alias("step"), F.from_json("props", "k long").alias("p"))
    return stepped.filter("p.k is not null").select("user_id", "event_id", "step", F.col("p.k").alias("k"))


def sections(messages: DataFrame, heading_words: int = 3) -> DataFrame:
    """Each line of a message with the heading above it; a heading is a short line that ends in a full stop."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    is_heading = F.col("line").endswith(".") & (F.size(F.split("line", " ")) <= heading_words)
    above = W.partitionBy("conv_id", "turn").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(above))
