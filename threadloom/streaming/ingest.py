"""Units kept up to date from a stream: whole owners are replaced where their digest has changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..shared import shared_dir, size_checked, stored
from ..sources import conversations

#: Folders of a table; an owner's units are in one of them, and a batch rewrites those that it changes.
BUCKETS = 64
#: A conversation of more messages is refused.
MOST_MESSAGES = 10_000

#: The units of a batch, with owner and unit_id, and the owners that are refused, with owner and reason.
Reader = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def message_units(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages as units of their conversations, without those of a conversation that has an invalid one or too many."""
    judged = conversations.validated(messages)
    told = judged.groupBy("conv_id").agg(F.min("reason").alias("reason"), F.count(F.lit(1)).alias("n"))
    reason = F.coalesce("reason", F.when(F.col("n") > MOST_MESSAGES, "too_many_messages"))
    refused = stored(told.select("conv_id", reason.alias("reason")).filter("reason is not null"), "refused")
    whole = messages.filter("conv_id is not null").join(size_checked(refused.select("conv_id"), 32), "conv_id", "left_anti")
    units = conversations.units(whole).filter("source_type = 'message'").select(F.col("parent_id").alias("owner"), "unit_id", "role", "position", "content", "content_hash", "token_count")
    return units, refused.select(conversations.conversation_name(F.col("conv_id")).alias("owner"), "reason")


def _bucket(owner: Column) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")


def _digests(units: DataFrame) -> DataFrame:
    """(owner, digest, n): a digest of all that an owner's units say, whatever their order; no list is gathered."""
    said = F.sha2(F.to_json(F.struct(*[c for c in sorted(units.columns) if c not in ("revision", "bucket", "owner")]), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(said, 1, 15), 16, 10).cast("decimal(38,0)")
    return units.groupBy("owner").agg(F.sum(part).alias("digest"), F.count(F.lit(1)).alias("n"))


class Table:
    """A table of units in folders by bucket, with what each batch did to it.

    A batch first writes the new content of the folders that it changes aside, then
    overwrites these folders with it, and last its report, which says that it is done. So
    a batch that is lost half-way is finished from what was set aside, and one that is run
    again once it was done does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType([f for f in schema if f.name not in ("revision", "bucket")]).add("revision", LongType()).add("bucket", IntegerType())

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def rows(self) -> DataFrame:
        """All units, with the revision in which their owner changed last."""
        if not self._exists(f"{self.path}/units"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/units")

    def reports(self) -> DataFrame:
        """(batch, change, n, revision): units of each batch by what became of them, and owners that were refused."""
        schema = "change string, n long, revision long, batch string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/reports") if self._exists(f"{self.path}/reports") else self.spark.createDataFrame([], schema)

    def apply(self, incoming: DataFrame, refused: DataFrame, name: str) -> None:
        """Replace the owners of ``incoming`` whose digest is another now; ``name`` tells the batch."""
        report, aside = f"{self.path}/reports/batch={name}", f"{self.path}/aside/batch={name}"
        if self._exists(report):
            return
        if not self._exists(f"{aside}/report/_SUCCESS"):
            self._set_aside(incoming, refused, aside)
        if self._exists(f"{aside}/units/_SUCCESS"):
            content = self.spark.read.schema(self.schema).parquet(f"{aside}/units")
            content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/units")
        self.spark.read.schema("change string, n long, revision long").parquet(f"{aside}/report").coalesce(1).write.mode("overwrite").parquet(report)
        self._delete(aside)

    def _set_aside(self, incoming: DataFrame, refused: DataFrame, aside: str) -> None:
        incoming = stored(incoming.withColumn("bucket", _bucket(F.col("owner"))), "incoming-units")
        met = [r.bucket for r in incoming.select("bucket").distinct().collect()]  # at most BUCKETS
        current = self.rows().filter(F.col("bucket").isin(met))
        owners = incoming.select("owner").distinct()
        old, new = _digests(current.join(owners, "owner", "left_semi")), _digests(incoming)
        was = F.struct("digest", "n")
        both = new.select("owner", was.alias("is")).join(old.select("owner", was.alias("was")), "owner", "left")
        changed = stored(both.filter(~F.col("is").eqNullSafe(F.col("was"))).select("owner"), "changed-owners")
        revision = self.reports().agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]

        a = current.join(owners, "owner", "left_semi").select("unit_id", "owner", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
        b = incoming.select("unit_id", "owner", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
        moved = a.join(b, ["owner", "unit_id"], "full_outer").join(changed.withColumn("other", F.lit(True)), "owner", "left")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
        told = moved.groupBy(kind.alias("change")).agg(F.count(F.lit(1)).alias("n"))
        told = told.unionByName(refused.groupBy(F.lit("refused").alias("change")).agg(F.count_distinct("owner").alias("n")))
        any_change = not changed.isEmpty()
        if any_change:
            touched = [r.bucket for r in changed.select(_bucket(F.col("owner")).alias("bucket")).distinct().collect()]
            small = size_checked(changed, 16, ["owner"])
            kept = current.filter(F.col("bucket").isin(touched)).join(small, "owner", "left_anti")
            fresh = incoming.join(small, "owner", "left_semi").withColumn("revision", F.lit(revision + 1).cast("long"))
            kept.unionByName(fresh).select(self.schema.names).write.mode("overwrite").parquet(f"{aside}/units")
        told.withColumn("revision", F.lit(revision + any_change).cast("long")).write.mode("overwrite").parquet(f"{aside}/report")


def ingest(stream: DataFrame, reader: Reader, table: Table, name: str = "ingest", folder: str | None = None) -> Table:
    """Bring ``table`` up to date with all that ``stream`` has.

    Each batch replaces whole owners; owners that a batch does not have stay as they are.
    Nothing is written, and the revision stays, where all digests agree. ``folder`` keeps
    the stream's progress, so that a later run reads only what is new; by default each run
    reads all. Batches are told by ``name`` and their number.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/threadloom-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        units, refused = reader(stored(batch, "batch"))
        table.apply(units, refused, f"{name}-{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return table
