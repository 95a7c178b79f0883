"""Conversations as context units and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, token_count

#: Roles that a message may have.
ROLES = ("user", "assistant", "system", "tool", "developer")


def conversation_name(conv: Column) -> Column:
    return F.concat(F.lit("conversation:"), conv.cast("string"))


def message_name(conv: Column, turn: Column) -> Column:
    return F.concat(conversation_name(conv), F.lit("/message:"), turn.cast("string"))


def validated(messages: DataFrame, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """``messages`` with ``reason``: null where valid, else the first rule broken."""
    times = F.count(F.lit(1)).over(W.partitionBy("conv_id", "turn"))
    reason = (
        F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), "missing_id")
        .when(times > 1, "duplicate_id")
        .when(F.col("role").isNull() | ~F.col("role").isin(*roles), "unknown_role")
        .when(F.col("text").isNull(), "missing_content")
    )
    return messages.withColumn("reason", reason)


def units(messages: DataFrame) -> DataFrame:
    """One unit per message and one per conversation."""
    own = messages.select(
        message_name(F.col("conv_id"), F.col("turn")).alias("unit_id"),
        F.lit("message").alias("source_type"),
        conversation_name(F.col("conv_id")).alias("parent_id"),
        "role",
        F.col("turn").alias("position"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
        token_count(F.col("text")).alias("token_count"),
    )
    whole = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(token_count(F.col("text"))).alias("token_count"))
    whole = whole.select(conversation_name(F.col("conv_id")).alias("unit_id"), F.lit("conversation").alias("source_type"), F.col("n").alias("position"), "token_count")
    return own.unionByName(whole, allowMissingColumns=True)


def edges(messages: DataFrame) -> DataFrame:
    """member_of and contains between messages and conversations; follows from a message to the next."""
    order = W.partitionBy("conv_id").orderBy("turn")
    named = messages.select("conv_id", message_name(F.col("conv_id"), F.col("turn")).alias("unit"), F.lag("turn").over(order).alias("before"))
    whole = conversation_name(F.col("conv_id"))
    kinds = F.array(
        F.struct(F.lit("member_of").alias("kind"), F.col("unit").alias("src_id"), whole.alias("dst_id")),
        F.struct(F.lit("contains").alias("kind"), whole.alias("src_id"), F.col("unit").alias("dst_id")),
        F.struct(F.lit("follows").alias("kind"), message_name(F.col("conv_id"), F.col("before")).alias("src_id"), F.col("unit").alias("dst_id")),
    )
    return named.select(F.explode(kinds).alias("e")).select("e.*").filter("src_id is not null")


def transcript(messages: DataFrame) -> DataFrame:
    """A line for each message, in place: a conversation of any length stays distributed."""
    return messages.select("conv_id", "turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text")).alias("line"))
