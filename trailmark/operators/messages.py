"""Conversation messages with media parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_TYPES = ("image", "image_url")  # fixed values
MEDIA_TYPES = ("image", "image_url", "video")  # fixed values


def _has_image(content: Column) -> Column:
    return F.exists(content, lambda p: p["type"].isin(*IMAGE_TYPES))


def prune_message_images(messages: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Keep media only in the latest user message with an image.

    Other user messages lose their media parts, and go when nothing is left;
    the messages of other roles stay as they are. The latest turn is a map-side
    combined maximum joined back, so a long conversation is never one task's.
    """
    user = F.col("role") == "user"
    latest = (
        messages.where(user & _has_image(F.col("content")))
        .groupBy(key).agg(F.max(turn).alias("_latest"))
    )
    joined = messages.join(latest, key, "left")
    pruned = F.filter("content", lambda p: ~p["type"].isin(*MEDIA_TYPES))
    touched = user & ~F.coalesce(F.col(turn) == F.col("_latest"), F.lit(False))
    out = joined.withColumn("content", F.when(touched, pruned).otherwise(F.col("content")))
    return out.where(~touched | (F.size("content") > 0)).drop("_latest")


def relabel_first_message(messages: DataFrame, turn: str = "turn", first_turn: int = 0) -> DataFrame:
    """Rename the list of available images in the first user message."""
    from trailmark.functions.text import relabel_refs

    first = (F.col(turn) == first_turn) & (F.col("role") == "user")

    def part(p: Column) -> Column:
        text = F.when(p["type"] == "text", relabel_refs(p["text"])).otherwise(p["text"])
        return p.withField("text", text)

    return messages.withColumn(
        "content", F.when(first, F.transform("content", part)).otherwise(F.col("content"))
    )
