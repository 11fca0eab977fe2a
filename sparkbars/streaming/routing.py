"""Messages of one feed told apart by their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Message types of the feed.
KLINE, ORDER_UPDATE, ACK, POSITION_CLOSED = "kline", "order_update", "ack", "position_closed"


def message_type(value: str = "value") -> Column:
    return F.get_json_object(value, "$.type")


def route(messages: DataFrame, kind: str, schema: str, value: str = "value") -> DataFrame:
    """Fields of the messages of one type; the stream may be batch or streaming."""
    picked = messages.filter(message_type(value) == kind)
    return picked.select(F.from_json(value, schema).alias("m")).select("m.*")
