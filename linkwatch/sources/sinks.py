"""Sinks for live-feed messages (JSON text per cycle)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Write one JSON message per line (column ``value``) as text files."""
    messages.select("value").write.mode(mode).text(path)
