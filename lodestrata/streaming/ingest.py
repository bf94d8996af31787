"""Structured Streaming into a collection: each micro-batch is one upsert and one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import documents


def upsert_stream(collection, source: DataFrame, checkpoint: str, json_column: str | None = None, trigger: dict | None = None):
    """Start a query that puts the rows of a streaming DataFrame (or the documents in ``json_column``) into ``collection``.

    Upserts are idempotent by key, so a batch that is replayed after a failure changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        rows = documents.from_text(batch, json_column, collection.schema) if json_column else batch
        if not rows.isEmpty():
            collection.put_many(rows)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
