"""An extension: a stream that tells when trees changed, each batch of which indexes them incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans.index import index_repo
from ..store import Store


def index_on_change(changes: DataFrame, warehouse: str) -> DataStreamWriter:
    """changes: a streaming frame with a root column.  Each batch indexes every tree it names once; a batch that is
    run again finds nothing changed.  Start the returned writer with a checkpoint location."""

    def run(batch: DataFrame, _: int) -> None:
        store = Store(batch.sparkSession, warehouse)
        for row in batch.select("root").where("root is not null").distinct().toLocalIterator():
            index_repo(store, row["root"])

    return changes.writeStream.foreachBatch(run)
