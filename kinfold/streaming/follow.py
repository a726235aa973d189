"""Archiving an append-only root as it grows, with Structured Streaming.

New files of the root become micro-batches; each is one batch of root keys whose closure is copied into the
destination. A micro-batch that is delivered again inserts nothing new, so the copy is exactly once.
The stream's own checkpoint says which files are done; it is apart from the key checkpoint of a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.predicates import where as predicate
from kinfold.graph import Graph
from kinfold.operators.closure import closure
from kinfold.operators.copy import insert_ignore, insert_missing
from kinfold.sources.store import Change, Store


def follow(spark: SparkSession, graph: Graph, root_folder: str, tables: Callable[[], dict[str, DataFrame]], destination: Store, where: str, checkpoint: str, max_files: int = 100) -> StreamingQuery:
    """Copy what has arrived in root_folder since the last call, and end. tables() gives the other tables as they are then."""
    schema, key = spark.read.parquet(root_folder).schema, graph.keys[graph.root]

    def one(batch: DataFrame, number: int) -> None:
        cond = predicate(where)
        rows = (batch if cond is None else batch.filter(cond)).persist()
        now = tables() | {graph.root: rows}
        found = closure(graph, now, rows.select(key))
        changes = {}
        for t in graph.copy_order():
            incoming, existing, own = found[t].of(now[t]), destination.table(t), graph.keys[t]
            changes[t] = Change(add=insert_missing(incoming, found[t].of(existing)) if own is None else insert_ignore(incoming, existing, [own]))
        destination.commit(changes)
        rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(root_folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
