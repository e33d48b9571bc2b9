"""Continuous ingest of a topic's folder: each micro-batch of new files triggers an incremental build."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Topic

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch_topic(topic: Topic, checkpoint: str, once: bool = True, **build_options) -> StreamingQuery:
    """Starts a stream over the folder.  ``once`` handles what is there and stops; otherwise it goes on.

    Builds are incremental by the manifest, so a batch that is delivered again after a failure changes nothing.
    """
    files = topic.spark.readStream.format("binaryFile").schema(FILES).load(f"{topic.engine.raw}/{topic.name}").select("path", "modificationTime")

    def rebuild(batch, _number: int) -> None:
        if not batch.isEmpty():
            topic.build(**build_options)

    writer = files.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
