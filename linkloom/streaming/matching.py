"""Matching a stream of reads against a catalog that stands still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkloom.config import MATCH, MatchConfig
from linkloom.operators.lifecycle import auto_confirm, route_reads
from linkloom.operators.matching import Prepared, prepare
from linkloom.tables import scratch, written

#: What tells reads apart, and for how long a read that is sent again is known.
READ, KNOWN_FOR = ("scan_id", "slot"), "1 day"


def match_stream(reads: DataFrame, catalog: DataFrame | Prepared, out: str, checkpoint: str, config: MatchConfig = MATCH, mode: str = "exact", once: bool = True, library: str | None = None, known_for: str = KNOWN_FOR) -> StreamingQuery:
    """Routes each micro-batch as a batch would and writes it under its batch id; automatic matches go to ``library`` as entries, if it is given.

    Reads carry created_at, the event time. A read that is sent again, in whatever batch, counts once: its
    scan and slot are kept as state for ``known_for`` after it was made, and no longer, so state is
    bounded; a read that comes later than that after the newest one is left out. The catalog's keys are made once. A
    batch that is run again overwrites its own folders, so results are written exactly once; the tables
    that a batch needs on its way are removed when it is done. For ``library``, reads carry detection_id.
    """
    prepared = catalog if isinstance(catalog, Prepared) else prepare(catalog, config)
    fresh = reads.withWatermark("created_at", known_for).dropDuplicatesWithinWatermark(list(READ))

    def each(batch: DataFrame, batch_id: int) -> None:
        folder = lambda root: f"{root.rstrip('/')}/batch_id={batch_id}"
        with scratch(batch.sparkSession):
            batch = written(batch, "batch")  # the state is gone through once, whatever reads the batch
            route_reads(batch, prepared, config, mode).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(folder(out))
        if library:
            detections = batch.sparkSession.read.parquet(folder(out))
            auto_confirm(detections).write.mode("overwrite").parquet(folder(library))

    writer = fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
