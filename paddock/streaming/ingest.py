"""Incremental landing -> facts with Structured Streaming (ST1).

New pages are picked up by a file stream source (explicit schema, one page
per file or many), exploded with their page positions and appended to a
parquet sink. The sink and its checkpoint make the ingestion exactly-once
and restartable after executor or driver loss; a second run only reads pages
it has not seen. The keep-first dedup runs on read, over the whole sink, so
re-landed pages never duplicate facts and earlier events are never lost.

``ingest_merged`` keeps a table that needs no dedup on read: every micro-batch
is merged into the folders of the events it touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialize
from ..sources.raw import POSITION, explode_results, json_options, keep_first, with_page_name
from ..sources.store import read_periods, write_periods
from ..spec import Params


def _stream_raw(spark: SparkSession, path_glob: str, lines: bool) -> DataFrame:
    return with_page_name(json_options(spark.readStream, lines).option("maxFilesPerTrigger", 1000).json(path_glob))


def _pages(spark: SparkSession, sink: str) -> int:
    try:
        return spark.read.parquet(sink).agg(F.countDistinct("_file").alias("n")).first().n
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return 0


def ingest_incremental(spark: SparkSession, landing_glob: str, sink: str, checkpoint: str,
                       params: Params = Params(), on_bad: str = "raise", lines: bool = False) -> int:
    """Run one availableNow pass; returns the number of pages whose rows are
    new in the sink (0 when nothing new was landed), counted in the sink. A
    malformed page fails the pass unless ``on_bad`` is ``quarantine``."""
    before = _pages(spark, sink)
    rows = explode_results(_stream_raw(spark, landing_glob, lines), params, on_bad)
    q = rows.writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return _pages(spark, sink) - before


def read_ingested(spark: SparkSession, sink: str) -> DataFrame:
    """Facts from the sink: keep-first over all ingested rows."""
    return keep_first(spark.read.parquet(sink))


EVENT = ("season", "round")
LEDGER = StructType([StructField(c, LongType()) for c in ("batch", "pages", "rows")])


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table, empty where none was written yet."""
    try:
        return read_periods(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _touched(batch: DataFrame):
    """A filter on the events of a micro-batch, which names folders: their number is that of the batch's events."""
    events = batch.groupBy("season").agg(F.collect_set("round").alias("rounds")).collect()
    cond = F.lit(False)
    for e in events:
        cond = cond | ((F.col("season") == F.lit(e.season)) & F.col("round").isin(e.rounds))
    return cond


def merge_batch(spark: SparkSession, batch: DataFrame, batch_id: int, table: str, ledger: str) -> None:
    """Merge one micro-batch of flat rows: the stored rows of its events are read back, reduced together with the
    new ones by keep-first, and written over these events' folders only; then the ledger takes the batch's id. A
    batch whose id the ledger holds is passed over; one that failed before that is merged again, which
    changes nothing, because keep-first of rows and their copies is keep-first of the rows."""
    path = f"{ledger}/batch_{batch_id}"
    if not _read(spark, path, LEDGER).isEmpty():
        return
    new = materialize(batch, "micro-batch")
    old = _read(spark, table, new.schema).filter(_touched(new))
    merged = materialize(keep_first(new.unionByName(old), positions=True), "merged-events")
    write_periods(merged, table, *EVENT)
    new.agg(F.lit(batch_id).cast("bigint").alias("batch"), F.countDistinct("_file").alias("pages"),
            F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(path)


def ingest_merged(spark: SparkSession, landing_glob: str, table: str, checkpoint: str,
                  params: Params = Params(), on_bad: str = "raise", lines: bool = False) -> int:
    """Run one availableNow pass into a merged table with a folder per event; returns the pages merged by it. The
    ledger of merged batches lies in the checkpoint's folder, whose batch ids it holds: with a new
    checkpoint all pages are merged again, to the same table. A page landed again under its name must be the same
    page; corrections need a name that sorts first."""
    ledger = f"{checkpoint.rstrip('/')}/merged"

    def pages() -> int:
        done = f"{ledger}/batch_*"
        try:
            return spark.read.schema(LEDGER).parquet(done).agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    before = pages()
    rows = explode_results(_stream_raw(spark, landing_glob, lines), params, on_bad)
    q = rows.writeStream.foreachBatch(lambda batch, i: merge_batch(batch.sparkSession, batch, i, table, ledger)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return pages() - before


def read_merged(spark: SparkSession, table: str) -> DataFrame:
    """Facts from the merged table, as stored."""
    return spark.read.parquet(table).drop(*POSITION).withColumns({c: F.col(c).cast("bigint") for c in EVENT})
