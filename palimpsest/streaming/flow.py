"""Documents as a stream: newest version per key, late results, micro-batches, errors kept apart.

Lateness is by version: a result counts when its generation is the document's current one. Pseudonyms are
stateless, so the only state is what the sink table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.plans.session import materialize, scoped


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key: a partial aggregate, so that a hot key isn't sorted or gathered."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(rows.columns)


def current_results(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results of documents that still exist, made for their current generation; later and earlier ones are dropped."""
    return results.join(documents.select("id", F.col("generation").alias("_g")), F.col("document_id") == F.col("id")).filter(F.col("generation") == F.col("_g")).drop("_g", "id")


def merge_results(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with status, output and error of their results; documents without one stay as they are, unknown results are ignored."""
    r = results.select(F.col("document_id").alias("id"), F.col("output_text").alias("_o"), F.col("error_message").alias("_e"), F.lit(True).alias("_hit"))
    both = documents.join(r, "id", "left")
    status = F.when(F.col("_e").isNotNull(), "error").when(F.col("_hit"), "ready").otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("error_message", F.when(F.col("_hit"), F.col("_e")).otherwise(F.col("error_message"))).withColumn("output_text", F.col("_o")).drop("_o", "_e", "_hit")


def reset(documents: DataFrame, changed: Column) -> DataFrame:
    """After a change of settings: documents with a text are pending again in the next generation."""
    again = changed & F.col("raw_text").isNotNull()
    return documents.withColumn("generation", F.col("generation") + again.cast("int")).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def processable(documents: DataFrame) -> DataFrame:
    return documents.filter((F.col("status") == "pending") & F.col("raw_text").isNotNull())


def can_export(processed: Column, active: Column, importing: Column, pasted: Column) -> Column:
    return processed & ~active & ~importing & ~pasted


def without_removed(documents: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Documents that weren't removed; removed has their ids, and one that is being processed is refused before it gets there."""
    return documents.join(removed.select(key).distinct(), key, "left_anti")


def run(stream: DataFrame, process: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, key: str = "id", order: list[str] = ("generation",), trigger: dict | None = None, debounce: str | None = None) -> StreamingQuery:
    """Processes every micro-batch: the newest row per key, then write(result, batch number).

    If the data of a batch make process fail, its documents are written with the message and status "error"; one document's
    failure is a column of its result and stops nothing. Failures of the cluster, and of write, end the query, which
    goes on from its checkpoint when it is started again: a batch is written once, or again under the same number.
    Bounded intake is maxFilesPerTrigger on the source. debounce ("250 milliseconds") is a processing-time trigger: only the
    newest version of a key in it is used. StreamingQuery.stop(), or cancellable() below, ends the work.
    """

    def one(batch: DataFrame, number: int) -> None:
        newest = latest_per_key(batch, key, list(order))
        with scoped():
            try:
                done = materialize(process(newest))
            except Exception as e:
                if not is_data_error(e):
                    raise
                done = newest.select(F.col(key).alias("document_id"), F.lit(None).cast("string").alias("output_text"), F.lit("error").alias("status"), F.lit(str(e)[:500]).alias("error_message"))
            write(done, number)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or ({"processingTime": debounce} if debounce else {"availableNow": True}))).start()


#: What tells that the cluster failed and not the data: the batch must be tried again, not written as an error.
CLUSTER = ["ExecutorLost", "executor lost", "FetchFailed", "heartbeat", "OutOfMemory", "No space left", "cancelled", "SparkContext was shut down"]


def is_data_error(e: Exception) -> bool:
    """Errors of plain Python, of analysis and of functions over the data; not those of the cluster."""
    return not isinstance(e, (OSError, MemoryError)) and not any(w in str(e) for w in CLUSTER)


@contextmanager
def cancellable(spark: SparkSession, group: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside belong to a group; the function given cancels them from another thread."""
    spark.addTag(group)
    try:
        yield lambda: spark.interruptTag(group)
    finally:
        spark.removeTag(group)
