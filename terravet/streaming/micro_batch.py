"""Updates as a stream: each micro-batch of change rows is one update of a project."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terravet import schemas
from terravet.plans.project import Project

#: Files taken in one update, as a bound on its size.
FILES = 1000


def change_stream(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """Changes as they arrive: parquet files of schemas.CHANGE's columns and `sequence`, in the order of their arrival."""
    work = {"targeted", "locha_id", "cc_id"}
    fields = [f for f in schemas.CHANGE.fields if f.name not in work]
    schema = schemas.T.StructType([*fields, schemas.T.StructField("sequence", schemas.T.LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(folder)


def ordered(batch: DataFrame) -> DataFrame:
    """The batch with insert_order: within an object by sequence, then version."""
    w = Window.partitionBy("objtype", "id").orderBy("sequence", "version", "deleted")
    return batch.withColumn("insert_order", F.row_number().over(w)).drop("sequence")


def update_batch(project: Project, provider: Callable[[DataFrame], DataFrame] | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls. A batch that is repeated after a loss is imported over itself and gives the same tables."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            project.update(ordered(batch), provider, now())

    return run


def start(project: Project, folder: str, checkpoint: str, provider: Callable[[DataFrame], DataFrame] | None = None, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> StreamingQuery:
    """Take all that is there in bounded batches and stop; one query for each project, so that no lock is needed."""
    stream = change_stream(project.spark, folder)
    return stream.writeStream.foreachBatch(update_batch(project, provider, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
