"""Resumable file ingest on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "unit"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incremental_ingest(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str,
                       keys: Sequence[str], valid: str, fmt: str = "parquet", max_files: int | None = None) -> None:
    """Ingest the files not seen before and stop.

    Finished files are skipped through the checkpoint.  Rows failing ``valid`` go to quarantine with
    the file they came from; of the rest one row per key is kept, and none whose key an earlier batch has.  The keys seen are a state store
    (RocksDB) of the stream, so a batch reads its own files and looks its keys up, however much has landed.  Two streams read
    the files, one for the rows and one for the account of files and rejects.  Every batch writes its own directories in overwrite mode, so a batch that is
    replayed after a failure replaces itself.
    """
    def stream() -> DataFrame:
        reader = spark.readStream.schema(schema).format(fmt)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.load(source).withColumn(UNIT, F.col("_metadata.file_name"))

    ok = F.coalesce(F.expr(valid), F.lit(False))

    def account(batch: DataFrame, batch_id: int) -> None:
        batch.where(~ok).withColumn("reason", F.lit(f"not ({valid})")).write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        batch.groupBy(UNIT).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("rejected")) \
            .write.mode("overwrite").parquet(f"{out}/units/batch={batch_id}")

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for frame, write, name in ((stream().where(ok).dropDuplicates(list(keys)), land, "rows"), (stream(), account, "units")):
            frame.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}") \
                .trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def landed(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Ingested rows of all batches."""
    full = T.StructType([*schema.fields, T.StructField(UNIT, T.StringType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(f"{out}/rows")


def ingest_progress(spark: SparkSession, out: str) -> DataFrame:
    """Per file: batches it appeared in, rows read and rejected, and whether all rows were accepted."""
    units = spark.read.schema("unit string, rows long, rejected long, batch long").parquet(f"{out}/units")
    return units.groupBy("unit").agg(F.count_distinct("batch").alias("attempts"), F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected")) \
        .withColumn("status", F.when(F.col("rejected") == 0, "completed").otherwise("completed with rejects"))
