"""Appends that hold each row exactly once, in flushes of bounded size, whenever a run is killed.

A micro-batch is written below a staging folder, a folder for each flush of at most `every` rows; each is then
renamed to a name made of the batch's id and the flush's number. The names are the ledger: a batch that runs again
after a crash, between any two of its steps, makes the same flushes (rows are ranked by key) and renames only those
that are missing. Readers see renamed folders only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strophe.shared import ranked


class Ledger:
    """The flushes below a path, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.disk = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self) -> set[str]:
        if not self.disk.exists(self._at(self.path)):
            return set()
        return {f.getPath().getName() for f in self.disk.listStatus(self._at(self.path)) if f.getPath().getName().startswith("flush-")}

    def staged(self, batch: int) -> str:
        return f"{self.path}/_staging-{batch}"

    def drop(self, name: str) -> None:
        self.disk.delete(self._at(name), True)

    def staged_flushes(self, batch: int) -> list[int]:
        where = self._at(self.staged(batch))
        found = [f.getPath().getName() for f in self.disk.listStatus(where)] if self.disk.exists(where) else []
        return sorted(int(n.split("=")[1]) for n in found if n.startswith("__flush="))

    def commit(self, batch: int, flush: int) -> None:
        """Renames a flush unless its name is there: one look by name, not a listing, which grows with every flush."""
        name = f"flush-{batch:09d}-{flush:09d}"
        where = self._at(f"{self.path}/{name}")
        if not self.disk.exists(where) and not self.disk.rename(self._at(f"{self.staged(batch)}/__flush={flush}"), where):
            raise OSError(f"can't rename {name}")


def append_once(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: int = 1000, kind: str = "json", **options) -> StreamingQuery:
    """What `work` makes of a stream's rows, appended in flushes of `every` rows, in order of `key`.

    `key` is a column of the result that no two rows share. The stream runs to its end as it is now.
    """

    def write(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        ledger.drop(ledger.staged(number))
        rows = ranked(work(batch), key, "__at").withColumn("__flush", F.floor(F.col("__at") / every)).drop("__at")
        rows.repartition("__flush").sortWithinPartitions("__flush", key).write.format(kind).options(**options).partitionBy("__flush").save(ledger.staged(number))
        for flush in ledger.staged_flushes(number):
            ledger.commit(number, flush)
        ledger.drop(ledger.staged(number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str, schema: str, kind: str = "json", **options) -> DataFrame:
    """The rows of all flushes, with the name of each row's flush; none where nothing was appended yet."""
    names = sorted(Ledger(spark, path).names())
    if not names:
        return spark.createDataFrame([], schema).withColumn("flush", F.lit(""))
    rows = spark.read.format(kind).schema(schema).options(**options).load(f"{path.rstrip('/')}/flush-*")
    return rows.withColumn("flush", F.regexp_extract(F.col("_metadata.file_path"), r"(flush-\d+-\d+)", 1))
