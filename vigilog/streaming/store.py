"""Output tables of the analyzer: one folder per table and batch.

A repeated batch overwrites its own folders and reads only those of earlier
batches, so a retry after a failure changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vigilog import schemas

TABLES = {
    "judged": "profiler string, kind string, value string, is_new boolean",
    "alerts": schemas.ALERTS,
    "alert_messages": schemas.ALERT_MESSAGES,
    "status": schemas.STATUS,
    "exit_nodes": schemas.EXIT_NODES,
    "lists": schemas.LISTS,
}


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def folder(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def write(self, table: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder(table, batch_id))

    def read(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self.folder(table, batch_id))

    def output(self, table: str) -> DataFrame:
        """The table over all batches."""
        return self.spark.read.schema(f"{TABLES[table]}, batch_id bigint").parquet(
            f"{self.root}/{table}"
        )

    # -- profiles: new values per batch, merged now and then ------------------

    def write_profile(self, batch_id: int, new: DataFrame) -> None:
        new.write.mode("overwrite").partitionBy("profiler").parquet(
            self.folder("profile", batch_id)
        )

    def profile(
        self, before: int, base: int = 0, profilers: list[str] | None = None
    ) -> DataFrame:
        """Profile values first seen before a batch.

        ``base`` names the merged copy of all batches below it. Only folders of
        the wanted profilers are read.
        """
        reader = self.spark.read.schema(schemas.PROFILE)
        held = self.spark.createDataFrame([], schemas.PROFILE)
        if base:
            held = reader.parquet(f"{self.root}/merged/upto={base}")
        if before > base:
            since = [self.folder("profile", b) for b in range(base, before)]
            added = reader.option("basePath", f"{self.root}/profile").parquet(*since)
            held = held.unionByName(added.select(held.columns))
        return held if profilers is None else held.filter(F.col("profiler").isin(profilers))

    def merge_profile(self, before: int, base: int) -> None:
        """Merged copy of all batches below ``before``, from the last one and since."""
        self.profile(before, base).write.mode("overwrite").partitionBy("profiler").parquet(
            f"{self.root}/merged/upto={before}"
        )

    # -- status: the running counts, carried from batch to batch --------------

    def previous_status(self, batch_id: int) -> dict[str, Row]:
        """Status after the batch before, one row per profiler.

        Refuses a store that does not belong to the stream's checkpoint.
        """
        if batch_id == 0:
            try:
                last = self.output("status").agg(F.max("batch_id").alias("b")).first()
            except AnalysisException:
                return {}
            if last and last.b:
                raise RuntimeError(f"{self.root} holds later batches of another checkpoint")
            return {}
        try:
            rows = self.read("status", batch_id - 1).collect()
        except AnalysisException as missing:
            raise RuntimeError(
                f"{self.root} lacks batch {batch_id - 1}: not the store of this checkpoint"
            ) from missing
        return {r.profiler: r for r in rows}
