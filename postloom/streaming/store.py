"""Tables of batches: what a batch writes replaces what an earlier try of it wrote, and reads are bounded by a batch."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Store:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def batch_path(self, table: str, batch_id: int, request: str | None = None) -> str:
        path = f"{self.path(table)}/batch={batch_id}"
        return path if request is None else f"{path}/request={request}"

    def write(self, df: DataFrame, table: str, batch_id: int, request: str | None = None) -> None:
        df.write.mode("overwrite").parquet(self.batch_path(table, batch_id, request))

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """The rows of ``table``, or of its batches before ``before``; null when nothing is stored."""
        try:
            df = self.spark.read.parquet(self.path(table))
        except AnalysisException as e:      # the table does not exist before its first batch
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return df if before is None else df.filter(F.col("batch") < before)

    def read_batch(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(self.batch_path(table, batch_id))
