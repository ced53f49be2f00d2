"""The pause flag of a run: one small JSON row on shared storage."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SCHEMA = "pause boolean, status string"


class Control:
    """Pause only a running run, resume only a paused one.

    Each change writes a new numbered folder and the highest number counts, so a
    reader never sees a half-replaced file.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def read(self) -> tuple[bool, str]:
        """Flag and status; absent or unreadable means running and not paused."""
        try:
            rows = self.spark.read.schema(_SCHEMA + ", change bigint").json(self.path)
            row = rows.filter(F.col("pause").isNotNull()).orderBy(F.desc("change")).first()
        except PySparkException:
            row = None
        return (bool(row["pause"]), row["status"] or "running") if row else (False, "running")

    def pause_requested(self) -> bool:
        return self.read()[0]

    def _write(self, pause: bool, status: str) -> None:
        try:
            last = self.spark.read.schema("change bigint").json(self.path).agg(F.max("change")).first()[0]
        except PySparkException:
            last = None
        change = (last or 0) + 1
        row = self.spark.range(1).select(F.lit(pause).alias("pause"), F.lit(status).alias("status"))
        row.coalesce(1).write.json(f"{self.path}/change={change}")

    def mark(self, status: str) -> None:
        """Records a status; the flag stays as it is."""
        self._write(self.pause_requested(), status)

    def pause(self) -> None:
        if self.read()[1] != "running":
            raise ValueError("only a running job can be paused")
        self._write(True, "running")

    def resume(self) -> None:
        if self.read()[1] != "paused":
            raise ValueError("only a paused job can be resumed")
        self._write(False, "running")
