"""The trail of what was done: a stream of activities is appended in batches, each once, and runs are kept up to date.

A batch's rows are written to a folder of its number, and then the table of runs is changed together with the note that the
batch is in (``versioned``). A batch that comes again, after a failure at any point, writes the same folder, finds its note
and changes nothing; readers see the batches that are noted, and so never half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelumen.sources.versioned import VersionedTable

#: Fixed value: characters of a task that are kept.
TASK_CHARS = 300
ACTIVITIES = "event_id string, run_id string, agent_id string, user_id string, action string, task string, brand string, status string, created_at timestamp"


def cleaned(activities: DataFrame) -> DataFrame:
    """ACTIVITIES as the trail has them: a task trimmed and cut, its own run where none is named, ``completed`` where no status is, and its day. Rows without an id are left out."""
    return activities.where("event_id IS NOT NULL").select(
        "event_id", F.coalesce("run_id", "event_id").alias("run_id"), "agent_id", "user_id", "action", F.substring(F.trim(F.coalesce("task", F.lit(""))), 1, TASK_CHARS).alias("task"), "brand",
        F.coalesce("status", F.lit("completed")).alias("status"), "created_at", F.date_format("created_at", "yyyy-MM-dd").alias("day"),
    )


def _runs(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(run_id, agent_id, brand, status, started_at, updated_at, events): each run with its latest status."""
    by = F.struct("created_at", "event_id")
    new = rows.groupBy("run_id").agg(F.min_by("agent_id", by).alias("agent_id"), F.max("brand").alias("brand"), F.max_by("status", by).alias("status"), F.min("created_at").alias("started_at"), F.max("created_at").alias("updated_at"), F.count(F.lit(1)).alias("events"))
    if known is None:
        return new
    late = F.struct("updated_at", "status")
    both = known.unionByName(new).groupBy("run_id").agg(F.min_by("agent_id", "started_at").alias("agent_id"), F.max("brand").alias("brand"), F.max_by("status", late).alias("status"), F.min("started_at").alias("started_at"), F.max("updated_at").alias("updated_at"), F.sum("events").alias("events"))
    return both


class Trail:
    """A trail in ``folder``; ``name`` tells the sources apart that write to it, and a stream's own id, which its checkpoint keeps, its batches.

    A stream that goes on from its checkpoint adds nothing twice; one that begins anew under another checkpoint tells its
    events again.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "trail") -> None:
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.runs = VersionedTable(spark, f"{self.folder}/runs")

    def write(self, rows: DataFrame, batch: int) -> None:
        """One batch; for ``foreachBatch``. Events that repeat within a batch count once."""
        source = f"{self.name}-{rows.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId') or 'batches'}"
        path = f"{self.folder}/events/{source}-{batch:012d}"
        if batch in self.runs.current().about.get(source, []):
            return
        cleaned(rows).dropDuplicates(["event_id"]).write.mode("overwrite").parquet(path)

        def make(known: DataFrame | None, about: dict) -> tuple[DataFrame, dict] | None:
            noted = about.get(source, [])
            if batch in noted:
                return None
            return _runs(self.spark.read.parquet(path), known), {**about, source: [*noted, batch]}

        self.runs.change(make)

    def events(self) -> DataFrame | None:
        """The rows of all batches that are in; None before the first."""
        paths = [f"{self.folder}/events/{source}-{b:012d}" for source, batches in sorted(self.runs.current().about.items()) for b in batches]
        return self.spark.read.parquet(*paths) if paths else None

    def start(self, activities: DataFrame, checkpoint: str) -> object:
        """Take in all that a stream of ACTIVITIES has, and end."""
        write: Callable[[DataFrame, int], None] = self.write
        return activities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
