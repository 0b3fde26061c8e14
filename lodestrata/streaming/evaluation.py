"""Evaluation runs as streaming jobs: one at a time for a user, with progress from a query listener.

Questions come as a stream (files of a test set), each batch is answered and its results replace
those of the same question, so a batch that is run again counts once. A table of jobs says what has
begun and how it ended; how far a running job is comes from the listener, which hears of every batch.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.store import Store

JOBS = "user_id string, job_id string, status string, total long, done long, error string"
RUNNING, DONE, FAILED = "running", "done", "failed"


class Progress(StreamingQueryListener):
    """Rows read and the end of every named query."""

    def __init__(self):
        self.lock, self.names, self.rows, self.ended = threading.Lock(), {}, {}, {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.names[str(event.id)] = event.name
            self.rows.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.rows[event.progress.name] = self.rows.get(event.progress.name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended[self.names.get(str(event.id))] = event.exception

    def of(self, name: str) -> int:
        with self.lock:
            return self.rows.get(name, 0)


class EvaluationJobs:
    """The evaluation jobs of one user over ``store``. Close it to take its listener off the session."""

    def __init__(self, spark: SparkSession, store: Store, user_id: str):
        self.spark, self.store, self.user_id = spark, store, user_id
        self.progress, self.queries = Progress(), {}
        spark.streams.addListener(self.progress)

    def close(self) -> None:
        self.spark.streams.removeListener(self.progress)

    def _write(self, job: str, status: str, total: int | None, done: int, error: str | None) -> None:
        row = self.spark.createDataFrame([(self.user_id, job, status, total, done, error)], JOBS)
        self.store.replace("jobs", row, ["user_id", "job_id"])

    def jobs(self) -> DataFrame:
        """This user's jobs, running ones as far as the listener knows."""
        table = self.store.read("jobs")
        rows = self.spark.createDataFrame([], JOBS) if table is None else table.filter(F.col("user_id") == self.user_id)
        live = self.spark.createDataFrame([(job, self.progress.of(job)) for job in self.queries] or [("", 0)], "job_id string, _live long")
        done = F.when(F.col("status") == RUNNING, F.coalesce("_live", "done")).otherwise(F.col("done"))
        return rows.join(live, "job_id", "left").select("user_id", "job_id", "status", "total", done.alias("done"), "error")

    def start(self, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], checkpoint: str, total: int | None = None, job: str | None = None) -> str:
        """Begins a run over a stream of questions (id and what ``answer`` needs) and gives its id.

        ``answer`` gives a row per question (id and its results). A job that a lost driver left
        running is taken up by its id, from its checkpoint; another one is refused meanwhile.
        """
        busy = [r["job_id"] for r in self.jobs().filter(F.col("status") == RUNNING).collect()]  # one at most
        if any(b != job or b in self.queries for b in busy):
            raise RuntimeError(f"job {busy[0]} is running")
        job = job or uuid.uuid4().hex
        self._write(job, RUNNING, total, 0, None)

        def batch(rows: DataFrame, _: int) -> None:
            results = answer(rows).withColumn("user_id", F.lit(self.user_id)).withColumn("job_id", F.lit(job))
            self.store.replace("results", results, ["user_id", "job_id", "id"])

        self.queries[job] = questions.writeStream.queryName(job).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        return job

    def wait(self, job: str) -> str:
        """Waits for a job's end, notes it, and gives its status."""
        query, error = self.queries[job], None
        try:
            query.awaitTermination()
        except Exception as problem:
            error = str(problem).split("\n")[0][:500]
        results = self.store.read("results")
        done = 0 if results is None else results.filter((F.col("user_id") == self.user_id) & (F.col("job_id") == job)).count()
        total = self.jobs().filter(F.col("job_id") == job).first()["total"]
        del self.queries[job]
        self._write(job, DONE if error is None else FAILED, total, done, error)
        return DONE if error is None else FAILED

    def results(self, job: str) -> DataFrame:
        return self.store.read("results").filter((F.col("user_id") == self.user_id) & (F.col("job_id") == job))
