"""Job states and the log of root keys, kept with the destination's store and committed with it.

The log is a table of events (root_key, status, error, at): a key's status is that of its latest event, so
changing the status of a batch adds rows in proportion to the batch.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.closure import numbered
from kinfold.sources.store import Change, Store, StoreError

PENDING, COPIED, COMPLETED, FAILED = 0, 1, 2, 3
IDLE, RUNNING, JOB_FAILED = 0, 1, 2
STALE_SECONDS = 60
EVENTS = "root_key string, status int, error string, at long"


class ResumeError(RuntimeError):
    pass


def log_name(job: str) -> str:
    from kinfold.functions.predicates import safe_name

    return f"_log_{safe_name(job)}"


def current(events: DataFrame) -> DataFrame:
    """root_key, status, error: the latest event of each key."""
    last = F.max_by(F.struct("status", "error"), F.col("at"))
    return events.groupBy("root_key").agg(last.alias("s")).select("root_key", "s.status", "s.error")


def replay_order(log: DataFrame) -> DataFrame:
    """Keys are stored as text and ordered as numbers."""
    return log.orderBy(F.col("root_key").cast("decimal(20,0)"))


def replay_positions(log: DataFrame) -> DataFrame:
    """root_key, position: the place of every key in the order of replay, from 1."""
    rows = log.select("root_key", F.col("root_key").cast("decimal(20,0)").alias("k"))
    return numbered(rows, "k").select("root_key", F.col("i").alias("position"))


def recovery_runs(log: DataFrame) -> DataFrame:
    """run, status, rows, first_key, last_key: copied and pending keys as ascending runs of one status.

    Two neighbours belong to one run if no key of the other status lies between them: gaps and islands. The
    places of a key among all keys and among those of its status grow together along a run, so that runs are
    groups of one difference; places are counted in ranges, not in one task.
    """
    key = F.col("root_key").cast("decimal(20,0)")
    rows = log.filter(F.col("status").isin(PENDING, COPIED)).select(key.alias("k"), "status")
    placed = numbered(rows, "k").withColumnRenamed("i", "place")
    each = [numbered(placed.filter(F.col("status") == s), "k") for s in (PENDING, COPIED)]
    runs = each[0].unionByName(each[1]).groupBy("status", (F.col("place") - F.col("i")).alias("d")).agg(F.count("*").alias("rows"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))
    return numbered(runs.drop("d"), "first_key").select(F.col("i").alias("run"), "status", "rows", "first_key", "last_key")


def nonterminal(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status").isin(PENDING, COPIED, FAILED))


def status_breakdown(log: DataFrame) -> DataFrame:
    name = F.when(F.col("status") == PENDING, "pending").when(F.col("status") == COPIED, "copied").when(F.col("status") == COMPLETED, "completed").when(F.col("status") == FAILED, "failed").otherwise("unknown")
    return log.groupBy("status").agg(F.count("*").alias("rows")).select("status", name.alias("meaning"), "rows")


def heartbeat_age(jobs: DataFrame, now) -> DataFrame:
    """Adds age_seconds and stale: no heartbeat, or one older than STALE_SECONDS."""
    age = F.timestamp_diff("SECOND", F.col("last_heartbeat_at"), now)
    return jobs.withColumn("age_seconds", age).withColumn("stale", F.coalesce(F.col("age_seconds") > STALE_SECONDS, F.lit(True)))


def same_root(jobs: DataFrame, root_table: str, job: str) -> DataFrame:
    return jobs.filter((F.col("root_table") == root_table) & (F.col("job_status") == RUNNING) & (F.col("job_name") != job))


def orphaned_logs(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """Log tables whose job is gone."""
    names = jobs.select(F.concat(F.lit("_log_"), F.regexp_replace("job_name", "[^A-Za-z0-9_-]", "_")).alias("table"))
    return catalog.filter(F.col("table").startswith("_log_")).join(names, "table", "left_anti")


@dataclass
class Tracker:
    """One job's state in a store."""

    store: Store
    job: str

    def open(self, root_table: str, kind: str) -> dict:
        """The job's row, made if there is none. A name keeps the kind of job it began with."""
        row = self.store.job(self.job)
        if row and row["job_type"] != kind:
            raise ResumeError(f"job {self.job!r} was started as {row['job_type']!r} and cannot run as {kind!r}")
        if row and row["root_table"] != root_table:
            raise ResumeError(f"job {self.job!r} works on {row['root_table']!r}, not {root_table!r}")
        row = row or {"job_name": self.job, "root_table": root_table, "job_type": kind, "checkpoint": None, "created_at": time.time()}
        row |= {"job_status": RUNNING, "last_heartbeat_at": time.time(), "updated_at": time.time()}
        changes = {} if log_name(self.job) in self.store.tables() else {log_name(self.job): Change(create=self.store.spark.createDataFrame([], EVENTS))}
        self.store.commit(changes, {self.job: row})
        return row

    @property
    def row(self) -> dict:
        if (row := self.store.job(self.job)) is None:
            raise StoreError(f"job {self.job!r} is unknown")
        return row

    @property
    def _name(self) -> str:
        """The job's name, if the store knows it."""
        return self.row["job_name"]

    @property
    def checkpoint(self) -> int | None:
        return int(c) if (c := self.row["checkpoint"]) not in (None, "") else None

    def log(self) -> DataFrame:
        return current(self.store.table(log_name(self.job)))

    def keys(self, *status: int) -> DataFrame:
        return self.log().filter(F.col("status").isin(*status)).select("root_key")

    def events(self, keys: DataFrame, status: int, error: str | None = None) -> DataFrame:
        at = F.lit(time.time_ns())
        return keys.select(F.col(keys.columns[0]).cast("string").alias("root_key"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), at.alias("at"))

    def log_pending(self, keys: DataFrame) -> None:
        """Keys that the log has already keep their status."""
        fresh = self.events(keys, PENDING).join(self.log().select("root_key"), "root_key", "left_anti")
        self.store.commit({log_name(self.job): Change(add=fresh)})

    def mark(self, keys: DataFrame, status: int, changes: dict[str, Change] | None = None, checkpoint: int | None = None, error: str | None = None) -> None:
        """Set the status of keys, and with it commit changes of tables and the checkpoint, all at once."""
        row = {"updated_at": time.time()} | ({} if checkpoint is None else {"checkpoint": str(checkpoint)})
        self.store.commit((changes or {}) | {log_name(self.job): Change(add=self.events(keys, status, error))}, {self._name: row})

    def finish(self, ok: bool) -> None:
        self.store.commit(jobs={self._name: {"job_status": IDLE if ok else JOB_FAILED, "updated_at": time.time()}})

    def heartbeat(self) -> None:
        self.store.commit(jobs={self._name: {"last_heartbeat_at": time.time()}})

    def should_resume(self) -> bool:
        return self.checkpoint is not None or not nonterminal(self.log()).isEmpty()

    def reset(self) -> None:
        """Forget the checkpoint, so that rows below it are looked at again."""
        self.store.commit(jobs={self._name: {"checkpoint": None}})
