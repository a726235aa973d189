"""The commands: archive, copy-only, purge, dry-run, validate, plan and list-jobs."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import graph as graphs
from kinfold.config import Config, validate
from kinfold.control import FileLock, HealthGate, Keepalive, LockError, Stop, may_force, wait_for_sentinel
from kinfold.operators.closure import Keys, closure, root_batch, table_counts
from kinfold.operators.copy import insert_ignore, insert_missing, needs_strict, strict_insert
from kinfold.operators.estimate import batch_count, estimate, payload, placeholders
from kinfold.operators.verify import verify
from kinfold.plans.catalog import Catalog
from kinfold.plans.preflight import FULL, NON_DESTRUCTIVE, SOURCE_ONLY, Finding, Preflight, PreflightError
from kinfold.sources.store import Change, MANY, Store
from kinfold.state import COMPLETED, COPIED, FAILED, PENDING, ResumeError, RUNNING, STALE_SECONDS, Tracker, recovery_runs, replay_order

PREVIEW = 10
HEARTBEAT_SECONDS = 15


@dataclass
class Stats:
    roots: int = 0
    batches: int = 0
    discovered: int = 0
    copied: int = 0
    verified_tables: int = 0
    deleted: int = 0
    replayed: int = 0
    stopped: bool = False
    per_table: dict[str, dict[str, int]] = field(default_factory=dict)

    def count(self, what: str, table: str, n: int) -> None:
        self.per_table.setdefault(table, {}).setdefault(what, 0)
        self.per_table[table][what] += n
        setattr(self, what, getattr(self, what) + n)


@dataclass
class Engine:
    spark: SparkSession
    config: Config
    source: Store | None = None
    destination: Store | None = None
    health: HealthGate | None = None
    stop: Stop = field(default_factory=Stop)
    on_checkpoint: Callable[[int | None, str], None] | None = None
    sleep: Callable[[float], None] = time.sleep
    #: Called with the name of each step of a batch before it runs; tests raise here to break a run off.
    step: Callable[[str], None] = lambda name: None

    def __post_init__(self) -> None:
        self.source = self.source or Store(self.spark, self.config.source.path)
        self.destination = self.destination or Store(self.spark, self.config.destination.path)
        self.log = logging.getLogger("kinfold")

    # -- commands ------------------------------------------------------------------------------------

    def archive(self, job: str, **flags) -> Stats:
        """Copy the closure, verify it, and remove it from the source."""
        return self._run(job, "archive", **flags)

    def copy_only(self, job: str, **flags) -> Stats:
        """Copy and verify the closure. Without force every destination table must be empty, even on a resume."""
        return self._run(job, "copy-only", **flags)

    def purge(self, job: str, **flags) -> Stats:
        """Remove the closure from the source without a copy."""
        return self._run(job, "purge", **flags)

    def dry_run(self, job: str) -> DataFrame:
        """position, table, rows, batches, bytes of a batch and its placeholders, after preflight."""
        g, j, p = graphs.build(self.config.job(job)), self.config.job(job), self.config.job_processing(job)
        self.preflight(job, NON_DESTRUCTIVE).run()
        tables = {t: self.source.table(t) for t in g.keys}
        counts = estimate(g, tables, j.where)
        sizes = None
        for t in g.keys:
            one = payload(tables[t], t, p.batch_size, g.keys[t], j.where if t == g.root else None)
            about = placeholders(len(tables[t].columns), p.batch_size)
            one = one.withColumn("too_many_placeholders", F.lit(about["too_many"]))
            sizes = one if sizes is None else sizes.union(one)
        root_rows = counts.filter(F.col("position") == 0).select(F.col("rows").alias("root_rows"))
        batches = F.expr(f"(root_rows + {p.batch_size - 1}) div {p.batch_size}").cast("long")
        return counts.join(F.broadcast(sizes), "table").crossJoin(F.broadcast(root_rows)).select("position", "table", "rows", batches.alias("batches"), "sample_rows", "bytes", "projected_bytes", "too_many_placeholders").orderBy("position")

    def validate(self, job: str | None = None, force_triggers: bool = False) -> DataFrame:
        """job, ok, check, table, detail for one job or all; a failing job does not keep the next from being looked at."""
        rows = []
        for name in [job] if job else sorted(self.config.jobs):
            try:
                pre = self.preflight(name, FULL, force_triggers=force_triggers)
                warnings = pre.run()
                rows.append((name, True, "", "", ""))
                rows += [(name, True, w.check, w.table, w.detail) for w in warnings]
            except PreflightError as e:
                rows += [(name, False, f.check, f.table, f.detail) for f in e.findings]
            except (graphs.GraphError, KeyError) as e:
                rows.append((name, False, "GRAPH", "", str(e)))
        return self.spark.createDataFrame(rows, "job string, ok boolean, check string, table string, detail string")

    def plan(self, job: str) -> str:
        """The tree, both orders and the edges; nothing is read but the configuration."""
        return plan_text(self.config, job)

    def list_jobs(self) -> list[tuple[str, str, int]]:
        return [(n, j.root_table, len(graphs.build(j).keys) - 1) for n, j in sorted(self.config.jobs.items())]

    def preflight(self, job: str, profile: str, force_triggers: bool = False, fk_visibility: bool = True, deletes: bool = False) -> Preflight:
        c, v = self.config, self.config.job_verification(job)
        writable = lambda side: ":" in (root := (self.source if side == "source" else self.destination).root) or os.access(root if os.path.exists(root) else os.path.dirname(root) or ".", os.W_OK)
        return Preflight(
            graphs.build(c.job(job)), Catalog(self.source, c.catalog.get("source")), None if profile == SOURCE_ONLY else Catalog(self.destination, c.catalog.get("destination")), profile,
            force_triggers, fk_visibility, deletes, v.method == "sha256" and not v.skip_verification, writable=writable, job_schema=c.destination.job_schema,
        )

    # -- one run -------------------------------------------------------------------------------------

    def _run(self, job: str, kind: str, force: bool = False, skip_preflight: bool = False, force_triggers: bool = False) -> Stats:
        validate(self.config)
        if self.config.replication.enabled and self.health is None:
            raise PreflightError("REPLICATION_CHECK", [Finding("REPLICATION_CHECK", "fatal", "", "replication is enabled, and nothing reads the state of its servers: give the engine a HealthGate")])
        if not skip_preflight:
            profile = {"archive": FULL, "copy-only": NON_DESTRUCTIVE, "purge": SOURCE_ONLY}[kind]
            for w in self.preflight(job, profile, force_triggers, kind != "copy-only", kind != "copy-only").run():
                self.log.warning("%s %s: %s", w.check, w.table, w.detail)
        if kind != "purge":
            self._check_payload(job)
        run = _Run(self, job, kind, force)
        return run.go()

    def _check_payload(self, job: str) -> None:
        """Refuse a batch whose projected rows of one table are larger than max_batch_bytes."""
        g, j, p = graphs.build(self.config.job(job)), self.config.job(job), self.config.job_processing(job)
        if not p.max_batch_bytes:
            return
        sizes = [payload(self.source.table(t), t, p.batch_size, g.keys[t], j.where if t == g.root else None) for t in g.copy_order()]
        # one row for each table
        over = reduce(DataFrame.union, sizes).filter(F.col("projected_bytes") > p.max_batch_bytes).collect()
        if over:
            what = "{} bytes projected for a batch of {}, the limit is {}; lower batch_size"
            raise PreflightError("PAYLOAD_CHECK", [Finding("PAYLOAD_CHECK", "fatal", r.table, what.format(r.projected_bytes, p.batch_size, p.max_batch_bytes)) for r in over])


def plan_text(config: Config, job: str) -> str:
    g, p = graphs.build(config.job(job)), config.job_processing(job)
    lines = [f"job {job}: {config.job(job).where}", "", g.tree(), "", f"depth: {max(g.levels().values())}", "copy order:", *[f"  {i + 1}. {t} (key {g.keys[t] or 'none'})" for i, t in enumerate(g.copy_order())]]
    lines += ["delete order:", *[f"  {i + 1}. {t}" for i, t in enumerate(g.delete_order())], "edges:", *[f"  {e.parent} -> {e.child} on {e.foreign_key} ({e.dependency})" for e in g.edges]]
    return "\n".join([*lines, f"batch_size {p.batch_size}, batch_delete_size {p.batch_delete_size}"])


class _Run:
    def __init__(self, engine: Engine, job: str, kind: str, force: bool):
        self.e, self.job, self.kind, self.force = engine, job, kind, force
        self.spec, self.graph = engine.config.job(job), graphs.build(engine.config.job(job))
        self.processing, v = engine.config.job_processing(job), engine.config.job_verification(job)
        self.method = "skip" if v.skip_verification else v.method
        self.key = self.graph.keys[self.graph.root]
        facts = Catalog(engine.destination, engine.config.catalog.get("destination"))
        self.unique = {t: [[p if isinstance(p, str) else p["column"] for p in u["columns"]] for u in facts.tables[t].unique] if kind != "purge" and t in facts.tables else [] for t in self.graph.keys}
        self.strict = needs_strict(v.method, v.skip_verification, any(self.unique.values()))
        self.tracker, self.stats = Tracker(engine.destination, job), Stats()
        self.held: list[DataFrame] = []

    def go(self) -> Stats:
        e, folder = self.e, self._lock_folder()
        startup, own = FileLock(folder, f"root_{self.graph.root}"), FileLock(folder, f"job_{self.job}")
        if not startup.acquire(wait=10):
            raise LockError(f"another job on {self.graph.root!r} is starting")
        try:
            self._check_same_root()
            free = own.acquire()
            row = e.destination.job(self.job) or {}
            stale = row.get("job_status") != RUNNING or time.time() - row.get("last_heartbeat_at", 0) > STALE_SECONDS
            if not may_force(self.kind, not free, stale, self.force):
                own.release()
                raise LockError(f"job {self.job!r} is running, or its heartbeat is less than {STALE_SECONDS} s old")
            self.tracker.open(self.graph.root, self.kind)
        finally:
            startup.release()
        lost: list[Exception] = []
        alive = Keepalive(lambda: self._beat(own), HEARTBEAT_SECONDS, lambda x: (lost.append(x), e.stop.requested.set())).start()
        ok = False
        try:
            if self.kind == "copy-only" and not self.force:
                for t in self.graph.keys:
                    if not e.destination.table(t).isEmpty():
                        raise ResumeError(f"destination table {t!r} is not empty; force copies into it all the same")
            self._recover()
            self._scan()
            if lost:
                raise LockError(f"the lock of job {self.job!r} was lost: {lost[0]}")
            ok = True
            return self.stats
        finally:
            self._release()
            alive.stop()
            self.tracker.finish(ok)
            own.release()

    def _lock_folder(self) -> str:
        """Locks exclude runs on one machine, where drivers are started; the store's version check excludes the rest."""
        root = self.e.destination.root
        return f"{root.removeprefix('file://')}/_locks" if not root.startswith(("hdfs:", "s3", "abfs", "gs:", "viewfs:")) else os.path.expanduser("~/.kinfold-locks")

    def _beat(self, lock: FileLock) -> None:
        if not lock.held():
            raise LockError("the lock file has another owner")
        self.tracker.heartbeat()

    def _hold(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist())
        return df

    def _release(self, keep: int = 0) -> None:
        while len(self.held) > keep:
            self.held.pop().unpersist()

    def _check_same_root(self) -> None:
        for name, row in self.e.destination.jobs().items():
            if name != self.job and row["root_table"] == self.graph.root and row["job_status"] == RUNNING:
                age = time.time() - row["last_heartbeat_at"]
                raise LockError(f"job {name!r} works on {self.graph.root!r} too" + ("" if age <= STALE_SECONDS else f", its heartbeat is {age:.0f} s old; if it has died, set its status to idle"))

    # -- recovery ------------------------------------------------------------------------------------

    def _recover(self) -> None:
        log = self.tracker.log()
        kind = self.e.source.table(self.graph.root).schema[self.key].dataType.simpleString()
        unread = log.filter(F.col("status") != COMPLETED).filter(F.expr(f"root_key is null or not root_key rlike '^[+-]?[0-9]+$' or try_cast(try_cast(root_key as decimal(20,0)) as {kind}) is null"))
        if bad := [r.root_key for r in unread.select("root_key").limit(PREVIEW).collect()]:
            raise ResumeError(f"job {self.job!r} has unfinished root keys that are no {kind}; for example {bad}")
        failed, copied, pending = (self._hold(log.filter(F.col("status") == s)) for s in (FAILED, COPIED, PENDING))
        some = lambda df: [r.root_key for r in replay_order(df).limit(PREVIEW).collect()]
        if first := some(failed):
            raise ResumeError(f"job {self.job!r} has failed root keys: set them to pending or completed first; for example {first}")
        a, b = some(copied), some(pending)
        if not a and not b:
            return
        if self.kind == "archive" and self.method == "count":
            raise ResumeError(f"job {self.job!r} has unfinished root keys, and counts cannot show that their copies are equal; use sha256; for example {(a + b)[:PREVIEW]}")
        if self.kind != "purge" and self.strict and b:
            raise ResumeError(f"job {self.job!r} has pending root keys that a strict insert cannot copy again; remove their copies, or verify by sha256; for example {b}")
        if self.kind == "copy-only":
            # in ascending runs of one status, so that the checkpoint never passes an unfinished key
            runs = recovery_runs(log).orderBy("run").collect()  # bounded by the batches that were in flight
            for r in runs:
                keys = (copied if r.status == COPIED else pending).filter(F.col("root_key").cast("decimal(20,0)").between(r.first_key, r.last_key))
                self._replay(keys, "promote" if r.status == COPIED else "copy", advance=True)
        else:
            self._replay(copied, "delete", advance=False)
            self._replay(pending, self._mode(), advance=False)

    def _mode(self) -> str:
        return {"archive": "full", "copy-only": "copy", "purge": "delete"}[self.kind]

    def _replay(self, log: DataFrame, mode: str, advance: bool) -> None:
        floor, after = self.tracker.checkpoint, None
        kind = self.e.source.table(self.graph.root).schema[self.key].dataType
        typed = log.select(F.col("root_key").cast("decimal(20,0)").cast(kind).alias(self.key))
        while True:
            kept = len(self.held)
            batch = self._hold(root_batch(typed, self.key, None, after, self.processing.batch_size))
            last = batch.agg(F.max(self.key)).first()[0]
            if last is None or not self._may_go_on():
                return
            self._batch(batch, mode, int(last) if advance and (floor is None or int(last) > floor) else None)
            self.stats.replayed += batch.count()
            after = int(last)
            self._release(kept)

    # -- batches -------------------------------------------------------------------------------------

    def _may_go_on(self) -> bool:
        e = self.e
        if not wait_for_sentinel(self.processing.sentinel_file, e.stop):
            self.stats.stopped = True
            return False
        if self.kind != "copy-only" and e.health:
            e.health.wait(e.stop)
        return True

    def _scan(self) -> None:
        e, first = self.e, True
        while not self.stats.stopped and self._may_go_on():
            e.source.refresh(*self.graph.keys)
            root = e.source.table(self.graph.root)
            kept = len(self.held)
            batch = self._hold(root_batch(root, self.key, self.spec.where, self.tracker.checkpoint, self.processing.batch_size))
            last = batch.agg(F.max(self.key)).first()[0]
            if last is None:
                return
            if not first and self.processing.sleep_seconds:
                e.sleep(self.processing.sleep_seconds)
            first = False
            e.step("log pending")
            self.tracker.log_pending(batch)
            self._batch(batch, self._mode(), int(last))
            self._release(kept)

    def _batch(self, roots: DataFrame, mode: str, checkpoint: int | None) -> None:
        """full: copy, verify, delete. copy: copy, verify. delete: the copies are there already, or none is wanted. promote: only complete."""
        e, g = self.e, self.graph
        found: dict[str, Keys] = {}
        changes: dict[str, Change] = {}
        source = {t: e.source.table(t) for t in g.keys}
        if mode != "promote":
            e.step("discover")
            found = {t: Keys(k.column, self._hold(k.rows)) for t, k in closure(g, source, roots).items()}
            # one row for each table
            sizes = {r.table: r.rows for r in table_counts(g, source, found).collect()}
            for t, n in sizes.items():
                self.stats.count("discovered", t, n)
        if mode in ("full", "copy"):
            e.step("copy")
            for t in g.copy_order():
                incoming, existing = found[t].of(source[t]), e.destination.table(t)
                key = None if g.keys[t] is None else [g.keys[t]]
                if key is None:
                    # only rows of the same parents can be the same
                    rows = insert_missing(incoming, found[t].of(existing))
                elif self.strict:
                    rows = strict_insert(t, incoming, existing, [key, *self.unique[t]])
                else:
                    rows = insert_ignore(incoming, existing, key, self.unique[t])
                changes[t] = Change(add=self._hold(rows))
            e.destination.commit(changes)
            added = reduce(DataFrame.union, [c.add.agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n") for t, c in changes.items()])
            for r in added.collect():
                self.stats.count("copied", r.t, r.n)
            e.step("verify")
            self.stats.verified_tables += len(verify(self.method, found, source, {t: e.destination.table(t) for t in g.keys}))
            e.step("mark copied")
            self.tracker.mark(roots, COPIED)
        if mode in ("full", "delete"):
            e.step("delete")
            if e.health:
                e.health.wait(e.stop)
            gone = {}
            for t in g.delete_order():
                self.stats.count("deleted", t, sizes[t])
                if sizes[t]:
                    gone[t] = Change(delete=found[t].rows)
            if gone:
                # all tables at once: a part of the delete cannot be seen
                e.source.commit(gone)
                if self.processing.delete_sleep_seconds:
                    e.sleep(self.processing.delete_sleep_seconds)
                if many := [t for t in gone if e.source.events(t) > MANY]:
                    e.source.compact(*many)
        e.step("complete")
        self.tracker.mark(roots, COMPLETED, checkpoint=checkpoint)
        if mode in ("full", "copy"):
            many = [t for t in g.keys if e.destination.events(t) > MANY]
            if many:
                e.destination.compact(*many)
        n = roots.count()
        self.stats.roots += n
        self.stats.batches += 1
        if e.on_checkpoint:
            try:
                e.on_checkpoint(checkpoint, "completed")
            except Exception as x:  # noqa: BLE001  a report, not a part of the batch
                self.e.log.warning("checkpoint callback failed: %s", x)


__all__ = ["Engine", "Finding", "Stats", "batch_count", "plan_text"]
