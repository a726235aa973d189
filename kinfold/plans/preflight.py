"""The ordered rules that a job must pass before it touches anything."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinfold.functions.predicates import fold_equal
from kinfold.graph import Graph
from kinfold.operators import audit
from kinfold.operators.purge import key_uniqueness
from kinfold.plans.catalog import Catalog, table_rows

FULL, NON_DESTRUCTIVE, SOURCE_ONLY = "full", "non-destructive", "source-only"
ENGINES = ("parquet", "innodb")
UNIQUE = "table string, parts array<struct<column:string,prefix:int,expression:string,collation:string>>"


@dataclass(frozen=True)
class Finding:
    check: str
    severity: str
    table: str
    detail: str


class PreflightError(RuntimeError):
    def __init__(self, check: str, findings: list[Finding]):
        self.check, self.findings = check, findings
        super().__init__(f"{check}: " + "; ".join(f"{f.table}: {f.detail}" if f.table else f.detail for f in findings))


@dataclass
class Preflight:
    graph: Graph
    source: Catalog
    destination: Catalog | None = None
    profile: str = FULL
    force_triggers: bool = False
    fk_visibility: bool = True
    #: Whether rows will be deleted now; a look ahead only warns where foreign keys may be unseen.
    deletes: bool = False
    digest_verified: bool = False
    measure_keys: bool = True
    writable: Callable[[str], bool] = lambda side: True
    job_schema: str = ""
    warnings: list[Finding] = field(default_factory=list)

    # -- rules, in their order; each yields findings -------------------------------------------------

    def tables_exist(self, side: Catalog | None = None, check: str = "TABLE_EXISTENCE_CHECK") -> Iterator[Finding]:
        side = side or self.source
        spark = side.spark
        gone = audit.missing_tables(table_rows(spark, list(self.graph.keys)), table_rows(spark, list(side.tables)))
        for r in gone.orderBy("table").collect():  # as many rows as the graph has tables, at most
            yield Finding(check, "fatal", r.table, "table is missing")
        for t in self.graph.keys:
            if t in side.tables and side.tables[t].type.upper() != "BASE TABLE":
                yield Finding(check, "fatal", t, f"is a {side.tables[t].type}, not a base table")

    def key_columns(self) -> Iterator[Finding]:
        for exact in (False, True):
            for t, key in self.graph.keys.items():
                names = [c["name"] for c in self.source.columns_of(t)]
                if key is None or key in names:
                    continue
                other = [n for n in names if fold_equal(n, key)]
                if other and not exact:
                    yield Finding("PK_COLUMN_CASE_CHECK", "fatal", t, f"key is spelled {other[0]!r}, configured as {key!r}")
                elif not other and exact:
                    yield Finding("PK_COLUMN_CHECK", "fatal", t, f"no column {key!r}")

    def single_keys(self) -> Iterator[Finding]:
        own = {t: self.source.tables[t].primary_key for t in self.graph.keys}
        for t, key in own.items():
            if key is not None and len(key) > 1:
                yield Finding("COMPOSITE_PK_CHECK", "fatal", t, f"the key has {len(key)} columns")
        for t, key in own.items():
            want = self.graph.keys[t]
            if want is None:
                continue
            if key is not None and not key:
                yield Finding("PRIMARY_KEY_CHECK", "fatal", t, "the table has no key")
            elif key is not None and len(key) == 1 and key[0] != want:
                yield Finding("PRIMARY_KEY_CHECK", "fatal", t, f"the key is {key[0]!r}, configured as {want!r}")
            elif key is None and self.measure_keys:
                r = key_uniqueness(self.source.store.table(t), want).first()
                if r.null_keys or r.distinct_keys != r.rows:
                    yield Finding("PRIMARY_KEY_CHECK", "fatal", t, f"{want!r} is not a key: {r.rows} rows, {r.distinct_keys} keys, {r.null_keys} nulls")

    def root_key_type(self) -> Iterator[Finding]:
        t, key = self.graph.root, self.graph.keys[self.graph.root]
        kind = self.source.store.table(t).schema[key].dataType
        if not (isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)):
            yield Finding("ROOT_PK_TYPE_UNSUPPORTED", "fatal", t, f"the root key is {kind.simpleString()}, not an integer")

    def engines(self) -> Iterator[Finding]:
        for t in self.graph.keys:
            if (e := self.source.tables[t].engine).lower() not in ENGINES:
                yield Finding("STORAGE_ENGINE_CHECK", "fatal", t, f"engine {e!r} is not supported")

    def job_schema_writable(self) -> Iterator[Finding]:
        if self.job_schema and not self.writable("state"):
            yield Finding("JOB_SCHEMA_PERMISSION_CHECK", "fatal", "", f"{self.job_schema!r} cannot be written")

    def destination_tables(self) -> Iterator[Finding]:
        yield from self.tables_exist(self.destination, "DEST_TABLE_EXISTENCE_CHECK")

    def destination_schema(self) -> Iterator[Finding]:
        check, a, b, tables = "DEST_SCHEMA_COMPATIBILITY_CHECK", self.source, self.destination, list(self.graph.keys)
        for t in tables:
            x, y = a.tables[t].primary_key, b.tables[t].primary_key
            if x is not None and y is not None and x != y:
                yield Finding(check, "fatal", t, f"keys differ: {x} and {y}")
        part = lambda p: (p, None, None, None) if isinstance(p, str) else (p.get("column"), p.get("prefix"), p.get("expression"), p.get("collation"))
        unique = lambda c: c.spark.createDataFrame([(t, [part(p) for p in u["columns"]]) for t in tables for u in c.tables[t].unique], UNIQUE)
        for r in audit.stricter_uniques(unique(a), unique(b)).orderBy("table").collect():
            yield Finding(check, "fatal", r.table, f"only the destination has a unique key on {[p.column or p.expression for p in r.parts]}")
        diff = audit.with_severity(audit.schema_diff(a.column_rows(tables), b.column_rows(tables)), self.digest_verified)
        for r in audit.first_fatal(diff).orderBy("table").collect():
            yield Finding(check, "fatal", r.table, f"{r.name}: {r.kind} ({r.source} and {r.destination})")
        for r in diff.filter("severity = 'warning'").orderBy("table", "position").collect():
            self.warnings.append(Finding(check, "warning", r.table, f"{r.name}: {r.kind} ({r.source} and {r.destination})"))

    def destination_writable(self) -> Iterator[Finding]:
        yield from self._grants(self.destination, "INSERT", "DEST_WRITE_PERMISSION_CHECK", "destination")

    def destination_triggers(self) -> Iterator[Finding]:
        yield from self._triggers(self.destination, "INSERT", "DEST_INSERT_TRIGGER_CHECK")

    def fk_indexes(self) -> Iterator[Finding]:
        c = self.source
        rows = [(t, i) for t in self.graph.keys for i in [*c.tables[t].indexes, *([c.tables[t].primary_key] if c.tables[t].primary_key else [])]]
        if not any(c.tables[t].indexes for t in self.graph.keys):
            return  # no index is declared at all: Parquet has none
        inside = c.foreign_key_rows().join(table_rows(c.spark, list(self.graph.keys)).withColumnRenamed("table", "child"), "child", "left_semi")
        for r in audit.unindexed_foreign_keys(inside, c.spark.createDataFrame(rows, "table string, columns array<string>")).orderBy("child", "name").collect():
            yield Finding("FK_INDEX_CHECK", "fatal", r.child, f"foreign key {r.name!r} has no index")

    def fk_visible(self) -> Iterator[Finding]:
        if self.fk_visibility and not self.source.complete:
            yield Finding("FK_COVERAGE_VISIBILITY_CHECK", "fatal", "", "not all foreign keys are sure to be declared")
        if self.fk_visibility and (outside := self.source.unseen(list(self.graph.keys))):
            found = Finding("FK_COVERAGE_VISIBILITY_CHECK", "fatal" if self.deletes else "warning", "", f"no foreign keys are declared, so {', '.join(outside)} may refer to the job's tables; archive and purge refuse that")
            self.warnings += [] if self.deletes else [found]
            yield found

    def fk_coverage(self) -> Iterator[Finding]:
        c = self.source
        for r in audit.external_children(c.foreign_key_rows(), table_rows(c.spark, list(self.graph.keys))).orderBy("parent").collect():
            yield Finding("FK_COVERAGE_CHECK", "fatal", r.parent, f"tables outside of the job refer to it: {', '.join(r.children)}")

    def internal_fks(self) -> Iterator[Finding]:
        if not self.graph.edges:
            return
        for r in audit.internal_fk_audit(self.source.foreign_key_rows(), self.graph.edge_rows(self.source.spark)).orderBy("child", "name").collect():
            yield Finding("INTERNAL_FK_COVERAGE", "fatal", r.child, f"foreign key {r.name!r} to {r.parent!r}: {r.problem}")

    def source_readable(self) -> Iterator[Finding]:
        yield from self._grants(self.source, "SELECT", "SOURCE_SELECT_PERMISSION_CHECK", None)

    def source_deletable(self) -> Iterator[Finding]:
        yield from self._grants(self.source, "DELETE", "SOURCE_DELETE_PERMISSION_CHECK", "source")

    def delete_triggers(self) -> Iterator[Finding]:
        if not self.force_triggers:
            yield from self._triggers(self.source, "DELETE", "DELETE_TRIGGER_CHECK")

    def warn_cascades(self) -> Iterator[Finding]:
        c, mine = self.source, table_rows(self.source.spark, list(self.graph.keys))
        side = lambda end: c.foreign_key_rows().join(mine.withColumnRenamed("table", end), end, "left_semi")
        for r in audit.cascade_edges(side("child"), side("parent")).orderBy("child", "name").collect():
            self.warnings.append(Finding("CASCADE_RULE", "warning", r.child, f"foreign key {r.name!r} to {r.parent!r} cascades"))
        return iter(())

    def _grants(self, side: Catalog, grant: str, check: str, write: str | None) -> Iterator[Finding]:
        for t in self.graph.keys:
            if grant not in [g.upper() for g in side.tables[t].grants]:
                yield Finding(check, "fatal", t, f"{grant} is not granted")
        if write and not self.writable(write):
            yield Finding(check, "fatal", "", f"the {write} folder cannot be written")

    def _triggers(self, side: Catalog, event: str, check: str) -> Iterator[Finding]:
        rows = [(t, x["name"], int(x.get("order", i))) for t in self.graph.keys for i, x in enumerate(side.tables[t].triggers) if x["event"].upper() == event]
        if rows:
            for r in audit.first_triggers(side.spark.createDataFrame(rows, "table string, name string, firing int")).orderBy("table").collect():
                yield Finding(check, "fatal", r.table, f"trigger {r.name!r} fires on {event}")

    def stages(self) -> list[Callable[[], Iterator[Finding]]]:
        dest, destructive = self.profile != SOURCE_ONLY, self.profile in (FULL, SOURCE_ONLY)
        return [
            self.tables_exist, self.key_columns, self.single_keys, self.root_key_type, self.engines, self.job_schema_writable,
            *([self.destination_tables, self.destination_schema, self.destination_writable, self.destination_triggers] if dest else []),
            self.fk_indexes, self.fk_visible, self.fk_coverage, self.internal_fks, self.source_readable,
            *([self.source_deletable, self.delete_triggers, self.warn_cascades] if destructive else []),
        ]

    def run(self) -> list[Finding]:
        """Stop at the first rule that finds something fatal; return the warnings."""
        for rule in self.stages():
            found = [f for f in rule() if f.severity == "fatal"]
            if found:
                first = found[0].check
                raise PreflightError(first, [f for f in found if f.check == first])
        return self.warnings

    def findings(self) -> DataFrame:
        """check, severity, table, detail: the first rule that fails, or the warnings."""
        try:
            rows = self.run()
        except PreflightError as e:
            rows = [*e.findings, *self.warnings]
        return self.source.spark.createDataFrame([(f.check, f.severity, f.table, f.detail) for f in rows], "check string, severity string, table string, detail string")


__all__ = ["FULL", "NON_DESTRUCTIVE", "SOURCE_ONLY", "Finding", "Preflight", "PreflightError"]
