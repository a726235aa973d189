"""Declared facts about tables: what Parquet files cannot say themselves.

A catalog has tables (type, engine, primary_key, unique keys, indexes, triggers, grants, columns) and
foreign keys. What is not declared is read from the store: column names, types and nullability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kinfold.sources.store import Store

COLUMNS = "table string, name string, position int, type string, nullable boolean, generated boolean, charset string, collation string"
KEYS = "table string, columns array<string>"
FOREIGN_KEYS = "name string, child string, columns array<string>, parent string, ref array<string>, on_delete string"


@dataclass
class TableFacts:
    type: str = "BASE TABLE"
    engine: str = "parquet"
    primary_key: list[str] | None = None
    unique: list[dict] = field(default_factory=list)  # columns, and optionally prefix lengths, expression, collation
    indexes: list[list[str]] = field(default_factory=list)
    triggers: list[dict] = field(default_factory=list)  # name, event, order
    grants: list[str] = field(default_factory=lambda: ["SELECT", "INSERT", "DELETE"])
    columns: list[dict] = field(default_factory=list)


class Catalog:
    """Facts of one side. Each is gathered once; an error in gathering it is met again each time it is asked for."""

    def __init__(self, store: Store, declared: dict | None = None):
        self.store, self.spark, self.declared = store, store.spark, declared or {}
        self._errors: dict[str, Exception] = {}

    def _once(self, name: str, make):
        if name in self._errors:
            raise self._errors[name]
        if name not in self.__dict__.setdefault("_facts", {}):
            try:
                self._facts[name] = make()
            except Exception as e:
                self._errors[name] = e
                raise
        return self._facts[name]

    @property
    def complete(self) -> bool:
        """Whether all foreign keys are sure to be declared."""
        return bool(self.declared.get("complete", True))

    def unseen(self, tables: list[str]) -> list[str]:
        """Tables other than these whose foreign keys nothing is known of: all of them, where none are declared."""
        known = "foreign_keys" in self.declared or self.declared.get("complete") is not None
        return [] if known else sorted(self.tables.keys() - set(tables))

    @property
    def tables(self) -> dict[str, TableFacts]:
        def make() -> dict[str, TableFacts]:
            own = self.declared.get("tables") or {}
            return {t: TableFacts(**(own.get(t) or {})) for t in {*self.store.tables(), *own} if not t.startswith("_log_")}

        return self._once("tables", make)

    @property
    def foreign_keys(self) -> list[dict]:
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        return self._once("foreign_keys", lambda: [{"name": f.get("name") or f"{f['child']}_{i}", "child": f["child"], "columns": as_list(f["columns"]), "parent": f["parent"], "ref": as_list(f["ref"]), "on_delete": (f.get("on_delete") or "NO ACTION").upper()} for i, f in enumerate(self.declared.get("foreign_keys") or [])])

    def columns_of(self, table: str) -> list[dict]:
        def make() -> list[dict]:
            said = {c["name"]: c for c in self.tables[table].columns if "name" in c} if table in self.tables else {}
            known = self.store.table(table).schema if table in self.store.tables() else []
            rows = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in known] or list(said.values())
            base = {"generated": False, "charset": "", "collation": "", "nullable": True}
            return [base | r | said.get(r["name"], {}) | {"position": i} for i, r in enumerate(rows)]

        return self._once(f"columns of {table}", make)

    def column_rows(self, tables: list[str]) -> DataFrame:
        rows = [(t, c["name"], c["position"], c["type"], c["nullable"], c["generated"], c["charset"], c["collation"]) for t in tables for c in self.columns_of(t)]
        return self.spark.createDataFrame(rows, COLUMNS)

    def foreign_key_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(f["name"], f["child"], f["columns"], f["parent"], f["ref"], f["on_delete"]) for f in self.foreign_keys], FOREIGN_KEYS)


def table_rows(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "table string")


__all__ = ["Catalog", "TableFacts", "table_rows"]
