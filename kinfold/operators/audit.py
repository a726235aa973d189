"""Audits over facts about tables: joins of what is declared with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_tables(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present, "table", "left_anti")


def internal_fk_audit(foreign_keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Foreign keys within the graph against its edges: name, child, parent, problem.

    foreign_keys: name, child, columns, parent, ref; edges: parent, child, fk, ref. A table's foreign key
    to itself is left out.
    """
    tables = edges.select(F.col("parent").alias("t")).union(edges.select("child")).distinct()
    inside = foreign_keys.filter("child <> parent").join(tables.select(F.col("t").alias("child")), "child", "left_semi").join(tables.select(F.col("t").alias("parent")), "parent", "left_semi")
    e = edges.select("parent", "child", F.col("fk").alias("edge_fk"), F.col("ref").alias("edge_ref"))
    both = inside.join(e, ["parent", "child"], "left")
    problem = (
        F.when(F.col("edge_fk").isNull(), "undeclared").when(F.size("columns") > 1, "composite")
        .when(F.element_at("columns", 1) != F.col("edge_fk"), "other column").when(F.element_at("ref", 1) != F.col("edge_ref"), "other key")
    )
    return both.select("name", "child", "parent", problem.alias("problem")).filter("problem is not null")


def external_children(foreign_keys: DataFrame, tables: DataFrame) -> DataFrame:
    """parent, children: tables outside of the graph that refer into it, which a delete would break."""
    out = foreign_keys.join(tables.select(F.col("table").alias("parent")), "parent", "left_semi").join(tables.select(F.col("table").alias("child")), "child", "left_anti")
    return out.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def cascade_edges(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cascading foreign keys met from either side, each once."""
    return outgoing.unionByName(incoming).filter("on_delete = 'CASCADE'").dropDuplicates(["child", "name"])


def schema_diff(source: DataFrame, destination: DataFrame) -> DataFrame:
    """table, name, kind, source, destination: one row for each difference of a column.

    Columns: table, name, position, type, nullable, generated, charset, collation.
    """
    cols = ["position", "type", "nullable", "generated", "charset", "collation"]
    a = source.select("table", "name", *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    b = destination.select("table", "name", *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    both = a.join(b, ["table", "name"], "full")
    text = lambda side, c: F.col(f"{side}_{c}").cast("string")
    here = F.col("in_a") & F.col("in_b")
    pair = lambda kind, c, cond: F.when(cond, F.struct(F.lit(kind).alias("kind"), text("a", c).alias("source"), text("b", c).alias("destination")))
    differs = lambda c: here & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    plain = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), r"^((?:tiny|small|medium|big)?int)\(\d+\)", "$1")
    rows = F.array_compact(F.array(
        pair("absent in destination", "type", F.col("in_b").isNull()), pair("absent in source", "type", F.col("in_a").isNull()), pair("order", "position", differs("position")),
        pair("type", "type", here & ~plain("a_type").eqNullSafe(plain("b_type"))), pair("nullable", "nullable", differs("nullable")),
        pair("generated", "generated", here & F.col("b_generated")), pair("charset", "charset", differs("charset")), pair("collation", "collation", differs("collation")),
    ))
    return both.withColumn("position", F.coalesce("a_position", "b_position")).select("table", "name", "position", F.explode(rows).alias("d")).select("table", "name", "position", "d.*")


def with_severity(diff: DataFrame, digest_verified: bool) -> DataFrame:
    """fatal, warning or ignored. The destination may be looser than the source, never stricter; a kind that is not known is fatal."""
    sev = (
        F.when(F.col("kind") == "nullable", F.when((F.col("source") == "true") & (F.col("destination") == "false"), "fatal").otherwise("ignored"))
        .when(F.col("kind") == "charset", F.lit("warning" if digest_verified else "fatal")).when(F.col("kind") == "collation", "warning").otherwise("fatal")
    )
    return diff.withColumn("severity", sev)


def first_fatal(diff: DataFrame) -> DataFrame:
    """The first fatal difference of each table, generated columns before all others."""
    w = Window.partitionBy("table").orderBy((F.col("kind") != "generated").cast("int"), "position", "kind", "name")
    return diff.filter("severity = 'fatal'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def stricter_uniques(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Unique keys of the destination that the source does not have, whatever their names: compared as sets of parts.

    table, parts (array of structs column, prefix, expression, collation).
    """
    sorted_ = lambda df: df.select("table", F.array_sort("parts").alias("parts"))
    return sorted_(destination).distinct().join(sorted_(source).distinct(), ["table", "parts"], "left_anti")


def unindexed_foreign_keys(foreign_keys: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys whose columns lead no index. indexes: table, columns."""
    i = indexes.select(F.col("table").alias("child"), F.col("columns").alias("by"))
    cond = (foreign_keys["child"] == i["child"]) & (F.slice(i["by"], 1, F.size(foreign_keys["columns"])) == foreign_keys["columns"])
    return foreign_keys.join(i, cond, "left_anti")


def first_triggers(triggers: DataFrame) -> DataFrame:
    """The first trigger to fire for each table. triggers: table, name, firing."""
    w = Window.partitionBy("table").orderBy("firing", "name")
    return triggers.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def in_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    counts = edges.groupBy(F.col("child").alias("table")).agg(F.countDistinct("parent").alias("in_degree"))
    return nodes.join(counts, "table", "left").select("table", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
