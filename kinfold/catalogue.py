"""All registered queries and the SQL that each must agree with.

The job is the tree customer -> orders -> lineitem (lineitem has no key) with a predicate on customer.
What a run would have left behind (a job log, a destination) is derived from the tables themselves.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import state
from kinfold.functions.digest import byte_size, table_digest
from kinfold.graph import Graph
from kinfold.operators import audit, cuts, digest_tree, many, measured, partition_delete, sketch_diff, unique_keys
from kinfold.operators.closure import Keys, batches, closure, discovery_stats, expand, root_batch, table_counts
from kinfold.operators.copy import conflicts, insert_ignore
from kinfold.operators.estimate import estimate, payload
from kinfold.operators.purge import delete_chunks, key_uniqueness, orphans, remaining
from kinfold.operators.verify import by_count, by_digest, row_diff
from kinfold.operators.zones import Zoned
from kinfold.sources import footers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WHERE, SIZE, AFTER = "c_nationkey = 3", 20, 500


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_graph() -> Graph:
    g = Graph("customer")
    for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", None)):
        g.add_table(t, k)
    g.add_edge("customer", "orders", "o_custkey")
    g.add_edge("orders", "lineitem", "l_orderkey")
    return g


def diamond() -> Graph:
    """nation -> customer -> orders and nation -> supplier; lineitem-like part rows hang on both sides by orders."""
    g = Graph("nation")
    for t, k in (("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("links", "link")):
        g.add_table(t, k)
    g.add_edge("nation", "customer", "c_nationkey")
    g.add_edge("nation", "supplier", "s_nationkey")
    g.add_edge("customer", "links", "custkey")
    g.add_edge("supplier", "links", "suppkey")
    return g


def diamond_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "customer", "supplier")}
    tables["links"] = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 97 + 1).alias("suppkey"))
    return tables


def job_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in job_graph().keys}


def job_closure(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, Keys]]:
    tables = job_tables(spark, sf_dir)
    return tables, closure(job_graph(), tables, root_batch(tables["customer"], "c_custkey", WHERE))


_ROOT = f"SELECT c_custkey FROM customer WHERE {WHERE}"
_ORDERS = f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({_ROOT})"
_LINES = f"l_orderkey IN ({_ORDERS})"

# -- root scans and batches ------------------------------------------------------------------------------


@query(f"{_ROOT} ORDER BY c_custkey LIMIT {SIZE}")
def root_batch_first(spark, sf_dir):
    return root_batch(table(spark, sf_dir, "customer"), "c_custkey", WHERE, limit=SIZE)


@query(f"{_ROOT} AND c_custkey > {AFTER} ORDER BY c_custkey LIMIT {SIZE}")
def root_batch_after_checkpoint(spark, sf_dir):
    return root_batch(table(spark, sf_dir, "customer"), "c_custkey", WHERE, after=AFTER, limit=SIZE)


@query("SELECT c_custkey FROM customer")
def root_batch_all(spark, sf_dir):
    return root_batch(table(spark, sf_dir, "customer"), "c_custkey", "1=1")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 2 YEAR")
def root_batch_dated(spark, sf_dir):
    """A predicate in MySQL's dialect."""
    return root_batch(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate < DATE_SUB(TIMESTAMP_NTZ'1998-08-02 00:00:00', INTERVAL 2 YEAR)")


@query(f"SELECT batch, count(*) AS rows, min(c_custkey) AS first_key, max(c_custkey) AS checkpoint FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // {SIZE} AS batch FROM customer) GROUP BY batch")
def batch_plan(spark, sf_dir):
    return batches(root_batch(table(spark, sf_dir, "customer"), "c_custkey", None), "c_custkey", SIZE)


@query(f"SELECT 'orders' AS \"table\", chunk, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 50 AS chunk FROM ({_ORDERS})) GROUP BY chunk")
def delete_chunk_plan(spark, sf_dir):
    _, found = job_closure(spark, sf_dir)
    return delete_chunks(found["orders"].rows, "o_orderkey", 50, "orders")


# -- discovery -------------------------------------------------------------------------------------------


@query(_ORDERS)
def discover_orders(spark, sf_dir):
    _, found = job_closure(spark, sf_dir)
    return found["orders"].rows


@query(f"SELECT * FROM lineitem WHERE {_LINES}")
def discover_lineitem(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return found["lineitem"].of(tables["lineitem"])


_LINKS = "SELECT o_orderkey AS link, o_custkey AS custkey, o_orderkey % 97 + 1 AS suppkey FROM orders"


@query(f"SELECT link FROM ({_LINKS}) WHERE custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7)) OR suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7))")
def discover_diamond(spark, sf_dir):
    """A table below two parents: what either leads to, each key once."""
    tables = diamond_tables(spark, sf_dir)
    found = closure(diamond(), tables, root_batch(tables["nation"], "n_nationkey", "n_nationkey IN (3, 7)"))
    return found["links"].rows


@query(f"SELECT * FROM (SELECT count(*) FILTER (n > 0) AS tables_scanned, sum(n)::BIGINT AS records_found, (max(l) FILTER (n > 0) + 1)::INT AS levels FROM (SELECT 0 AS l, (SELECT count(*) FROM ({_ROOT})) AS n UNION ALL SELECT 1, (SELECT count(*) FROM ({_ORDERS})) UNION ALL SELECT 2, (SELECT count(*) FROM lineitem WHERE {_LINES})))")
def discovery_totals(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return discovery_stats(job_graph(), tables, found)


QUERIES["discovery_stats"], ORACLE["discovery_stats"] = QUERIES.pop("discovery_totals"), ORACLE.pop("discovery_totals")

# -- estimates -------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS rows FROM ({_ROOT})")
def estimate_root(spark, sf_dir):
    return root_batch(table(spark, sf_dir, "customer"), "c_custkey", WHERE).agg(F.count("*").alias("rows"))


@query(f"SELECT count(*) AS rows FROM lineitem WHERE {_LINES}")
def estimate_chain_lineitem(spark, sf_dir):
    tables = job_tables(spark, sf_dir)
    roots = root_batch(tables["customer"], "c_custkey", WHERE)
    orders = expand(tables["orders"], "o_custkey", roots, ["o_orderkey"])
    return expand(tables["lineitem"], "l_orderkey", orders, ["l_orderkey"]).agg(F.count("*").alias("rows"))


@query(f"SELECT count(*) AS rows, ((count(*) + {SIZE - 1}) // {SIZE})::BIGINT AS batches FROM ({_ROOT})")
def estimate_batches(spark, sf_dir):
    roots = root_batch(table(spark, sf_dir, "customer"), "c_custkey", WHERE)
    return roots.agg(F.count("*").alias("rows")).withColumn("batches", F.expr(f"(rows + {SIZE - 1}) div {SIZE}"))


_ALL = f"SELECT 0 AS position, 'customer' AS \"table\", (SELECT count(*) FROM ({_ROOT})) AS rows UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM ({_ORDERS})) UNION ALL SELECT 2, 'lineitem', (SELECT count(*) FROM lineitem WHERE {_LINES})"


@query(_ALL)
def estimate_all_tables(spark, sf_dir):
    return estimate(job_graph(), job_tables(spark, sf_dir), WHERE)


@query(f"SELECT position, \"table\", position AS level, rows FROM ({_ALL})")
def closure_counts(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return table_counts(job_graph(), tables, found)


# -- copy, verification, purge: the destination has every third order already ----------------------------

_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_DEST = f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 30 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0"


def destination_orders(orders: DataFrame) -> DataFrame:
    changed = F.when(F.col("o_orderkey") % 30 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return orders.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", changed)


@query(f"SELECT {_COLS} FROM orders WHERE o_orderkey IN ({_ORDERS})")
def copy_rows_orders(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return found["orders"].of(tables["orders"])


@query(f"SELECT {_COLS} FROM orders WHERE o_orderkey IN ({_ORDERS}) AND o_orderkey NOT IN (SELECT o_orderkey FROM ({_DEST}))")
def insert_ignore_new_rows(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return insert_ignore(found["orders"].of(tables["orders"]), destination_orders(tables["orders"]), ["o_orderkey"])


_SHADOW = "SELECT c_custkey AS id, c_mktsegment || '/' || (c_custkey % 40) AS code FROM customer"


@query(f"WITH s AS ({_SHADOW}), d AS (SELECT * FROM s WHERE id % 50 = 0) SELECT min(id) AS id, code FROM s WHERE id NOT IN (SELECT id FROM d) AND code NOT IN (SELECT code FROM d) GROUP BY code")
def insert_ignore_unique(spark, sf_dir):
    """Conflicts on a second unique key, with the destination and among the incoming rows."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 40).cast("string")).alias("code"))
    return insert_ignore(s, s.filter("id % 50 = 0"), ["id"], [["code"]])


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey IN ({_ORDERS}) AND o_orderkey IN (SELECT o_orderkey FROM ({_DEST}))")
def strict_insert_conflicts(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return conflicts(found["orders"].of(tables["orders"]), destination_orders(tables["orders"]), ["o_orderkey"])


def both_sides(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    two = {t: found[t] for t in ("customer", "orders")}
    return two, tables, tables | {"orders": destination_orders(tables["orders"])}


_BOTH = f"SELECT 'customer' AS \"table\", (SELECT count(*) FROM ({_ROOT})) AS source_rows, (SELECT count(*) FROM ({_ROOT})) AS destination_rows UNION ALL SELECT 'orders', (SELECT count(*) FROM ({_ORDERS})), (SELECT count(*) FROM ({_DEST}) WHERE o_orderkey IN ({_ORDERS}))"


@query(f"SELECT *, source_rows = destination_rows AS match FROM ({_BOTH})")
def verify_count(spark, sf_dir):
    return by_count(*both_sides(spark, sf_dir))


@query(f"SELECT *, source_rows = destination_rows AS match FROM ({_BOTH})")
def verify_sha256_tables(spark, sf_dir):
    """The customers are the same on both sides, the orders are not."""
    return by_digest(*both_sides(spark, sf_dir))


@query(
    "WITH t AS (SELECT sha256(concat_ws(chr(0), 'c_acctbal=' || coalesce(c_acctbal::DECIMAL(18,2)::VARCHAR, '~'), 'c_custkey=' || c_custkey, 'c_mktsegment=' || coalesce(strlen(c_mktsegment) || ':' || c_mktsegment, '~'), 'c_name=' || coalesce(strlen(c_name) || ':' || c_name, '~'), 'c_nationkey=' || coalesce(c_nationkey::VARCHAR, '~'))) AS d FROM customer)"
    + f" SELECT rows, sha256(concat_ws(',', rows, {', '.join(f's{i}' for i in range(4))})) AS digest FROM (SELECT count(*) AS rows, {', '.join(f"sum(('0x' || substr(d, {15 * i + 1}, 15))::BIGINT)::HUGEINT AS s{i}" for i in range(4))} FROM t)"
)
def verify_sha256(spark, sf_dir):
    """The digest of a whole table; the balance as decimal text, which both engines write alike."""
    return table_digest(table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")))


@query(f"SELECT coalesce(s.o_orderkey, d.o_orderkey) AS key, CASE WHEN d.o_orderkey IS NULL THEN 'source_only' ELSE 'changed' END AS difference FROM orders s LEFT JOIN ({_DEST}) d ON s.o_orderkey = d.o_orderkey WHERE d.o_orderkey IS NULL OR s.o_totalprice <> d.o_totalprice")
def verify_row_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return row_diff(orders, destination_orders(orders), "o_orderkey")


@query(f"SELECT * FROM orders WHERE o_orderkey NOT IN ({_ORDERS})")
def purge_remaining_orders(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return remaining(tables["orders"], found["orders"])


@query(f"SELECT * FROM lineitem WHERE NOT {_LINES}")
def purge_remaining_lineitem(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    return remaining(tables["lineitem"], found["lineitem"])


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS before, (SELECT count(*) FROM {t} WHERE NOT {c}) AS left_in_source, (SELECT count(*) FROM {t} WHERE {c}) AS archived, true AS conserved" for t, c in (("customer", f"({WHERE})"), ("orders", f"o_orderkey IN ({_ORDERS})"), ("lineitem", f"({_LINES})")))
    + ")"
)
def archive_conservation(spark, sf_dir):
    tables, found = job_closure(spark, sf_dir)
    out = None
    for t in found:
        n = lambda df, name: df.agg(F.count("*").alias(name))
        one = n(tables[t], "before").crossJoin(n(remaining(tables[t], found[t]), "left_in_source")).crossJoin(n(found[t].of(tables[t]), "archived")).select(F.lit(t).alias("table"), "*")
        out = one if out is None else out.union(one)
    return out.withColumn("conserved", F.col("before") == F.col("left_in_source") + F.col("archived"))


@query(f"SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN ({_ORDERS}))")
def orphans_lineitem(spark, sf_dir):
    """What a delete of the orders alone would leave behind."""
    tables, found = job_closure(spark, sf_dir)
    return orphans(tables["lineitem"], "l_orderkey", remaining(tables["orders"], found["orders"]), "o_orderkey")


@query("SELECT * FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 200)")
def orphans_labels(spark, sf_dir):
    return orphans(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents").filter("n_chars >= 200"), "doc_id")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT {k}) AS distinct_keys, count(*) FILTER ({k} IS NULL) AS null_keys FROM {t}" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"))))
def key_measures(spark, sf_dir):
    each = [key_uniqueness(table(spark, sf_dir, t), k).select(F.lit(t).alias("table"), "*") for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    return each[0].union(each[1]).union(each[2])


QUERIES["key_uniqueness"], ORACLE["key_uniqueness"] = QUERIES.pop("key_measures"), ORACLE.pop("key_measures")

# -- file skipping, many batches, digest trees, measured keys --------------------------------------------


@query(
    "WITH k AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT greatest(1, (count(*) + 3) // 4) FROM orders WHERE o_orderstatus <> 'P') AS batch FROM orders WHERE o_orderstatus <> 'P')"
    " SELECT batch, count(*) AS rows, min(o_orderkey) AS first_key, max(o_orderkey) AS checkpoint FROM k GROUP BY batch"
)
def keyset_scan_batches(spark, sf_dir):
    """Four batches of all orders with a predicate, each from the files whose keys it needs: the table is laid out by its key first."""
    zoned = orders_by_key(spark, sf_dir)
    orders, where = table(spark, sf_dir, "orders"), "o_orderstatus <> 'P'"
    size = max(1, (orders.filter(where).count() + 3) // 4)
    found = [keys.agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("checkpoint")).first() for keys, _, _ in zoned.batches(where, size)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(found)], "batch long, rows long, first_key long, checkpoint long")


def orders_by_key(spark, sf_dir) -> Zoned:
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return Zoned.of(spark, path, "o_orderkey")


def shared_folder(spark) -> str:
    """The session's spark.checkpoint.dir; a new local folder where it is unset and the driver runs its own tasks."""
    sc = spark.sparkContext
    if not (path := sc.getConf().get("spark.checkpoint.dir")):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="kinfold-")
    return path


_LABELS = f"SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS batch FROM customer WHERE {WHERE.replace('= 3', 'IN (3, 7, 11)')}"


@query(
    f"WITH r AS ({_LABELS}), o AS (SELECT o_orderkey, batch FROM orders JOIN r ON o_custkey = c_custkey), l AS (SELECT batch FROM lineitem JOIN o ON l_orderkey = o_orderkey)"
    " SELECT batch, 0 AS position, 'customer' AS \"table\", count(*) AS rows FROM r GROUP BY batch UNION ALL SELECT batch, 1, 'orders', count(*) FROM o GROUP BY batch UNION ALL SELECT batch, 2, 'lineitem', count(*) FROM l GROUP BY batch"
)
def closure_many_batches(spark, sf_dir):
    """What each of many batches finds, by one join for each edge."""
    tables = job_tables(spark, sf_dir)
    roots = many.labelled_roots(tables["customer"].filter("c_nationkey IN (3, 7, 11)"), "c_custkey", 100)
    return many.batch_counts(job_graph(), tables, many.labelled_closure(job_graph(), tables, roots))


@query(
    f"WITH l AS ({_LINKS}), w AS (SELECT link, c_nationkey AS batch FROM l JOIN customer ON custkey = c_custkey UNION ALL SELECT link, s_nationkey FROM l JOIN supplier ON suppkey = s_suppkey)"
    " SELECT link, min(batch)::BIGINT AS batch FROM w GROUP BY link"
)
def closure_many_batches_diamond(spark, sf_dir):
    """Every nation is a batch; a link that a customer and a supplier lead to belongs to the first of their batches."""
    tables = diamond_tables(spark, sf_dir)
    roots = tables["nation"].select("n_nationkey", F.col("n_nationkey").cast("long").alias("batch"))
    return many.labelled_closure(diamond(), tables, roots)["links"]


@query(ORACLE["verify_row_diff"])
def verify_tree_diff(spark, sf_dir):
    """As verify_row_diff, going down only where digests differ."""
    orders = table(spark, sf_dir, "orders")
    shape = digest_tree.Shape.over(orders, "o_orderkey", 500)
    return digest_tree.tree_diff(orders, destination_orders(orders), "o_orderkey", shape)


_FEW = "SELECT * REPLACE (CASE WHEN o_orderkey % 700 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey % 500 <> 0"


@query(ORACLE["verify_row_diff"].replace(_DEST, _FEW))
def verify_sketch_diff(spark, sf_dir):
    """Rows that differ from a destination with few differences, peeled from two sketches of its size."""
    orders = table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 700 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return sketch_diff.sketch_diff(orders, orders.where("o_orderkey % 500 <> 0").withColumn("o_totalprice", changed), "o_orderkey")


_EARLY = "o_orderdate < TIMESTAMP '1995-01-01 00:00:00' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7) OR c_mktsegment = 'BUILDING')"


@query(
    f"WITH o AS (SELECT *, year(o_orderdate)::INT AS o_year, {_EARLY} AS gone FROM orders) SELECT o_year, count(*) AS before, count(*) FILTER (gone) AS deleted, count(*) FILTER (NOT gone) AS \"left\", count(*) FILTER (NOT gone) AS read_back,"
    " count(*) FILTER (gone) = 0 AS untouched FROM o GROUP BY o_year"
)
def purge_by_partition(spark, sf_dir):
    """A delete of early orders from a table laid out by year: counts of every year, its rows as read back, and whether its files are the ones from before."""
    orders = table(spark, sf_dir, "orders")
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    partition_delete.lay_out(orders.withColumn("o_year", F.year("o_orderdate")), path, "o_year")
    files = lambda: spark.read.parquet(path).groupBy("o_year").agg(F.count("*").alias("rows"), F.collect_set("_metadata.file_path").alias("files"))
    first = spark.createDataFrame(files().collect(), "o_year int, before long, files array<string>")  # one row a year
    buyers = table(spark, sf_dir, "customer").where("c_nationkey in (3, 7) or c_mktsegment = 'BUILDING'")
    early = expand(orders.where("o_orderdate < TIMESTAMP_NTZ'1995-01-01 00:00:00'"), "o_custkey", buyers.select("c_custkey"), ["o_orderkey"])
    done = partition_delete.delete_keys(spark, path, Keys("o_orderkey", early), "o_year", "o_year < 1995")
    after = files().select("o_year", F.col("rows").alias("read_back"), F.col("files").alias("now"))
    out = first.join(done.select("o_year", "deleted"), "o_year", "left").join(after, "o_year", "left")
    deleted = F.coalesce("deleted", F.lit(0))
    return out.select("o_year", "before", deleted.alias("deleted"), (F.col("before") - deleted).alias("left"), F.coalesce("read_back", F.lit(0)).alias("read_back"), F.coalesce(F.array_sort("files") == F.array_sort("now"), F.lit(False)).alias("untouched"))


UNIQUE_COLUMNS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
}


def _unique_sql() -> str:
    """Every set of at most three columns by counting its groups, then those with no unique subset."""
    each = []
    for t, names in UNIQUE_COLUMNS.items():
        for size in (1, 2, 3):
            for c in combinations(sorted(names), size):
                nulls = " OR ".join(f"{x} IS NULL" for x in c)
                each.append(f"SELECT '{t}' AS \"table\", {list(c)} AS cols WHERE (SELECT count(*) FROM {t}) > 0 AND NOT EXISTS (SELECT 1 FROM {t} WHERE {nulls}) AND NOT EXISTS (SELECT 1 FROM {t} GROUP BY {', '.join(c)} HAVING count(*) > 1)")
    return f"WITH u AS ({' UNION ALL '.join(each)}) SELECT \"table\", array_to_string(cols, ',') AS columns, len(cols)::INT AS size FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.\"table\" = u.\"table\" AND len(v.cols) < len(u.cols) AND list_has_all(u.cols, v.cols))"


@query(_unique_sql())
def measured_unique_keys(spark, sf_dir):
    """All minimal unique sets of at most three of the given columns."""
    each = [unique_keys.minimal_keys(table(spark, sf_dir, t), names, 3).select(F.lit(t).alias("table"), F.array_join("columns", ",").alias("columns"), F.size("columns").alias("size")) for t, names in UNIQUE_COLUMNS.items()]
    return reduce(DataFrame.union, each)


KEY_COLUMNS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["event_id", "user_id"], "documents": ["doc_id"], "labels": ["doc_id"],
}


def _measured_sql() -> str:
    """Every pair of columns by an anti-join."""
    columns = [(t, c) for t, names in KEY_COLUMNS.items() for c in names]
    pairs = [(a, b) for a in columns for b in columns if a[0] != b[0]]
    one = "SELECT '{0}' AS child, '{1}' AS child_column, '{2}' AS parent, '{3}' AS parent_column WHERE (SELECT count({1}) FROM {0}) > 0 AND (SELECT count(*) = count(DISTINCT {3}) FROM {2}) AND NOT EXISTS (SELECT 1 FROM {0} WHERE {1} IS NOT NULL AND {1} NOT IN (SELECT {3} FROM {2} WHERE {3} IS NOT NULL))"
    return " UNION ALL ".join(one.format(*a, *b) for a, b in pairs)


@query(_measured_sql())
def measured_foreign_keys(spark, sf_dir):
    """All foreign keys that the key columns of the tables hold to, by one grouping of their values."""
    return measured.foreign_keys({t: table(spark, sf_dir, t) for t in KEY_COLUMNS}, KEY_COLUMNS)


# -- audits of the job's graph against the foreign keys that the data has ---------------------------------

_MEASURED = _measured_sql()


@query(f"SELECT parent, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM ({_MEASURED}) WHERE parent IN ('customer', 'orders', 'lineitem') AND child NOT IN ('customer', 'orders', 'lineitem') GROUP BY parent")
def fk_coverage_audit(spark, sf_dir):
    """Tables outside of the job whose rows lead into it: a delete would leave them behind."""
    found = audit.external_children(measured_foreign_keys(spark, sf_dir), spark.createDataFrame([(t,) for t in job_graph().keys], "table string"))
    return found.select("parent", F.array_join("children", ",").alias("children"))


_EDGES = "(VALUES ('customer', 'orders', 'o_custkey', 'c_custkey'), ('orders', 'lineitem', 'l_orderkey', 'o_orderkey')) AS e(parent, child, fk, ref)"


@query(
    f"WITH e AS (SELECT * FROM {_EDGES}), t AS (SELECT parent AS t FROM e UNION SELECT child FROM e)"
    f" SELECT * FROM (SELECT f.child || '.' || f.child_column AS name, f.child, f.parent, CASE WHEN e.fk IS NULL THEN 'undeclared' WHEN e.fk <> f.child_column THEN 'other column' WHEN e.ref <> f.parent_column THEN 'other key' END AS problem FROM ({_MEASURED}) f LEFT JOIN e ON e.parent = f.parent AND e.child = f.child WHERE f.parent IN (SELECT t FROM t) AND f.child IN (SELECT t FROM t)) WHERE problem IS NOT NULL"
)
def internal_fk_audit(spark, sf_dir):
    """Foreign keys of the data between tables of the job that its edges do not have."""
    f = measured_foreign_keys(spark, sf_dir).select(F.concat_ws(".", "child", "child_column").alias("name"), "child", F.array("child_column").alias("columns"), "parent", F.array("parent_column").alias("ref"))
    edges = spark.createDataFrame([("customer", "orders", "o_custkey", "c_custkey"), ("orders", "lineitem", "l_orderkey", "o_orderkey")], "parent string, child string, fk string, ref string")
    return audit.internal_fk_audit(f, edges)


# -- job states: the log has every customer of the job, its status by its key ----------------------------

_LOG = "SELECT c_custkey::VARCHAR AS root_key, (c_custkey // 3 % 4)::INT AS status FROM customer"


def job_log(spark, sf_dir) -> DataFrame:
    """Two events a key: pending first, then what it has come to."""
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("root_key"))
    first = keys.select("root_key", F.lit(0).alias("status"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("at"))
    last = keys.select("root_key", F.expr("cast(c_custkey div 3 % 4 as int)").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(2).cast("long").alias("at"))
    return state.current(first.union(last))


@query(f"SELECT root_key, status FROM ({_LOG}) WHERE status IN (0, 1, 3)")
def log_nonterminal(spark, sf_dir):
    return state.nonterminal(job_log(spark, sf_dir)).select("root_key", "status")


@query(f"SELECT status, ['pending', 'copied', 'completed', 'failed'][status + 1] AS meaning, count(*) AS rows FROM ({_LOG}) GROUP BY status")
def log_status_breakdown(spark, sf_dir):
    return state.status_breakdown(job_log(spark, sf_dir))


@query(f"SELECT root_key, (row_number() OVER (ORDER BY root_key::BIGINT))::INT AS position FROM ({_LOG}) WHERE status = 0")
def log_replay_order(spark, sf_dir):
    """log_replay_all with small positions. Keys as numbers, not as text: 9 comes before 10."""
    return log_replay_all(spark, sf_dir).withColumn("position", F.col("position").cast("int"))


@query(f"SELECT root_key, row_number() OVER (ORDER BY root_key::BIGINT) AS position FROM ({_LOG}) WHERE status = 0")
def log_replay_all(spark, sf_dir):
    """All pending keys with their place in the order of replay."""
    return state.replay_positions(job_log(spark, sf_dir).filter("status = 0"))


@query(f"WITH l AS (SELECT root_key::BIGINT AS k, status FROM ({_LOG}) WHERE status IN (0, 1)), c AS (SELECT *, (status IS DISTINCT FROM lag(status) OVER (ORDER BY k))::INT AS ch FROM l), r AS (SELECT *, sum(ch) OVER (ORDER BY k)::BIGINT AS run FROM c) SELECT run, min(status) AS status, count(*) AS rows, min(k) AS first_key, max(k) AS last_key FROM r GROUP BY run")
def recovery_runs(spark, sf_dir):
    found = state.recovery_runs(job_log(spark, sf_dir))
    return found.select("run", "status", "rows", F.col("first_key").cast("long").alias("first_key"), F.col("last_key").cast("long").alias("last_key"))


_JOBS = "SELECT 'job_' || c_custkey AS job_name, CASE WHEN c_custkey % 2 = 0 THEN 'orders' ELSE 'customer' END AS root_table, (c_custkey % 3)::INT AS job_status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 12:00:00' - to_seconds((c_custkey % 120)::INT) END AS last_heartbeat_at FROM customer"


def jobs(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    beat = F.expr("timestampadd(SECOND, -cast(c_custkey % 120 as int), TIMESTAMP_NTZ'2024-01-01 12:00:00')")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("job_"), c.cast("string")).alias("job_name"), F.when(c % 2 == 0, "orders").otherwise("customer").alias("root_table"), (c % 3).cast("int").alias("job_status"),
        F.when(c % 5 != 0, beat).alias("last_heartbeat_at"),
    )


@query(f"SELECT job_name FROM ({_JOBS}) WHERE root_table = 'orders' AND job_status = 1 AND job_name <> 'job_4'")
def same_root_conflicts(spark, sf_dir):
    return state.same_root(jobs(spark, sf_dir), "orders", "job_4").select("job_name")


@query(f"SELECT job_name, date_diff('second', last_heartbeat_at, TIMESTAMP '2024-01-01 12:00:00') AS age_seconds, coalesce(date_diff('second', last_heartbeat_at, TIMESTAMP '2024-01-01 12:00:00') > 60, true) AS stale FROM ({_JOBS})")
def heartbeat_age(spark, sf_dir):
    return state.heartbeat_age(jobs(spark, sf_dir), F.expr("TIMESTAMP_NTZ'2024-01-01 12:00:00'")).select("job_name", "age_seconds", "stale")


@query("SELECT '_log_job_' || c_custkey AS \"table\" FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 12 <> 0")
def orphaned_logs(spark, sf_dir):
    logs = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("_log_job_"), F.col("c_custkey").cast("string")).alias("table"))
    return state.orphaned_logs(logs, jobs(spark, sf_dir).filter("job_status = 0"))


# -- payload ---------------------------------------------------------------------------------------------

_FIRST = f"SELECT * FROM customer WHERE {WHERE} ORDER BY c_custkey LIMIT {SIZE}"
_BYTES = "8 + coalesce(strlen(c_name) + 2, 4) + 8 + 8 + coalesce(strlen(c_mktsegment) + 2, 4)"


@query(_FIRST)
def payload_sample_root(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(WHERE).orderBy("c_custkey").limit(SIZE)


@query(f"SELECT 'customer' AS \"table\", count(*) AS sample_rows, sum({_BYTES})::BIGINT AS bytes, (sum({_BYTES})::BIGINT * {SIZE} // count(*))::BIGINT AS projected_bytes FROM ({_FIRST})")
def payload_bytes(spark, sf_dir):
    return payload(table(spark, sf_dir, "customer"), "customer", SIZE, "c_custkey", WHERE)


_ORDER_BYTES, BUDGET = "32 + coalesce(strlen(o_orderstatus) + 2, 4) + coalesce(strlen(o_orderpriority) + 2, 4)", 4000


@query(
    f"WITH RECURSIVE p AS (SELECT *, (sum(s) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, row_number() OVER (ORDER BY k) AS i FROM (SELECT o_orderkey AS k, ({_ORDER_BYTES})::BIGINT AS s FROM orders)),"
    f" c(i, before) AS (SELECT i, upto - s FROM p WHERE i = 1 UNION ALL SELECT min(p.i), min(p.upto - p.s) FROM c JOIN p ON p.i > c.i AND p.upto > c.before + {BUDGET} GROUP BY c.i),"
    " b AS (SELECT p.*, sum((c.i IS NOT NULL)::INT) OVER (ORDER BY p.i)::BIGINT - 1 AS batch FROM p LEFT JOIN c ON c.i = p.i)"
    " SELECT batch, count(*) AS rows, sum(s)::BIGINT AS bytes, min(k) AS first_key, max(k) AS checkpoint FROM b GROUP BY batch"
)
def cuts_by_bytes(spark, sf_dir):
    """All orders in batches of as many rows as a statement of BUDGET bytes takes."""
    orders = table(spark, sf_dir, "orders")
    return cuts.cuts(orders, "o_orderkey", byte_size(orders.schema), BUDGET)


# -- footers ---------------------------------------------------------------------------------------------

FOOTER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels", "benchmark")


def _footer_sql() -> str:
    """Rows and nulls of each column by reading all rows."""
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", u.column_name AS \"column\", (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) FROM {t}) - u.n AS nulls FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n) u" for t in FOOTER_TABLES)


@query(_footer_sql())
def footer_counts(spark, sf_dir):
    """Rows and nulls of every column, from footers alone."""
    each = [footers.totals(footers.footers(spark, f"{sf_dir}/{t}.parquet")).select(F.lit(t).alias("table"), "column", "rows", "nulls") for t in FOOTER_TABLES]
    return reduce(DataFrame.union, each)


#: Parts of a table that were written with other columns, in SQL that both sides understand.
VARIANTS = {
    "a": ("o_orderkey % 2 = 0", "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"),
    "b": ("o_orderkey % 4 = 1", "o_orderkey, cast(o_custkey AS INT) AS o_custkey, o_orderstatus, cast(o_totalprice AS DECIMAL(15, 2)) AS o_totalprice, o_orderdate, o_orderpriority"),
    "c": ("o_orderkey % 4 = 3", "o_orderkey, o_orderstatus, o_custkey, o_totalprice, o_orderpriority, o_custkey % 7 AS o_clerk"),
}


def _drift_sql() -> str:
    kind = "CASE WHEN column_type = 'BIGINT' THEN 'int64' WHEN column_type = 'INTEGER' THEN 'int32' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type LIKE 'DECIMAL%' THEN 'decimal128' || replace(column_type[8:], ',', ', ') WHEN column_type = 'TIMESTAMP' THEN 'timestamp[us]' ELSE lower(column_type) END"
    of = lambda v: f"SELECT column_name AS c, {kind} AS t, row_number() OVER () AS p FROM (DESCRIBE SELECT {VARIANTS[v][1]} FROM orders)"
    each = []
    for v in VARIANTS:
        both = f"SELECT coalesce(e.c, f.c) AS \"column\", e.t AS et, f.t AS ft, CASE WHEN e.c = f.c THEN row_number() OVER (PARTITION BY e.c = f.c ORDER BY e.p) - 1 END AS ep, CASE WHEN e.c = f.c THEN row_number() OVER (PARTITION BY e.c = f.c ORDER BY f.p) - 1 END AS fp FROM ({of('a')}) e FULL JOIN ({of(v)}) f ON e.c = f.c"
        kinds = f"SELECT \"column\", CASE WHEN ft IS NULL THEN 'missing' WHEN et IS NULL THEN 'extra' WHEN et <> ft THEN 'type' END AS kind, et AS expected, ft AS found FROM ({both}) UNION ALL SELECT \"column\", CASE WHEN ep <> fp THEN 'moved' END, ep::VARCHAR, fp::VARCHAR FROM ({both})"
        each.append(f"SELECT '{v}' AS variant, *, (SELECT count(*) FROM orders WHERE {VARIANTS[v][0]}) AS rows FROM ({kinds}) WHERE kind IS NOT NULL")
    return " UNION ALL ".join(each)


@query(_drift_sql())
def schema_drift(spark, sf_dir):
    """How the files of a table that was written in variants differ from the columns that most of its rows have."""
    path = f"{shared_folder(spark)}/variants-{uuid.uuid4().hex}"
    for v, (where, columns) in VARIANTS.items():
        table(spark, sf_dir, "orders").where(where).selectExpr(*[c.strip() for c in re.split(r",(?![^(]*\))", columns)]).write.parquet(f"{path}/variant={v}")
    found = footers.footers(spark, path)
    each = footers.drift(found, footers.usual(found)).withColumn("variant", F.regexp_extract("file", "variant=([a-z])/", 1))
    return each.groupBy("variant", "column", "kind", "expected", "found").agg(F.sum("file_rows").alias("rows"))
