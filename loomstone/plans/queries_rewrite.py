"""Queries over the row-local surface: projections, casts, filters, partition expressions, parts, the guard."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.operators.rewrite import PARTITION, by_part, read_staged, rewritten, staged
from loomstone.sources.store import scratch
from loomstone.sources.tables import as_tsv, table

from .ddl import TableSpec
from .guard import accepts
from .registry import query

EVENTS = TableSpec(
    "db", "events_new",
    T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("amount_text", T.StringType()), T.StructField("event_date", T.DateType()), T.StructField("migrated", T.ShortType())]),
    partition_by="cast(year(event_date) * 100 + month(event_date) as bigint)", sort_by=("event_date", "id"),
)
EVENTS_SELECT = "SELECT event_id, event_type, cast(user_id AS string), cast(ts AS date), cast(1 AS short) FROM source WHERE value > 10"

LINES = TableSpec(
    "db", "lines",
    T.StructType([T.StructField("order_key", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("net_cents", T.LongType()), T.StructField("flags", T.StringType()), T.StructField("ship_date", T.DateType()), T.StructField("big", T.BooleanType())]),
    partition_by="cast(year(ship_date) * 100 + month(ship_date) as bigint)", sort_by=("ship_date", "order_key"),
)
COLUMNS = ["l_orderkey", "l_linenumber", "cast(round(l_extendedprice * (1 - l_discount) * 100) AS bigint)", "concat(l_returnflag, l_linestatus)", "cast(l_shipdate AS date)", "l_quantity >= 25"]
KEPT = "l_returnflag <> 'N' OR l_quantity > 10"
LINES_SELECT = f"SELECT {', '.join(COLUMNS)} FROM source WHERE {KEPT}"
LINES_ORACLE = (
    "SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net_cents, concat(l_returnflag, l_linestatus) AS flags, "
    "CAST(l_shipdate AS DATE) AS ship_date, l_quantity >= 25 AS big FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity > 10"
)


def _scratch(spark) -> str:
    """A folder for a query's own files, in the shared folder."""
    return scratch(spark, "query")


def _table(spark, sf_dir, name):
    return table(spark, f"{sf_dir}/{name}.parquet")


@query("rewrite_events", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS amount_text, CAST(ts AS DATE) AS event_date, CAST(1 AS SMALLINT) AS migrated FROM events WHERE value > 10")
def rewrite_events(spark, sf_dir):
    """Projection by position, casts, a constant, dropped columns and a filter (rows 1-8)."""
    return rewritten(_table(spark, sf_dir, "events"), EVENTS_SELECT, EVENTS)


@query("rewrite_lineitem", LINES_ORACLE)
def rewrite_lineitem(spark, sf_dir):
    """Computed columns and a filter of two arms (rows 3, 4, 7, 8)."""
    return rewritten(_table(spark, sf_dir, "lineitem"), LINES_SELECT, LINES)


@query("rewrite_orders", "SELECT o_orderkey AS k, CAST(o_orderkey % 100 AS SMALLINT) AS bucket, upper(o_orderstatus) AS status, CAST(o_orderdate AS DATE) AS day, substring(o_orderpriority, 1, 1) AS priority FROM orders WHERE o_orderstatus IN ('O', 'F') AND year(o_orderdate) >= 1996")
def rewrite_orders(spark, sf_dir):
    """The same by DataFrame functions instead of a statement (rows 1-8)."""
    spec = TableSpec("db", "orders_new", T.StructType([T.StructField("k", T.LongType()), T.StructField("bucket", T.ShortType()), T.StructField("status", T.StringType()), T.StructField("day", T.DateType()), T.StructField("priority", T.StringType())]))

    def select(df):
        kept = df.filter(F.col("o_orderstatus").isin("O", "F") & (F.year("o_orderdate") >= 1996))
        return kept.select("o_orderkey", F.col("o_orderkey") % 100, F.upper("o_orderstatus"), F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1))

    return rewritten(_table(spark, sf_dir, "orders"), select, spec)


@query("rewrite_try_cast", "SELECT event_id AS id, TRY_CAST(event_type AS BIGINT) IS NULL AS failed, TRY_CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS back FROM events")
def rewrite_try_cast(spark, sf_dir):
    """Casts that can fail give null (row 3)."""
    spec = TableSpec("db", "t", T.StructType([T.StructField("id", T.LongType()), T.StructField("as_number", T.LongType()), T.StructField("back", T.IntegerType())]))
    out = rewritten(_table(spark, sf_dir, "events"), "SELECT event_id, event_type, cast(user_id AS string) FROM source", spec)
    return out.select("id", F.col("as_number").isNull().alias("failed"), "back")


@query("rewrite_by_part", LINES_ORACLE)
def rewrite_by_part(spark, sf_dir):
    """All parts' outputs together: the select of a part is the select of the whole (row 26)."""
    return by_part(_table(spark, sf_dir, "lineitem"), F.pmod("l_orderkey", F.lit(16)), lambda df: df.filter(KEPT).selectExpr(*COLUMNS), LINES)


@query("rewrite_each_part", LINES_ORACLE)
def rewrite_each_part(spark, sf_dir):
    """Parts rewritten one after another and put together again (rows 25, 26)."""
    source = _table(spark, sf_dir, "lineitem")
    out = None
    for k in range(4):
        own = source.filter(F.pmod("l_orderkey", F.lit(4)) == k)
        part = rewritten(own, lambda df: df.filter(KEPT).selectExpr(*COLUMNS), LINES)
        out = part if out is None else out.unionAll(part)
    return out


@query("staged_events", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS amount_text, CAST(ts AS DATE) AS event_date, CAST(1 AS SMALLINT) AS migrated, CAST(year(ts) * 100 + month(ts) AS VARCHAR) AS month FROM events WHERE value > 10")
def staged_events(spark, sf_dir):
    """Written by partition, sorted and compressed, then read again (rows 9-11, 26, 27, 32)."""
    path = staged(rewritten(_table(spark, sf_dir, "events"), EVENTS_SELECT, EVENTS), EVENTS, _scratch(spark))
    return read_staged(spark, path, EVENTS, True).withColumnRenamed(PARTITION, "month")


@query("staged_partitions", "SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS VARCHAR) AS month, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS files FROM lineitem WHERE l_returnflag <> 'N' OR l_quantity > 10 GROUP BY ALL")
def staged_partitions(spark, sf_dir):
    """Files and rows of each destination partition: a rebalance leaves one file a partition (rows 27, 28, 113)."""
    path = staged(rewritten(_table(spark, sf_dir, "lineitem"), LINES_SELECT, LINES), LINES, _scratch(spark))
    month = F.col(PARTITION).cast("string").alias("month")
    return spark.read.parquet(path).groupBy(month).agg(F.count("*").alias("n"), F.countDistinct("_metadata.file_path").alias("files"))


@query("partition_expression", "SELECT CAST(year(ts) * 100 + month(ts) AS BIGINT) AS month, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def partition_expression(spark, sf_dir):
    """The year-and-month expression of a destination (row 9)."""
    spec = TableSpec.from_ddl("CREATE TABLE db.t (ts DateTime) ENGINE = MergeTree PARTITION BY toYYYYMM(ts) ORDER BY ts")
    return _table(spark, sf_dir, "events").groupBy(F.expr(spec.partition_by).alias("month")).agg(F.count("*").alias("n"))


@query("sort_key_order", f"SELECT *, CAST(row_number() OVER (PARTITION BY year(ship_date) * 100 + month(ship_date) ORDER BY net_cents, order_key, line) AS BIGINT) AS place FROM ({LINES_ORACLE})")
def sort_key_order(spark, sf_dir):
    """A staged row's place in its partition's file, which is its place under the destination's sort key (row 10)."""
    spec = replace(LINES, sort_by=("net_cents", "order_key", "line"))
    path = staged(rewritten(_table(spark, sf_dir, "lineitem"), LINES_SELECT, spec), spec, _scratch(spark))
    return spark.read.parquet(path).select(*spec.schema.names, (F.col("_metadata.row_index") + 1).alias("place"))


#: Statements over `events`, and whether a part's rows decide for themselves.
STATEMENTS = [
    ("filter", "SELECT event_id, value * 2 AS v FROM events WHERE value > 1", True),
    ("case", "SELECT CASE WHEN value > 1 THEN 'a' ELSE 'b' END AS c FROM events", True),
    ("sort", "SELECT event_id FROM events ORDER BY event_id", True),
    ("explode", "SELECT explode(array(1, 2)) AS e, event_id FROM events", True),
    ("aggregate", "SELECT count(*) AS n FROM events", False),
    ("group", "SELECT event_type, sum(value) AS s FROM events GROUP BY event_type", False),
    ("distinct", "SELECT DISTINCT event_type FROM events", False),
    ("window", "SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events", False),
    ("limit", "SELECT event_id FROM events ORDER BY event_id LIMIT 3", False),
    ("offset", "SELECT event_id FROM events OFFSET 3", False),
    ("join", "SELECT a.event_id FROM events a JOIN events b ON a.event_id = b.event_id", False),
    ("in subquery", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events)", False),
    ("scalar subquery", "SELECT event_id, (SELECT max(value) FROM events) AS m FROM events", False),
    ("exists", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.event_id)", False),
    ("union", "SELECT event_id FROM events UNION ALL SELECT user_id FROM events", False),
    ("except", "SELECT event_id FROM events EXCEPT SELECT user_id FROM events", False),
    ("random", "SELECT event_id, rand() AS r FROM events", False),
    ("uuid", "SELECT uuid() AS u FROM events", False),
    ("clock", "SELECT current_timestamp() AS t FROM events", False),
    ("sample", "SELECT event_id FROM events TABLESAMPLE (10 PERCENT)", False),
]


@query("row_locality", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {str(ok).upper()})" for n, _, ok in STATEMENTS) + ") AS t(statement, accepted)")
def row_locality(spark, sf_dir):
    """Which statements the guard accepts (row 13)."""
    _table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.createDataFrame([(n, accepts(spark, s)) for n, s, _ in STATEMENTS], "statement string, accepted boolean")


@query("tsv_lines", "SELECT concat_ws(chr(9), CAST(r_regionkey AS VARCHAR), r_name) AS line FROM region")
def tsv_lines(spark, sf_dir):
    """Results as lines with tabs (row 117)."""
    return as_tsv(_table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
