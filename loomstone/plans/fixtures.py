"""Part-state tables derived from the star schema, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which windows are judged.
NOW = "1999-06-01 00:00:00"

_CTE = """
WITH part_state AS (
  SELECT concat('job-', lpad(cast(o_custkey % 400 AS STRING_T), 4, '0'))  AS job_id,
         concat('part-', lpad(cast(o_orderkey AS STRING_T), 8, '0'))      AS part_id,
         CASE WHEN (o_custkey % 400) % 8 = 0 THEN 'IMPORTED'
              WHEN (o_custkey % 400) % 8 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'SUPERSEDED' ELSE 'FINISHED' END
              WHEN (o_custkey % 400) % 8 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'COMPACT_READY' ELSE 'FINISHED' END
              WHEN (o_custkey % 400) % 8 = 3 THEN 'READY'
              WHEN (o_custkey % 400) % 8 = 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'IN_PROGRESS' ELSE 'READY' END
              WHEN (o_custkey % 400) % 8 = 5 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'IMPORTING' ELSE 'FINISHED' END
              WHEN (o_custkey % 400) % 8 = 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'COMPACT_READY' ELSE 'COMPACTING' END
              ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'COMPACT_READY' END END AS status,
         cast(year(o_orderdate) * 100 + month(o_orderdate) AS bigint) AS partition_id,
         cast(o_orderkey % 4 + 1 AS bigint)    AS part_count,
         cast(o_orderkey % 3 AS bigint)        AS source_part_count,
         cast(o_orderkey % 1000 AS bigint)     AS part_rows,
         cast(o_orderkey % 97 + 1 AS bigint)   AS part_bytes,
         cast(o_orderkey % 3 AS bigint)        AS generation,
         concat('worker-', cast(o_orderkey % 5 AS STRING_T)) AS worker_id,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL
              WHEN o_orderkey % 6 = 1 THEN 'download_source'
              WHEN o_orderkey % 6 = 2 THEN 'insert_select'
              WHEN o_orderkey % 6 = 3 THEN 'wait_merges'
              WHEN o_orderkey % 6 = 4 THEN 'custom_stage'
              ELSE 'upload_finished_tarballs' END AS rewrite_stage,
         o_orderdate                           AS updated_at
  FROM ORDERS_T),
parts AS (
  SELECT concat('part-', lpad(cast(l_suppkey % 16 AS STRING_T), 4, '0'))    AS source_part,
         cast(year(l_shipdate) * 100 + month(l_shipdate) AS bigint)    AS partition_id,
         cast(count(*) AS bigint)                                      AS part_rows,
         cast(sum(l_linenumber * 100 + l_suppkey) AS bigint)           AS part_bytes
  FROM LINEITEM_T
  GROUP BY l_suppkey % 16, year(l_shipdate) * 100 + month(l_shipdate)),
lineage AS (
  SELECT job_id, concat('compact-', job_id, '-', cast(partition_id AS STRING_T)) AS output_id,
         CASE WHEN part_rows % 50 = 0 THEN concat(part_id, '-x') ELSE part_id END AS input_id
  FROM part_state WHERE status = 'SUPERSEDED'),
st AS (
  SELECT job_id, part_id, status, partition_id, part_count, part_rows, part_bytes, worker_id, rewrite_stage, updated_at,
         concat('bucket-', cast(part_rows % 2 AS STRING_T)) AS bucket,
         concat('stage/jobs/', job_id, '/source/', part_id) AS source_key,
         concat('stage/jobs/', job_id, '/finished/', part_id) AS finished_key,
         CASE WHEN part_rows % 100 = 0 THEN ' ' ELSE 'db' END AS destination_database, 't' AS destination_table, 'ddl' AS destination_schema,
         CASE WHEN status IN ('COMPACT_READY', 'COMPACTING') THEN generation ELSE 0 END AS compact_generation,
         source_part_count AS source_active_part_count,
         part_count + CASE WHEN part_count = 4 THEN 1 ELSE 0 END AS destination_active_part_count,
         part_rows AS destination_active_part_rows, part_bytes AS destination_active_part_bytes,
         part_rows * 2 AS read_rows, part_bytes * 20 AS read_bytes, part_rows AS written_rows, part_bytes * 10 AS written_bytes,
         CASE WHEN part_rows % 40 = 0 THEN 1 ELSE NULL END AS destination_failed_merges,
         CASE WHEN status = 'COMPACT_READY' AND part_rows % 10 > 0 THEN updated_at END AS compact_ready_at,
         CASE WHEN status = 'COMPACTING' THEN updated_at - INTERVAL 1 DAY END AS compacting_at,
         CASE WHEN part_rows % 7 > 0 THEN updated_at + INTERVAL 2 HOUR END AS progress_updated_at,
         CASE WHEN status = 'SUPERSEDED' THEN concat('compact-', job_id, '-', cast(partition_id AS STRING_T)) END AS superseded_by,
         CASE WHEN status = 'COMPACTING' THEN concat('out-', cast(partition_id % 7 AS STRING_T)) END AS compact_output_part_id,
         CASE WHEN status = 'COMPACTING' AND part_rows % 3 > 0 THEN 9 END AS compact_input_part_count,
         CASE WHEN status = 'COMPACTING' AND part_rows % 3 > 0 THEN 4 END AS compact_output_part_count,
         CASE WHEN status = 'FAILED' THEN concat('error ', cast(part_rows AS STRING_T)) END AS error
  FROM part_state)
"""
#: In DuckDB also the partition counts of each part, as rows.
DUCKDB = (
    _CTE.replace("STRING_T", "VARCHAR").replace("ORDERS_T", "orders").replace("LINEITEM_T", "lineitem")
    + """, entries AS (
  SELECT job_id, part_id, status, bucket, destination_database, updated_at, compact_generation, destination_active_part_count, part_bytes, CAST(partition_id AS VARCHAR) AS partition_id, part_count AS n FROM st
  UNION ALL
  SELECT job_id, part_id, status, bucket, destination_database, updated_at, compact_generation, destination_active_part_count, part_bytes, CAST(partition_id + 1 AS VARCHAR), 1 FROM st WHERE part_count = 4),
outputs AS (
  SELECT job_id, output_id, list(input_id ORDER BY input_id) AS inputs, CAST(count(*) AS BIGINT) AS n FROM lineage GROUP BY job_id, output_id)
"""
)


def _sql(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    text = _CTE.replace("STRING_T", "STRING").replace("ORDERS_T", "{orders}").replace("LINEITEM_T", "{lineitem}")
    return spark.sql(text + select, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def part_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT * FROM part_state")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT * FROM parts")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, "SELECT job_id, output_id AS output, input_id AS input FROM lineage")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-state rows with all attributes that operators read; partition counts as a map."""
    st = _sql(spark, sf_dir, "SELECT * FROM st")
    own = F.create_map(F.col("partition_id").cast("string"), F.col("part_count"))
    more = F.create_map(F.col("partition_id").cast("string"), F.col("part_count"), (F.col("partition_id") + 1).cast("string"), F.lit(1).cast("long"))
    return (
        st.withColumn("destination_active_partition_counts", F.when(F.col("part_count") == 4, more).otherwise(own))
        .withColumn("compact_input_part_ids", F.lit(None).cast("array<string>"))
        .withColumn("created_at", F.col("updated_at"))
        .withColumn("importing_at", F.lit(None).cast("string"))
        .withColumn("imported_at", F.lit(None).cast("string"))
        .drop("partition_id", "part_count", "part_rows", "part_bytes")
    )


def state_with_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, and a COMPACT_READY row for each output in the lineage."""
    own = state(spark, sf_dir)
    made = lineage(spark, sf_dir).groupBy("job_id", "output").agg(F.array_sort(F.collect_list("input")).alias("compact_input_part_ids"), F.count("*").alias("destination_active_part_count"))
    made = made.select("job_id", F.col("output").alias("part_id"), F.lit("COMPACT_READY").alias("status"), "compact_input_part_ids", "destination_active_part_count", F.lit(1).cast("long").alias("compact_generation"))
    return own.withColumn("compact_generation", F.col("compact_generation").cast("long")).unionByName(made, allowMissingColumns=True)
