"""The row-locality guard: a select may be run part by part only if every row decides for itself.

The analyzed plan of the select is walked. Projections, filters, generators, sorts and one scan are fine;
whatever looks at more than a row, at another table, or at something that differs between runs is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALLOWED = frozenset("Project Filter SubqueryAlias View LogicalRelation LogicalRDD LocalRelation Generate Sort ResolvedHint UnresolvedHint Range DataSourceV2Relation".split())
LEAVES = frozenset("LogicalRelation LogicalRDD LocalRelation Range DataSourceV2Relation HiveTableRelation OneRowRelation".split())
#: Deterministic to the analyzer, yet other in each run.
RUN_DEPENDENT = ("current_timestamp", "current_date", "now", "localtimestamp", "input_file_name", "input_file_block_start", "spark_partition_id", "monotonically_increasing_id")


class NotRowLocal(ValueError):
    """A select that gives another result part by part than over the whole table."""


def violations(df: DataFrame) -> list[str]:
    """Why the plan isn't row-local; empty if it is."""
    jvm = df.sparkSession._jvm
    has_subquery = jvm.org.apache.spark.sql.catalyst.expressions.SubqueryExpression.hasSubquery
    found: list[str] = []
    leaves = 0
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name in LEAVES:
            leaves += 1
        if name not in ALLOWED:
            found.append(f"{name} needs more than one row")
        for i in range(node.expressions().size()):
            e = node.expressions().apply(i)
            text = e.toString().lower()
            if has_subquery(e):
                found.append(f"a subquery reads another table: {e.sql()}" if e.resolved() else "a subquery reads another table")
            elif not e.deterministic():
                found.append(f"not deterministic: {text}")
            else:
                found += [f"differs between runs: {w}" for w in RUN_DEPENDENT if f"{w}(" in text]
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    if leaves > 1:
        found.append("more than one source is read")
    return sorted(set(found))


def check(df: DataFrame) -> DataFrame:
    """The select itself, or NotRowLocal."""
    found = violations(df)
    if found:
        raise NotRowLocal("; ".join(found))
    return df


def accepts(spark: SparkSession, statement: str) -> bool:
    return not violations(spark.sql(statement))
