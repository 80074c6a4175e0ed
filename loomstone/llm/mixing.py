"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything here is DataFrame operations. The per-source table has a row for each source and is the only
thing that meets in one task; what grows with the documents is aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, read, written
from .registry import query

#: Hash digits for each level of the search for the last document taken: 16**3 bins a source and level.
DIGITS, LEVELS = 3, 3


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """source, source_size -> with weight: the given weights in turn over the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.lit(weights), (at % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """source, source_size, weight -> with target.

    The targets sum to share * all sizes in proportion to the weights, none above epochs * its source's size;
    what a clamped source cannot take goes to the others by weight until none is above. In order of the level
    at which each would be clamped, the clamped sources are the first so many, so a running sum finds them.
    If even all clamped sources cannot take the total, each gets its cap. Weights must be above 0.
    """
    fill = F.col("cap") / F.col("weight")
    order = Window.orderBy(fill, F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # levels rise as sources are clamped and fall after, so the first unclamped source has the highest of the rest
    first = F.max(F.when(~F.col("clamped"), F.col("level"))).over(Window.partitionBy())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    return (
        sources.withColumn("weight", F.col("weight").cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("total", total)
        .withColumn("level", (F.col("total") - before) / left)
        .withColumn("clamped", fill <= F.col("level"))
        .withColumn("first", first)
        .withColumn("target", F.when(F.col("clamped") | F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("first"))))
        .select("source", "source_size", "weight", "target")
    )


def mix(rows: DataFrame, sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """rows (doc_id, source, size and more) -> with source_size, target, copies, taken.

    sized has the rows' doc_id, source and size, written; targets has source, source_size, target. A source
    with target t and size s takes each document floor(t / s) times, and once more those first in a seeded hash
    order whose words fill the rest; the sum is within half a document of the target. The hash order is never
    sorted whole: words are summed in 16**3 bins of the hash a source, the bin in which the rest is filled is
    split again, and only rows of the last, 16**9th part of a source are put in order. Null sources are a source
    of their own; null ids hash as the text "null"; documents of no words are taken as often as the others, but
    never where the whole source has no words. No document is taken oftener than the epochs allow.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.withColumn("__whole", whole).withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    keyed = sized.withColumn("__code", code)
    # cut: hash prefix of the bin in which the rest is filled, so far; room: words still to fill inside it
    cuts = goal.select("source", F.lit("").alias("__cut"), F.col("__rest").alias("__room"))
    for level in range(LEVELS):
        inside = keyed if level == 0 else _with_source(keyed, cuts).filter(F.substring("__code", 1, level * DIGITS) == F.col("__cut"))
        bins = inside.groupBy("source", F.substring("__code", 1, (level + 1) * DIGITS).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bin")
        below = F.coalesce(F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        binned = _with_source(bins, cuts).withColumn("below", below)
        # the last bin that begins below the room: what comes before it is taken whole
        at = binned.filter(F.col("below") <= F.col("__room")).groupBy("source").agg(F.max(F.struct("bin", (F.col("__room") - F.col("below")).alias("room"))).alias("last"))
        cuts = written(at.select("source", F.col("last.bin").alias("__cut"), F.col("last.room").alias("__room")), f"mix-cuts{level}")
    # written, so that Spark knows how small the table is and rows with texts aren't shuffled to meet it
    full = _with_source(rows.withColumn("__code", code), written(_with_source(goal, cuts), "mix-goals"))
    prefix = F.substring("__code", 1, LEVELS * DIGITS)
    order = Window.partitionBy("source").orderBy("__code", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = full.filter(prefix == F.col("__cut")).withColumn("__more", (before * 2 + F.col("size") <= F.col("__room") * 2).cast("long"))
    rest = full.filter(F.col("__cut").isNull() | (prefix != F.col("__cut"))).withColumn("__more", F.coalesce((prefix < F.col("__cut")).cast("long"), F.lit(0).cast("long")))
    out = rest.unionByName(edge).withColumn("copies", F.col("__whole") + F.when(F.col("__rest") > 0, F.col("__more")).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("__code", "__cut", "__room", "__more", "__whole", "__rest")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join the per-source table, null to null; Spark broadcasts it only while it is below its size threshold."""
    named = sources.withColumnRenamed("source", "of")
    return rows.join(named, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mixed(documents: DataFrame, weights: list[float], share: float, epochs: float, seed: str, columns: list[str] = ()) -> DataFrame:
    """The mix of documents (doc_id, source, text): one row a document with size, source_size, target, copies, taken.

    `columns` are further columns of the documents to keep; other columns named like a result are left out.
    """
    sized = written(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(water_fill(source_weights(sources, weights), share, epochs).drop("weight"), "mix-targets")
    keep = [c for c in columns if c not in ("doc_id", "source", "size", "source_size", "target", "copies", "taken", "of")]
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep) if keep else sized
    return mix(rows, sized, targets, seed)


def repeated(documents: DataFrame, weights: list[float], share: float, epochs: float, seed: str) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as the mix takes it."""
    rows = documents.select("doc_id", "source", "text", F.struct(*documents.columns).alias("__row"))
    plan = mixed(rows, weights, share, epochs, seed, ["__row"])
    return plan.select("__row", F.explode(F.expr("array_repeat(1, cast(copies as int))")).alias("copy")).select("__row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS code FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (SELECT CAST(sum(source_size) AS BIGINT) FROM sources) * 1.5::DOUBLE AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
goals AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE least(cap, weight * (SELECT max(level) FROM levels WHERE cap / weight > level)) END AS target FROM levels),
ordered AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY code, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN before * 2 + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""


@query("op1_mix_sources", ORACLE)
def op1_mix_sources(spark, sf_dir):
    """All documents mixed by word count: weights 3, 1, 2 in turn, 150% of all words, 2 epochs at most."""
    out = mixed(read(spark, sf_dir, "documents"), [3.0, 1.0, 2.0], 1.5, 2.0, "mix-1")
    return out.select("doc_id", "size", "source_size", "target", "taken")
