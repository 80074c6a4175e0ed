"""Exact top-k search by distributed histogram selection.

Rows are dealt into lanes that fit a task, queries into blocks. A pass sends every block past every lane: a task holds
its lane's rows and scores one block after another, so neither the driver nor a broadcast holds queries or rows, and the
number of jobs depends on the passes alone. Passes count scores in ever finer bins until each query's k-th best score
is located; a last pass keeps the rows at or above it, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read, written
from .registry import query

#: Queries a block, bins a pass, rows a matrix product, numbers that a lane's rows have at most: what bounds a task's memory.
BLOCK, BINS, ROWS, LANE = 256, 2048, 2048, 1 << 23
#: No more passes once at most this many times k rows are at or above a query's cut.
SPARE = 8
#: Rows and queries go to tasks packed: kind (0 rows, 1 queries), block, ids and vectors as 64-bit numbers; of queries their place and state.
PACKED = "lane int, kind int, block long, ids binary, vectors binary, places array<int>, low array<long>, high array<long>, width array<long>, need array<long>"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that have an id and a vector of finite components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def matrix(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each row's components as 64-bit integers; shorter rows end in zeros. OverflowError if one doesn't fit."""
    at = np.asarray(column.offsets)
    floats = np.floor(scale * np.asarray(column.values, dtype=np.float64)[at[0] : at[-1]])
    if len(floats) and not np.abs(floats).max() < 2.0**63:
        raise OverflowError("a component doesn't fit 64 bits")
    flat, n, sizes = floats.astype(np.int64), len(column), np.diff(at)
    out = np.zeros((n, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Inner products (queries x rows); by floats where they are exact, else in 64-bit arithmetic. OverflowError if one might not fit."""
    a, b = asked.astype(np.float64), rows.T.astype(np.float64)
    sizes = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, rows.shape[1])
    if sizes < 2.0**52:
        return (a @ b).astype(np.int64)
    if sizes >= 2.0**62:
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.abs(a @ b) + (rows.shape[1] + 1) * 2.0**-52 * (np.abs(a) @ np.abs(b))
        if not most.max(initial=0) < 2.0**63:
            raise OverflowError("an inner product doesn't fit 64 bits")
    return asked @ rows.T  # sums that run over on the way come back, as the whole fits


def packed(vectors: DataFrame, width: int, scale: float, most: int) -> DataFrame:
    """id, v -> block, ids, vectors: `most` rows of a partition at a time. Blocks are numbered apart from each other."""
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids, rows = np.asarray(part.column(1)), matrix(part.column(2), width, scale)
                yield pa.record_batch([part.column(0)[:1], pa.array([count]), pa.array([ids.tobytes()]), pa.array([rows.tobytes()])], schema=schema)
                count += 1

    found = vectors.select(F.spark_partition_id().alias("part"), "id", "v").mapInArrow(lean(run), "part int, run long, ids binary, vectors binary")
    return found.select((F.col("part").cast("long") * (1 << 40) + F.col("run")).alias("block"), "ids", "vectors")


def lanes(batches, width: int):
    """A lane's rows (ids, vectors) with each block of queries in turn: block, places, ids, vectors, low, high, width, need."""
    lane, ids, rows = None, np.zeros(0, np.int64), np.zeros((0, width), np.int64)
    held: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["lane"] != lane:
                lane, held, ids, rows = row["lane"], [], None, None
            found = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(-1, width)
            if row["kind"] == 0:
                held.append(found)
                continue
            if ids is None:
                ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
                rows = np.concatenate([h[1] for h in held]) if held else np.zeros((0, width), np.int64)
                held = []
            places = np.array(row["places"], np.int64)
            yield ids, rows, row["block"], places, found[0][places], found[1][places], *(np.array(row[k], np.int64) for k in ("low", "high", "width", "need"))


def _counts(width: int):
    """For mapInArrow: a lane's scores from low to high, by query and bin, from the top down to where the lane alone reaches `need`.

    A lower bin can't hold the k-th score, as this lane's own rows already reach it above. Bins may reach beyond high,
    where rows are off `need` already.
    """
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for ids, rows, block, places, own, asked, low, high, step, need in lanes(batches, width):
            seen = np.zeros((len(places), BINS), np.int64)
            for at in range(0, len(ids), ROWS):
                scores = products(rows[at : at + ROWS], asked)
                # the distance from low may be of 64 bits
                bins = (scores.view(np.uint64) - low.view(np.uint64)[:, None]) // step.view(np.uint64)[:, None]
                ok = (ids[at : at + ROWS][None, :] != own[:, None]) & (scores >= low[:, None]) & (scores <= high[:, None]) & (bins < BINS)
                flat = (np.arange(len(places))[:, None] * BINS + bins.view(np.int64))[ok]
                seen += np.bincount(flat, minlength=seen.size).reshape(seen.shape)
            above = seen[:, ::-1].cumsum(axis=1)[:, ::-1] - seen
            q, b = np.nonzero((seen > 0) & (above < need[:, None]))
            yield pa.record_batch([pa.array(np.full(len(q), block)), pa.array(places[q], pa.int32()), pa.array(b, pa.int32()), pa.array(seen[q, b])], schema=schema)

    return count


def _best(width: int, k: int):
    """For mapInArrow: a lane's k best rows of each query among those at or above its low."""
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(batches):
        for ids, rows, block, places, own, asked, low, *_ in lanes(batches, width):
            q = v = s = np.zeros(0, np.int64)
            for at in range(0, len(ids), ROWS):
                scores = products(rows[at : at + ROWS], asked)
                i, j = np.nonzero((ids[at : at + ROWS][None, :] != own[:, None]) & (scores >= low[:, None]))
                if not len(i):
                    continue
                q, v, s = np.concatenate([q, i]), np.concatenate([v, ids[at + j]]), np.concatenate([s, scores[i, j]])
                order = np.lexsort((v, ~s, q))
                q, v, s = q[order], v[order], s[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
                q, v, s = q[keep], v[keep], s[keep]
            yield pa.record_batch([pa.array(np.full(len(q), block)), pa.array(places[q], pa.int32()), pa.array(own[q]), pa.array(v), pa.array(s)], schema=schema)

    return best


def top_k(queries: DataFrame, rows: DataFrame, k: int, scale: float) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query (both id, v).

    A row of the query's own id doesn't count. Rows without an id or with a null, NaN or infinite component
    take no part (see usable); columns besides id and v are left out. A query that is there twice is answered once for
    each; rows that are there twice count twice. Vectors of another length count as if filled up with zeros. Ties go to
    the smaller id. Tables without rows give none. A component or product beyond 64 bits raises OverflowError.
    """
    spark = rows.sparkSession
    # repartition deals out anew: a lane of rows isn't one of a file
    bounds = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"), F.count("*").alias("n")).first()
    asked = queries.count()
    width, n = bounds["width"] or 0, bounds["n"]
    width = max(width, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    if not (width and n and asked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = np.floor(scale * bounds["most"]) + 1
    # lanes that a task holds, and for small tables as many as there are cores
    dealt = min(-(-n // ROWS), max(-(-n * width // LANE), spark.sparkContext.defaultParallelism))
    lane = (F.pmod(F.xxhash64("block"), F.lit(dealt))).cast("int").alias("lane")
    chunks = written(packed(rows, width, scale, min(ROWS, max(1, n // dealt))), "topk-rows")
    none = [F.lit(None).cast(t).alias(c) for c, t in (x.strip().split() for x in PACKED.split(",")[5:])]
    chunks = chunks.select(lane, F.lit(0).alias("kind"), "block", "ids", "vectors", *none)
    blocks = written(packed(queries.repartition(-(-asked // (8 * BLOCK))), width, scale, BLOCK), "topk-queries")

    def places(batches):
        for batch in batches:
            for block, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                size = np.abs(np.frombuffer(vectors, np.int64).reshape(-1, width).astype(np.float64)).sum(axis=1) * most
                size = np.minimum(np.ceil(size * (1 + 1e-9)), 2.0**63 - 8192).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(size), block)), pa.array(np.arange(len(size)), pa.int32()), pa.array(-size), pa.array(2 * (size // BINS) + 2)], names=["block", "place", "low", "width"])

    top = F.lit((1 << 63) - 1)
    state = blocks.select("block", "ids", "vectors").mapInArrow(lean(places), "block long, place int, low long, width long")
    state = written(state.select("block", "place", "low", top.alias("high"), "width", F.lit(k).cast("long").alias("need"), F.lit(False).alias("done")), "topk-state")

    def passed(state: DataFrame) -> DataFrame:
        """Each lane's rows, then all blocks of queries in that state."""
        each = F.array_sort(F.collect_list(F.struct(F.col("place").alias("places"), "low", "high", "width", "need"))).alias("s")
        sent = state.groupBy("block").agg(each).join(blocks, "block").select(F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))).alias("lane"), F.lit(1).alias("kind"), "block", "ids", "vectors", *[f"s.{c}" for c in ("places", "low", "high", "width", "need")])
        return chunks.unionByName(sent).repartition(dealt, "lane").sortWithinPartitions("lane", "kind")

    while not state.filter("not done").isEmpty():
        counted = passed(state.filter("not done")).mapInArrow(lean(_counts(width)), "block long, place int, bin int, n long")
        found = counted.groupBy("block", "place", "bin").agg(F.sum("n").alias("n"))
        met = found.join(state.select("block", "place", F.col("need").alias("wanted")), ["block", "place"])
        down = Window.partitionBy("block", "place").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        located = met.withColumn("total", F.sum("n").over(down)).filter((F.col("total") >= F.col("wanted")) & (F.col("total") - F.col("n") < F.col("wanted")))
        new = state.join(located.select("block", "place", "bin", F.col("n").alias("inside"), "total"), ["block", "place"], "left")
        # without a bin there are fewer than k rows in all, and all of them count
        open_ = ~F.col("done") & F.col("bin").isNotNull()
        low = F.col("low") + F.col("bin") * F.col("width")
        above = F.lit(k) - F.col("need") + F.col("total")
        ends = F.col("done") | F.col("bin").isNull() | (F.col("width") == 1) | (above <= SPARE * k)
        state = written(
            new.select(
                "block", "place", F.when(open_, low).otherwise(F.col("low")).alias("low"), F.when(open_, low + (F.col("width") - 1)).otherwise(F.col("high")).alias("high"),
                F.when(open_, F.expr(f"(width - 1) div {BINS} + 1")).otherwise(F.col("width")).alias("width"),
                F.when(open_, F.col("need") - (F.col("total") - F.col("inside"))).otherwise(F.col("need")).alias("need"), ends.alias("done"),
            ),
            "topk-state",
        )
    best = passed(state).mapInArrow(lean(_best(width, k)), "block long, place int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op3_top_k", ORACLE)
def op3_top_k(spark, sf_dir):
    """The 10 best rows of all embeddings for each row whose id is divisible by 100."""
    rows = usable(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.filter("id % 100 = 0"), rows, 10, 1024.0)
