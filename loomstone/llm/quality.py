"""Quality classifier: a byte-level convolutional network in numpy, trained here and applied to whole texts.

Bytes are embedded and convolved with learned filters; filter outputs are max-pooled over overlapping chunks
that cover the whole document; the mean, the largest and the smallest of the chunks' pooled values go through
a hidden layer into one probability. For scoring, embedding and filters fold into a table for each pair of
bytes, so a filter of four bytes costs two look-ups a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lengths, read, slices
from .registry import query

#: Bytes a filter spans, bytes an overlapping half of a chunk, filters, embedding width, hidden units.
SPAN, HALF, FILTERS, EMBED, HIDDEN = 4, 128, 24, 8, 16
#: Bounds of the training sample: labelled rows, bytes of one text, bytes of all.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_BYTES = 3000, 1 << 20, 24 << 20
STEPS, BATCH, RATE = 1200, 32, 0.01


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves of each document, and the place of its first; a filter that begins in its text also ends in its halves."""
    halves = -(-(sizes + SPAN - 1) // HALF)
    return halves, np.concatenate([[0], np.cumsum(halves)])


def placed(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes with each filled up with zeros to whole halves, and layout()."""
    halves, first = layout(sizes)
    out = np.zeros(first[-1] * HALF + SPAN, np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out[np.arange(len(data)) + np.repeat(first[:-1] * HALF - begins, sizes)] = data
    return out, halves, first


def chunks(pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk values, each the larger of two neighbouring halves of a document, and the document of each.

    A document of h halves has max(1, h - 1) chunks, so chunks overlap by a half and cover the whole.
    """
    halves = np.diff(first)
    doc = np.repeat(np.arange(len(halves)), halves)
    at = np.arange(first[-1])
    last = first[1:][doc] - 1
    keep = (at < last) | (halves[doc] == 1)
    a = at[keep]
    b = np.minimum(a + 1, last[keep])
    return np.maximum(pooled[a], pooled[b]), doc[keep]


def combined(values: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """Mean, largest and smallest of each document's chunk values, side by side."""
    starts = np.searchsorted(doc, np.arange(documents))
    count = np.bincount(doc, minlength=documents)[:, None]
    return np.hstack([np.add.reduceat(values, starts) / count, np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)])


class Network:
    """Weights by name; see the module's docstring for the form."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "embed": draw(256, EMBED, scale=0.5),
            "filters": draw(SPAN, EMBED, FILTERS, scale=0.4),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(3 * FILTERS, HIDDEN, scale=0.15),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }

    def tables(self) -> list[np.ndarray]:
        """For each two of a filter's bytes, the filters' sums by the pair's value."""
        w = self.weights
        single = np.einsum("be,kef->kbf", w["embed"], w["filters"])
        return [(single[k][None, :, :] + single[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, SPAN, 2)]

    def responses(self, data: np.ndarray, first: np.ndarray, tables: list[np.ndarray], most: int = 1 << 15, places: bool = False):
        """Each half's largest filter outputs before bias, and with places the byte where each is.

        Filters that begin in the last bytes of a document's halves, which are zeros, would reach the next
        document's; they don't count.
        """
        over = (first[1:, None] * HALF - np.arange(SPAN - 1, 0, -1)).reshape(-1)
        n = (len(data) - SPAN) // HALF * HALF
        pairs = data[:-1].astype(np.int32) + (data[1:].astype(np.int32) << 8)
        out = np.empty((n // HALF, FILTERS), np.float32)
        where = np.empty((n // HALF, FILTERS), np.int64) if places else None
        for at in range(0, n, most):
            to = min(n, at + most)
            sums = tables[0][pairs[at:to]]
            for k, table in enumerate(tables[1:], 1):
                sums += table[pairs[at + 2 * k : to + 2 * k]]
            sums[over[np.searchsorted(over, at) : np.searchsorted(over, to)] - at] = -np.inf
            sums = sums.reshape(-1, HALF, FILTERS)
            if places:
                best = sums.argmax(axis=1)
                out[at // HALF : to // HALF] = np.take_along_axis(sums, best[:, None, :], 1)[:, 0]
                where[at // HALF : to // HALF] = best + np.arange(at, to, HALF)[:, None]
            else:
                out[at // HALF : to // HALF] = sums.max(axis=1)
        return (out, where) if places else out

    def score(self, data: np.ndarray, sizes: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """A probability for each document; data are their bytes one after another."""
        if not len(sizes):
            return np.zeros(0)
        w = self.weights
        laid, _, first = placed(data, sizes)
        values, doc = chunks(self.responses(laid, first, tables or self.tables()), first)
        x = combined(np.maximum(values + w["bias"], 0), doc, len(sizes))
        h = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
        return 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0]).astype(np.float64)))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over a batch."""
        w, n = self.weights, len(texts)
        sizes = np.array([len(t) for t in texts])
        laid, _, first = placed(np.concatenate(texts), sizes)
        pooled, where = self.responses(laid, first, self.tables(), places=True)
        halves = np.diff(first)
        owner = np.repeat(np.arange(n), halves)
        at, last = np.arange(first[-1]), (first[1:] - 1)[owner]
        a = at[(at < last) | (halves[owner] == 1)]
        b = np.minimum(a + 1, last[a])
        doc = owner[a]
        second = pooled[b] > pooled[a]
        values = np.where(second, pooled[b], pooled[a])
        places = np.where(second, where[b], where[a])
        active = values + w["bias"] > 0
        z = np.where(active, values + w["bias"], 0).astype(np.float32)
        x = combined(z, doc, n).astype(np.float32)
        pre = x @ w["hidden"] + w["hidden_bias"]
        h = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0])))
        d = ((p - labels) / n).astype(np.float32)
        g = {"out": h.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dh = np.outer(d, w["out"]) * (pre > 0)
        g["hidden"], g["hidden_bias"] = x.T @ dh, dh.sum(axis=0)
        dx = dh @ w["hidden"].T
        count = np.bincount(doc, minlength=n)[:, None]
        mean, top, low = dx[:, :FILTERS] / count, dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS :]
        tops, lows = x[:, FILTERS : 2 * FILTERS][doc] == z, x[:, 2 * FILTERS :][doc] == z
        starts = np.searchsorted(doc, np.arange(n))
        ties = lambda hit: np.maximum(np.add.reduceat(hit.astype(np.float32), starts), 1)[doc]
        dz = (mean[doc] + top[doc] * tops / ties(tops) + low[doc] * lows / ties(lows)) * active
        g["bias"] = dz.sum(axis=0)
        g["filters"], g["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
        i, f = np.nonzero(dz)
        amount, place = dz[i, f], places[i, f]
        for k in range(SPAN):
            byte = laid[place + k]
            by_byte = np.zeros((256, FILTERS), np.float32)
            np.add.at(by_byte, (byte, f), amount)
            g["filters"][k] = w["embed"].T @ by_byte
            g["embed"] += by_byte @ w["filters"][k].T
        return g

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> "Network":
        """Adam over STEPS shuffled batches, as many for few texts as for many; the learning rate falls to zero."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        order = np.zeros(0, np.int64)
        for step in range(1, STEPS + 1):
            if not len(order):
                order = r.permutation(len(texts))
            batch, order = order[:BATCH], order[BATCH:]
            rate = RATE * (1 - (step - 1) / STEPS)
            for k, g in self.gradients([texts[i] for i in batch], labels[batch]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts and labels to learn from: the first `rows` labelled ids by hash that are not held out.

    An id labelled twice counts with the mean of its labels. The driver gets SAMPLE_BYTES of text at most,
    and no text of over SAMPLE_TEXT bytes; both bounds hold at any size of the tables.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = documents.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").filter(F.octet_length("text") <= SAMPLE_TEXT)
    texts, total = [], 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        total += len(data)
        if total > SAMPLE_BYTES:
            break
        texts.append((data, r["label"]))
    return [t for t, _ in texts], np.array([y for _, y in texts], np.float32)


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fitted(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """A network trained on the sample; without labelled rows an untrained one."""
    texts, y = sample(documents, labels, label)
    return Network().train(texts, y) if texts else Network()


def scored(documents: DataFrame, network: Network) -> DataFrame:
    """documents with a column score (0 to 1), in one pass without a shuffle; null and empty texts have one, the same for all.

    Whole texts are scored, however long; repeated rows are kept and equal texts have equal scores. An input column
    named score is replaced; all others are kept.
    """
    fields = [f for f in documents.schema.fields if f.name != "score"]
    rows = documents.select(*[f"`{f.name}`" for f in fields])
    weights = network.weights

    def run(batches):
        net = Network()
        net.weights = weights
        tables = net.tables()
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                n = lengths(column)
                data = np.frombuffer("".join(x or "" for x in column.to_pylist()).encode(), np.uint8)
                yield pa.record_batch([*part.columns, pa.array(net.score(data, n, tables))], names=[*part.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(lean(run), StructType([*fields, StructField("score", DoubleType())]))


def classified(documents: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.7) -> DataFrame:
    """documents with score and predicted (1 if score is `least` or more, a score of just that too).

    Input columns of these names are replaced. Without documents there are no rows; without labels, or with null ones
    alone, an untrained network scores. Otherwise as scored().
    """
    return scored(documents, fitted(documents, labels, label)).withColumn("predicted", (F.col("score") >= least).cast("int"))


@query("op7_quality")
def op7_quality(spark, sf_dir):
    """Every document scored by the network learned from labels.quality."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    network = fitted(documents, read(spark, sf_dir, "labels"))
    out = scored(documents, network)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
