"""Substring dedup with suffix automata of reference shards.

`without_references` is the plain form: the automaton of a bounded set of reference texts is broadcast, and
documents stream through it for matching statistics.

`repeated_windows` removes what the corpus repeats of itself. All documents against all shards would cost the
square of the corpus, so each stretch of text meets only the shard that can match it. A window of `size` words
is routed by its anchor: the smallest hash of `gram` consecutive words in it, which equal windows share.
Consecutive windows of one anchor travel as one context. An anchor in two documents or more makes a reference
shard of its distinct contexts; the shard's suffix automaton takes contexts in ascending order of their
smallest document, and each context streams through it to learn the owner of its windows: the smallest
document in which the window stands. Copies collapse to one context before they are shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import WORD, lean, meet, read, slices, written
from .registry import query
from .words import U, Words, mixed, spans_hash

#: Words of an anchor, and contexts of a shard beyond which its windows are compared one by one.
GRAM, CONTEXTS = 6, 2048
#: Bound of a broadcast automaton: words of the references it is made of.
REFERENCE_WORDS = 200_000


class SuffixAutomaton:
    """Of sequences of words, added in ascending order of their owners; a state knows its first owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.owner: list = [None]

    def add(self, words, owner) -> None:
        nexts, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is not None:
                last = self._split(last, word, known)
                continue
            nexts.append({})
            length.append(length[last] + 1)
            owners.append(owner)
            link.append(0)
            made, state = len(nexts) - 1, last
            while state >= 0 and word not in nexts[state]:
                nexts[state][word] = made
                state = link[state]
            if state >= 0:
                known = nexts[state][word]
                link[made] = known if length[known] == length[state] + 1 else self._split(state, word, known)
            last = made

    def _split(self, state: int, word, known: int) -> int:
        """A state for the shorter strings of `known` that end in a step from `state`."""
        nexts = self.next
        nexts.append(nexts[known].copy())
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[known])
        self.owner.append(self.owner[known])
        made = len(nexts) - 1
        self.link[known] = made
        while state >= 0 and nexts[state].get(word) == known:
            nexts[state][word] = made
            state = self.link[state]
        return made

    def statistics(self, words):
        """For each place the longest suffix there that the sequences hold: its length and state."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            yield matched, state

    def owners(self, words, size: int) -> list:
        """The owner of each window of `size` words, None where the sequences don't hold it."""
        out, link, length = [], self.link, self.length
        for at, (matched, state) in enumerate(self.statistics(words), 1):
            if at < size:
                continue
            if matched < size:
                out.append(None)
                continue
            while length[link[state]] >= size:
                state = link[state]
            out.append(self.owner[state])
        return out


def contexts(words: Words, size: int, gram: int = GRAM):
    """Anchor, its text's row, first window (in words of its text) and number of windows of each context."""
    h = words.hash
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < size:
        return np.zeros(0, np.uint64), none, none, none
    grams = spans_hash(h, np.arange(n - gram + 1), np.arange(gram, n + 1))
    wide = size - gram + 1
    # smallest hash in reach of each window, by doubling: runs of powers of two, then two that overlap
    best, reach = grams, 1
    while reach * 2 <= wide:
        best, reach = np.minimum(best[: len(best) - reach], best[reach:]), reach * 2
    windows = n - size + 1
    best = np.minimum(best[:windows], best[wide - reach : wide - reach + windows])
    inside = words.row[:windows] == words.row[size - 1 :]
    at = np.nonzero(inside)[0]
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    best, row = best[at], words.row[at]
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])])
    start = np.nonzero(new)[0]
    count = np.diff(np.concatenate([start, [len(at)]]))
    return best[start], row[start], at[start] - words.first[row[start]], count


def _anchors(rows: DataFrame, size: int) -> DataFrame:
    """anchor, n: the anchors that stand in documents of two ids or more, with the number of their contexts."""
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                anchor, row, _, _ = contexts(Words(part.column(1)), size)
                doc = np.asarray(part.column(0))[row]
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(doc)], schema=schema)

    found = rows.mapInArrow(lean(run), "anchor long, doc_id long")
    return found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high").select("anchor", "n")


def _segments(rows: DataFrame, size: int, wanted: DataFrame, with_text: bool) -> DataFrame:
    """The contexts of wanted anchors, and a few others: anchor, cid (a hash of the words) and either key, start, n, or the words.

    With more anchors than a filter of bounded size tells apart, the contexts of all.
    """
    n = wanted.count()
    held = rows.sparkSession.sparkContext.broadcast(bloom.build(wanted, "anchor", n) if n <= bloom.KEYS else None)
    fields = "anchor long, cid long, " + ("words binary" if with_text else "doc_id long, code long, start int, n int")
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                anchor, row, start, n = contexts(words, size)
                if held.value is not None:
                    keep = bloom.holds(held.value, anchor)
                    anchor, row, start, n = anchor[keep], row[keep], start[keep], n[keep]
                first = words.first[row] + start
                cid = spans_hash(words.hash, first, first + n + size - 1).view(np.int64)
                if with_text:
                    _, once = np.unique(np.stack([anchor.view(np.int64), cid]), axis=1, return_index=True)
                    texts = [words.joined(a, b) for a, b in zip(first[once].tolist(), (first + n + size - 1)[once].tolist())]
                    yield pa.record_batch([pa.array(anchor[once].view(np.int64)), pa.array(cid[once]), pa.array(texts, pa.binary())], schema=schema)
                else:
                    doc, code = np.asarray(part.column(0))[row], np.asarray(part.column(2))[row]
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip((anchor.view(np.int64), cid, doc, code, start, n), schema)], schema=schema)

    return rows.mapInArrow(lean(run), fields)


def _shards(refs: DataFrame, size: int, parts: int) -> DataFrame:
    """anchor, cid, low, words -> anchor, cid, owners: for each window the smallest document, by each anchor's automaton."""
    schema = pa.schema([("anchor", pa.int64()), ("cid", pa.int64()), ("owners", pa.list_(pa.int64()))])

    def run(batches):
        automaton, current = None, None
        for batch in batches:
            out = ([], [], [])
            for anchor, cid, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != current:
                    automaton, current = SuffixAutomaton(), anchor
                words = text.split()
                owners = automaton.owners(words, size)
                if None in owners:
                    automaton.add(words, low)
                    owners = [low if x is None else x for x in owners]
                out[0].append(anchor)
                out[1].append(cid)
                out[2].append(owners)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    dealt = refs.select("anchor", "cid", "low", "words").repartition(parts, "anchor").sortWithinPartitions("anchor", "low", "cid")
    return dealt.mapInArrow(lean(run), "anchor long, cid long, owners array<long>")


def _one_by_one(refs: DataFrame, size: int) -> DataFrame:
    """As _shards, for anchors with so many contexts that no task should hold them: windows meet by their words."""
    schema = pa.schema([("anchor", pa.int64()), ("cid", pa.int64()), ("low", pa.int64()), ("i", pa.int32()), ("window", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for anchor, cid, low, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                out += [(anchor, cid, low, i, b" ".join(words[i : i + size])) for i in range(len(words) - size + 1)]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    each = written(refs.select("anchor", "cid", "low", "words").mapInArrow(lean(run), "anchor long, cid long, low long, i int, window binary"), "substring-windows")
    owners = written(each.groupBy("window").agg(F.min("low").alias("owner"), F.count("*").alias("n")), "substring-firsts")
    listed = meet(each, owners, "window", each.count()).groupBy("anchor", "cid").agg(F.sort_array(F.collect_list(F.struct("i", "owner"))).alias("o"))
    return listed.select("anchor", "cid", F.col("o.owner").alias("owners"))


def repeated_windows(documents: DataFrame, size: int) -> DataFrame:
    """documents (doc_id, text) -> doc_id, code, runs: windows (start, n) that also start in a document of a smaller id.

    code is xxhash64 of the text, so that rows of one id with other texts are told apart; they don't own each
    other's windows. Documents without such windows, and rows with a null id, aren't there.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("code")).filter(F.col("doc_id").isNotNull())
    shared = written(_anchors(rows, size), "substring-anchors")
    segments = _segments(rows, size, shared, False)
    if shared.count() > bloom.KEYS:
        segments = meet(written(segments, "substring-all"), shared, "anchor", shared.agg(F.sum("n")).first()[0])
    segments = written(segments, "substring-segments")
    found = segments.groupBy("anchor", "cid").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    found = written(found, "substring-contexts")
    several = written(found.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "substring-several")
    if not several.isEmpty():
        # the words of the contexts of those anchors alone; a context's smallest document comes from above
        wanted = meet(found.select("anchor", "cid", "low"), several.withColumn("n", F.col("contexts")), "anchor", found.count())
        refs = written(_segments(rows, size, several, True).distinct().join(wanted, ["anchor", "cid"]), "substring-references")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), refs.count() // 100_000)
        owned = _shards(refs.filter(F.col("contexts") <= CONTEXTS), size, parts)
        many = refs.filter(F.col("contexts") > CONTEXTS)
        if not many.isEmpty():
            owned = owned.unionByName(_one_by_one(many, size))
        found = found.join(owned, ["anchor", "cid"], "left")
    else:
        found = found.withColumn("owners", F.lit(None).cast("array<long>"))
    found = written(found.filter("high > low or exists(owners, x -> x < high)").drop("high"), "substring-owners")
    hits = meet(segments, found, ["anchor", "cid"], segments.count()).filter("doc_id > low or owners is not null")
    each = F.when(F.col("owners").isNull(), F.array(F.struct(F.col("start").alias("start"), F.col("n").alias("n")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("owners", i) < F.col("doc_id")), lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(1).alias("n")))
    )
    return hits.select("doc_id", "code", each.alias("runs")).filter("size(runs) > 0").groupBy("doc_id", "code").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def covered(count: int, runs, size: int) -> np.ndarray:
    """Which of a text's words stand in one of the windows; runs are (start, n) pairs."""
    edges = np.zeros(count + 1, np.int64)
    for run in runs or ():
        edges[run["start"]] += 1
        edges[min(count, run["start"] + run["n"] + size - 1)] -= 1
    return np.cumsum(edges[:-1]) > 0


_WORD = re.compile(WORD.encode())


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words that are gone; white space elsewhere stays, each cut leaves one space."""
    if not gone.any():
        return text
    out, at = [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))[0].reshape(-1, 2)
    for a, b in edges.tolist():
        out.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    return b"".join([*out, text[at:]])


def finished(documents: DataFrame, runs: DataFrame, size: int, digest: bool) -> DataFrame:
    """documents with the windows removed: n_words, n_removed and kept_sha256, or all columns with the text cut.

    Null texts have no words and stay null; rows without an id lose none; repeated rows are kept, each cut alike; whole
    texts are cut, however long. Without digest every column is kept, whatever its name (two leading underscores are
    reserved); with it those besides doc_id and text are left out. No documents give no rows.
    Only documents that have such windows, and few others, are shuffled to meet them: a filter of bounded
    size tells those that surely have none.
    """
    spark = documents.sparkSession
    runs = written(runs, "substring-runs")
    keys = runs.select(F.xxhash64("doc_id", "code").alias("key"))
    held = spark.sparkContext.broadcast(bloom.build(keys, "key", keys.count()))
    columns = ["doc_id", "text"] if digest else documents.columns
    rows = documents.select(*columns, F.xxhash64("text").alias("__code"))
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else documents.schema
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    both = rows.select("*", F.xxhash64(F.col("doc_id").cast("long"), F.col("__code")).alias("__key"))

    def run(clean: bool):
        def finish(batches):
            for batch in batches:
                if clean:
                    keep = ~bloom.holds(held.value, np.asarray(batch.column(batch.schema.get_field_index("__key"))))
                    batch = batch.filter(pa.array(keep))
                for part in slices(batch, "text"):
                    text = part.column(part.schema.get_field_index("text"))
                    windows = [None] * part.num_rows if clean else part.column(part.schema.get_field_index("__runs")).to_pylist()
                    texts = [None if x is None else x for x in text.cast(pa.binary()).to_pylist()]
                    if digest:
                        out = []
                        for x, w in zip(texts, windows):
                            words = (x or b"").split()
                            gone = covered(len(words), w, size) if w else None
                            kept = [y for y, g in zip(words, gone) if not g] if w else words
                            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                        a, b, c = zip(*out) if out else ((), (), ())
                        yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=names)
                    else:
                        new = [x if not w else cut(x, covered(len(x.split()), w, size)) for x, w in zip(texts, windows)]
                        cut_ = [None if x is None else x.decode() for x in new]
                        yield pa.record_batch([pa.array(cut_, pa.string()) if n == "text" else part.column(i) for i, n in enumerate(columns)], names=columns)

        return finish

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(bloom.holds(held.value, np.asarray(batch.column(batch.schema.get_field_index("__key"))))))

    clean = both.mapInArrow(lean(run(True)), fields)
    hit = both.mapInArrow(lean(maybe), both.schema)
    named = runs.select(F.col("doc_id").alias("__id"), F.col("code").alias("__of"), F.col("runs").alias("__runs"))
    hit = hit.join(named, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__code") == F.col("__of")), "left").drop("__id", "__of")
    return clean.unionByName(hit.mapInArrow(lean(run(False)), fields))


def deduplicated(documents: DataFrame, size: int) -> DataFrame:
    """documents with every word gone that stands in a window of `size` words which also starts in a document of a smaller id."""
    return finished(documents, repeated_windows(documents, size), size, False)


def without_references(documents: DataFrame, references: list[str], size: int, most: int = REFERENCE_WORDS) -> DataFrame:
    """documents without the windows of `size` words that the references hold; their automaton is broadcast.

    The references may have `most` words in all, which bounds what is broadcast.
    """
    words = [r.encode().split() for r in references]
    if sum(map(len, words)) > most:
        raise ValueError(f"the references have over {most} words; make shards of them")
    automaton = SuffixAutomaton()
    for w in words:
        automaton.add(w, 0)
    held = documents.sparkSession.sparkContext.broadcast(automaton)
    names = documents.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for x in part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                    if x is not None:
                        w = x.split()
                        found = [{"start": i, "n": 1} for i, o in enumerate(held.value.owners(w, size)) if o is not None]
                        x = cut(x, covered(len(w), found, size)).decode()
                    out.append(x)
                yield pa.record_batch([pa.array(out, pa.string()) if n == "text" else part.column(i) for i, n in enumerate(names)], names=names)

    return documents.mapInArrow(lean(run), documents.schema)


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS seq
  FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 12, 0))) AS i FROM w)),
first AS (SELECT seq, min(doc_id) AS owner FROM windows GROUP BY seq),
hit AS (SELECT doc_id, i FROM windows JOIN first USING (seq) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
gones AS (SELECT doc_id, list(j) AS js, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, k: NOT coalesce(list_contains(g.js, k - 1), FALSE)), ' ')) AS kept_sha256
FROM w LEFT JOIN gones g ON w.doc_id = g.doc_id
"""


@query("op9_substring_dedup", ORACLE)
def op9_substring_dedup(spark, sf_dir):
    """All documents without the 13-word windows that also start in a document of a smaller id."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return finished(documents, repeated_windows(documents, 13), 13, True)
