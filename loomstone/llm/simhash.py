"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distances, connected components.

Fingerprints that differ in at most d bits, cut into b > d blocks, agree in b - d of them. Each choice of
b - d blocks is a table of buckets; pairs in a bucket are verified. Copies collapse to one fingerprint first;
a bucket is compared where it lies and gives back a spanning forest of its links, never its pairs; buckets
too large for a task are cut into tiles, and each pair of tiles goes to a task of its own.

Texts whose sets of shingles are alike in 0.8 or more differ in about 0.15 of a SimHash's bits, too many for
blocks of bits. Their blocks are of shingles: sets that differ in at most d shingles, dealt by hash into
m > d parts, agree in one part. Texts that share a part are held against each other by Hamming distance, and
the groups that this gives are refined by their exact similarity (see near_deduplicated).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lengths, meet, read, slices, values, written
from .components import components
from .registry import query

#: Fingerprints of a tile, and rows that a task links at a time.
TILE, RUN = 2048, 1 << 17


def shingled(texts: list[bytes], shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, one text's after another's, and how many each text has."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(xxh64_intdigest(line, seed))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
        hashes += [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        counts[i] = len(words) - shingle + 1
    return np.array(hashes, np.uint64), counts


def distinct(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without a text's repeated shingles, in the order of the hashes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts))


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit numbers mixed anew."""
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bits_of(h: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints (texts x width) of shingles' hashes: the first 64 bits are of the hashes, further ones of the hashes mixed anew."""
    out = np.zeros((len(counts), width), np.uint64)
    some = np.nonzero(counts)[0]
    if len(some):
        starts = np.cumsum(counts[some]) - counts[some]
        cuts = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(starts.tolist(), counts[some].tolist())])
        pieces = np.searchsorted(cuts, starts)
        for word in range(width):
            if word:
                h = mixed(h)
            # eight counters of a byte in each 64-bit number: sums of at most 255 rows don't run over
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
            sums = np.add.reduceat(bits, cuts, axis=0).view(np.uint8)
            over = 2 * np.add.reduceat(sums, pieces, axis=0, dtype=np.int64) > counts[some][:, None]
            out[some, word] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(texts: list[bytes], shingle: int, width: int = 1, seed: int = 42) -> np.ndarray:
    """64 * width bits for each text (texts x width, unsigned): a bit is set if it is in over half of the shingles' hashes."""
    return bits_of(*shingled(texts, shingle, seed), width)


def fingerprinted(documents: DataFrame, shingle: int = 3, width: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, f0 and on (the fingerprint's 64-bit words as signed longs); null and wordless texts have 0.

    Repeated rows are kept, whole texts are hashed however long, and only the named columns are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"f{i}", pa.int64()) for i in range(width))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints(values(part.column(1)), shingle, width).view(np.int64)
                yield pa.record_batch([part.column(0), *(pa.array(found[:, i]) for i in range(width))], schema=schema)

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), ", ".join(f"{n} long" for n in schema.names))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def pigeonhole(bits: int, blocks: int) -> list[tuple[int, int]]:
    """Tables (word, mask) for 64-bit fingerprints: each choice of blocks in which those at most `bits` apart agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(0, signed(sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen))) for chosen in combinations(range(blocks), blocks - bits)]


def exact_tables(bits: int, n: int) -> list[tuple[int, int]]:
    """Pigeonhole tables with blocks enough that of n unrelated fingerprints about 4 share a bucket, if that takes at most bits + 4."""
    return pigeonhole(bits, next(b for b in range(bits + 2, bits + 5) if b == bits + 4 or n >> (64 * (b - bits) // b) <= 4))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (... x width)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def linked(group: np.ndarray, node: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group -> a spanning forest (node, root) of the pairs in a group at most `bits` apart."""
    starts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]])
    sizes = np.diff(starts)
    left, right = [], []
    few = np.repeat(sizes <= 64, sizes)
    for step in range(1, min(64, int(sizes.max(initial=1)))):
        at = np.nonzero((group[:-step] == group[step:]) & few[:-step])[0]
        at = at[apart(fp[at], fp[at + step]) <= bits]
        left.append(at)
        right.append(at + step)
    for k in np.nonzero(sizes > 64)[0]:
        own = fp[starts[k] : starts[k + 1]]
        for row in range(0, len(own), 256):
            i, j = np.nonzero(np.bitwise_count(own[row : row + 256, None, 0] ^ own[None, :, 0]) <= bits)
            i += row
            i, j = i[i < j], j[i < j]
            near = apart(own[i], own[j]) <= bits
            left.append(i[near] + starts[k])
            right.append(j[near] + starts[k])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = node[np.concatenate(left)], node[np.concatenate(right)]
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    own = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[own], nodes[root[own]]


def buckets(fps: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """Fingerprints (node, f0) -> with `bucket`, a row for each table."""
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"f{w}").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, (w, m) in enumerate(tables)]))
    return fps.select("node", "f0", table.alias("k")).select("node", "f0", F.xxhash64("k.t", "k.key").alias("bucket"))


def links(keys: DataFrame, width: int, bits: int, parts: int) -> DataFrame:
    """Rows node, f0 and on, bucket -> edges (a, b) that connect what pairs in a bucket at most `bits` apart connect."""
    words = [f"f{i}" for i in range(width)]
    # buckets of more than a tile are at most a TILE-th of the rows; written, so that Spark sees how many there are
    # and shuffles the rows to meet them only if they are many
    counts = keys.groupBy("bucket").count().filter(F.col("count") > TILE)
    large = written(counts.select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "simhash-large")
    tiled = keys.join(large, "bucket", "left")
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.xxhash64("bucket", F.least(tile, u), F.greatest(tile, u)))
    group = F.explode(F.when(F.col("tiles").isNull(), F.array("bucket")).otherwise(both)).alias("group")
    dealt = tiled.select(group, "node", *words).repartition(parts, "group").sortWithinPartitions("group")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held = np.zeros((0, 2 + width), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns], axis=1)])
            if len(held) >= RUN:
                end = int(np.searchsorted(held[:, 0], held[-1, 0], side="left"))  # the last group may go on
                a, b = linked(held[:end, 0], held[:end, 1], held[:end, 2:].view(np.uint64), bits)
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)
                held = held[end:]
        a, b = linked(held[:, 0], held[:, 1], held[:, 2:].view(np.uint64), bits)
        yield pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

    return dealt.mapInArrow(lean(run), "a long, b long")


def near_groups(marked: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, f0 (and more) -> with component_id: the smallest doc_id reached over fingerprints at most `bits` apart.

    No link is lost. Rows with a null id link others and get their component's id, null if no row of it has one.
    Repeated rows are kept. A column named node is overwritten and goes.
    """
    spark = marked.sparkSession
    known = written(marked.groupBy("f0").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).withColumn("node", F.col("f0")), "simhash-fps")
    n = known.count()
    tables = exact_tables(bits, n)
    parts = _parts(spark, n * len(tables))
    forest = components(written(links(buckets(known, tables), 1, bits, parts), "simhash-links").distinct(), "simhash-components")
    rooted = written(known.select("node", "doc_id", "n").join(forest, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"), F.col("n").alias("rows")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    named = written(meet(rooted, least, "root", n).select("node", "component_id", F.col("rows").alias("n")), "simhash-named")
    return meet(marked.withColumn("node", F.col("f0")), named, "node", marked.count()).drop("node")


def _parts(spark, rows: int) -> int:
    """Partitions for so many narrow rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2_000_000)


#: For texts alike in 0.8 or more of their distinct 5-word shingles: 64-bit words of a fingerprint, and differing bits
#: allowed. Such texts differ in a share of at most 0.19 of the bits (four shingles against five; of large sets 0.15), about
#: 48 with a deviation of 6; unrelated ones in 128, with one of 8.
NEAR_SHINGLE, NEAR_WIDTH, NEAR_BITS = 5, 4, 80
#: Parts of a set that are compared at most: at a similarity of exactly 0.8 each agrees with a chance of 0.37 or more, so
#: a pair is missed with one of 4e-7; sets dealt into fewer parts lose none, but for empty parts, so they are dealt again
#: until there are LEAST_PARTS.
MOST_PARTS, LEAST_PARTS = 32, 12
#: Texts and bytes of a group, or of a pair of its tiles, that a task refines at a time.
GROUP_TEXTS, GROUP_BYTES = 2048, 8 << 20


def part_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of each text's distinct shingles: owner and key, sorted by owner.

    Sets of 2^c to 2^(c+1) - 1 shingles are dealt as class c, and as class c + 1 if one of that class can be alike in
    0.8. Of a class, sets that are that much alike differ in at most d = 2 * (2^(c+1) - 1) / 9 shingles and are dealt
    into d + 1 parts; a part's key is the sum of its shingles' hashes. Sets of one shingle are like equal ones alone.
    """
    owners, keys = [], []
    class_ = np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1
    for step in (0, 1):
        c = class_ + step
        takes = counts >= 2 if step == 0 else (counts >= 4) & (5 * counts >= 4 << c)
        parts = 2 * ((2 << c) - 1) // 9 + 1
        rounds = np.where(takes, -(-LEAST_PARTS // parts), 0)
        for turn in range(int(rounds.max(initial=0))):
            own = np.repeat(np.arange(len(counts)), counts)
            some = (rounds > turn)[own]
            own, hash_ = own[some], mixed(h[some], turn + 1)
            part = ((hash_ >> np.uint64(20)) % parts[own].astype(np.uint64)).astype(np.int64)
            some = part < MOST_PARTS
            at = own[some] * MOST_PARTS + part[some]
            order = np.argsort(at, kind="stable")
            at, hash_ = at[order], hash_[some][order]
            if len(at):
                first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
                owner, part = at[first] // MOST_PARTS, at[first] % MOST_PARTS
                owners.append(owner)
                keys.append(mixed(np.add.reduceat(hash_, first), 1) + mixed(((c[owner] * MOST_PARTS + part) * LEAST_PARTS + turn).astype(np.uint64), 2))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


def sketched(documents: DataFrame, shingle: int = NEAR_SHINGLE, width: int = NEAR_WIDTH) -> DataFrame:
    """doc_id, __text, text -> doc_id, __text, node (of equal sets of shingles), f0 and on (of distinct shingles), parts, bytes of the text."""
    names = [("doc_id", pa.int64()), ("__text", pa.int64()), ("node", pa.int64()), *((f"f{i}", pa.int64()) for i in range(width)), ("parts", pa.list_(pa.int64())), ("bytes", pa.int64())]
    schema = pa.schema(names)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = distinct(*shingled(values(part.column(2)), shingle))
                prints = bits_of(h, counts, width).view(np.int64)
                ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h, 3), dtype=np.uint64)])
                to = np.cumsum(counts)
                node = mixed(ends[to] - ends[to - counts], 4) + mixed(counts.astype(np.uint64), 5)
                owner, key = part_keys(h, counts)
                offsets = np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64)))
                columns = [part.column(0), part.column(1), pa.array(node.view(np.int64)), *(pa.array(prints[:, i]) for i in range(width)), lists, pa.array(lengths(part.column(2)))]
                yield pa.record_batch(columns, schema=schema)

    types = ", ".join(f"{n} {'array<long>' if n == 'parts' else 'long'}" for n in schema.names)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "__text", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), types)


def alike(h: np.ndarray, counts: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the sets of shingles that are alike in 0.8 or more, told exactly.

    Each set is held once against those not reached yet, by lists of the sets that have a shingle; the lists are
    made anew whenever half of the sets are reached.
    """
    n = len(counts)
    shingle = np.unique(h, return_inverse=True)[1]
    owner = np.repeat(np.arange(n), counts)
    own_end = np.cumsum(counts)
    reached, made = np.zeros(n, bool), 2 * n
    left, right = [], []
    for start in range(n):
        if reached[start]:
            continue
        reached[start] = True
        queue = [start]
        while queue:
            open_ = n - int(reached.sum())
            if not open_:
                break
            if 2 * open_ <= made:  # lists of those that are left
                some = ~reached[owner]
                order = np.argsort(shingle[some], kind="stable")
                holders, ends = owner[some][order], np.cumsum(np.bincount(shingle[some], minlength=int(shingle.max(initial=-1)) + 1))
                made = open_
            at = queue.pop()
            mine = shingle[own_end[at] - counts[at] : own_end[at]]
            to = ends[mine]
            size = to - np.where(mine > 0, ends[mine - 1], 0)
            skip = np.repeat(to - np.cumsum(size), size)
            shared = np.bincount(holders[np.arange(int(size.sum())) + skip], minlength=n)
            found = np.nonzero(~reached & (9 * shared >= 4 * (counts[at] + counts)) & (shared > 0))[0]
            reached[found] = True
            queue += found.tolist()
            left.append(node[found])
            right.append(np.full(len(found), node[start]))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def refined(texts: DataFrame, parts: int) -> DataFrame:
    """Rows group, node, text -> edges (a, b) that connect what pairs in a group alike in 0.8 or more connect.

    A group's rows must fit a task; rows of one node count once.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        group, nodes, held = None, [], []

        def close():
            a, b = alike(np.concatenate(held), np.array([len(x) for x in held], np.int64), np.array(nodes, np.int64))
            nodes.clear()
            held.clear()
            return pa.record_batch([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = distinct(*shingled(values(part.column(2)), NEAR_SHINGLE))
                ends = np.cumsum(counts)
                for i, (g, node) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if g != group:
                        if nodes:
                            yield close()
                        group = g
                    elif nodes and nodes[-1] == node:
                        continue
                    nodes.append(node)
                    held.append(h[ends[i] - counts[i] : ends[i]])
        if nodes:
            yield close()

    return texts.select("group", "node", "text").repartition(parts, "group").sortWithinPartitions("group", "node").mapInArrow(lean(run), "a long, b long")


def near_deduplicated(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, of several with it the one of the smallest text hash.

    Near copies are texts whose sets of 5-word shingles (A-Z in lower case) are alike in 0.8 or more; groups are what
    such links connect. Texts without words, null among them, are copies of each other. A row without an id stays
    if no row with one is like it; of several such that are like each other, one does. Rows are judged by id and text:
    two texts of one id are two documents. All columns are kept; columns that begin with two underscores are reserved.
    Equal texts and equal sets of shingles are told by 64-bit hashes.

    First come candidates: texts that share a part of their shingles (part_keys) and whose fingerprints differ in at
    most NEAR_BITS of 256 bits. The groups that these connect are then refined by exact similarity, in the tasks.
    """
    spark = documents.sparkSession
    words = [f"f{i}" for i in range(NEAR_WIDTH)]
    hashed = documents.withColumn("__text", F.xxhash64(F.col("text").cast("string")))
    marked = written(sketched(hashed), "simhash-marked")
    first = F.min_by(F.struct("doc_id", "__text", "bytes", "parts", *words), F.struct(F.col("doc_id").isNull(), "doc_id", "__text")).alias("r")
    known = written(marked.groupBy("node").agg(first).select("node", "r.*"), "simhash-nodes")
    keys = known.select("node", *words, F.explode("parts").alias("bucket"))
    parts = _parts(spark, known.count() * 32)
    coarse = components(written(links(keys, NEAR_WIDTH, NEAR_BITS, parts), "simhash-links").distinct(), "simhash-coarse")
    # every node of a group of two or more, its group's root too, with the tiles that the group is cut into
    members = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root")).distinct().join(known.select("node", "doc_id", "__text", "bytes"), "node")
    members = written(members, "simhash-members")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum("bytes") / GROUP_BYTES)).cast("int").alias("tiles"), F.count("*").alias("n"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.xxhash64("root", F.least(tile, u), F.greatest(tile, u)))
    dealt = meet(members, sizes, "root", members.count()).select("node", _row("doc_id", "__text").alias("__row"), F.explode(F.when(F.col("tiles") <= 1, F.array("root")).otherwise(both)).alias("group"))
    texts = hashed.select(_row("doc_id", "__text").alias("__row"), F.col("text").cast("string").alias("text")).join(dealt, "__row")
    forest = components(written(refined(texts, parts), "simhash-alike").distinct(), "simhash-components")
    rooted = marked.select("node", "doc_id", "__text").join(forest, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__text")).alias("r"))
    kept = written(kept.select(_row("r.doc_id", "r.__text").alias("__row")), "simhash-kept")
    rows = hashed.withColumn("__row", _row("doc_id", "__text")).join(kept, "__row", "left_semi")
    return rows.dropDuplicates(["__row"]).drop("__row", "__text")


def _row(doc_id: str, text: str):
    """A key of an id, null too, and a text's hash."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(doc_id).isNull(), F.col(text))


@query("op4_simhash")
def op4_simhash(spark, sf_dir):
    """Fingerprints of 3-word shingles of all documents, linked at 3 or fewer differing bits."""
    marked = written(fingerprinted(read(spark, sf_dir, "documents"), 3), "simhash-marked")
    return near_groups(marked, 3).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
