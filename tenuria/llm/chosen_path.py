"""MinHash near duplicates by a chosen-path set similarity join.

A document's set is that of its distinct word shingles. Documents of one set are one record, with a signature of COORDINATES minwise
tokens. A tree branches a record at each node along a minwise token: the node chooses one coordinate of the signature, in a quarter of
the nodes two (1.25 = 1 / 0.8 on average, so that a pair at the threshold keeps one common branch), and the record goes to the child of
that coordinate and its token there. After DEPTH levels each record of a node is paired with the node's first one. Links among these
pairs give classes. A node of one class has nothing left to find, so groups of near copies are never paired within. Other nodes are
compared exhaustively, but only between classes: nodes of at most NODE records as a whole by signatures, larger ones in blocks of
the records outside their largest class against blocks of the whole node, on full sets, so that of these pairs only links become rows.
Branching large nodes further would lose links (each level keeps a pair at the threshold in fewer trees) for fewer comparisons.

A pair at similarity 0.8 keeps a common branch over four levels in 0.577 of the trees, so TREES = 20 trees miss 0.423^20 = 3e-8 of such
pairs, and fewer above. The signature rules out pairs 5.6 deviations below the threshold; the rest are confirmed on their full sets
(64-bit hashes of the shingles), first one pair per record, then those that still join two classes. Full sets are made of those records only.

Defined results: a null text is empty; a text without words is linked with nothing and is its own component; fewer words than a shingle
are one shingle; repeated rows share a component; component_id is the smallest non-null doc_id reachable, null if there is none; kept is
doc_id <=> component_id, so rows without doc_id in components without any are kept. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenuria.llm.components import components
from tenuria.llm.frames import mix, slices, texts
from tenuria.llm.simhash import LOWER
from tenuria.session import stored

WORDS, THRESHOLD = 4, 80
COORDINATES, TREES, DEPTH, NODE = 128, 20, 4, 64
SURE = 0.6
BLOCK = 1 << 15  # shingles of a block of NODE records, unless one record has more


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a lower-cased text; bytes.split() cuts at the six white-space characters."""
    import xxhash

    parts = text.translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def salts() -> np.ndarray:
    return mix(np.arange(1, COORDINATES + 1, dtype=np.uint64), 0x9E3779B97F4A7C15)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, cut to 32 bits."""
    out, at, salt = np.full(COORDINATES, 2**64 - 1, np.uint64), 0, salts()[:, None]
    while at < len(hashes):  # in parts, as each hash becomes one kilobyte
        x = (hashes[None, at : at + 4096] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        out = np.minimum(out, ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).min(axis=1))
        at += 4096
    return (out >> np.uint64(32)).astype(np.uint32)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key."""
    return texts(docs).withColumn("text_key", F.md5("text"))


def records(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest of the set (binary; null for an empty one), n_shingles, signature, sketch (its low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for whole in batches:
            for batch in slices(whole, "text"):
                digest, size, marks = [], [], []
                for t in batch.column(1):
                    s = shingles(t.as_buffer().to_pybytes())
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    marks.append(signature(s) if len(s) else None)
                full = pa.array([None if m is None else m.tobytes() for m in marks], pa.binary())
                low = pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in marks], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), full, low],
                                                 ["doc_id", "text_key", "digest", "n_shingles", "signature", "sketch"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, text_key string, digest binary, n_shingles long, signature binary, sketch binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, shingles (their hashes as bytes) of the wanted records (sid, text_key); each text is brought in once, whatever its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(t.as_buffer().to_pybytes()).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["sid", "shingles"])

    one = keyed_texts(docs).groupBy("text_key").agg(F.first("text").alias("text"))
    return one.join(wanted, "text_key").select("sid", "text").mapInArrow(run, "sid long, shingles binary")


def branch(rows: DataFrame, levels: int = DEPTH) -> DataFrame:
    """sid, node: the nodes `levels` below the roots of all trees (rows: sid, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
                row, path = np.tile(np.arange(n), TREES), np.repeat(mix(np.arange(1, TREES + 1, dtype=np.uint64), 0xE7037ED1A0B428DB), n)
                for _ in range(levels):
                    chosen = mix(path, 0xD6E8FEB86659FD93)
                    second = chosen % np.uint64(4) == 0
                    row, path = np.append(row, row[second]), np.append(path, path[second])
                    place = np.append(chosen >> np.uint64(8), chosen[second] >> np.uint64(32)) % np.uint64(COORDINATES)
                    token = marks[row, place.astype(np.int64)].astype(np.uint64)
                    path = mix(path ^ mix(place + np.uint64(1), 0x9E3779B97F4A7C15) ^ token, 0xA0761D6478BD642F)
                order = np.lexsort((path, row))  # a coordinate chosen twice leads to one node twice
                row, path = row[order], path[order]
                new = np.append(True, (row[1:] != row[:-1]) | (path[1:] != path[:-1])) if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(path[new].view(np.int64))], ["sid", "node"])

    return rows.select("sid", "signature").mapInArrow(run, "sid long, node long")


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in SURE of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda i, b=batch: np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, COORDINATES)
            if batch.num_rows:
                same = (read(2) == read(3)).sum(axis=1) >= SURE * COORDINATES
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(same)) for i in (0, 1)], ["a", "b"])

    left = marks.select(F.col("sid").alias("a"), F.col("sketch").alias("mark_a"))
    right = marks.select(F.col("sid").alias("b"), F.col("sketch").alias("mark_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "mark_a", "mark_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs with 100 * intersection >= threshold * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True)) if 100 * min(len(s), len(t)) >= threshold * max(len(s), len(t)) else 0
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the class of `key`: a record without links is its own."""
    found = labels.select(F.col("vertex").alias(key), F.col("label").alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def nodes_of(marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of each node's first record with its others; the rows (node, sid) of small nodes, and of large ones."""
    nodes = stored(branch(marks))
    sizes = stored(nodes.groupBy("node").agg(F.count("*").alias("n"), F.min("sid").alias("first")).where("n > 1"))
    met = stored(nodes.join(sizes, "node"))
    stars = met.where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct()
    return stars, met.where(F.col("n") <= NODE).select("node", "sid"), met.where(F.col("n") > NODE).select("node", "sid")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two lists (sid, label, sketch): pairs a < b of different classes whose sketches agree, each once a batch."""
    for batch in batches:
        found = set()
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            sides = []
            for side in (left.values, right.values):
                sketch = np.frombuffer(b"".join(side.field(2).to_pylist()), np.uint8).reshape(len(side), COORDINATES)
                sides.append((side.field(0).to_numpy(), side.field(1).to_numpy(), sketch))
            (x, x_label, x_mark), (y, y_label, y_mark) = sides
            for i in range(len(x)):
                near = ((x_mark[i] == y_mark).sum(axis=1) >= SURE * COORDINATES) & (y_label != x_label[i])
                found.update((min(int(x[i]), v), max(int(x[i]), v)) for v in y[near].tolist())
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _linked(x: pa.StructArray, y: pa.StructArray, threshold: int) -> set[tuple[int, int]]:
    """Links a < b between records (sid, label, shingles) of two blocks that are of different classes, on full sets."""
    sids, labels = ([side.field(k).to_numpy() for side in (x, y)] for k in (0, 1))
    sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in side.field(2)] for side in (x, y)]
    sizes = [np.array([len(s) for s in some], np.int64) for some in sets]
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    every = [np.concatenate(some) for some in sets]
    shared, both = np.intersect1d(*every), np.zeros((len(x), len(y)), np.int64)
    places = [np.searchsorted(shared, h) for h in every]
    inside = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == h) for p, h in zip(places, every, strict=True)] if len(shared) else None
    for at in range(0, len(shared), 8192):  # shared shingles as columns of ones, in parts
        width, parts = min(8192, len(shared) - at), []
        for place, owner, known, n in zip(places, owners, inside, sizes, strict=True):
            some = known & (place >= at) & (place < at + width)
            ones = np.zeros((len(n), width), np.float32)
            ones[owner[some], place[some] - at] = 1
            parts.append(ones)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    link = (100 * both >= threshold * (sizes[0][:, None] + sizes[1] - both)) & (labels[0][:, None] != labels[1])
    return {(min(p), max(p)) for p in ((int(sids[0][i]), int(sids[1][j])) for i, j in zip(*np.nonzero(link), strict=True))}


def mixed_nodes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """node, sid, label, and the largest class `main` of the node; for nodes of several classes."""
    placed = stored(labelled(rows, labels, "sid", "label"))
    counts = placed.groupBy("node", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("node").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("classes")).where("classes > 1")
    return stored(placed.join(main.select("node", "main"), "node"))


def within_nodes(mixed: DataFrame, marks: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of different classes in small nodes."""
    members = F.collect_list(F.struct("sid", "label", "sketch"))
    lists = mixed.join(marks.select("sid", "sketch"), "sid").groupBy("node").agg(members.alias("x")).select("x", F.col("x").alias("y"))
    return lists.mapInArrow(_compare, "a long, b long").distinct()


def across_blocks(mixed: DataFrame, marks: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between classes in large nodes: blocks of the records outside a node's largest class against blocks of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                found |= _linked(x.values, y.values, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    sized = stored(mixed.join(marks.select("sid", "n_shingles"), "sid"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        parts = rows.groupBy("node").agg(F.ceil(F.greatest(F.count("*") / NODE, F.sum("n_shingles") / BLOCK)).alias("parts"))
        cut = rows.join(parts, "node").withColumn("block", F.pmod(F.xxhash64("sid"), "parts")).join(sets, "sid").repartition("node")  # sets move once
        return cut.groupBy("node", "block").agg(F.collect_list(F.struct("sid", "label", "shingles")).alias(name)).select("node", name)

    pairs = blocks(sized.where("label <> main"), "x").join(blocks(sized, "y"), "node").select("x", "y")
    return pairs.mapInArrow(run, "a long, b long").distinct()


def wanted(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """sid, text_key of the records in pairs."""
    return own.join(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "sid").select("sid", "text_key")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    if threshold < THRESHOLD:
        raise ValueError("branching and signatures are set for similarities of 0.8 and more")
    rows = stored(records(docs))
    full = rows.where(F.col("digest").isNotNull())
    own = stored(full.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.min("signature").alias("signature"),
                                            F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles")).withColumn("sid", F.monotonically_increasing_id()))
    stars, small, large = nodes_of(own.select("sid", "signature"))
    pairs = stored(likely(stars, own))
    sets = stored(sets_of(docs, wanted(pairs, own)))
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", "b")).distinct()
    edges = stored(confirmed(nearest, sets, threshold))
    labels = components(edges, "a", "b")
    apart = labelled(labelled(pairs, labels, "a", "label_a"), labels, "b", "label_b").where("label_a <> label_b").select("a", "b")
    edges = stored(edges.union(confirmed(apart, sets, threshold)))
    labels = components(edges, "a", "b")
    several, crowded = mixed_nodes(small, labels), mixed_nodes(large, labels)
    rest = stored(within_nodes(several, own))
    lacking = wanted(rest, own).union(own.join(crowded.select("sid").distinct(), "sid").select("sid", "text_key")).distinct()
    if not lacking.isEmpty():
        sets = stored(sets.union(sets_of(docs, lacking.join(sets, "sid", "left_anti"))))
        edges = stored(edges.union(confirmed(rest, sets, threshold)).union(across_blocks(crowded, own, sets, threshold)))
        labels = components(edges, "a", "b")
    placed = labelled(own.select("sid", "digest", "least"), labels, "sid", "label")
    first = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = placed.join(first, "label").select("digest", "component_id")
    linked = full.join(by_set, "digest").select("doc_id", "n_shingles", "component_id")
    alone = rows.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

