"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

Every 50-byte string has one sampled suffix: the one whose first 24 bytes have the smallest hash of the 27 that begin in it.
Equal strings have equal sampled suffixes, so arrays of those (about 7 of 100 positions) find every repeat that arrays of
all suffixes find. An array is sorted by the hash of the suffix's head, cut to the bits that the corpus needs, and dealt over
shards by key range. A new batch of documents gets its arrays, they are merge-scanned against those of every existing level,
what is new becomes a level, and levels of equal size merge geometrically. Heads that two documents share are resolved:

1. a run (the neighbouring 50-byte strings of one sampled suffix) that a smaller doc_id also has, byte for byte, is covered;
2. where runs of one head differ, the first document of each run has its single 50-byte strings looked up.

Both steps compare hashes of the bytes (104 and 128 bits). Documents travel as compressed blocks in a table bucketed by
block, which no step shuffles; shards get sorted arrays in which a block has a key once, however many documents hold it.

Defined results: a null text is empty; texts under 50 bytes keep all; rows with one doc_id are one document; a null doc_id
counts as larger than all others; an empty table gives no rows. Only the key and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenuria.llm.frames import lanes, mix, ranges, span_hashes, texts, trim, utf8
from tenuria.session import shared_dir

LENGTH, HEAD = 50, 24
BATCHES = 4
BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
BLOCKS = "block long, batch int, doc_ids array<long>, lengths array<long>, body binary"
SHARD = "shard long, kind string, block long, level int, a binary, b binary, c binary"
SCHEMA = pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def pack(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers as compressed byte planes; ascending ones by their differences."""
    import zstandard

    x = numbers.astype(np.uint64)
    x = np.diff(x, prepend=np.uint64(0)) if ascending else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


class Block:
    """Documents of one block, the sampled heads of their 50-byte strings, and the runs those form."""

    def __init__(self, row: dict, shift: int):
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, sum(row["lengths"])))
        self.id = row["block"]
        self.offsets = np.append(0, np.cumsum(np.array(row["lengths"], np.int64)))
        self.doc_ids = np.array([NO_ID if d is None else d for d in row["doc_ids"]], np.int64)
        self.n = n = int(self.offsets[-1])
        self.data = np.zeros(n + 2 * LENGTH + 64, np.uint8)
        self.data[:n] = np.frombuffer(body, np.uint8)
        view = lanes(self.data)
        low = np.full(n + LENGTH, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, n, 1 << 18):  # in parts, for the sake of memory
            j = min(n, i + (1 << 18))
            h = view[i:j] * np.uint64(0x9E3779B97F4A7C15) + view[i + 8 : j + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + view[i + 16 : j + 16] * np.uint64(0xD6E8FEB86659FD93)
            low[i:j] = mix(h, 0xA0761D6478BD642F)
        step = 1
        while 2 * step <= LENGTH - HEAD + 1:
            low = np.minimum(low[: len(low) - step], low[step:])
            step *= 2
        rest = LENGTH - HEAD + 1 - step
        low = np.minimum(low[: len(low) - rest], low[rest:])[:n]
        ok = np.ones(n + 2, bool)
        ok[0] = ok[-1] = False
        tail = np.minimum(np.diff(self.offsets), LENGTH - 1)
        ok[1 + ranges(self.offsets[1:] - tail, tail)] = False
        same = np.zeros(n + 1, bool)
        same[1:n] = low[1:] == low[:-1]
        self.start = np.flatnonzero(ok[1:-1] & ~(ok[:-2] & same[:n]))
        end = np.flatnonzero(ok[1:-1] & ~(ok[2:] & same[1:]))
        self.count = end - self.start + 1
        # Smallest hashes crowd at zero; mixed once more, they spread evenly over the shards.
        self.head = mix(low[self.start], 0xE7037ED1A0B428DB) >> np.uint64(shift)
        self.doc = self.doc_ids[np.searchsorted(self.offsets, self.start, side="right") - 1] if n else np.zeros(0, np.int64)

    def pick(self, some: np.ndarray) -> None:
        self.start, self.count, self.head, self.doc = self.start[some], self.count[some], self.head[some], self.doc[some]

    def runs(self) -> np.ndarray:
        """Hash of each run's bytes."""
        return span_hashes(self.data, self.start, self.count + LENGTH - 1)[0]

    def strings(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions, two hashes and documents of the 50-byte strings of some runs."""
        at = ranges(self.start[some], self.count[some])
        view = lanes(self.data)
        one, two = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
        for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            lane = view[at + k]
            one = mix(one ^ (lane * np.uint64(0xA0761D6478BD642F)), 0x9E3779B97F4A7C15)
            two = mix((two + np.uint64(0x632BE59BD9B4E019)) ^ (lane * np.uint64(0xE7037ED1A0B428DB)), 0xD6E8FEB86659FD93)
        return at, one, two, np.repeat(self.doc[some], self.count[some])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first is the major one), and which rows begin a group in that order."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


def dealt(key: np.ndarray, bits: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards in use and where each begins, for sorted keys of so many bits."""
    top = key >> np.uint64(bits - 32) if bits > 32 else key << np.uint64(32 - bits)
    shard = (top * np.uint64(shards)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(shard, prepend=np.uint64(shards)) != 0)
    return shard[first], np.append(first, len(key))


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def by_row(make):
    """A mapInArrow function from one over rows; what a row needed is free before the next is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            out = make(row)
            if out is not None:
                yield out
        trim()

    return run


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


class SuffixLevels:
    """The index of one corpus in the shared folder: blocks, levels, and what the scans have found."""

    def __init__(self, spark: SparkSession, total_bytes: int, batches: int = BATCHES, block_bytes: int = BLOCK_BYTES):
        self.spark, self.batches, self.block_bytes = spark, batches, block_bytes
        self.folder = f"{shared_dir(spark)}/suffix-{uuid4().hex}"
        self.name = f"suffix_blocks_{uuid4().hex}"
        self.shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Bits of a head: ten more than it takes to number all positions, so that few heads meet by chance.
        self.bits = min(64, max(33, int(total_bytes).bit_length() + 10))
        self.levels: dict[int, str] = {}
        self.flags: list[str] = []
        self.seen = 0

    def put(self, docs: DataFrame) -> DataFrame:
        """Write the documents as blocks of consecutive rows; a batch is a range of doc_ids."""
        edges = docs.stat.approxQuantile("doc_id", [k / self.batches for k in range(1, self.batches)], 0.02) if self.batches > 1 else []
        most = self.block_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zstandard
            from pyspark import TaskContext

            packer, block = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
            for batch in batches:
                data, offsets = utf8(batch.column(1))
                ids, at = batch.column(0).to_pylist(), 0
                while at < len(ids):
                    end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
                    number = NO_ID if ids[at] is None else ids[at]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block], pa.int64()), "batch": pa.array([sum(number > e for e in edges)], pa.int32()),
                        "doc_ids": pa.array([ids[at:end]], pa.list_(pa.int64())), "lengths": pa.array([np.diff(offsets[at : end + 1])], pa.list_(pa.int64())),
                        "body": pa.array([packer.compress(data[offsets[at] : offsets[end]].tobytes())], pa.binary()),
                    })
                    at, block = end, block + 1

        docs.mapInArrow(run, BLOCKS).write.bucketBy(self.shards, "block").option("path", f"{self.folder}/blocks").option("compression", "uncompressed").saveAsTable(self.name)
        return self.blocks()

    def blocks(self) -> DataFrame:
        return self.spark.table(self.name)

    def arrays(self, blocks: DataFrame) -> DataFrame:
        """Sorted heads of each block by shard; a: heads, b: which of them two documents of the block hold."""
        bits, shards = self.bits, self.shards

        def heads_of(row: dict) -> pa.RecordBatch | None:
            x = Block(row, 64 - bits)
            order, new = groups(x.head)
            first = np.flatnonzero(new)
            if not len(first):
                return None
            doc = x.doc[order]
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            heads = x.head[order][first]
            own, edge = dealt(heads, bits, shards)
            return to_batch([{"shard": int(s), "kind": "new", "block": x.id, "level": -1, "a": pack(heads[i:j], True), "b": np.packbits(many[i:j]).tobytes(), "c": None} for s, i, j in zip(own, edge, edge[1:], strict=False)])

        return blocks.mapInArrow(by_row(heads_of), SHARD)

    def add_batch(self, blocks: DataFrame) -> None:
        """Scan the arrays of new blocks against each level, mark shared heads, and merge levels of equal size."""
        self.seen += 1
        merged = []
        while len(merged) in self.levels:
            merged.append(len(merged))
        to = len(merged)

        def scan(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            shard = rows[0]["shard"]
            new = [(unpack(r["a"], True), r["block"], r["b"]) for r in rows if r["kind"] == "new"]
            out = []
            levels = {r["level"]: (unpack(r["a"], True), unpack(r["b"]).view(np.int64)) for r in rows if r["kind"] == "level"}
            heads = np.concatenate([a for a, _, _ in new]) if new else np.zeros(0, np.uint64)
            block = np.repeat(np.array([b for _, b, _ in new], np.int64), [len(a) for a, _, _ in new]) if new else np.zeros(0, np.int64)
            many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(a)] for a, _, m in new]).astype(bool) if new else np.zeros(0, bool)
            order, first = groups(heads)
            start = np.flatnonzero(first)
            heads, block = heads[order], block[order]
            if len(start):
                shared = (np.diff(np.append(start, len(heads))) > 1) | np.logical_or.reduceat(many[order], start)
                unseen = np.ones(len(start), bool)
                flagged = []
                for keys, holder in levels.values():
                    at, hit = find(keys, heads[start])
                    shared |= hit
                    unseen &= ~hit
                    flagged.append((keys[at[hit]], holder[at[hit]]))
                own = shared[np.cumsum(first) - 1]
                flagged.append((heads[own], block[own]))
                key, holder = (np.concatenate(x) for x in zip(*flagged, strict=True))
                order, new_holder = groups(holder, key)
                key, holder = key[order][new_holder], holder[order][new_holder]
                edge = np.append(np.flatnonzero(np.diff(holder, prepend=-1) != 0), len(holder))
                out += [{"kind": "flag", "block": int(holder[i]), "level": -1, "a": pack(key[i:j], True), "b": None} for i, j in zip(edge, edge[1:], strict=False)]
                levels[-1] = heads[start][unseen], block[start][unseen]
            parts = [levels[k] for k in [-1, *merged] if k in levels]
            if parts:
                keys, holder = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                out.append({"kind": "level", "block": -1, "level": to, "a": pack(keys[order], True), "b": pack(holder[order].view(np.uint64))})
            return pa.Table.from_pylist([r | {"shard": shard, "c": None} for r in out], schema=SCHEMA)

        rows = self.arrays(blocks)
        for path in self.levels.values():
            rows = rows.unionByName(self.spark.read.schema(SHARD).parquet(path).where("kind = 'level'"))
        path = f"{self.folder}/batch-{self.seen}"
        rows.groupBy("shard").applyInArrow(scan, SHARD).write.option("compression", "uncompressed").parquet(path)
        self.flags.append(path)
        for k in merged:
            del self.levels[k]
        self.levels[to] = path

    def marks(self) -> DataFrame:
        """block, marks: packed shared heads."""
        found = self.spark.read.schema(SHARD).parquet(*self.flags).where("kind = 'flag'") if self.flags else self.spark.createDataFrame([], SHARD)
        return found.groupBy("block").agg(F.collect_list("a").alias("marks"))

    def resolve(self, text: bool = False) -> DataFrame:
        """doc_id, n_bytes, spans (start and length of removed bytes, in order), and kept (binary) or, if asked for, text:
        what is kept without the characters of which a byte is removed."""
        bits, shards, spark = self.bits, self.shards, self.spark
        last = "text" if text else "kept"

        def marked(row: dict) -> pa.RecordBatch | None:
            x = Block(row, 64 - bits)
            x.pick(find(np.sort(np.concatenate([unpack(m, True) for m in row["marks"]])), x.head)[1])
            run = x.runs()
            order, new = groups(x.head, run)
            first = np.flatnonzero(new)
            if not len(first):
                return None
            doc = np.minimum.reduceat(x.doc[order], first)
            head, run = x.head[order][first], run[order][first]
            own, edge = dealt(head, bits, shards)
            return to_batch([{"shard": int(s), "kind": "run", "block": x.id, "level": -1, "a": pack(head[i:j], True), "b": pack(run[i:j]), "c": pack(doc[i:j].view(np.uint64))} for s, i, j in zip(own, edge, edge[1:], strict=False)])

        def first_runs(group: pa.Table) -> pa.Table:
            """For each block its runs with the smallest doc_id that has them; b of odd value: the head has other runs."""
            rows = group.to_pylist()
            head, run, doc = (np.concatenate([unpack(r[k], k == "a") for r in rows]) for k in "abc")
            n = [len(unpack(r["a"])) for r in rows]
            row = np.repeat(np.arange(len(rows)), n)
            order, new = groups(head, run)
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(doc.view(np.int64)[order], first)
            _, new_head = groups(head[order][first])
            runs_of_head = np.diff(np.append(np.flatnonzero(new_head), len(first)))
            mixed = np.repeat(runs_of_head > 1, runs_of_head)
            at = np.cumsum(new) - 1
            smallest, other = np.zeros(len(head), np.int64), np.zeros(len(head), np.uint64)
            smallest[order], other[order] = least[at], mixed[at]
            out = []
            for i, r in enumerate(rows):
                own = np.flatnonzero(row == i) if len(rows) < 3 else np.arange(sum(n[:i]), sum(n[: i + 1]))
                out.append({"shard": r["shard"], "kind": "found", "block": r["block"], "level": -1, "a": pack(run[own]), "b": pack(other[own]), "c": pack(smallest[own].view(np.uint64))})
            return pa.Table.from_pylist(out, schema=SCHEMA)

        def stored(rows: DataFrame, name: str) -> DataFrame:
            rows.write.option("compression", "uncompressed").parquet(f"{self.folder}/{name}")
            return spark.read.schema(SHARD).parquet(f"{self.folder}/{name}")

        def by_block(rows: DataFrame, name: str) -> DataFrame:
            return rows.groupBy("block").agg(F.collect_list(F.struct("a", "b", "c")).alias(name))

        runs = self.blocks().join(self.marks(), "block").mapInArrow(by_row(marked), SHARD)
        runs = stored(runs.groupBy("shard").applyInArrow(first_runs, SHARD), "runs")

        def known(x: Block, row: dict) -> tuple[np.ndarray, np.ndarray]:
            """Which runs are covered by a smaller doc_id, and which need their single strings looked up."""
            parts = row["runs"] or []
            if not parts:
                x.pick(np.zeros(0, np.int64))
                return np.zeros(0, bool), np.zeros(0, bool)
            run, other, least = (np.concatenate([unpack(p[k]) for p in parts]) for k in "abc")
            order = np.argsort(run)
            own = x.runs()
            at, hit = find(run[order], own)
            x.pick(hit)
            at = order[at[hit]]
            covered = least[at].view(np.int64) < x.doc
            return covered, ~covered & (other[at] == 1)

        def single(row: dict) -> pa.RecordBatch | None:
            x = Block(row, 64 - bits)
            _, look = known(x, row)
            _, one, two, doc = x.strings(np.flatnonzero(look))
            order, new = groups(one, two)
            first = np.flatnonzero(new)
            if not len(first):
                return None
            # A string that several documents of the block hold goes with its smallest and its largest doc_id.
            least, most = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            twice = 1 + (most > least)
            one, two, doc = np.repeat(one[order][first], twice), np.repeat(two[order][first], twice), np.repeat(least, twice)
            doc[np.cumsum(twice) - 1] = most
            own, edge = dealt(one, 64, shards)
            return to_batch([{"shard": int(s), "kind": "string", "block": x.id, "level": -1, "a": pack(one[i:j], True), "b": pack(two[i:j]), "c": pack(doc[i:j].view(np.uint64))} for s, i, j in zip(own, edge, edge[1:], strict=False)])

        def repeated(group: pa.Table) -> pa.Table:
            """For each block its strings that a smaller doc_id also has."""
            rows = group.to_pylist()
            one, two, doc = (np.concatenate([unpack(r[k], k == "a") for r in rows]) for k in "abc")
            n = [len(unpack(r["a"])) for r in rows]
            order, new = groups(one, two)
            least = np.zeros(len(one), np.int64)
            least[order] = np.minimum.reduceat(doc.view(np.int64)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            most = np.zeros(len(one), np.int64)
            most[order] = np.maximum.reduceat(doc.view(np.int64)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            out = []
            for r, end, size in zip(rows, np.cumsum(n), n, strict=True):
                own = np.arange(end - size, end)
                own = own[most[own] > least[own]]
                if len(own):
                    out.append({"shard": r["shard"], "kind": "found", "block": r["block"], "level": -1, "a": pack(one[own]), "b": pack(two[own]), "c": pack(least[own].view(np.uint64))})
            return pa.Table.from_pylist(out, schema=SCHEMA)

        with_runs = self.blocks().join(by_block(runs, "runs"), "block")
        strings = stored(with_runs.mapInArrow(by_row(single), SHARD).groupBy("shard").applyInArrow(repeated, SHARD), "strings")

        def cut(row: dict) -> pa.RecordBatch | None:
            x = Block(row, 64 - bits)
            covered, look = known(x, row)
            begin, size = x.start[covered], x.count[covered] + LENGTH - 1
            parts = row["strings"] or []
            if parts and look.any():
                one, two, least = (np.concatenate([unpack(p[k]) for p in parts]) for k in "abc")
                order = np.argsort(one)
                at, mine, second, doc = x.strings(np.flatnonzero(look))
                to, hit = find(one[order], mine)
                to = order[to]
                hit &= (two[to] == second) & (least[to].view(np.int64) < doc)
                begin, size = np.append(begin, at[hit]), np.append(size, np.full(int(hit.sum()), LENGTH))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], (begin + size)[order]
            # Touching ranges of one document are one run of removed bytes; those of two documents stay apart.
            doc = np.searchsorted(x.offsets, begin, side="right")
            reach = np.maximum.accumulate(end) if len(end) else end
            new = np.ones(len(begin), bool)
            new[1:] = (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            begin, end, doc = begin[first], np.maximum.reduceat(end, first) if len(first) else end, doc[first] - 1
            keep = np.ones(x.n, bool)
            low, high = begin, end
            if text:  # to whole characters: a text starts with a first byte, and a first byte or padding follows it
                inside = ((x.data & 0xC0) == 0x80).astype(np.int64)
                for _ in range(3):
                    low, high = low - inside[low], high + inside[high]
            keep[ranges(low, high - low)] = False
            kept = x.data[: x.n][keep].tobytes()
            edge = np.append(0, np.cumsum(keep))[x.offsets].tolist()
            spans = np.searchsorted(doc, np.arange(len(x.doc_ids) + 1))
            inner = pa.StructArray.from_arrays([pa.array(begin - x.offsets[doc], pa.int64()), pa.array(end - begin, pa.int64())], ["start", "length"])
            own = [kept[i:j] for i, j in zip(edge, edge[1:], strict=False)]
            return pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(x.offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(spans, pa.int32()), inner),
                pa.array([b.decode("utf-8") for b in own], pa.string()) if text else pa.array(own, pa.binary()),
            ], ["doc_id", "n_bytes", "spans", last])

        blocks = self.blocks().join(by_block(runs, "runs"), "block", "left").join(by_block(strings, "strings"), "block", "left")
        return blocks.mapInArrow(by_row(cut), f"doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, {last} {'string' if text else 'binary'}")


def remove_repeats(docs: DataFrame, batches: int = BATCHES, block_bytes: int = BLOCK_BYTES, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, kept (or text): bytes of a document without the 50-byte strings that also start in a smaller doc_id."""
    d = texts(docs)
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = SuffixLevels(docs.sparkSession, total, batches, block_bytes)
    index.put(d)
    for k in range(batches):
        index.add_batch(index.blocks().where(F.col("batch") == k))
    return index.resolve(text)
