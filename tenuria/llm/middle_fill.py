"""Fill-in-middle transformation as a pyarrow.compute pipeline over batches of texts.

A text is split into units (code points, words with the white space after them, or lines) by list arrays over its own bytes. Flattening gives
the parent of each unit, the place inside its parent its ordinal, and the ordinal against the two cut points its role: prefix, middle or suffix.
The units of a role are filtered, built into lists again and joined, and the pieces are joined with the markers in prefix-suffix-middle
(psm) or suffix-prefix-middle (spm) order. Cut points and form come from a hash of the document's key, so reruns agree.

Defined results: a null text is empty; an empty text, one that holds a marker, and a share of the others stay plain; a null key hashes as no
digits; rows that repeat a key are cut by the same numbers, each over its own length; cuts may coincide, which leaves pieces empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria.llm.frames import slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
UNITS = ("char", "word", "line")


def starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte; every text's first byte starts one."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    if unit == "line":
        after = data == 10
    else:  # a word with the white space after it
        space = (data == 32) | ((data >= 9) & (data <= 13))
        after = space & ~np.append(space[1:], True)
    out = np.append(False, after[:-1]) if len(data) else np.zeros(0, bool)
    out[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return out


def units(text: pa.Array, unit: str) -> pa.LargeListArray:
    """The texts as lists of their units, over the bytes they already have."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(text.buffers()[2], np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    at = np.flatnonzero(starts(data, offsets - first, unit)).astype(np.int64)
    cuts = pa.py_buffer(np.append(at, last - first))
    flat = pa.LargeStringArray.from_buffers(len(at), cuts, pa.py_buffer(data))
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(at, offsets - first)), flat)


def pieces(lists: pa.LargeListArray, low: pa.Array, high: pa.Array) -> list[pa.Array]:
    """Prefix (units before low), middle (before high) and suffix of each list, joined to texts."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = pc.subtract(pa.array(np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists)]), lists.offsets[0])
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(first, parent))
    in_prefix, in_suffix = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))
    out = []
    for role in (in_prefix, pc.invert(pc.or_(in_prefix, in_suffix)), in_suffix):
        size = np.bincount(pc.filter(parent, role).to_numpy(), minlength=len(lists))
        rebuilt = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pc.filter(flat, role))
        out.append(pc.binary_join(rebuilt, pa.scalar("", pa.large_string())))
    return out


def draws(key: Column) -> list[Column]:
    """Four unsigned numbers: the first 8-digit groups of the hex sha256 of "1:" and the decimal key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, unit: str = "char") -> DataFrame:
    """doc_id, n (units), form, prefix_units and middle_units (null if plain), output."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                text = batch.column(1).cast(pa.large_string())
                lists = units(text, unit)
                n = pc.list_value_length(lists)
                one, two = [pa.array(h.to_numpy() % (n.to_numpy() + 1)) for h in batch.columns[2:4]]
                low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
                marked = pc.or_(pc.equal(n, 0), pc.match_substring_regex(text, "|".join((PREFIX, SUFFIX, MIDDLE))))
                plain = pc.or_(marked, pa.array(batch.column(4).to_numpy() % 100 >= PLAIN_FROM))
                spm = pa.array(batch.column(5).to_numpy() % 100 < SPM_BELOW)
                prefix, middle, suffix = pieces(lists, low, high)
                join = lambda *parts: pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))
                filled = pc.if_else(spm, join(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), join(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
                form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
                known = pc.invert(plain)
                none = pa.scalar(None, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), n, form, pc.if_else(known, low, none), pc.if_else(known, pc.subtract(high, low), none), pc.if_else(plain, text, filled).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    h = draws(F.col("doc_id"))
    rows = texts(docs).select("doc_id", "text", *[c.alias(f"h{i}") for i, c in enumerate(h)])
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: markers stand nowhere in the texts of psm and spm rows, so the first ones found are those set."""
    first, second, third = output.substr(F.lit(1), F.lit(3)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    a, b = F.instr(output, second), F.instr(output, third)
    one = output.substr(F.length(first) + 1, a - 4)
    two, middle = output.substr(a + 3, b - a - 3), output.substr(b + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
