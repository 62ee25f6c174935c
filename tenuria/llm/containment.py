"""Benchmark decontamination: short items inside long documents, by DataFrame functions alone.

Items are partitioned by their number of word shingles, in powers of two. An item's signature is its smallest shingle hashes
(a bottom-k MinHash); the partition fixes how many: as many as an item of its largest size can miss, plus one. A document
with the wanted share of an item's shingles then holds at least one hash of the signature, so the search misses nothing.
Documents look up their hashes in the signatures; the shingles of each candidate pair are compared as text.

Words are runs of letters, marks and digits of the lower-cased text; a shingle is five words. A text with fewer words is one
shingle of them all, one without words has none; with `short`, documents also have shingles of as few words as the shorter
items have, so that those are found inside them. Defined results: a null text has no words; an item or a document that repeats
gives each pair once; empty tables give no pairs; null ids are ids like others. Only keys and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenuria.llm.frames import id_key
from tenuria.session import stored

WORDS = 5
PERCENT = 80
#: With its marks, as a letter of Thai may have some.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*"
GAPS = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), lambda w: w != "")


def shingled(parts: Column, make, k: int = WORDS) -> Column:
    """make(array of k words) for every k words in a row; all of them at once if there are fewer; null without words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: make(F.slice(w, i, F.lit(k))))).when(n > 0, F.array(make(w)))

    # The function of a one-element array has its words split once, not once per shingle.
    return F.get(F.transform(F.array(parts), of), F.lit(0))


def windows(parts: Column, make, k: int) -> Column:
    """make(array of k words) for every k words in a row; none if there are fewer."""

    def of(w: Column) -> Column:
        last = F.size(w) - (k - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: make(F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<long>"))

    return F.get(F.transform(F.array(parts), of), F.lit(0))


def apart(text: Column) -> Column:
    """The text with spaces around each letter of the scripts that write none between words."""
    return F.regexp_replace(text, UNSPACED, " $0 ")


def hashed(part: Column) -> Column:
    return F.xxhash64(part)


def joined(part: Column) -> Column:
    return F.array_join(part, " ")


def signatures(items: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """item_id, width (words of a shingle), item_shingles (distinct), need (how many of them a document must hold), hash: one
    row per hash of the signature."""
    s = items.select("item_id", F.least(F.size("words"), F.lit(k)).alias("width"), F.array_distinct(shingled(F.col("words"), joined, k)).alias("item_shingles"), F.array_distinct(shingled(F.col("words"), hashed, k)).alias("hashes"))
    n = F.size("hashes")
    s = s.where(n > 0).withColumn("need", F.ceil(F.size("item_shingles") * percent / 100).cast("int"))
    largest = (F.lit(2) ** (F.floor(F.log2(n.cast("double"))) + 1) - 1).cast("int")
    size = largest - F.ceil(largest * percent / 100) + 1
    return s.select("item_id", "width", "item_shingles", "need", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), size.cast("int"))).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = WORDS, short: bool = False) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: pairs in which the document holds `percent` of the item's shingles.

    short: an item of fewer than k words is also found inside a longer document, and each letter of a script without spaces
    is a word.
    """
    split = (lambda text: words(apart(text))) if short else words
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split(F.col("text")).alias("words"))
    # Written first, so that Spark sees its size and broadcasts it only below its threshold; beyond, both sides are shuffled.
    marks = stored(signatures(items.select(F.col("item_id").cast("long").alias("item_id"), split(F.col("text")).alias("words")), percent, k))
    # At most k - 1 widths; documents have shingles of those alone that some item has.
    widths = [r["width"] for r in marks.select("width").where(F.col("width") < k).distinct().collect()] if short else []
    own = shingled(F.col("words"), hashed, k)
    if widths:
        own = F.array_distinct(F.concat(F.coalesce(own, F.array().cast("array<long>")), *[windows(F.col("words"), hashed, w) for w in widths]))
    hashes = d.select("doc_id", F.explode(own).alias("hash"))
    pairs = stored(hashes.join(marks.select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct())
    wanted = marks.select("item_id", "width", "item_shingles", "need").distinct()
    # Texts are joined as they are, with ids alone, and are split into words only where they are compared.
    near = pairs.select(id_key().alias("of"), id_key("item_id").alias("found"))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(near, id_key() == F.col("of"))
    n_shared = F.size(F.array_intersect("item_shingles", shingled(split(F.col("text")), joined, k)))
    if widths:
        inside = F.concat(F.lit(" "), joined(split(F.col("text"))), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("item_shingles")[0], F.lit(" ")))
        n_shared = F.when(F.col("width") < k, inside.cast("int")).otherwise(n_shared)
    checked = held.join(wanted, F.col("found") == id_key("item_id")).select("doc_id", "item_id", F.size("item_shingles").alias("n_item"), "need", n_shared.alias("n_shared"))
    # Rows of one doc_id are one document for the result; the fullest of them counts.
    return checked.where("n_shared >= need").groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared")).select(
        "doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"),
        (F.col("n_shared") / F.col("n_item")).alias("containment"))


#: The rule of `contained` with `short`: each row is a document, each distinct text of an item is an item.
CONTAINED_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, w FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark)),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT k, item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) AS s FROM i),
n AS (SELECT k, count(*) AS n_item FROM bs GROUP BY k),
long AS (SELECT r, doc_id, item_id, n_item, count(*) AS n_shared FROM ds JOIN bs USING (s) JOIN n USING (k)
    GROUP BY r, doc_id, k, item_id, n_item HAVING count(*) * 100 >= 80 * n_item),
short AS (SELECT r, doc_id, item_id, 1::BIGINT AS n_item, 1::BIGINT AS n_shared
    FROM d JOIN (SELECT item_id, array_to_string(w, ' ') AS s FROM i WHERE len(w) BETWEEN 1 AND 4)
    ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || s || ' '))
SELECT doc_id, item_id, n_item, max(n_shared) AS n_shared, max(n_shared) / n_item AS containment
FROM (SELECT * FROM long UNION ALL SELECT * FROM short) GROUP BY doc_id, item_id, n_item
""".replace("{words}", r"""list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''),
    '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*)', ' \1 ', 'g')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')""")
