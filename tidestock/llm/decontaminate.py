"""Benchmark decontamination with built-in expressions: size-partitioned MinHash containment search.

Texts are lower-cased and cut into words of letters and digits; a shingle is five words in a row,
repeats counted once. An item of fewer than five words is one shingle of all its words. A document
holds an item if it has at least `share` of the item's shingles, wherever they stand.

Items are partitioned by size (shingles, in powers of two). The signature of an item is its
smallest hashes (bottom-k MinHash); k follows from the largest size of the partition so that a
document that lacks all of them must lack more than 1 - share of the item. The search therefore
misses nothing: it looks up a document's shingle hashes in the signatures, and skips partitions
whose items need more shingles than the document has. Candidates are then verified by counting the
item's shingles, as text, in the document.

Only the items' shingles are ever sent to all executors, and only while they stay below a stated
number of rows; beyond it the lookups are shuffled joins. Documents are told apart by id and a hash
of the text, so repeated ids with different texts are judged apart.

Defined cases: null and empty texts hold nothing and are held by nothing; a null doc_id is kept as
null; repeated rows with equal id and text give one result row; repeated item ids are one item per
text; very long texts are searched whole; empty tables give an empty result; further columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WORDS, SHARE = 5, 0.8
#: Rows up to which a table derived from the items (hashes, or shingles as text) is sent to all executors.
SMALL_ROWS = 200_000
#: Distinct documents up to which the candidates are.
SMALL_KEYS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(parts: Column, length: int) -> Column:
    """Texts of `length` words in a row; none if there are fewer words."""
    starts = F.when(F.size(parts) >= length, F.sequence(F.lit(1), F.size(parts) - length + 1)).otherwise(
        F.expr("cast(array() as array<int>)")
    )
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(parts, i, F.lit(length))))


def hashes(parts: Column, length: int) -> Column:
    return F.array_distinct(F.transform(shingles(parts, length), lambda s: F.xxhash64(s)))


def item_shingles(items: DataFrame, length: int = WORDS, share: float = SHARE) -> DataFrame:
    """(item_id, item, shingle, hash, length, size, need, partition, place) of every item.

    item: hash of the text beside the id; need: shingles a document must share; partition: the
    largest size in the item's partition; place: rank of the hash among the item's, from 1.
    """
    rows = items.select("item_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("item"), words("text").alias("w")).where("size(w) > 0")
    rows = rows.dropDuplicates(["item_id", "item"]).withColumn("length", F.least(F.size("w"), F.lit(length)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    made = F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, F.col("length")))))
    ordered = F.array_sort(F.transform(made, lambda s: F.struct(F.xxhash64(s).alias("hash"), s.alias("shingle"))))
    sized = rows.select("item_id", "item", "length", ordered.alias("made")).withColumn("size", F.size("made"))
    return sized.select(
        "item_id", "item", "length", "size", F.ceil(F.col("size") * share - 1e-9).cast("int").alias("need"),
        (F.pow(F.lit(2), F.floor(F.log2(F.col("size") + 1e-9)) + 1) - 1).cast("int").alias("partition"),
        F.posexplode("made").alias("place", "one"),
    ).select("item_id", "item", "length", "size", "need", "partition", (F.col("place") + 1).alias("place"), "one.*")


def signatures(found: DataFrame, share: float = SHARE) -> DataFrame:
    """The k smallest hashes of every item: more than a document that holds the item may lack."""
    k = F.floor(F.col("partition") * (1 - share) + 1e-9) + 1
    return found.where(F.col("place") <= k).select("hash", "length", "item_id", "item", "need", "partition")


def _sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a stored table, with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= rows else df


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, length: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared, containment) of documents that hold items.

    Few documents are candidates, so only their texts are cut up again for the exact check.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.store(item_shingles(items, length, share), "items")
    lengths = sorted(r["length"] for r in known.select("length").distinct().collect())  # at most `length` values
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = docs.select("doc_id", text_hash, "text")
    if not lengths:
        kinds = (docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
        schema = "doc_id {}, text_hash long, item_id {}, n_shingles int, n_shared long, containment double"
        return docs.sparkSession.createDataFrame([], schema.format(*kinds))
    signed = _sent_if_small(scratch.store(signatures(known, share), "signatures"), SMALL_ROWS)
    cut = rows.select("doc_id", "text_hash", words("text").alias("w"))
    per_length = F.array(*[F.struct(F.lit(n).alias("length"), hashes(F.col("w"), n).alias("hashes")) for n in lengths])
    looked_up = (
        cut.select("doc_id", "text_hash", F.explode(per_length).alias("one"))
        .select("doc_id", "text_hash", "one.length", F.size("one.hashes").alias("n"), F.explode("one.hashes").alias("hash"))
        .join(signed, ["hash", "length"]).where("n >= need")
    )
    candidates = scratch.store(looked_up.select("doc_id", "text_hash", "item_id", "item").distinct(), "candidates")

    key = F.xxhash64("doc_id", "text_hash")
    wanted = scratch.store(candidates.select(key.alias("doc_key")).distinct(), "wanted")
    again = rows.withColumn("doc_key", key).join(_sent_if_small(wanted, SMALL_KEYS), "doc_key", "left_semi")
    cut = again.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words("text").alias("w"))
    every = F.array_distinct(F.flatten(F.array(*[shingles(F.col("w"), n) for n in lengths])))
    hits = (
        cut.select("doc_id", "text_hash", F.explode(every).alias("shingle"))
        .join(_sent_if_small(known.select("item_id", "item", "size", "need", "shingle"), SMALL_ROWS), "shingle")
        .groupBy("doc_id", "text_hash", "item_id", "item", "size", "need").agg(F.count("*").alias("n_shared"))
        .where("n_shared >= need")
    )
    return hits.join(
        candidates.withColumnsRenamed({c: f"c_{c}" for c in candidates.columns}),
        F.expr("doc_id <=> c_doc_id and text_hash = c_text_hash and item_id <=> c_item_id and item = c_item"), "left_semi",
    ).select(
        "doc_id", "text_hash", "item_id", F.col("size").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("size")).alias("containment")
    )


def clean(docs: DataFrame, items: DataFrame, share: float = SHARE, length: int = WORDS) -> DataFrame:
    """docs without those that hold an item; all other rows and columns as they are."""
    scratch = Scratch(docs.sparkSession)
    bad = contained(docs, items, share, length).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = _sent_if_small(scratch.store(bad, "held"), SMALL_KEYS)
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__hash"])
    return docs.join(bad, same, "left_anti")


#: The same search for DuckDB, by comparing all shingles.
ORACLE_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
dw AS (SELECT doc_id, text, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM d),
iw AS (SELECT DISTINCT item_id, text, [x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark),
il AS (SELECT *, least(len(w), 5) AS n FROM iw WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, text, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s FROM il),
size AS (SELECT item_id, text, count(*) AS n_shingles FROM item GROUP BY ALL),
lengths AS (SELECT DISTINCT n FROM il),
doc AS (SELECT DISTINCT doc_id, dw.text, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS s
        FROM dw, lengths WHERE len(w) >= n),
hit AS (SELECT doc_id, doc.text AS dt, item_id, item.text AS it, count(*) AS n_shared FROM doc JOIN item USING (s, n) GROUP BY ALL)
SELECT doc_id, hit.item_id, CAST(n_shingles AS INTEGER) AS n_shingles, n_shared, n_shared / n_shingles AS containment
FROM hit JOIN size ON hit.item_id IS NOT DISTINCT FROM size.item_id AND hit.it = size.text
WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
