"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Every step is DataFrame code. A step must look only at rows that the step before
left in a group of two or more. To know that inside the scan, without shuffling
any text, the surviving keys are folded into a bit set of fixed size and joined
to the scan by broadcast. The set may let a lone row through (two keys on one
bit); it never stops a row of a group. Groups are formed on the exact keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxtable.llm.common import stored

#: 64-bit words of the bit set: 16 million bits, so at most 262,144 rows are broadcast however large the input is.
WORDS = 1 << 18
PREFIX_CHARS = 64
BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text") -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), BLANKS, " ")


def _bit_set(keys: DataFrame, key: Column) -> DataFrame:
    h = F.xxhash64(key)
    bits = keys.select(h.bitwiseAND(F.lit(WORDS - 1)).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 58).cast("int")).alias("bit"))
    return stored(bits.groupBy("__word").agg(F.bit_or("bit").alias("__bits")), "exact-bits")


def _maybe(rows: DataFrame, bit_set: DataFrame, key: Column) -> DataFrame:
    """rows with `maybe`: false only where the key is surely not among those of the bit set."""
    h = F.xxhash64(key)
    hit = F.call_function("shiftright", F.col("__bits"), F.shiftrightunsigned(h, 58).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    joined = rows.withColumn("__word", h.bitwiseAND(F.lit(WORDS - 1))).join(F.broadcast(bit_set), "__word", "left")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__word", "__bits")


def row_hash(text: str = "text") -> Column:
    """Tells apart the rows of one doc_id, null included, by their text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def first_row() -> Column:
    """Orders rows (doc_id, h): the smallest id comes first, a null id last, equal ids go by h."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.col("h").alias("h"))


def _hashed(docs: DataFrame, text: str, sha: bool, *more: Column) -> DataFrame:
    """doc_id, more, maybe, text_sha256 per row of docs; maybe is true for all rows whose text is there twice."""
    rows = docs.select(F.col("doc_id"), normalised(text).alias("t"), *more)
    size = F.length("t")
    lengths = rows.groupBy(size.alias("n")).count().filter("count > 1")
    first = _maybe(rows, _bit_set(lengths, F.col("n")), size)
    prefix = F.xxhash64(F.substring("t", 1, PREFIX_CHARS))
    prefixes = first.filter("maybe").groupBy(size.alias("n"), prefix.alias("p")).count().filter("count > 1")
    second = _maybe(rows, _bit_set(prefixes, F.struct("n", "p")), F.struct(size.alias("n"), prefix.alias("p")))
    full = F.sha2(F.col("t").cast("binary"), 256)
    return stored(second.select(*[c for c in second.columns if c != "t"], (full if sha else F.when(F.col("maybe"), full)).alias("text_sha256")), "exact-rows")


def exact_groups(docs: DataFrame, text: str = "text", sha: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept; with sha also text_sha256.

    Null text is empty. Texts that are equal after normalisation are one group,
    the smallest doc_id stays (a null id only if it has no other). A document's
    repeated rows are all listed and counted; `kept` is true for each row that
    bears the kept id. Other columns of docs are not read. No rows give no rows.
    sha: hash every text, not only those in doubt, and return the hash.
    """
    hashed = _hashed(docs, text, sha)
    groups = hashed.filter("maybe").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    joined = hashed.filter("maybe").join(stored(groups, "exact-groups"), "text_sha256", "left").drop("maybe")
    alone = hashed.filter("NOT maybe").drop("maybe").withColumn("keep_id", F.lit(None).cast("long")).withColumn("group_size", F.lit(None).cast("long"))
    out = joined.unionByName(alone).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    return out if sha else out.drop("text_sha256")


def keep_rows(docs: DataFrame, decisions: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs without those that decisions (doc_id, h by row_hash, kept) drop; rows with no decision stay.

    A decision is met by id and text, so rows that share an id, null included, are
    dropped or kept each by its own text; decided rows equal in both stay once. All of
    docs' columns and no other. Rows that are surely not dropped, by a bit set, stay
    where they are; only the others meet the exact decisions in a shuffle.
    """
    own = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(own))])
    key, h = F.col(f"c{own.index('doc_id')}").cast("long"), row_hash(f"c{own.index(text)}")
    by_row = decisions.groupBy(F.col("doc_id").cast("long").alias("__id"), F.col("h").alias("__h")).agg(F.max("kept").alias("__keep"), F.count("*").alias("__rows"))
    special = stored(by_row.filter("NOT __keep OR __rows > 1"), "special-rows")
    marked = _maybe(inner, _bit_set(special, F.struct("__id", "__h")), F.struct(key.alias("__id"), h.alias("__h")))
    sure = marked.filter("NOT maybe").drop("maybe")
    met = marked.filter("maybe").drop("maybe").join(special.hint("merge"), key.eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left")
    kept = sure.unionByName(met.filter("__keep IS NULL").select(*inner.columns))
    if not special.filter("__keep").isEmpty():  # of rows equal in id and text, the first by all columns; pruned in front of the shuffle
        w = Window.partitionBy(key, h).orderBy(*[F.col(c).cast("string") for c in inner.columns])
        first = met.filter("__keep").withColumn("__nth", F.row_number().over(w)).filter("__nth = 1")
        kept = kept.unionByName(first.select(*inner.columns))
    return kept.toDF(*own)


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each text, the one with the smallest id (a null id last), columns unchanged."""
    rows = _hashed(docs, text, False, row_hash(text).alias("h")).filter("maybe")
    groups = rows.groupBy("text_sha256").agg(F.min(first_row()).alias("first"), F.count("*").alias("n")).filter("n > 1").select("text_sha256", "first")
    met = rows.join(stored(groups, "exact-firsts"), "text_sha256")
    return keep_rows(docs, met.select("doc_id", "h", (first_row() == F.col("first")).alias("kept")), text)
