"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. Distinct blocks are sorted (by two hashes and the block itself) and get
integer names; then adjacent pairs of names are sorted (by a hash and the pair) and named in the same way, until one name is left for each document.
Texts of one block count have equal names only if they are equal: names are given to sorted distinct values, never to hashes,
so there are no collisions. A name is the value's section of the sort order and its place there, so names depend on the
texts alone, not on partitions or on the order of the rows.

Work at scale: block texts are shuffled once, already distinct within each task. Rows of a document carry two 64-bit
hashes of a block to its name; if two distinct blocks share both hashes (that is looked for at each run), the rows of
that run are matched by whole blocks instead. Levels after the first move names only, and finished documents leave, so
the number of rounds is the logarithm of the longest text in blocks. Groups of copies are aggregated before they are
shuffled; their members are joined back by a sort-merge join that adaptive execution splits where a key is hot.

Defined cases: null counts as empty; equal means identical once blanks (space, tab to CR) are deleted; of equal texts the
one with the most code points stays, then the smallest doc_id (null ids last), then one of fully repeated rows; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, LAST_ID, materialize, release

BLOCK = 4096


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def blocks_of(text: Column, size: int) -> Column:
    """Fixed-size blocks of a text; an empty text is one empty block."""
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) > size, found).otherwise(F.array(text))


def hashes(c: Column, bits: int) -> tuple[Column, Column]:
    one, two = F.xxhash64(c), F.xxhash64(F.lit(1), c)
    return (one, two) if bits == 64 else (F.pmod(one, F.lit(1 << bits)), F.lit(0).cast("long"))


#: Sections of the sort order, which are sorted on their own, and the bits for places in one.
SECTIONS, PLACE_BITS = 4096, 40


def named(distinct: DataFrame, h: str, order: list[str]) -> DataFrame:
    """Distinct values with names in the order of a hash and of the values themselves. The hash's high bits are the section, so
    sections are of like size whatever the values."""
    w = Window.partitionBy("section").orderBy(h, *order)
    section = F.shiftright(h, 52).cast("long") + SECTIONS // 2
    return distinct.withColumn("section", section).withColumn("name", F.shiftleft("section", PLACE_BITS) + F.row_number().over(w)).drop("section")


def block_identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row per document: row_id, doc_id, n_points, text_sha256, n_blocks, name. (n_blocks, name) is the identity."""
    h1, h2 = hashes(F.col("block"), hash_bits)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_points"), normalised(text).alias("norm"))
    pieces = source.select(blocks_of(F.col("norm"), block).alias("blocks")).select(F.explode("blocks").alias("block"))
    found = materialize(pieces.select(h1.alias("h1"), h2.alias("h2"), "block").distinct().select("h1", "h2"), "blocks")
    clash = not found.groupBy("h1", "h2").count().where("count > 1").isEmpty()
    names = None if clash else materialize(named(found, "h1", ["h2"]), "names")
    hashed = F.transform("blocks", lambda b: F.struct(*[h.alias(n) for h, n in zip(hashes(b, hash_bits), ("h1", "h2"))]))
    rows = materialize(
        source.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_points", F.sha2("norm", 256).alias("text_sha256"),
            blocks_of(F.col("norm"), block).alias("blocks"),
        ).select("row_id", "doc_id", "n_points", "text_sha256", F.size("blocks").alias("n_blocks"), (F.col("blocks") if clash else hashed).alias("keys"))
    )
    if clash:
        key = ["block"]
        exploded = rows.select("row_id", "n_blocks", F.posexplode("keys").alias("pos", "block"))
        names = materialize(named(pieces.select(h1.alias("h1"), h2.alias("h2"), "block").distinct(), "h1", ["h2", "block"]).select("block", "name"), "names")
    else:
        key = ["h1", "h2"]
        exploded = rows.select("row_id", "n_blocks", F.posexplode("keys").alias("pos", "k")).select("row_id", "n_blocks", "pos", "k.*")
    level = materialize(exploded.join(names, key).select("row_id", "n_blocks", "pos", "name"))
    most = rows.agg(F.max("n_blocks")).first()[0] or 0
    done = level.where("n_blocks = 1").select("row_id", "name")
    width = 1  # blocks under one name
    while width < most:
        pairs = materialize(
            level.where(F.col("n_blocks") > width)
            .groupBy("row_id", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
            )
        )
        fresh = materialize(named(pairs.select("l", "r").distinct().withColumn("h", F.xxhash64("l", "r")), "h", ["l", "r"]).drop("h"))
        level = materialize(pairs.join(fresh, ["l", "r"]).select("row_id", "n_blocks", "pos", "name"))
        release(pairs, fresh)
        done = done.unionByName(level.where((F.col("n_blocks") > width) & (F.col("n_blocks") <= 2 * width)).select("row_id", "name"))
        width *= 2
    return rows.drop("keys").join(done, "row_id")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, dropped ones too."""
    ident = materialize(block_identities(docs, doc_id, text, block, hash_bits))
    best = F.struct((-F.col("n_points")).alias("len"), F.coalesce("doc_id", F.lit(LAST_ID)).alias("at"), "doc_id", "row_id")
    groups = ident.groupBy("n_blocks", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    own = (F.col("best").isNull()) | (F.col("best.row_id") == F.col("row_id"))
    return ident.join(groups, ["n_blocks", "name"], "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        own.alias("kept"),
        "text_sha256",
    )
