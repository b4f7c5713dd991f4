"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one hashes every normalised text to two bits of a blocked Bloom filter and keeps the
bits that were hit twice or more. Pass two looks every row up: a row whose two bits are both
kept may be repeated and is shuffled to its equals; all other rows are certain to be unique
and pass straight through, without a shuffle.

Defined results: null texts count as empty, and empty texts are equal to each other and to
texts of white space only. Of equal texts the one with the most code points stays, then the
smallest id (null ids last). Rows repeated with the same id and text share the verdict of
that id. An empty table gives an empty result. Carried columns keep their names, whatever
these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import BROADCAST_BYTES, SPACE, store, table, text_of

#: Bits of one block: what ``bitmap_construct_agg`` holds.
BLOCK = 32768


def normalised_sha256(text: Column) -> Column:
    return F.sha2(F.translate(text, SPACE, ""), 256)


def _blocks(rows: int, bits_per_row: int) -> int:
    return max(1, -(-rows * bits_per_row // BLOCK))


def _bits(blocks: int) -> tuple[Column, list[Column]]:
    """The block of a row's hash, and its two bits there."""
    h = F.xxhash64("_sha")
    bits = [F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(BLOCK)) for salt in (1, 2)]
    return F.pmod(h, F.lit(blocks)), bits


def repeat_filter(hashed: DataFrame, blocks: int) -> DataFrame:
    """Pass one: ``(_block, _bitmap)`` of the bits that two or more rows hit."""
    block, bits = _bits(blocks)
    hits = hashed.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_bit"))
    twice = hits.groupBy("_block", "_bit").count().where("count > 1")
    return twice.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def _is_set(bit: Column) -> Column:
    byte = F.substring(F.col("_bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.getbit(value, (bit % 8).cast("int")) == 1, F.lit(False))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), bits_per_row: int = 16, only_kept: bool = False
) -> DataFrame:
    """Columns ``carry``, then keep_id, group_size, kept, text_sha256, for every row.

    With ``only_kept``: one row of each group, and only the columns ``carry``.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    hashed = df.select(
        *[F.col(c).alias(n) for c, n in zip(carry, names)],
        F.col(id_col).alias("_id"),
        F.char_length(text_of(text_col)).alias("_n"),
        normalised_sha256(text_of(text_col)).alias("_sha"),
    )
    if set(carry) <= {id_col}:
        hashed = store(hashed)  # narrow: the text is read and hashed once
    blocks = _blocks(df.count(), bits_per_row)
    found = repeat_filter(hashed, blocks)
    if blocks * BLOCK // 8 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    block, bits = _bits(blocks)
    looked_up = hashed.withColumn("_block", block).join(found, "_block", "left")
    looked_up = looked_up.withColumn("_maybe", _is_set(bits[0]) & _is_set(bits[1])).drop("_block", "_bitmap")

    unique = looked_up.where(~F.col("_maybe")).select(
        *names, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    )
    maybe = looked_up.where("_maybe")
    rank = F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))
    best = maybe.groupBy("_sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("_best"))
    repeated = maybe.join(best, "_sha").select(
        *names,
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_id").eqNullSafe(F.col("_best.id")) & (-F.col("_n") == F.col("_best.n"))).alias("kept"),
        "_sha",
    )
    if only_kept:
        out = unique.select(names).unionByName(repeated.where("kept").dropDuplicates(["_sha"]).select(names))
        return out.toDF(*carry)
    out = unique.unionByName(repeated)
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(carry, names)], "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256")
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
