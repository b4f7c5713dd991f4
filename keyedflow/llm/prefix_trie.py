"""Prefix trie of conversations, with subtree totals rolled up by bands of depth.

Conversations are ordered by turn and rebuilt from the opening of the first conversation of their
block; each distinct sequence of first turns is a node. A node is named by its depth and 128 bits: the
XOR of the hashes of its turns, each hashed together with its depth. XORs of consecutive turns are made
chunk by chunk, so no task needs a whole conversation.

Roll-up: depths are cut into bands of ``BAND``. Each node gives its own values to its ancestors within
its band alone, which are at most ``BAND``. What band roots (the first nodes of a band) hold is
then summed by the same rule over the tree of band roots alone, which is ``BAND`` times less deep, and so on;
the completed totals of band roots go to their ancestors in the band above. So a tree of depth D takes
log(D) / log(BAND) levels, two sums each, and no row becomes more than ``BAND`` rows.

The conversations that end at a node are joined in ascending order piece by piece; only finished pieces
of ``PIECE`` ids go to the one task that has to hash them one after another, as a stream.

Defined results: null roles and texts count as empty, null turns come first, and turns with the same
number follow by a hash of role and text. Repeated rows are turns of their own. Rows without conv_id
belong to no conversation and are left out. A conversation whose opening is absent and that has no
turns left ends at the root. Empty tables have no nodes, not even a root. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyedflow.llm.common import in_order, store, table

BLOCK, OPENINGS = 5, 9
BAND = 8
#: Turns of a conversation whose hashes one task combines.
CHUNK = 8192
#: Ids joined into one piece before they are hashed in order.
PIECE = 256
#: Rows of a key above which it counts as hot, at least.
HOT = 100_000
ROOT = "struct<d:bigint,a:bigint,b:bigint>"


def node(d: Column, a: Column, b: Column) -> Column:
    return F.struct(d.cast("long").alias("d"), a.alias("a"), b.alias("b"))


def looked_up(rows: DataFrame, names: DataFrame, on: str, weight: str, how: str = "inner", hot: int | None = None) -> DataFrame:
    """``rows`` joined with ``names``, which has one row per ``on`` and its number of rows as ``weight``.

    Names with very many rows are broadcast and joined where the rows are. They are at most a thousand,
    or the number of all rows divided by ``HOT``, whichever is less.
    """
    if hot is None:
        hot = max(HOT, (names.agg(F.sum(weight)).first()[0] or 0) // 1000)
    heavy = names.where(F.col(weight) > hot)
    if heavy.isEmpty():
        return rows.join(names.drop(weight), on, how)
    heavy = F.broadcast(heavy.drop(weight))
    light = names.where(F.coalesce(F.col(weight) <= hot, F.lit(True))).drop(weight)
    return rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(light, on, how))


def ordered_turns(df: DataFrame) -> DataFrame:
    """``c, x, y, bytes, pos``: conversation, two hashes of role and text, size of the text, place among all turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit(1), text, role).alias("y"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return in_order(store(rows), "c", F.col("turn").isNotNull(), "turn", "x", "y")


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations ``(c, d, x, y, bytes, length)``, and all ids with their lengths ``(c, length)``."""
    turns = ordered_turns(df)
    sizes = turns.groupBy("c").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    own = sizes.withColumns({
        "h": (F.crc32(F.col("c").cast("string").cast("binary")) % OPENINGS).cast("long"), "opening": F.col("c") - F.col("c") % BLOCK,
    })
    openings = sizes.select(F.col("c").alias("opening"), F.col("n").alias("opening_n"))
    convs = own.join(openings, "opening", "left").select(
        "c", "n", "h", "opening", "start", F.least("h", F.coalesce("opening_n", F.lit(0).cast("long"))).alias("taken")
    )
    convs = store(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    rows = store(
        looked_up(turns, convs.select("c", "start", "h", "taken", "length", "n"), "c", "n").withColumn("p", F.col("pos") - F.col("start"))
    )
    rest = rows.where("p >= h").select("c", (F.col("taken") + F.col("p") - F.col("h") + 1).alias("d"), "x", "y", "bytes", "length")
    # The first turns of an opening, at most eight rows, for at most nine conversations.
    heads = rows.where(F.col("p") < OPENINGS - 1).select(F.col("c").alias("opening"), "p", "x", "y", "bytes")
    first = heads.join(convs.select("c", "opening", "h", "length"), "opening").where("p < h").select(
        "c", (F.col("p") + 1).alias("d"), "x", "y", "bytes", "length"
    )
    return first.unionByName(rest), convs.select("c", "length")


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``c, d, node, parent, bytes, last``: the node that a conversation reaches with each of its turns."""
    own = turns.withColumns({"a": F.xxhash64("x", "d"), "b": F.xxhash64("y", F.lit(1), "d"), "chunk": F.floor((F.col("d") - 1) / chunk)})
    # Only conversations above a chunk have totals to hand on.
    totals = own.where(F.col("length") > chunk).groupBy("c", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = W.partitionBy("c").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select("c", "chunk", *[F.bit_xor(x).over(earlier).alias(x) for x in ("a", "b")]).where("chunk > 0")
    rows = own.select("c", "chunk", "d", "a", "b", "bytes", (F.col("d") == F.col("length")).alias("last")).unionByName(carry, allowMissingColumns=True)
    upto = W.partitionBy("c", "chunk").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.select("*", F.bit_xor("a").over(upto).alias("ra"), F.bit_xor("b").over(upto).alias("rb")).where("d is not null")
    return run.select(
        "c", "d", node(F.col("d"), F.col("ra"), F.col("rb")).alias("node"),
        node(F.col("d") - 1, F.col("ra").bitwiseXOR(F.col("a")), F.col("rb").bitwiseXOR(F.col("b"))).alias("parent"),
        "bytes", "last",
    )


def nodes_of(rows: DataFrame, band: int, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per node of ``rows`` (c, d, node, parent): its smallest member, members, and ``up``.

    ``up`` holds the ancestors down from the root of the band of the node's parent.
    """
    within = W.partitionBy("c", F.floor((F.col("d") - 1) / band)).orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    led = rows.select("node", "c", "d", "parent", *more, F.collect_list("parent").over(within).alias("up"))
    found = led.groupBy("node").agg(F.min(F.struct("c", "d", "parent", "up", *more)).alias("first"), F.count(F.lit(1)).alias("n_convs"))
    return found.select("node", "first.*", "n_convs")


def roll_up(rows: DataFrame, nodes: DataFrame, values: list[str], depth: int, band: int) -> DataFrame:
    """``(node, *values)`` summed over every node's subtree.

    ``rows`` are (c, d, node, parent) for d >= 1, ``nodes`` their (node, d, up, *values), the root included.
    """
    is_root = F.col("d") % band == 0
    itself = F.array("node")
    inside = nodes.select(F.explode(F.when(is_root, itself).otherwise(F.concat("up", itself))).alias("node"), *values)
    inside = store(inside.groupBy("node").agg(*[F.sum(v).alias(v) for v in values]))
    if depth < band:
        return inside
    # The tree of band roots; the first ancestor in `up` is the root of the band above.
    above = W.partitionBy("c", F.floor((F.col("d") - 1) / band)).orderBy("d").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    roots = rows.select("c", "d", "node", F.first("parent").over(above).alias("parent")).where(is_root)
    roots = store(roots.withColumn("d", (F.col("d") / band).cast("long")))
    small = nodes_of(roots, band).select("node", "d", "up")
    small = small.unionByName(nodes.where("d = 0").select("node", "d", F.array().cast(f"array<{ROOT}>").alias("up")))
    totals = roll_up(roots, store(small.join(inside, "node")), values, depth // band, band)
    done = nodes.where(is_root & (F.col("d") > 0)).select("node", "up").join(totals, "node")
    down = done.select(F.explode("up").alias("node"), *values)
    return store(inside.unionByName(down).groupBy("node").agg(*[F.sum(v).alias(v) for v in values]))


def _hash_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order, one node after another, to the digest of each node's joined pieces."""
    at, digest = None, None
    for batch in batches:
        done = []
        for *key, piece in batch[["d", "a", "b", "ids"]].itertuples(index=False):
            if key != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=["d", "a", "b", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["d", "a", "b", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of the conversations ``ends`` (node, c)."""
    placed = in_order(ends, "node", "c")
    pieces = placed.groupBy("node", F.floor(F.col("pos") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("c")).alias("ids"))
    joined = pieces.select("node.d", "node.a", "node.b", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.repartition(parts, "d", "a", "b").sortWithinPartitions("d", "a", "b", "piece")
    hashed = dealt.mapInPandas(_hash_pieces, "d long, a long, b long, ends_sha256 string")
    return hashed.select(node(F.col("d"), F.col("a"), F.col("b")).alias("node"), "ends_sha256")


def prefix_trie(df: DataFrame, band: int = BAND, chunk: int = CHUNK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; ``band`` is at least 2."""
    turns, convs = rebuilt(df)
    rows = store(prefixes(turns, chunk))
    root = F.lit(0).cast("long")
    root = node(root, root, root)
    everyone = convs.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root.alias("node"), "c", F.lit(0).cast("long").alias("d"), F.lit(None).cast(ROOT).alias("parent"),
        F.array().cast(f"array<{ROOT}>").alias("up"), F.lit(0).cast("long").alias("bytes"), "n_convs",
    )
    nodes = store(nodes_of(rows, band, ("bytes",)).unionByName(everyone))
    children = store(nodes.where("d > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    with_children = nodes.join(children, "node", "left").fillna(0, ["n_children"])
    worth = store(with_children.select(
        "node", "c", "d", "parent", "up", "n_convs", "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    ))
    depth = worth.agg(F.max("d")).first()[0] or 0
    values = ["n_leaves", "saved_tokens"]
    totals = roll_up(rows.select("c", "d", "node", "parent"), worth.select("node", "d", "up", *values), values, depth, band)
    ends = rows.where("last").select("node", "c").unionByName(convs.where("length = 0").select(root.alias("node"), "c"))
    # Rows of a parent are its children.
    parents = worth.where("n_children > 0").select(F.col("node").alias("parent"), F.col("c").alias("parent_conv_id"), "n_children")
    named = looked_up(worth.where("d > 0"), parents.withColumnRenamed("n_children", "rows"), "parent", "rows").unionByName(
        worth.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    )
    out = named.drop(*values).join(totals, "node").join(ends_of(store(ends)), "node", "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", *values,
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


#: Unsigned crc32 of the decimal digits, bit by bit; 3988292384 is its polynomial.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1),
  lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, bit: xor(v // 2, 3988292384::BIGINT * (v % 2)))), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS opening, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT c.*, least(h, coalesce(s.n, 0)) AS taken FROM c LEFT JOIN sizes s ON s.conv_id = c.opening),
turns AS (
  SELECT k.conv_id, t.p + 1 AS d, role, text FROM k JOIN t ON t.conv_id = k.opening AND t.p < k.h
  UNION ALL
  SELECT k.conv_id, taken + t.p - h + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.p >= k.h),
steps AS (
  SELECT conv_id, d, strlen(text) AS bytes,
         list(md5(role || chr(31) || text)) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM c),
nodes AS (SELECT path, any_value(d) AS d, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM steps GROUP BY path),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_children IS NULL)::BIGINT AS leaf, (n_convs - 1) * bytes AS saved
  FROM nodes n LEFT JOIN children USING (path)),
totals AS (
  SELECT path[1:up] AS path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT path, leaf, saved, unnest(range(0, d + 1)) AS up FROM own) GROUP BY 1),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(path, d) AS path FROM steps GROUP BY conv_id) GROUP BY path)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN totals t ON t.path = o.path LEFT JOIN ends e ON e.path = o.path
LEFT JOIN nodes p ON o.d > 0 AND p.path = o.path[1:o.d - 1]
"""
