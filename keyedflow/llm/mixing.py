"""Mixing sources to target weights with Pareto order sampling.

Every source has a target number of words. Within a source a document's expected copies grow
with its length (by the logarithm) and stop at the allowed repeats; whole copies are certain,
and what is left of the expectation is the document's inclusion probability p. Documents are
ranked by Pareto's quotient of odds, u / (1 - u) over p / (1 - p) with a random u, and taken in
that order until the source's words are reached. The last one taken is cut there, so every
source meets its target to the word.

u is a hash of id and text, so reruns agree. The order is found without sorting a source: words
are summed by ranges of the rank first, and only the range in which the target falls is sorted.

Defined results: a null or empty text has size 0 and nothing is taken of it. A null source is a
source of its own and comes last. Repeated rows are rows of their own. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyedflow.llm.common import WORD, in_order, store, table, text_of

WEIGHTS = (5, 2, 1)
SHARE, REPEATS = 1.5, 2
#: Ranges of the rank within a source; the one that holds the target is sorted.
RANGES = 1 << 16


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with target: by weight, at most ``repeats`` times the size.

    What a source can't take is shared among the others by weight, until none is above.
    """
    ordered = in_order(store(sources.withColumn("_none", F.col("source").isNull())), "_none", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights)).cast("int") + 1)
    ordered = store(ordered.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * repeats))
    left = share * (ordered.agg(F.sum("source_size")).first()[0] or 0)
    full = 0.0  # up to this much for each weight, a source is full
    while True:
        open_ = ordered.where(F.col("_most") / F.col("_weight") > F.lit(full)).agg(F.sum("_weight")).first()[0]
        held = ordered.where(F.col("_most") / F.col("_weight") <= F.lit(full)).agg(F.sum("_most")).first()[0] or 0
        if not open_:
            rate = full
            break
        rate = (left - held) / open_
        if rate <= full:
            break
        below = ordered.where((F.col("_most") / F.col("_weight") > F.lit(full)) & (F.col("_most") / F.col("_weight") <= F.lit(rate)))
        if below.isEmpty():
            break
        full = rate
    target = F.least(F.col("_most").cast("double"), F.col("_weight") * F.lit(float(rate)))
    return ordered.select("source", "source_size", target.alias("target"))


def _weight(size: Column) -> Column:
    """Weight of a document's size: the same within a power of two, so few numbers tell all."""
    return 1.0 + F.floor(F.log2(size.cast("double")))


def _rates(sized: DataFrame, goals: DataFrame, repeats: int) -> DataFrame:
    """Per source, the rate by which weights become expected copies that sum to the target.

    At most 64 weights a source: those at the top are cut at ``repeats``, the rest share.
    """
    by_weight = sized.where("size > 0").groupBy("source", _weight(F.col("size")).alias("w")).agg(F.sum("size").alias("words"))
    by_weight = by_weight.join(goals, by_weight["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    above = Window.partitionBy("source").orderBy(F.desc("w"))
    over = F.coalesce(F.sum("words").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(above.rowsBetween(0, Window.unboundedFollowing))
    rate = (F.col("target") - repeats * over) / rest
    fits = F.when(rate * F.col("w") <= repeats * (1 + 1e-12), rate)
    # The first weight, from the top, that need not be cut.
    return by_weight.select("source", "w", fits.alias("rate")).groupBy("source").agg(F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("w"))).alias("rate"))


def mix(df: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, and what identifies a row: source, draw."""
    sized = store(
        df.select("doc_id", "source", words(text_of()).alias("size"), F.xxhash64("doc_id", text_of(), F.lit(seed)).alias("draw"))
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, weights, share, repeats)
    rates = _rates(sized, goals, repeats)
    known = goals.join(rates, goals["source"].eqNullSafe(rates["source"]), "left").drop(rates["source"])
    known = store(known.withColumnRenamed("source", "_source"))

    expected = F.least(F.coalesce(F.col("rate"), F.lit(0.0)) * _weight(F.col("size")), F.lit(float(repeats)))
    rows = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    rows = rows.withColumn("_copies", F.when(F.col("size") > 0, F.greatest(expected, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("_whole", F.floor("_copies")).withColumn("_p", F.col("_copies") - F.floor("_copies"))
    u = (F.shiftrightunsigned("draw", 11) + 0.5) / F.lit(float(1 << 53))
    rank = F.when(F.col("_p") > 0, (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p"))))
    rows = rows.withColumn("_rank", rank)
    # rank / (1 + rank) lies between 0 and 1 and keeps the order.
    rows = rows.withColumn("_range", F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANGES))

    certain = rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.max("target").alias("_target"))
    ranges = rows.where("_rank is not null").groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    ranges = ranges.join(certain, ranges["source"].eqNullSafe(certain["source"])).drop(certain["source"])
    in_source = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"),
        (F.round("_target") - F.col("_certain") - F.coalesce(F.sum("_words").over(in_source), F.lit(0))).cast("long").alias("_left"),
        "_words",
    )
    full, at = F.expr("_left >= _words"), F.expr("_left > 0 and _left < _words")
    cuts = ranges.groupBy("_s").agg(
        F.max(F.when(full, F.col("_r"))).alias("_through"),
        F.max(F.when(at, F.col("_r"))).alias("_edge"),
        F.max(F.when(at, F.col("_left"))).alias("_left"),
    )
    rows = rows.join(cuts, rows["source"].eqNullSafe(cuts["_s"]), "left").drop("_s")
    edge = rows.where("_range = _edge").withColumn(
        "_before",
        F.coalesce(
            F.sum("size").over(Window.partitionBy("source", "_range").orderBy("_rank", "draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    part = F.greatest(F.least(F.col("_left") - F.col("_before"), F.col("size")), F.lit(0))
    rest = rows.where("_range is null or _edge is null or _range <> _edge")
    drawn = F.coalesce(F.col("_range") <= F.col("_through"), F.lit(False))
    whole = F.col("_whole") * F.col("size")
    out = edge.withColumn("taken", whole + part).drop("_before").unionByName(
        rest.withColumn("taken", whole + F.when(drawn, F.col("size")).otherwise(0))
    )
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source", "draw")


def mixed(df: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, whole.

    Of the one document of a source that the mix takes in part, the last copy is taken if the mix takes
    half of it or more, so a source is off its target by half of one document at most. Rows repeated with
    the same id and text all get the largest share of any of them.
    """
    shares = mix(df, seed=seed).where("taken > 0").groupBy("draw").agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names)], F.xxhash64("doc_id", text_of(), F.lit(seed)).alias("draw"))
    copies = F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int")
    rows = rows.join(shares, "draw").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return rows.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("source", "draw")
