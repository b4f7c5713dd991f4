"""Near-duplicates: fast similarity sketches, banding, exact verification, components.

Every set of word shingles gets a fast similarity sketch: in round i every shingle is hashed to
a bin and a value there, and a coordinate takes its smallest value of the first round that
reaches it; after as many rounds as coordinates, round by round all shingles go to one bin, so
every coordinate fills. Two sets agree in a coordinate with a probability equal to their
likeness (Jaccard), with the concentration of independent samples.

Sets with equal sketches in a band of ROWS coordinates are candidates. Sets of likeness 0.8
miss all BANDS bands with a probability of 7e-6. Equal sets count once. In a bucket the set that
meets most others is compared with all; only buckets whose sets are then still in different
components are compared fully, in blocks of BLOCK sets, by their sketches first. Candidates
are confirmed on full sets. No bucket or candidate is left out, whatever its size.

Defined results: null texts count as empty. A text without words has no shingles and is linked
with nothing, not even with another empty text; its component is its own id. A text with fewer
words than a shingle has its whole sequence as the one shingle. Rows repeated with an id share
its component; an id that is null takes part, and counts as the component's id only if the
component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import let_go, store, table, text_of
from keyedflow.llm.components import components

#: Words of a shingle: of op9, and of near-duplicate stages.
WIDTH, STAGE_WIDTH = 4, 5
BANDS, ROWS = 30, 5
SIZE = BANDS * ROWS
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets of a block, and the likeness by sketch from which a pair is confirmed on full sets: at
#: a true likeness of 0.8 the sketch stays above it but for one pair in 200,000.
BLOCK, FLOOR = 512, 0.65
#: Words of a block, all sets together, before there are more blocks.
BLOCK_WORDS = 2_000_000
#: Bytes of text that are hashed at a time in a task.
CHUNK = 1 << 20

_ODD = np.random.default_rng(2).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_SEEDS = np.random.default_rng(3).integers(1, 1 << 63, 2 * SIZE, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of every text; all texts' bytes are hashed together."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    # In place, as each of these is many times as large as the texts.
    nth = np.arange(len(data))
    nth -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
    powers = np.full(int(nth.max()) + 1, _ODD[0])
    powers[0] = 1
    values = np.cumprod(powers)[nth]
    del nth
    scaled = data.astype(np.uint64)
    scaled += np.uint64(1)
    values *= scaled
    del scaled
    values[space] = 0
    hashes = _mix(np.add.reduceat(values, starts))
    at = np.searchsorted(starts, bounds)
    return [hashes[a:b] for a, b in zip(at[:-1], at[1:])]


def shingle_sets(texts: Iterable[str], width: int) -> Iterator[np.ndarray]:
    """The sorted hashes of every text's distinct shingles."""
    for own in _chunks(t.encode("utf-8", "surrogatepass").lower() for t in texts):
        for words in _word_hashes(own):
            n = len(words)
            if n == 0:
                yield words
            elif n < width:
                yield _mix((np.append(words, np.uint64(n)) * _ODD[8 : 9 + n]).sum(keepdims=True))
            else:
                yield np.unique(_mix(sum(words[i : n - width + 1 + i] * _ODD[4 + i] for i in range(width))))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a set that is not empty: the round that filled it, and the value."""
    out = np.zeros(SIZE, np.uint64)
    open_ = np.ones(SIZE, bool)
    turn = 0
    while turn < SIZE and open_.any():
        turns = min(SIZE - turn, max(1, 4 * SIZE // len(shingles)))
        h = _mix(shingles[None, :] ^ _SEEDS[turn : turn + turns, None])
        bins = ((h >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        rounds = np.arange(turn, turn + turns, dtype=np.uint64)[:, None]
        # By bin, then round, then value: the first of each bin is what it takes.
        keys = np.sort(((bins << np.uint64(48)) | (rounds << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).ravel())
        bins = (keys >> np.uint64(48)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        first = first[open_[bins[first]]]
        out[bins[first]] = keys[first] & np.uint64(0xFFFFFFFFFFFF)
        open_[bins[first]] = False
        turn += turns
    for b in np.flatnonzero(open_):
        value = (_mix(shingles ^ _SEEDS[SIZE + b]) & np.uint64(0xFFFFFFFF)).min()
        out[b] = (np.uint64(SIZE + b) << np.uint64(32)) | value
    return out


def bands(sketched: np.ndarray) -> np.ndarray:
    rows = _mix(sketched).reshape(BANDS, ROWS) * _ODD[:ROWS]
    return _mix(rows.sum(1) + np.arange(BANDS, dtype=np.uint64) * _ODD[15]).view(np.int64)


def sketches(df: DataFrame, width: int) -> DataFrame:
    """doc_id, row, n_shingles, set_id, bands, bits (a byte of each coordinate) of every row."""
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, k1 long, k2 long, n_shingles long, set_id binary, bands array<long>, bits binary"
    names = ["doc_id", "row", "k1", "k2", "n_shingles", "set_id", "bands", "bits"]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rows = []
            for s in shingle_sets((t.as_py() for t in batch["text"]), width):
                if len(s):
                    made = sketch(s)
                    bits = (_mix(made) & np.uint64(255)).astype(np.uint8).tobytes()
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), bands(made), bits))
                else:
                    rows.append((0, None, None, None))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names[:4]] + made, names)

    return store(_keyed(df).withColumn("row", F.monotonically_increasing_id()).mapInArrow(sketched, schema))


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with two hashes that tell them by id and text."""
    text = text_of()
    return df.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, "doc_id", F.lit(1)).alias("k2"))


def _alike(n1: str, n2: str):
    """Whether the sizes allow a link: the intersection has at most the smaller set's size."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * PERCENT


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are linked; ``texts`` has node, text."""

    def confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            keep = []
            others = shingle_sets(batch["text_b"].tolist(), width)
            for a, text, other in zip(batch["a"], batch["text_a"], others):
                if last is None or last[0] != a:
                    last = (a, next(shingle_sets([text], width)))
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * shared >= PERCENT * (len(last[1]) + len(other) - shared))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return store(pairs.join(second, "b").join(first, "a").mapInPandas(confirmed, "a long, b long"))


def _star_pairs(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """In every bucket, the set that meets most others with each of them."""
    meets = shared.groupBy("node").agg(F.sum("in_bucket").alias("meets"))
    hubs = shared.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("node")).alias("order"))).alias("hub"))
    pairs = shared.join(hubs.select("bucket", (-F.col("hub.order")).alias("a")), "bucket").where("node <> a")
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    return _sized(pairs, sets)


def _sized(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    n1 = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("n1"))
    n2 = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("n2"))
    return pairs.join(n1, "a").join(n2, "b").where(_alike("n1", "n2")).select("a", "b")


def _block_links(shared: DataFrame, sets: DataFrame, found: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links between sets of one bucket that are in different components, from blocks of it.

    Buckets of two have been compared. Two blocks of a bucket meet in one task, which compares
    their sets by the sketches' bytes and then fully; it gives only links that join what it has
    not joined yet, so no more than it has sets. A pair counts in its first common band only.
    A block has about BLOCK sets, fewer where these are large.
    """
    at = shared.where("in_bucket > 2").join(found, "node", "left")
    at = at.withColumn("component", F.coalesce("component", "node"))
    at = at.join(sets.select("node", "n_shingles", "bits", "bands"), "node")
    mixed = at.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n_shingles").alias("words")
    ).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("in_bucket") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    at = at.join(mixed.select("bucket", "words"), "bucket").withColumn("blocks", blocks)
    at = at.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(texts, "node")
    at = at.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    at = at.select(
        "bucket", F.least("mine", "other").alias("lower"), F.greatest("mine", "other").alias("upper"),
        "mine", "node", "component", "n_shingles", "bits", "bands", "text",
    )

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(b"".join(group["bits"]), np.uint8).reshape(-1, SIZE)
        banded = np.array(group["bands"].tolist(), np.int64)
        node, n, component, mine = (group[c].to_numpy(copy=True) for c in ("node", "n_shingles", "component", "mine"))
        bucket, lower, upper = (group[c].iloc[0] for c in ("bucket", "lower", "upper"))
        full: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in full:
                full[i] = next(shingle_sets([group["text"].iloc[i]], width))
            return full[i]

        columns, out = np.flatnonzero(mine == upper), []
        for i in np.flatnonzero(mine == lower):
            other = columns[(component[columns] != component[i]) & ((lower != upper) | (columns > i))]
            other = other[100 * np.minimum(n[other], n[i]) >= PERCENT * np.maximum(n[other], n[i])]
            other = other[((bits[other] == bits[i]).mean(1) - 1 / 256) / (1 - 1 / 256) >= FLOOR]
            same = banded[other] == banded[i]
            other = other[banded[i][same.argmax(1)] == bucket] if len(other) else other
            if not len(other):
                continue
            own, sizes = of(i), n[other]
            every = np.concatenate([of(j) for j in other])
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            shared_ = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
            for j in other[100 * shared_ >= PERCENT * (len(own) + sizes - shared_)]:
                if component[i] != component[j]:
                    component[component == component[j]] = component[i]
                    out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return at.groupBy("bucket", "lower", "upper").applyInPandas(linked, "a long, b long").distinct()


def without_near_copies(df: DataFrame, width: int = STAGE_WIDTH) -> DataFrame:
    """The rows of ``df``, whole, that their component keeps; told by id and text."""
    dropped = store(near_dedup(df.select("doc_id", "text"), keys=True, width=width).where("not kept").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct())
    same = (F.xxhash64("doc_id", text_of()) == F.col("_k1")) & (F.xxhash64(text_of(), "doc_id", F.lit(1)) == F.col("_k2"))
    return df.join(dropped, same, "left_anti")


def near_dedup(df: DataFrame, keys: bool = False, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df`` (doc_id, text).

    Shingles have ``width`` words. With ``keys`` also the two hashes that tell rows by id and text.
    """
    rows = sketches(df, width)
    # Sets that several rows have count once, as the node that is their smallest row.
    sets = store(
        rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("row", "k1", "k2", "n_shingles", "bands", "bits")).alias("s")).select(
            "set_id", F.col("s.row").alias("node"), "s.k1", "s.k2", "s.n_shingles", "s.bands", "s.bits"
        )
    )
    entries = sets.select("node", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    shared = store(entries.join(buckets, "bucket"))

    pairs = store(_star_pairs(shared, sets))
    # Texts of the sets that share a bucket; rows alike in id and text are the same text.
    candidates = shared.select("node").distinct().join(sets.select("node", "k1", "k2"), "node")
    texts = _keyed(df).select("k1", "k2", "text").join(candidates, ["k1", "k2"]).select("node", "text")
    if rows.groupBy("k1", "k2").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])
    texts = store(texts)

    links = verified(pairs, texts, width)
    found = store(components(links))
    more = store(_block_links(shared, sets, found, texts, width))
    if not more.isEmpty():
        found = store(components(links.unionByName(more)))

    known = rows.select("doc_id", "row", "n_shingles", "set_id", F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).join(sets.select("set_id", "node"), "set_id", "left")
    known = known.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = known.join(least, "component", "left").withColumn(
        "component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    )
    told = [F.col("_k1").alias("k1"), F.col("_k2").alias("k2")] if keys else []
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *told)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
