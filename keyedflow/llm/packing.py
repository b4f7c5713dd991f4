"""Best-fit packing of token sequences, large items matched first.

The number of pieces of each length is all that a packing needs to know, and there are at most
as many lengths as a sequence has tokens. So the lengths are counted in Spark, the plan is made
from the counts, and the pieces find their places by their rank among those of equal length.

The plan: pieces above a third of the capacity are matched, the longest with the longest that
still fits, at most two in a sequence. Smaller pieces follow from long to short, each into the
smallest gap that holds it, or into a new sequence where there is none.

Token ids are made a word at a time: a text is cut before spaces where the tokenizer's pattern
can't join across, and the ids of a word are kept while a worker has such tasks. Texts in which spaces
stand inside other white space, or that hold one of the vocabulary's added tokens, such as the mark
of a text's end, are encoded as one; an added token is its own id, as in the tokenizer itself.

Defined results: null texts count as empty; an empty text is the end token alone. Repeated rows
are packed as often as they occur, also null ids. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import in_order, kept, store, table, text_of

CAPACITY = 2048
END = 0
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 300_000
#: The ranks of the vocabulary in byte_bpe_50k.json, which also names its added tokens.
RANKS = "byte_bpe_50k.tiktoken"
# A space between two white-space characters: a run of these is one token to the tokenizer.
INSIDE_SPACE = re.compile(r"\s \s")


def assignments(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces go: ``(length, first, count, sequence, each, offset)``.

    Pieces ``first`` to ``first + count - 1`` of a length fill sequences from ``sequence`` on,
    ``each`` of them per sequence, the first of these at ``offset``.
    """
    left, used, out, sequences = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, count)
    order: list[int] = []

    def put(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        out.append((length, used[length], count, sequence, each, offset))
        used[length] += count
        left[length] -= count

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps[gap].append((sequence, count))

    large = sorted(n for n in counts if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            at = bisect.bisect_right(large, min(n, capacity - n)) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == n else 1):
                at -= 1
            if at < 0:
                count = left[n]
                put(n, count, sequences, 1, 0)
                free(capacity - n, sequences, count)
            elif large[at] == n:
                count = left[n] // 2
                put(n, 2 * count, sequences, 2, 0)
                free(capacity - 2 * n, sequences, count)
            else:
                count = min(left[n], left[large[at]])
                put(n, count, sequences, 1, 0)
                put(large[at], count, sequences, 1, n)
                free(capacity - n - large[at], sequences, count)
            sequences += count

    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                gap = capacity
                first, count = sequences, -(-left[n] // (gap // n))
                sequences += count
            else:
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            each = gap // n
            filled, rest = min(count, left[n] // each), 0
            if filled:
                put(n, filled * each, first, each, capacity - gap)
                free(gap - each * n, first, filled)
            if filled < count and left[n]:
                rest = left[n]
                put(n, rest, first + filled, each, capacity - gap)
                free(gap - rest * n, first + filled, 1)
            taken = filled + (rest > 0)
            free(gap, first + taken, count - taken)
    return out


class _Words(dict):
    """Ids of a space and a word, as bytes."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as file:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        with open(public_tokenizers.path(ranks.replace(".tiktoken", ".json"))) as file:
            self.added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        known = {token: rank for token, rank in known.items() if rank not in self.added.values()}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=self.added)

    def ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = self.ids(" " + word)
        return found

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4").tobytes()
        if INSIDE_SPACE.search(text):
            return self.ids(text)
        first, *words = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, words))


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def pieces(df: DataFrame, capacity: int = CAPACITY, ranks: str = RANKS, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, and the ids if asked for."""
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(("words", ranks), lambda: _Words(ranks))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = words.encode(text) + end
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((row, i, start, length, zlib.crc32(own), np.frombuffer(own, "<u4").tolist() if keep_ids else None))
            row, *columns = zip(*rows) if rows else [()] * (len(types) + 1)
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), *map(pa.array, columns, types)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]).select(names)

    return df.select("doc_id", text_of().alias("text")).mapInArrow(tokenised, schema + ", ids array<int>" * keep_ids)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces, with a ``length`` up to the capacity, with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    # At most one row for each length.
    counts = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    first, place = {}, 0
    for length in sorted(counts):
        first[length] = place
        place += counts[length]
    plan = [(n, first[n] + at, first[n] + at + count, sequence, each, offset) for n, at, count, sequence, each, offset in assignments(counts, capacity)]
    # A few rows for each length, whatever the number of pieces.
    plan = spark.createDataFrame(plan, "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    placed = in_order(cut_pieces, "length", F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece")
    here = (F.col("length") == F.col("_length")) & (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))
    row = F.col("pos") - F.col("_from")
    return placed.join(F.broadcast(plan), here).select(
        *cut_pieces.columns,
        (F.col("_sequence") + F.floor(row / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + (row % F.col("_each")) * F.col("length")).alias("offset"),
    )


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(store(pieces(table(spark, sf_dir, "documents", "doc_id", "text"))))
