"""The prefix trie against a trie of plain tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keyedflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, d long"


def expected(rows: list[tuple]) -> Counter:
    turns = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            turns[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(own, key=lambda t: t[0])] for c, own in turns.items()}
    members, built = defaultdict(list), {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        opening = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = turns.get(opening, [])[:h] + own[h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(own) - 1) * len(n[-1][1].encode()) if n else 0
    ends = defaultdict(list)
    for c, path in built.items():
        ends[tuple(path)].append(c)
    return Counter(
        (
            min(own), len(n), min(members[n[:-1]]) if n else None, len(own), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, own in members.items()
    )


def conversations() -> list[tuple]:
    rnd = random.Random(8)
    rows = [(c, t, rnd.choice("ua"), rnd.choice(["yes", "nö", "", None])) for c in range(-12, 120) if c % 7 for t in range(rnd.randint(1, 12))]
    rows += [(c, 0, "system", "same opening") for c in range(200, 260)] + [(None, 1, "u", "nobody"), (3, None, None, None), (3, None, "u", None)]
    rows += [(10_001, t, "u", f"only {t}") for t in range(3)]  # no opening, so maybe no turns
    rows += [(500, t, "u", "long" if t % 50 else "x" * 5000) for t in range(300)] + [(501, t, "u", "long") for t in range(40)]
    rows += [(15, 2, "u", "again"), (15, 2, "u", "again")]  # repeated rows are turns
    return [(*r, "n", 1) for r in rows]


@pytest.mark.parametrize("band, chunk", [(prefix_trie.BAND, prefix_trie.CHUNK), (2, 4), (3, 50)])
def test_equals_plain_trie(spark, band, chunk):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(df, band, chunk)
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_many_conversations_end_at_one_node(spark):
    rows = [(c, 0, "system", "hello", "n", 1) for c in range(3000)]
    assert Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == expected(rows)


def test_hot_names_give_the_same_join(spark):
    rows = spark.range(1000).select((F.col("id") % 40).alias("k"), "id").where("k <> 39 or id > 500")
    names = rows.where("k <> 5").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("id").alias("top"))
    want = sorted(map(tuple, rows.join(names.drop("w"), "k").select("id", "top").collect()))
    for hot in (0, 20, 24, 10_000):
        assert sorted(map(tuple, prefix_trie.looked_up(rows, names, "k", "w", hot=hot).select("id", "top").collect())) == want


def test_bands_bound_the_explosion(spark):
    rows = [(0, t, "u", str(t), "n", 1) for t in range(400)]
    turns, _ = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    nodes = prefix_trie.nodes_of(prefix_trie.prefixes(turns), 8)
    sizes = nodes.agg(F.max(F.size("up")), F.min(F.size("up")), F.count(F.lit(1))).first()
    assert tuple(sizes) == (8, 1, 400)
