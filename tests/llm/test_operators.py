"""Each operator against brute force, on a small fixture with the awkward cases in it."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import connect, difference
from keyedflow.llm import common, exact_dedup, fingerprints, html_text, mixing, near_dedup, packing, sharding, toxicity, url_rules, warc
from keyedflow.llm.queries import LLM_ORACLE, LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def documents() -> list[tuple]:
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choices("abcdeé", k=4)) for _ in range(n))
    base = [text(rnd.randint(5, 120)) for _ in range(60)]
    texts = [None, "", " \n\t", "ä", "one two", "One  two", *base, *base[:9], " ".join(base[3].split()) + "\n"]
    texts += [t.rsplit(" ", 2)[0] for t in base[:20]] + [t + " end" for t in base[10:30]] + [text(5000), "x" * 30_000]
    texts += ["line one\nline two\r\n" * 40, "a<|endoftext|>b  c \n d", " \u00a0 lead", "e\u0301\U0001f600 " * 9]
    rows = [(7 * i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "x", None) for i, t in enumerate(texts)]
    return rows + rows[20:23] + [(None, base[5], "en", "s1", 0, "x", None), (None, "no id", "en", "s1", 0, None, None)]


def pages() -> list[tuple]:
    page = lambda i, body: f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav>{body}<footer>f {i}</footer></body></html>"
    rows = [(i, f"http://H{i % 3}.example.com/en/{i}", page(i, f"<article><h1>A &amp; b {i}</h1><p>text <b>bo</b>ld {i}<p>more</article>")) for i in range(20)]
    rows += [(30, None, None), (31, "no scheme", ""), (32, "https://x.net/fr/?q=/es/", "<p>" + "long " * 20_000), (33, "http://example.com", rows[1][2])]
    rows += [(34, "http://example.com/en/", rows[1][2]), (35, "http://a.www.example.com/en/x#y", "z" * 99), (36, "u://b.net/es/", "z" * 99)]
    return rows + [rows[2], (None, "http://www.example.com", rows[1][2]), (40, "http://h/", "\r\n\r\nWARC/1.1\r\n" * 4000)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("llm"))
    spark.createDataFrame(documents(), DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages(), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    labels = [(7 * i, None if i == 3 else 1, int(i % 7 == 0)) for i in range(0, 100)] + [(0, 1, 1), (None, 0, 1), (7, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, 0, "user", "a", "k")], "conv_id long, turn long, role string, text string, node string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(0, [0.5], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "pages", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_empty_tables(spark, empty, name):
    assert LLM_QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_equals_sql(spark, sf_dir, name):
    assert difference(LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_ORACLE[name]) is None


def test_exact_dedup(spark, data):
    groups = defaultdict(list)
    for doc_id, text, *_ in documents():
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    expected = Counter()
    for digest, rows in groups.items():
        best = min(rows)
        for row in rows:
            expected[(row[3], best[3], len(rows), row[0] == best[0] and row[3] == best[3], digest)] += 1
    assert Counter(map(tuple, exact_dedup.op1_exact_dedup(spark, data).collect())) == expected
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stay = corpus_pipeline.exact(spark, docs, data)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_repeat_filter_keeps_every_repeated_row(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2000).cast("string").alias("text"))
    for bits in (1, 16):  # a filter that is far too small only sends more rows
        assert exact_dedup.exact_dedup(rows, carry=["doc_id"], bits_per_row=bits).where("group_size = 2").count() == 2000


def test_toxicity_on_held_out_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id")
    found = scores.where("held_out").join(rows, "doc_id").join(docs, "doc_id").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in found) >= 0.95 * len(found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in scores.collect())


def test_toxicity_awkward_rows(spark, data):
    rows = toxicity.op2_toxicity(spark, data).collect()
    assert len(rows) == len(documents()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_training_rows_has_one_row_for_each_id(spark):
    docs = [(0, f"text {i % 7}") for i in range(500)] + [(1, "other"), (1, None), (3, "more"), (None, "none")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(1, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    ids = {r.doc_id for r in docs.where(~toxicity.held_out()).where("doc_id is not null").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(ids) and 0 in ids and all(r.toxic == r.doc_id % 2 for r in rows)
    assert sorted(rows) == sorted(toxicity.training_rows(docs.repartition(3), labels).collect())


def test_factorization_machine_learns_pairs():
    # Toxic only where both terms stand together: no weight of a single term can tell.
    rows = [(int(a and b), [i for i, x in enumerate((a, b)) if x]) for a in (0, 1) for b in (0, 1) for _ in range(100)]
    model = toxicity.Model(np.array([5, 9]), 0.0)
    model.fit(np.array([y for y, _ in rows]), np.array([len(x) for _, x in rows]), np.array([i for _, x in rows for i in x]))
    alone, together = max(model.raw([0]), model.raw([1])), model.raw([0, 1])
    assert alone < 0 < together and together - alone > 2


def test_toxicity_of_pairs_that_tell_nothing_alone(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = [(i, rng.random() < 0.5, rng.random() < 0.5, rng.sample(noise, 6)) for i in range(1200)]
    docs = spark.createDataFrame([(i, " ".join(words + ["insult"] * a + ["people"] * b)) for i, a, b, words in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(a != b)) for i, a, b, _ in rows], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    unseen = [(scores[i] >= 0.5) == (a != b) for i, a, b, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(unseen) >= 0.95 * len(unseen)


def test_toxicity_of_each_language(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = toxicity.op2_toxicity(spark, folder).where("held_out").join(labels, "doc_id").join(docs, "doc_id").collect()
    for lang in {r.lang for r in rows}:
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic]
        clean = [r.predicted for r in rows if r.lang == lang and not r.toxic]
        assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.05 * len(clean), lang


def test_toxicity_inside_a_run_without_spaces(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E80)]
    texts = [("".join(rng.choice(letters) for _ in range(30)), i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t[:9] + "\u9f98\u9f97" * bad + t[9:]) for i, (t, bad) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, (_, bad) in enumerate(texts)], "doc_id long, toxic int")
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in scores)


def likeness_of(spark, pairs):
    """Likeness of fingerprints given as strings alone."""
    df = spark.createDataFrame(pairs, "a string, b string").select(fingerprints.from_text(F.col("a")).alias("a"), fingerprints.from_text(F.col("b")).alias("b"))
    return [r.likeness for r in fingerprints.with_likeness(df, "a", "b", "likeness").select("likeness").collect()]


def test_sketch_difference_recovers_digests(spark):
    names, cases = [0], []
    for shared, left, right in [(0, 0, 0), (5, 0, 0), (10, 2, 1), (0, 16, 16), (3, 0, 40), (0, 100, 0), (60, 1, 1), (300, 40, 0), (50, 50, 400)]:
        lines = [f"line {i}" for i in range(names[0], names[0] + shared + left + right)]
        names[0] += len(lines)
        cases.append(("\n".join(lines[: shared + left]), "\n".join(lines[:shared] + lines[shared + left :])))
    keys = lambda c: fingerprints.digests(F.col(c))
    df = spark.createDataFrame(cases, "ta string, tb string").select(keys("ta").alias("ka"), keys("tb").alias("kb"))
    df = df.select("ka", "kb", fingerprints.fingerprint(F.col("ka")).alias("a"), fingerprints.fingerprint(F.col("kb")).alias("b"))
    df = fingerprints.with_likeness(fingerprints.differing(df, "a", "b", "d"), "a", "b", "l")
    left = 0
    for row in df.select("ka", "kb", "d", "l").collect():
        a, b = set(row.ka), set(row.kb)
        found = {1: a - b, -1: b - a}
        assert all(d.key in found[d.n] for d in row.d.found) and len({d.key for d in row.d.found}) == len(row.d.found)
        # Those that can't be told apart are counted, at least; a digest lost on both sides counts on both.
        assert abs(len(row.d.found) + row.d.left - len(a ^ b)) <= row.d.left
        left += row.d.left
        assert row.l == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=0.05)
    assert left < 40


def test_a_sketch_with_too_many_digests_is_stuck(spark):
    full = fingerprints.sketches(fingerprints.digests(F.concat_ws("\n", F.sequence(F.lit(1), F.lit(100)).cast("array<string>"))), F.lit(0))
    row = spark.range(1).select(fingerprints.listed(full).alias("p")).first().p
    assert row.left > 90 and len(row.found) < 10


def test_sketches_are_plain_arrays(spark):
    # A structure for each cell took most of the time. The strings stay as they were.
    keys = fingerprints.digests(F.concat_ws("\n", F.sequence(F.lit(1), F.lit(60)).cast("array<string>")))
    df = spark.range(1).select(fingerprints.fingerprint(keys).alias("f"))
    assert df.schema["f"].dataType.simpleString() == "array<struct<n:array<int>,key:array<bigint>>>"
    row = df.select(F.size("f").alias("n"), F.sha2(fingerprints.as_text(F.col("f")), 256).alias("sha")).first()
    assert row.n == 16 and row.sha == "ad653825c5f05f098942ce0836db598ca263a4fcad4592dd3c5cb4b64df59f80"


def test_fingerprints(spark, data):
    rows = [(r[0], r[1] or "") for r in documents()]
    first = {}
    for doc_id, text in rows:
        first.setdefault(doc_id, text)
    ids = sorted((i for i in first if i is not None))
    got = fingerprints.op3_fingerprints(spark, data).where("doc_id is not null").collect()
    assert len(got) == len(rows) - 2
    by_text = {}
    for r in got:
        text, after = first[r.doc_id], ids.index(r.doc_id) + 1
        assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        if after < len(ids):
            moved = len(text) // 4
            edited = text[: len(text) - moved] + first[ids[after]][:moved]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r.near_edited > r.near_next for r in got if r.n_chars > 100]) > 0.9
    assert likeness_of(spark, [(r.fingerprint, r.edited_fingerprint) for r in got]) == pytest.approx([r.near_edited for r in got])
    by_id = {r.doc_id: r for r in got}
    pairs = [(by_id[i], by_id[j]) for i, j in zip(ids, ids[1:])]
    assert likeness_of(spark, [(r.fingerprint, s.fingerprint) for r, s in pairs]) == pytest.approx([r.near_next for r, _ in pairs])


def test_paragraphs_of_long_texts_are_shared(spark):
    rnd = random.Random(6)
    word = lambda alphabet: "".join(rnd.choices(alphabet, k=rnd.randint(2, 9)))
    prose = lambda n, join, end: "".join(word("abcdefgh") + (end if rnd.random() < 0.1 else join) for _ in range(n))
    cjk = "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(9000))
    lines = [prose(9, " ", ", ") for _ in range(1500)]
    texts = ["\n".join(lines), "\r\n".join(lines), prose(9000, " ", ". "), prose(9000, " ", ", "), prose(9000, "", ""), cjk]
    rows = [(i, t, "New. " + t[:200] + "more" + t[200:]) for i, t in enumerate(texts)]
    keys = lambda c: fingerprints.digests(F.col(c))
    df = spark.createDataFrame(rows, "i int, ta string, tb string").select("i", keys("ta").alias("a"), keys("tb").alias("b"))
    df = df.select("*", fingerprints.fingerprint(F.col("a")).alias("fa"), fingerprints.fingerprint(F.col("b")).alias("fb"))
    rows = fingerprints.with_likeness(df, "fa", "fb", "l").select("i", "a", "b", "l").collect()
    for r in rows:
        x, y = set(r.a), set(r.b)
        assert len(x) > 100 and r.l == pytest.approx(len(x & y) / len(x | y), abs=0.02) and r.l > 0.9, r.i
    # A short text within a long one, and the same lines whatever ends them.
    own = {r.i: set(r.a) for r in rows}
    part = spark.createDataFrame([("\n".join(lines[700:720]),)], "t string").select(fingerprints.digests(F.col("t"))).first()[0]
    assert set(part) <= own[0] == own[1]


def test_warc(spark, data):
    first = {}
    for page_id, _, html in pages():
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    expected = Counter()
    for page_id, _, html in pages():
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and page_id != first[html or ""]
        expected[page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first[html or ""] if revisit else None] += 1
    assert Counter(map(tuple, warc.op4_warc(spark, data).collect())) == expected


def test_warc_round_trip_and_missing_segment(spark, folder):
    payload = ("é\r\n" * 30_000).encode()
    assert warc.unchunked(warc.chunked(payload)) == payload and warc.unchunked(warc.chunked(b"")) == b""
    rows = spark.createDataFrame([(1, "u", payload.decode())], "page_id long, url string, html string")
    warc.write_archives(rows, f"{folder}/w", segment=1000)
    found = warc.read_records(spark, f"{folder}/w")
    whole = warc.payloads(warc.reassembled(found)).first()
    assert bytes(whole.payload) == payload and found.count() > 50
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(found.where("number <> 3")).collect()


def test_sharding(spark, data):
    rows = sharding.op5_balanced_shards(spark, data).collect()
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in documents())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    together = defaultdict(set)
    for r in rows:
        together[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in together.values()) <= 2


def test_sharding_a_group_above_the_quota(spark):
    rows = spark.range(800).select(F.col("id").alias("row"), F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("group"))
    out = sharding.balanced_shards(rows, sharding.links_of_equals(rows)).collect()
    assert Counter(r.shard for r in out) == {s: 100 for s in range(8)}
    most = Counter(r.shard for r in out if r.group == "hot").most_common(1)[0][1]
    assert most > 60  # far more than the 37 of an even spread


def test_assignments_are_complete_and_tight():
    for seed in range(30):
        rnd = random.Random(seed)
        counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, 101), rnd.randint(1, 60))}
        where = defaultdict(list)
        for length, first, count, sequence, each, offset in packing.assignments(counts, 100):
            for k in range(count):
                where[sequence + k // each].append((offset + k % each * length, length, first + k))
        assert Counter(n for own in where.values() for _, n, _ in own) == counts
        assert all(len({r for own in where.values() for _, m, r in own if m == n}) == counts[n] for n in counts)
        for own in where.values():
            at = 0
            for offset, length, _ in sorted(own):
                assert offset == at
                at += length
            assert at <= 100
        least = max(math.ceil(sum(n * c for n, c in counts.items()) / 100), sum(c for n, c in counts.items() if n > 50))
        assert len(where) <= 1.25 * least + 2


def test_packing(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text, *_ in documents():
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            own = np.array(ids[start : start + length], "<u4").tobytes()
            expected[doc_id, piece, start, length, zlib.crc32(own)] += 1
    rows = packing.op6_best_fit_packing(spark, data).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 2048) + 2


def test_added_tokens_are_single_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    made, words, rnd = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._Words(packing.RANKS), random.Random(9)
    texts = ["<|endoftext|> x", "a\n <|endoftext|>b ", "<|endoftext|>" * 3, "a<|endoftext", "<|endoftext |>", " <|endoftext|>  <|endoftext|>\n"]
    texts += ["".join(rnd.choices(["<|endoftext|>", " ", "\n", "ab", "c's", "ä", "12", "<|", "|>"], k=rnd.randint(0, 12))) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids, text


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if rate * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else rate * weight[s] for s in names}
        full |= above


def test_mixing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, _, source, *_ in documents():
        sizes[source] += len(WORD.findall(text or ""))
    targets = brute_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes) and len(rows) == len(documents())
    assert Counter(mixing.mix(docs.repartition(5)).collect()) == Counter(rows)
    once = docs.dropDuplicates(["doc_id", "text"])
    mixed = mixing.mixed(once)
    assert mixed.columns == docs.columns
    # Whole documents, as often as the mix takes them; half of one or more counts as all of it.
    expected = Counter()
    for r in mixing.mix(once.where("doc_id is not null")).collect():
        expected[r.doc_id] += int(r.taken / r["size"] + 0.5) if r["size"] else 0
    mixed = mixing.mixed(once.where("doc_id is not null"))
    assert Counter(r.doc_id for r in mixed.collect()) == +expected
    assert mixed.exceptAll(mixed.join(once, "doc_id", "left_semi")).isEmpty() and mixed.distinct().join(once.select("doc_id", "text"), ["doc_id", "text"]).count() == len(+expected)
    largest, near = Counter(), Counter()
    for r in once.where("doc_id is not null").collect():
        largest[r.source] = max(largest[r.source], len(WORD.findall(r.text or "")))
    for r in mixed.collect():
        near[r.source] += len(WORD.findall(r.text))
    goals = {r.source: r.target for r in mixing.mix(once.where("doc_id is not null")).collect()}
    assert all(abs(near[s] - goals[s]) <= largest[s] / 2 + 1 for s in goals)


def test_html_text_judges_whole_names():
    kept = '<p class="share-price">The share price rose.</p><section id="related-work"><p>Earlier work.</p></section><p class="search_results">Found.</p>'
    left = '<div class="share-buttons">Share it</div><p class="ad-slot-top">Buy</p><ul id="related-posts"><li>More</li></ul><div class="x cookie_notice">Cookies</div>'
    for markup in (f"<article>{kept}{left}</article>", f"<body><div>{left}{kept}</div></body>"):
        assert html_text.main_text(html_text.Page(markup), None) == "The share price rose. Earlier work. Found."
    assert html_text.main_text(html_text.Page('<body><div class="page-header">Top</div><p>Text</p></body>'), None) == "Text"


def test_html_text_of_pages_given_twice(spark):
    def page(i):
        extra = "<p>Members read this first, on every page.</p>"
        return f"<body><article><h1>Title {i}</h1><div>{extra}</div><p>{'Text of page %d. ' % i * 5}</p></article></body>"

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(6)]
    kind = "page_id long, url string, html string"
    once = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, kind)).collect()}
    for more in (rows, rows + rows, rows[:1] * 3):
        again = html_text.extract(spark.createDataFrame(rows + more, kind)).collect()
        assert len(again) == len(rows) + len(more) and all(r.text == once[r.page_id] for r in again)
    assert all("Members" not in text and f"Text of page {i}." in text for i, text in once.items())


def test_html_text(spark, data):
    rows = {r.page_id: r for r in html_text.op8_html_text(spark, data).collect()}
    assert len(rows) == len({p for p, *_ in pages()})
    for i in range(20):
        assert rows[i].text == f"A & b {i} text bold {i} more" and rows[i].n_chars == len(rows[i].text)
    assert rows[30].text == rows[31].text == "" and rows[32].n_chars == 5 * 20_000 - 1


def test_template_without_article(spark):
    body = "<div class=top><a href=/>Home</a></div><div id='post-{0}'><h2>Title {0}</h2><p>text of page {0}, long enough to count<p>Read more here</div><div>Follow us</div>"
    rows = spark.createDataFrame([(i, f"http://h.org/{i}", f"<html><body>{body.format(i)}</body></html>") for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(rows).collect()} == {f"Title {i} text of page {i}, long enough to count" for i in range(6)}
    for markup, text in [("a < b &lt; c <x", "a < b < c <x"), ("<p>x<script>a</p>", "x"), ("<!-- a > b -->y", "y"), ("<div class='cookie-notice'>c</div>z", "z")]:
        assert html_text.main_text(html_text.Page(markup), None) == text


def extracted(spark, bodies: list[str]) -> list[str]:
    rows = [(i, f"http://h.org/{i}", f"<html><body>{body}</body></html>") for i, body in enumerate(bodies)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id")
    return [r.text for r in found.collect()]


def test_links_in_articles_are_text(spark):
    article = "<article><h1><a href=/{0}>Title {0}</a></h1><p>text of page {0}<ol><li><a href=/s{0}>Source {0}</a></ol></article>"
    menu = "<div><a href=/{0}>Elsewhere {0}</a></div>"
    bodies = [(menu + article).format(i) for i in range(5)] + ["<article><h1>Title 5</h1><ol><li>Unlinked 5</ol></article>"]
    expected = [f"Title {i} text of page {i} Source {i}" for i in range(5)] + ["Title 5 Unlinked 5"]
    assert extracted(spark, bodies) == expected
    # Without an article: headlines stay, and a list where it has no links.
    post = "<div><h2><a href=/{0}>Title {0}</a></h2><p>a long text of page {0}, and more of it<ul><li>{1}</ul></div>"
    links = ["<a href=/n>Next to {0}</a>"] * 5 + ["Plain {0}"]
    expected = [f"Title {i} a long text of page {i}, and more of it" + " Plain 5" * (i == 5) for i in range(6)]
    assert extracted(spark, [post.format(i, links[i].format(i)) for i in range(6)]) == expected


def test_a_link_without_an_end_tag_ends_with_its_block(spark):
    for start in ("<a name=top>", "<a href=/top>", "<p><a href=/top>"):
        body = start + "<div><h2>Title {0}</h2><p>text of page {0}</div>"
        assert extracted(spark, [body.format(i) for i in range(5)]) == [f"Title {i} text of page {i}" for i in range(5)]
    linked = lambda markup: [(t, n) for _, t, n, _ in html_text.Page(markup).blocks]
    assert linked("<a href=x><h3>ab</h3><p>cd</p></a>ef") == [("ab", 2), ("cd", 2), ("ef", 0)]
    assert linked("<ul><li><a href=x>ab<li>cd</a><li>ef</ul>") == [("ab", 2), ("cd", 0), ("ef", 0)]


def test_text_of_the_template_in_articles(spark):
    notice = "<div class=x1>Write to us</div>"
    article = "<article><h1>Title {0}</h1><p>text of page {0}<p>more text of page {0}{1}</article>"
    expected = [f"Title {i} text of page {i} more text of page {i}" for i in range(8)]
    assert extracted(spark, [article.format(i, notice) for i in range(8)]) == expected
    # A notice of some pages only.
    assert extracted(spark, [article.format(i, notice if i < 5 else "") for i in range(8)]) == expected
    # Also without an article, and pages that are copies keep their text.
    post = "<div class=post><h2>Title {0}</h2><p>text of page {0}<p>more text of page {0}{1}</div>"
    assert extracted(spark, [post.format(i, notice if i < 5 else "") for i in range(8)]) == expected
    assert extracted(spark, [article.format(0 if i < 5 else i, "") for i in range(8)]) == [expected[0 if i < 5 else i] for i in range(8)]
    assert extracted(spark, [article.format(0, "")] * 5) == [expected[0]] * 5


def components_by_force(rows: list[tuple]) -> dict:
    sets = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
        sets.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(sets[i]), (c := least.get(find(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(rows))


def test_near_dedup(spark, data):
    got = near_dedup.op9_near_dedup(spark, data).collect()
    assert Counter(map(tuple, got)) == components_by_force([r[:2] for r in documents()])


def test_near_dedup_of_a_large_loose_group(spark, monkeypatch):
    # Copies of one text with a few words changed: most are linked, and not all with the same one.
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 6)):
            words[k] = f"v{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == components_by_force(rows)


def test_near_stage_takes_five_words(spark):
    # Two words changed, apart: likeness is above 0.8 over four words and below it over five.
    words = [f"w{i}" for i in range(80)]
    other = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    shared = lambda k: len({tuple(words[i : i + k]) for i in range(81 - k)} & {tuple(other[i : i + k]) for i in range(81 - k)})
    assert 100 * shared(4) >= 80 * (2 * 77 - shared(4)) and 100 * shared(5) < 80 * (2 * 76 - shared(5))
    assert {r.component_id for r in near_dedup.near_dedup(rows).collect()} == {1}
    assert {r.component_id for r in near_dedup.near_dedup(rows, width=5).collect()} == {1, 2}
    assert corpus_pipeline.near(spark, rows, "").count() == 2


def test_a_worker_keeps_the_things_of_one_operator(spark):
    first = common.kept("a", object)
    assert common.kept("a", object) is first
    common.kept("b", object)
    assert common.kept("a", object) is not first
    common.let_go()
    assert not common._kept
    # Stages that give whole texts to Python do so in small batches.
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    corpus_pipeline.near(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(corpus_pipeline.BATCH_ROWS) == "1000"


def test_sketch_estimates_likeness():
    rnd = np.random.default_rng(1)
    for n, shared in [(1, 1), (2, 1), (40, 32), (3000, 2400)]:
        a = rnd.integers(1, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[:shared], rnd.integers(1, 1 << 63, n - shared, dtype=np.uint64)))
        agree = (near_dedup.sketch(a) == near_dedup.sketch(b)).mean()
        assert abs(agree - shared / (2 * n - shared)) < 0.15


def test_url_rules(spark, data):
    for r in url_rules.op10_url_rules(spark, data).collect():
        url = {p: u for p, u, _ in pages()}[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])


def test_pipeline(spark, data, empty):
    rows = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert rows.count() > 0 and [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"
    kept = corpus_pipeline.near(spark, docs, data)
    expected = {r[0] for r in components_by_force([r[:2] for r in documents()]) if r[3]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == expected
    assert corpus_pipeline.run(spark, empty).count() == 0
