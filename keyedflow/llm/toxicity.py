"""Toxicity with a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first four and five letters, and in scripts
written without spaces all two and three letters in a row, hashed; a term counts once for each
text. The model scores a text as

    sigmoid(bias + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j)

over its terms, so that two terms can weigh more, or less, together than alone; x is 1 for a
term that many training rows have and less for rare ones, n / (n + RARE) for one that n have.

Weights start at a term's log odds where these are beyond chance; Adam follows the gradients of
rows and pairs, and a lasso holds at zero what the sample doesn't bear out.

Training: of the labelled rows that may be used, a sample of at most TRAIN_ROWS with the
smallest hash of their id, one for each id (that with the smallest hash of its text). All terms
of the sample are trained, as sparse rows; the model has at most BUCKETS of them. Both are bounds
on the model, not on the data: every whole text is scored.

Defined results: null texts count as empty; a text without known terms gets the model's bias
(near the share of toxic rows). Without any label that may be used all scores are 0. Rows
repeated with the same id and text get the same score. A label given more than once counts as
toxic if any says so; null labels are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import let_go, store, table, text_of

TRAIN_ROWS, FACTORS, BUCKETS, RARE = 16_000, 8, 1 << 21, 4
#: Passes over the sample (more over few rows), rows at a time, step, and the size of the first factors.
EPOCHS, STEPS, BATCH, RATE, START = 8, 900, 128, 0.02, 0.05
#: How far a term's labels must be off before its weight leaves zero: in standard deviations of
#: what chance gives, and in rows; and before its factors do, in roots of the number of rows.
LASSO, LEAST, PAIR_LASSO = 1.0, 2.0, 0.3
THRESHOLD = 0.3
LETTERS = re.compile(r"[^\W\d_]+")
#: Scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
#: Words whose terms a Python worker keeps, and their longest.
KEPT_WORDS, KEPT_LENGTH = 300_000, 40


def _forms(word: str) -> set[str]:
    forms = {"=" + word, *(f"{n}{word[:n]}" for n in (4, 5) if len(word) > n)}
    if UNSPACED.search(word):
        forms.update("~" + word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1))
    return forms


class _Terms(dict):
    """Hashed terms of a word: buckets, or their numbers in ``known`` without those it lacks (-1)."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = {zlib.crc32(form.encode("utf-8", "surrogatepass")) % BUCKETS for form in _forms(word)}
        if self.known is not None:
            found = {i for i in self.known[list(found)].tolist() if i >= 0}
        if len(word) > KEPT_LENGTH:
            return tuple(found)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = kept = tuple(found)
        return kept

    def of(self, text: str) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(LETTERS.findall(text.lower())))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, toxic, terms`` of the sample, stored."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = _Terms()
        for batch in batches:
            found = [known.of(text) for text in batch["text"].to_pylist()]
            columns = [batch["doc_id"], batch["toxic"], pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "terms"])

    # The sample has TRAIN_ROWS rows of two numbers at most.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    # One row for each id; a task keeps one before the shuffle, however many rows the id has.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return store(rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(terms, f"doc_id {kind}, toxic int, terms array<int>"))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` that begin at ``starts``; no run is empty."""
    return np.add.reduceat(values, starts, axis=0)


def _counts(present: np.ndarray, terms: int) -> np.ndarray:
    """How often each term occurs; by parts, since counting copies its input."""
    total = np.zeros(terms, np.int64)
    for i in range(0, len(present), 1 << 20):
        total += np.bincount(present[i : i + (1 << 20)], minlength=terms)
    return total


def _odds(toxic: np.ndarray, sizes: np.ndarray, present: np.ndarray, terms: int) -> np.ndarray:
    """Log odds of the label with and without each term; 0 where chance would give as much to one of the terms."""
    positive, total, n = toxic.sum(), len(toxic), _counts(present, terms)
    a = _counts(present[np.repeat(toxic > 0, sizes)], terms)
    b = n - a

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    gain = (
        part(a, n * positive / total) + part(b, n * (total - positive) / total)
        + part(positive - a, (total - n) * positive / total) + part(total - positive - b, (total - n) * (total - positive) / total)
    )
    odds = np.log((a + 0.5) * (total - positive - b + 0.5) / ((b + 0.5) * (positive - a + 0.5)))
    return np.where(gain > np.log(terms), odds, 0)


class _Batch:
    """Some sparse rows: the terms that occur in them, and their entries by row and by term."""

    def __init__(self, toxic: np.ndarray, sizes: np.ndarray, present: np.ndarray):
        self.toxic = toxic
        self.terms, own = np.unique(present, return_inverse=True)
        by_term = np.argsort(own, kind="stable")
        self.row_starts = np.cumsum(sizes) - sizes
        self.term_starts = np.searchsorted(own[by_term], np.arange(len(self.terms)))
        # The two that are as long as the rows, in few bytes.
        self.own = own.astype(np.int32)
        self.row_of_term = np.repeat(np.arange(len(sizes), dtype=np.int16), sizes)[by_term]


class Model:
    """Parameters of a factorization machine over the terms ``terms``."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms, self.bias = terms, bias
        # One more than the terms: a term that every row has, its weight is the bias.
        self.w = np.zeros(len(terms) + 1, np.float32)
        self.v = np.random.default_rng(11).normal(0, START, (len(terms) + 1, FACTORS)).astype(np.float32)
        self.v[-1] = 0

    def known(self) -> _Terms:
        numbers = np.full(BUCKETS, -1, np.int32)
        numbers[self.terms] = np.arange(len(self.terms), dtype=np.int32)
        return _Terms(numbers)

    def raw(self, present: list[int]) -> float:
        if not present:
            return self.bias
        own = self.v[present]
        pairs = 0.5 * (own.sum(0) ** 2 - (own**2).sum(0)).sum()
        return float(self.bias + self.w[present].sum() + pairs)

    def scores(self, texts: pa.Array, known: _Terms) -> np.ndarray:
        raw = np.array([self.raw(known.of(text.as_py() or "")) for text in texts], float)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, toxic: np.ndarray, sizes: np.ndarray, present: np.ndarray) -> None:
        """Adam on the log loss over the terms that a batch has, with a lasso on weights and factors.

        The lasso keeps at zero what the sample doesn't bear out; it is what holds back the many
        terms that few rows have, in place of a choice of terms.

        Row i has the label ``toxic[i]`` and the next ``sizes[i]`` numbers of ``present``.
        """
        if not len(self.terms) or not len(toxic):
            return
        seen = _counts(present, len(self.terms))
        value = np.append(seen / (seen + RARE), 1).astype(np.float32)
        # A word has up to three terms, which start with its odds together.
        self.w[:-1] = _odds(toxic, sizes, present, len(self.terms)) / 3
        self.w[-1] = self.bias
        chooser = np.random.default_rng(5)
        batches, order, starts = [], chooser.permutation(len(toxic)), np.cumsum(sizes) - sizes
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            own = [np.append(present[starts[r] : starts[r] + sizes[r]], np.int32(len(self.terms))) for r in rows]
            batches.append(_Batch(toxic[rows].astype(np.float32), sizes[rows] + 1, np.concatenate(own)))
        touched = np.zeros(len(value), np.int64)
        for b in batches:
            touched[b.terms] += 1
        share = (toxic.mean() * (1 - toxic.mean())) or 0.25
        off = np.sqrt(share * np.append(seen, 0))
        often = len(batches) / (len(toxic) * np.maximum(touched, 1))
        lasso = (np.maximum(LASSO * off, LEAST) * often).astype(np.float32)
        pair_lasso = (PAIR_LASSO * np.sqrt(len(toxic)) * often).astype(np.float32)
        lasso[-1] = 0
        params = [self.w, self.v]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        epochs = max(EPOCHS, STEPS // len(batches))
        for _ in range(epochs):
            for i in chooser.permutation(len(batches)):
                rate = RATE * (1 - step / (epochs * len(batches)))
                b, step = batches[i], step + 1
                x = value[b.terms]
                paired = x.copy()
                paired[b.terms == len(self.terms)] = 0
                w, v = self.w[b.terms], self.v[b.terms]
                xv = v * paired[:, None]
                sums = _sums(xv[b.own], b.row_starts)
                score = _sums((w * x - 0.5 * (xv**2).sum(1))[b.own], b.row_starts) + 0.5 * (sums**2).sum(1)
                wrong = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - b.toxic) / len(b.toxic)
                rows = b.row_of_term
                by_term = _sums(wrong[rows], b.term_starts)
                by_pair = _sums((wrong[:, None] * sums)[rows], b.term_starts)
                gradients = [by_term * x, (by_pair - xv * by_term[:, None]) * paired[:, None]]
                for p, g, m, s in zip(params, gradients, first, second):
                    own_m = m[b.terms] = 0.9 * m[b.terms] + 0.1 * g
                    own_s = s[b.terms] = 0.999 * s[b.terms] + 0.001 * g * g
                    pace = rate / (np.sqrt(own_s / (1 - 0.999**step)) + 1e-4)
                    moved = p[b.terms] - pace * own_m / (1 - 0.9**step)
                    if p is self.w:
                        p[b.terms] = np.sign(moved) * np.maximum(np.abs(moved) - pace * lasso[b.terms], 0)
                    else:
                        length = np.sqrt((moved**2).sum(1)) + 1e-12
                        less = pace.mean(1) * pair_lasso[b.terms] / length
                        p[b.terms] = moved * np.maximum(1 - less, 0)[:, None]
        self.bias = float(self.w[-1])
        self.w, self.v = self.w * value, self.v * value[:, None]
        # Terms whose weight and factors ended at zero add nothing to any score.
        told = np.append((self.w[:-1] != 0) | self.v[:-1].any(1), True)
        self.terms, self.w, self.v = self.terms[told[:-1]], self.w[told], self.v[told]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    # At most TRAIN_ROWS rows of numbers.
    rows = training_rows(docs, labels).select("doc_id", "toxic", "terms").toArrow().sort_by("doc_id")
    if not len(rows):
        return None
    toxic = rows["toxic"].to_numpy()
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in rows["terms"].chunks]).astype(np.int64)
    buckets = np.concatenate([c.flatten().to_numpy() for c in rows["terms"].chunks])
    del rows
    seen = np.zeros(BUCKETS, bool)
    seen[buckets] = True
    terms = np.flatnonzero(seen)
    present = (np.cumsum(seen, dtype=np.int32) - 1)[buckets]
    del buckets
    model = Model(terms.astype(np.int32), float(np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5))))
    model.fit(toxic, sizes, present)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and score of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = model.known()
        for batch in batches:
            scores = model.scores(batch["text"], known)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, that score below ``threshold``."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = model.known()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at), known) < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scores = score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
