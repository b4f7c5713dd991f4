"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A text becomes its words, in lower case (A-Z alone) and between single spaces. Rules
(``license_rules``) are grouped by the keyword that all their matches hold; a rule's expression is
tried only on texts that have its keyword among their words and its longer pieces of text anywhere.
A match gives a detection: an interval of words. Of two detections one of which contains the
other, the contained one is suppressed when its rule has no higher priority (a smaller tier comes
first; of equal intervals the one with the smaller tier stays, then the rule that stands first). Both conditions pass on from one container to the next, so the outcome does not
depend on the order in which detections are looked at. Detections that merely overlap stay.
Base rules stand apart: they suppress nothing and are never suppressed.

Everything happens within the row, so nothing is shuffled and a document with very many matches
costs about as much as their number.

Defined results: null texts count as empty. Texts without words have no detections; labels are
then the empty string, first_word and last_word null and score 0. The score is the largest weight of
a rule whose detection stays, base rules included. Repeated rows and ids get a row each with equal
results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import string
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import table, text_of
from keyedflow.llm.license_rules import Rule, rules

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks around matches; no word has them.
OPEN, CLOSE = "\x01", "\x02"
_RULE = "struct<no:int,label:string,needs:array<string>,pattern:string,tier:int,weight:double,base:boolean>"
_HIT = "struct<start:bigint,back:bigint,tier:int,no:int,label:string,weight:double,base:boolean>"


def words_of(text: Column) -> Column:
    """The words between single spaces, with a space at both ends; a single space if there are none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    body = F.trim(F.regexp_replace(lower, NO_WORD, " "))
    return F.when(body == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def n_words(words: Column) -> Column:
    return (F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "))) - 1).cast("long")


def _literal(listed: Sequence[Rule]) -> Column:
    """The rules as one constant: an array of keywords, each with its rules."""
    numbered = sorted(enumerate(listed), key=lambda r: r[1].keywords)
    groups = [
        {"keywords": keywords, "rules": [{"no": no} | {k: v for k, v in r._asdict().items() if k != "keywords"} for no, r in own]}
        for keywords, own in groupby(numbered, key=lambda r: r[1].keywords)
    ]
    return F.from_json(F.lit(json.dumps(groups)), f"array<struct<keywords:array<string>,rules:array<{_RULE}>>>")


def candidates(words: Column, listed: Sequence[Rule]) -> Column:
    """The rules whose keywords the text holds: whole words first, then longer pieces."""
    keywords = F.lit(sorted({k for r in listed for k in r.keywords}))
    groups = _literal(listed)

    def of(present: Column) -> Column:
        held = F.filter(groups, lambda g: F.arrays_overlap(g["keywords"], present))
        return F.filter(F.flatten(F.transform(held, lambda g: g["rules"])), lambda r: F.forall(r["needs"], lambda k: F.contains(words, k)))

    present = F.array_intersect(F.split(words, " "), keywords)
    return F.transform(F.array(present), lambda p: F.when(F.size(p) > 0, of(p)).otherwise(F.array().cast(f"array<{_RULE}>")))[0]


def _spans(words: Column, rule: Column) -> Column:
    """The detections of one rule."""

    def marked(text: Column, mark: str, shift: int) -> Column:
        return F.array_compact(F.transform(F.split(text, " "), lambda w, i: F.when(F.contains(w, F.lit(mark)), i - shift)))

    def found(text: Column) -> Column:
        # A match starts with the space before its first word, so OPEN ends the word before it.
        return F.zip_with(
            marked(text, OPEN, 0),
            marked(text, CLOSE, 1),
            lambda start, end: F.struct(
                start.cast("long").alias("start"), (-end).cast("long").alias("back"),
                *[rule[c].alias(c) for c in ("tier", "no", "label", "weight", "base")],
            ),
        )

    replaced = F.regexp_replace(words, rule["pattern"], F.lit(f"{OPEN}$0{CLOSE}"))
    return F.transform(
        F.array(replaced), lambda t: F.when(F.contains(t, F.lit(OPEN)), found(t)).otherwise(F.array().cast(f"array<{_HIT}>"))
    )[0]


def detections(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: Sequence[Rule] | None = None) -> DataFrame:
    """``id, n_words, hits``: all detections of a row, before suppression; word ``-back`` is a hit's last."""
    words = df.select(F.col(id_col).alias("id"), words_of(text_of(text_col)).alias("words"))
    found = words.select("*", candidates(F.col("words"), rules() if listed is None else listed).alias("rules"))
    return found.select(
        "id", n_words(F.col("words")).alias("n_words"),
        F.flatten(F.transform("rules", lambda r: _spans(F.col("words"), r))).alias("hits"),
    )


def _resolved(hits: Column) -> Column:
    """What stays of the detections: ``(labels, score, kept)``.

    In the order of their starts, longest first, a detection is contained in an earlier one of
    tier t or less exactly if it ends within the furthest end of those.
    """
    start = F.struct(
        *[F.lit(-1).cast("long").alias(f"end{t}") for t in (1, 2, 3)],
        F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("kept"),
    )

    def step(s: Column, h: Column) -> Column:
        covered = F.when(h["tier"] == 1, s["end1"]).when(h["tier"] == 2, s["end2"]).otherwise(s["end3"])
        stays = -h["back"] > covered
        return F.struct(
            *[F.when(h["tier"] <= t, F.greatest(s[f"end{t}"], -h["back"])).otherwise(s[f"end{t}"]).alias(f"end{t}") for t in (1, 2, 3)],
            F.when(stays, F.array_union(s["labels"], F.array(h["label"]))).otherwise(s["labels"]).alias("labels"),
            F.when(stays, F.greatest(s["score"], h["weight"])).otherwise(s["score"]).alias("score"),
            (s["kept"] + stays.cast("long")).alias("kept"),
        )

    return F.aggregate(F.sort_array(hits), start, step)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``df``: its id, words, base places, labels and score."""
    parted = detections(df, id_col, text_col, listed).select(
        "id", "n_words",
        F.filter("hits", lambda h: h["base"]).alias("base"),
        F.filter("hits", lambda h: ~h["base"]).alias("own"),
    )
    base, resolved = F.col("base"), F.col("resolved")
    done = parted.withColumn("resolved", F.when(F.size("own") > 0, _resolved(F.col("own"))))
    base_labels = F.array_distinct(F.transform(base, lambda h: h["label"]))
    all_labels = F.array_union(base_labels, F.coalesce(resolved["labels"], F.array().cast("array<string>")))
    base_weight = F.array_max(F.transform(base, lambda h: h["weight"]))
    return done.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_labels), ",").alias("labels"),
        F.coalesce(F.greatest(resolved["score"], base_weight), F.lit(0.0)).alias("score"),
        F.coalesce(resolved["kept"], F.lit(0).cast("long")).alias("n_kept"),
    )


def op13_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))
