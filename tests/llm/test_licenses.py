"""License scans against the same rules in plain Python, without a prefilter."""

from __future__ import annotations

import random
import re
from collections import Counter
from re import _parser

import pytest
from pyspark.sql import functions as F

from keyedflow.llm import licenses
from keyedflow.llm.license_rules import BASE, Rule, rules

RULES = rules()


def sample(pattern: str, rnd: random.Random) -> str:
    """A text that the pattern matches."""

    def made(items) -> str:
        out = ""
        for kind, value in items:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "NOT_LITERAL":
                out += rnd.choice("qz7")
            elif kind == "IN":
                choices = [chr(v) for k, v in value if str(k) == "LITERAL"] + [chr(rnd.randint(*v)) for k, v in value if str(k) == "RANGE"]
                out += rnd.choice(choices) if str(value[0][0]) != "NEGATE" else rnd.choice("qz7")
            elif kind == "BRANCH":
                out += made(rnd.choice(value[1]))
            elif kind == "SUBPATTERN":
                out += made(value[3])
            elif kind == "MAX_REPEAT":
                low, high, body = value
                out += "".join(made(body) for _ in range(rnd.randint(low, min(high, low + 3))))
            elif kind != "ASSERT":
                raise AssertionError(kind)
        return out

    return made(_parser.parse(pattern))


def words_of(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(text: str | None, listed: list[Rule]) -> tuple:
    words = words_of(text)
    line = " " + " ".join(words) + " "
    found = []
    for no, rule in enumerate(listed):
        for m in re.finditer(rule.pattern, line):
            start = line[: m.start()].count(" ")
            found.append((start, start + m.group().count(" ") - 1, rule.tier, no, rule))
    base = [f for f in found if f[4].base]
    own = [f for f in found if not f[4].base]

    def beaten(x, y) -> bool:
        inside = y[0] <= x[0] and x[1] <= y[1]
        return x is not y and inside and (y[2] < x[2] or y[2] == x[2] and (y[:2] != x[:2] or y[3] < x[3]))

    kept = [x for x in own if not any(beaten(x, y) for y in own)]
    labels, base_labels = {f[4].label for f in kept + base}, {f[4].label for f in base}
    starts = [f[0] for f in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)),
        max((f[4].weight for f in kept + base), default=0.0), len(kept),
    )


def scanned(spark, texts: list, listed: list[Rule] | None = None) -> list[tuple]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit(1))
    return [tuple(r)[1:] for r in licenses.license_scan(df, listed=listed).orderBy("doc_id").collect()]


def test_there_are_hundreds_of_rules_and_the_base_comes_first():
    assert len(RULES) > 300 and [r.label for r in RULES if r.base] == list(BASE.values())
    assert len({r.pattern for r in RULES}) > 0.98 * len(RULES)


def test_every_match_passes_its_prefilter():
    rnd = random.Random(3)
    for rule in RULES:
        for _ in range(12):
            text = sample(rule.pattern, rnd) + " "
            assert re.search(rule.pattern, text), (rule, text)
            assert set(rule.keywords) & set(text.split()) and all(n in text for n in rule.needs), (rule, text)


def test_equal_to_rules_without_prefilter(spark):
    rnd = random.Random(5)
    filler = "the of copyright license version 2 0 und ä 許可 Mit GPL apache cc by nc under licensed a".split()
    texts = [None, "", " \t\n", "###", "ä", "MIT License", "mit\nLICENSE, mit-license Apache License general public license"]
    texts += ["x " * 20 + "mit license. " * 400, "Released under the MIT License.", "permit license", "mit licenses", "İ mit license"]
    for _ in range(150):
        parts = [rnd.choice(filler) for _ in range(rnd.randint(0, 20))]
        for rule in rnd.sample(RULES, rnd.randint(0, 4)):
            parts.insert(rnd.randint(0, len(parts)), sample(rule.pattern, rnd).strip().title())
        texts.append(rnd.choice([" ", "  ", "\n", ", "]).join(parts))
    got = scanned(spark, texts)
    for text, row in zip(texts, got):
        assert row == pytest.approx(expected(text, RULES)), text
    assert sum(row[-1] > 1 for row in got) > 40


def test_priority_and_containment(spark):
    def rule(label, pattern, tier):
        return Rule(label, [pattern.split()[0]], [], f" {pattern}(?= )", tier, tier / 10)

    listed = [rule("long", "a b c d", 2), rule("first", "b c", 1), rule("inside", "c d", 2), rule("same", "a b c d", 2), rule("weak", "a b c", 3), rule("over", "d e", 2)]
    assert scanned(spark, ["a b c d e", "a b c", "c d"], listed) == [
        (5, 0, None, None, "", "first,long,over", 0.2, 3),
        (3, 0, None, None, "", "first,weak", 0.3, 2),
        (2, 0, None, None, "", "inside", 0.2, 1),
    ]


def test_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in licenses.op13_licenses(spark, sf_dir).collect())
    assert got == Counter((r.doc_id, *expected(r.text, RULES)) for r in rows)


def test_main_path_has_no_python(spark, sf_dir):
    plan = licenses.op13_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
