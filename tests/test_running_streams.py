"""Running operators on streams: equal to the batch operators over any cut, and safe to replay."""

import random

import pytest
from pyspark.sql import functions as F

from keyedflow import Count, Sum, drop_late, interval_join, table_join_changelog, window_aggregate_changelog
from keyedflow.operators.joins import tagged_arrivals
from keyedflow.streaming import intervals, running
from keyedflow.streaming.tables import BucketTable

from helpers import at

TOTALS = (Count("n"), Sum("v", "total"))
SCHEMA = "key STRING, value STRUCT<v: DOUBLE, side: STRING>, ts TIMESTAMP, partition INT, offset BIGINT"


def arrivals(seed: int, hot: bool = False) -> list[tuple]:
    """Records of three partitions in the order in which they arrive, a key in one of them, times going back and forth."""
    rnd, offsets, out = random.Random(seed), [0, 0, 0], []
    for i in range(400):
        p = rnd.randrange(3)
        value = None if rnd.random() < 0.05 else (float(rnd.randrange(100)) if rnd.random() < 0.9 else None, rnd.choice("lr"))
        key = None if rnd.random() < 0.05 else f"hot{p}" if hot and rnd.random() < 0.7 else f"{rnd.choice('abcde')}{p}"
        out.append((key, value, at(i * 40 + rnd.randrange(4000)), p, offsets[p]))
        offsets[p] += rnd.randrange(1, 4)
    return out


def cuts(rows: list, seed: int) -> list[list]:
    rnd = random.Random(seed)
    ends = sorted(rnd.sample(range(1, len(rows)), 5))
    return [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)])]


def result(df) -> list:
    flat = df.select("key", F.to_json("value").alias("v"), F.unix_millis("ts").alias("ms"), "partition", "offset")
    return sorted(map(tuple, flat.collect()), key=repr)


def run_batches(spark, steps, batches, twice=()) -> list:
    """Results of the steps over the batches; those numbered in ``twice`` are replayed."""
    out = []
    for i, rows in enumerate(batches):
        for attempt in range(1 + (i in twice)):
            df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
            for step in steps:
                df = step(df, i)
            got = result(df)
        out += got
    return sorted(out, key=repr)


def changelog_steps(folder, grace, rows_per_chunk=10**6):
    steps = [running.inputs_step(TOTALS)]
    if grace is not None:
        steps.append(running.late_drop_step(BucketTable(f"{folder}/times", ["partition"], 1), 1_000, grace, rows_per_chunk=rows_per_chunk))
    return [*steps, running.changelog_step(BucketTable(f"{folder}/totals", ["key", "_start"], 4), TOTALS, 1_000, rows_per_chunk=rows_per_chunk)]


@pytest.mark.parametrize("seed, rows_per_chunk", [(1, 10**6), (2, 7)])
def test_late_drop(spark, folder, seed, rows_per_chunk):
    rows = arrivals(seed)
    want = result(drop_late(spark.createDataFrame(rows, SCHEMA), 1_000, 500))
    step = running.late_drop_step(BucketTable(folder, ["partition"], 1), 1_000, 500, rows_per_chunk=rows_per_chunk)
    assert run_batches(spark, [step], cuts(rows, seed), twice=(2,)) == want and 0 < len(want) < len(rows)


@pytest.mark.parametrize("seed, grace, rows_per_chunk", [(3, None, 10**6), (4, 500, 10**6), (5, 500, 7)])
def test_changelog(spark, folder, seed, grace, rows_per_chunk):
    rows = arrivals(seed, hot=True)
    want = result(window_aggregate_changelog(spark.createDataFrame(rows, SCHEMA), TOTALS, 1_000, grace))
    assert run_batches(spark, changelog_steps(folder, grace, rows_per_chunk), cuts(rows, seed), twice=(0, 3)) == want


@pytest.mark.parametrize("seed, rows_per_chunk", [(6, 10**6), (7, 7)])
def test_table_join(spark, folder, seed, rows_per_chunk):
    # One arrival sequence for both sides, in offset order.
    rows = [(k or "n", v or (None, "l"), ts, 0, i) for i, (k, v, ts, _, _) in enumerate(arrivals(seed, hot=True))]

    def sides(df):
        return [df.where(F.col("value.side") == s) for s in "lr"]

    want = result(table_join_changelog(*sides(spark.createDataFrame(rows, SCHEMA)), "l", "r", "key", order_by="offset"))
    step = running.table_join_step(BucketTable(folder, ["key"], 4), "l", "r", "offset", rows_per_chunk)
    batches = [tagged_arrivals(*sides(spark.createDataFrame(b, SCHEMA)), "key", True) for b in cuts(rows, seed)]
    assert run_batches(spark, [step], batches, twice=(1, 5)) == want and want


def pairs(df) -> list:
    flat = df.select("key", F.to_json("value").alias("v"), F.unix_millis("ts").alias("ms"))
    return sorted(map(tuple, flat.collect()), key=repr)


@pytest.mark.parametrize("seed, rows_per_task", [(10, None), (11, 10)])
def test_interval_join_over_waiting_records(spark, folder, seed, rows_per_task):
    """Times lie at most four seconds out of order, which the grace covers; most keys are one hot key."""
    rows = [(k or "n", v or (None, "l"), ts, p, o) for k, v, ts, p, o in arrivals(seed, hot=True)]

    def sides(df):
        return [df.where(F.col("value.side") == s) for s in "lr"]

    want = pairs(interval_join(*sides(spark.createDataFrame(rows, SCHEMA)), "l", "r", "key", 100))
    step, got = intervals.interval_step(folder, "l", "r", 100, 4_100, rows_per_task, waiting_windows=8), []
    for i, part in enumerate(cuts(rows, seed)):
        batch = tagged_arrivals(*sides(spark.createDataFrame(part, SCHEMA)), "key", True)
        tries = [pairs(step(batch, i)) for _ in range(1 + (i in (2, 5)))]
        assert tries[0] == tries[-1]  # a replayed batch adds the same pairs
        got += tries[0]
    assert sorted(got, key=repr) == want and want
    buckets = [b for own in intervals._batches(spark, folder).values() for b in own]
    assert min(buckets) > 3_000  # what can find no partner any more is gone


def test_failed_batch_is_replayed_by_the_stream(spark, folder):
    rows = arrivals(8)
    first, second = spark.createDataFrame(rows[:200], SCHEMA), spark.createDataFrame(rows[200:], SCHEMA)
    source = f"{folder}/in"

    def run(fail: bool) -> None:
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        steps = changelog_steps(f"{folder}/state", 500)

        def broken(df, batch_id):
            raise RuntimeError("stopped after the state was written")

        writer = running.step_stream(stream, [*steps, broken] if fail else steps, f"{folder}/out", f"{folder}/c")
        writer.trigger(availableNow=True).start().awaitTermination()

    first.write.mode("append").parquet(source)
    run(False)
    second.write.mode("append").parquet(source)
    with pytest.raises(Exception, match="stopped after"):
        run(True)
    run(False)
    want = result(window_aggregate_changelog(spark.createDataFrame(rows, SCHEMA), TOTALS, 1_000, 500))
    assert result(running.read_steps(spark, f"{folder}/out")) == want


def test_a_batch_reads_and_writes_only_the_buckets_it_touches(spark, folder):
    table, combine = BucketTable(folder, ["k"], 8), {"v": lambda new, held: F.coalesce(new, F.lit(0)) + F.coalesce(held, F.lit(0))}
    frame = lambda rows: spark.createDataFrame(rows, "k STRING, v BIGINT")
    running.merged(table, spark, frame([(str(i), 1) for i in range(100)]), 0, combine)
    for i in range(1, 30):
        state = running.merged(table, spark, frame([("7", 1)]), i, combine)
        touched = table.touched(frame([("7", 1)]))
        read = {f.partition("batch_id=")[2] for f in state.inputFiles()}
        assert len(read) == 1 and all(f"bucket={touched[0]}/" in f for f in read)
    rows = {r.k: r.v for r in table.current(spark).collect()}
    assert rows == {str(i): 30 if i == 7 else 1 for i in range(100)}
    # The other buckets keep their first version, and stale ones are gone.
    assert sorted(table._names(spark, "rows")) == ["batch_id=0", "batch_id=28", "batch_id=29"] and len(table._indexes(spark)) == 2
    assert len([n for n in table._names(spark, "rows/batch_id=0") if n.startswith("bucket=")]) == 7
    assert len([n for n in table._names(spark, "rows/batch_id=29") if n.startswith("bucket=")]) == 1


def test_no_python_runs_per_row(spark, folder):
    rows = arrivals(9)
    step = running.table_join_step(BucketTable(folder, ["key"], 4), "l", "r", "offset")
    df = spark.createDataFrame([(k or "n", v, t, p, o) for k, v, t, p, o in rows], SCHEMA)
    df.write.parquet(f"{folder}-in")
    stored = spark.read.schema(SCHEMA).parquet(f"{folder}-in")
    plan = step(tagged_arrivals(stored, stored, "key", True), 0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "ArrowEval" not in plan


def test_rules(spark, folder):
    with pytest.raises(ValueError, match="buckets"):
        BucketTable(folder, ["k"], 0)
    with pytest.raises(ValueError, match="keys"):
        BucketTable(folder, [])
    with pytest.raises(ValueError, match="no batch"):
        BucketTable(f"{folder}/none", ["k"]).current(spark)
