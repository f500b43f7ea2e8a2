"""Keyed state, deltas and compaction against their batch forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.streaming import deltas, streaks

SCHEMA = "k long, i long, bad boolean, ts timestamp"


def _outcomes(rng, n):
    return [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([True, True, True, False, None])) for i in range(n)]


def _plain(rows, least=3):
    want, n = [], {}
    for k, i, bad in sorted(rows, key=lambda r: r[1]):
        n[k] = n.get(k, 0) + 1 if bad else 0
        if n[k] >= least:
            want.append((k, i, n[k]))
    return sorted(want)


def test_streaks_of_three_batches_that_are_started_again(spark, tmp_path):
    rows = _outcomes(random.Random(4), 300)
    land, root = str(tmp_path / "in"), str(tmp_path / "out")
    frame = lambda part: spark.createDataFrame(part, "k long, i long, bad boolean").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i"))).coalesce(1)
    run = lambda: streaks.run_streaks(streaks.keyed_streaks(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(land), "k", "i", "bad", "ts"), root)
    first = rows[:100]
    random.Random(1).shuffle(first)  # within a batch, rows come in any order
    frame(first).write.parquet(land)
    assert sorted(map(tuple, run().collect())) == _plain(first)
    for part in (rows[100:200] + rows[50:100], rows[200:]):  # a new query, the second with old rows among the new
        frame(part).write.mode("append").parquet(land)
        found = run()
    assert sorted(map(tuple, found.collect())) == _plain(rows)
    assert spark.conf.get(streaks.STORE) != streaks.ROCKS


def test_state_of_a_quiet_source_is_dropped(spark, tmp_path):
    land, root = str(tmp_path / "in"), str(tmp_path / "out")
    day = 86_400
    for part in ([(1, 1, True, 0), (1, 2, True, 10)], [(2, 3, False, 40 * day)], [(2, 4, False, 80 * day)], [(1, 5, True, 81 * day), (1, 6, True, 81 * day), (1, 7, True, 81 * day)]):
        spark.createDataFrame(part, "k long, i long, bad boolean, s long").select("k", "i", "bad", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(land)
        found = streaks.run_streaks(streaks.keyed_streaks(spark.readStream.schema(SCHEMA).parquet(land), "k", "i", "bad", "ts"), root)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 3)]  # not 5


@pytest.mark.parametrize("seed", range(20))
def test_counts_that_are_carried_on(seed):
    rng = random.Random(seed)
    rows = [(1, i, rng.random() < 0.8) for i in range(60)]
    n, last, got = 0, None, []
    for a in range(0, 60, 15):
        part = rows[max(0, a - 5) : a + 15]  # five of them again
        rng.shuffle(part)
        at, count, n, last = streaks.count_streak(np.array([r[1] for r in part]), np.array([r[2] for r in part]), n, last)
        got += [(1, i, c) for i, c in zip(at.tolist(), count.tolist(), strict=True) if c >= 3]
    assert got == _plain(rows)
    assert streaks.count_streak(np.array([], dtype=np.int64), np.array([], dtype=bool), 2, 9)[2:] == (2, 9)


def _written(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_deltas_do_not_grow_with_the_snapshot(spark, tmp_path):
    schema, keys, root = "s string, k long, v string", ["s", "k"], tmp_path / "out"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state, sizes = {}, []
    for number in range(6):
        rows = [("a" if k % 2 else "b/c=d", k, f"{number}") for k in (range(20_000) if number == 0 else range(number, 40 + number))]
        batch = frame([*rows, (rows[0][0], rows[0][1], "twice")]).withColumn("line_", F.when(F.col("v") == "twice", 1).otherwise(0))
        assert deltas.append_batch(batch, number, keys, "s", str(root), ["line_"])
        state |= {(s, k): v for s, k, v in rows} | {(rows[0][0], rows[0][1]): "twice"}
        sizes.append(_written(root / "data"))
    assert max(np.diff(sizes)) < sizes[0] / 20
    held = lambda **more: {(r["s"], r["k"]): r["v"] for r in deltas.snapshot(spark, str(root), keys, "s", **more).collect()}
    assert held() == state and not deltas.append_batch(frame([("a", 1, "again")]).withColumn("line_", F.lit(0)), 3, keys, "s", str(root), ["line_"])
    before = held(version=0)
    assert len(before) == 20_000 and deltas.compact(spark, str(root), keys, "s", deltas=7) == []
    assert len(deltas.compact(spark, str(root), keys, "s", deltas=6)) == 2 and held() == state
    assert held(partitions=["a"]) == {k: v for k, v in state.items() if k[0] == "a"}
    assert deltas.vacuum(spark, str(root), keep=1) and held() == state
    assert len(list((root / "data").iterdir())) == 1
    assert deltas.append_batch(frame([("new", 1, "x")]).withColumn("line_", F.lit(0)), 6, keys, "s", str(root), ["line_"]) and held() == state | {("new", 1): "x"}


def test_landed_files_become_deltas(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    run = lambda: deltas.load_deltas(spark, str(land), "s string, k long, v string", ["k"], "s", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (land / "1.json").write_text('{"s":"x","k":1,"v":"a"}\n{"s":"y","k":2,"v":"b"}\n')
    run()
    (land / "2.json").write_text('{"s":"y","k":2,"v":"d"}\n{"s":"y","k":2,"v":"c"}\n')
    run()
    run()
    assert sorted(map(tuple, deltas.snapshot(spark, str(tmp_path / "out"), ["k"], "s").collect())) == [("x", 1, "a"), ("y", 2, "c")]
    listed = [(r["partition"], r["batch"], r["rows"]) for r in deltas.entries(spark, str(tmp_path / "out")).collect()]
    assert sorted(listed) == [("part_=x", 0, 1), ("part_=y", 0, 1), ("part_=y", 1, 1)]
    with pytest.raises(ValueError, match="nothing"):
        deltas.snapshot(spark, str(tmp_path / "none"), ["k"], "s")
