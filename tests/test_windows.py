"""Streams in several micro-batches, out of order, with repeats and a restart, against the batch over the same rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cardloom.streaming import windows

ROW = "id long, who string, at timestamp, version long"
START = datetime(2024, 1, 1)


def batches(rng):
    """Rows of five hours, each up to 20 minutes late, a tenth of them twice; then one that closes all windows."""
    rows = [(i, rng.choice("abc"), START + timedelta(minutes=rng.randrange(300)), i) for i in range(240)]
    come = sorted(rows + rng.sample(rows, 24), key=lambda r: r[2] + timedelta(minutes=rng.randrange(20)))
    parts = [come[i : i + 60] for i in range(0, len(come), 60)]
    return rows, [*parts, [(9_999, "end", START + timedelta(days=3), 9_999)]]


def run(spark, tmp_path, parts, make, mode="append"):
    """Half of the micro-batches, a new query on the same checkpoint, then the rest."""
    source, out, done = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in half:
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(source)
            stream = make(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source))
            if mode == "append":
                query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).trigger(availableNow=True).start()
            else:
                query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", done).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(out)


def told(df):
    return sorted(tuple(r) for r in df.filter("who <> 'end'").collect())


def test_windows_and_sessions_are_those_of_the_batch(spark, tmp_path):
    rows, parts = batches(random.Random(1))
    whole = spark.createDataFrame(rows, ROW)
    totals = {"n": F.count("*"), "least": F.min("id")}
    for name, make in (
        ("tumbling", lambda df, **k: windows.tumbling(df, "at", "30 minutes", ["who"], totals, **k)),
        ("sliding", lambda df, **k: windows.tumbling(df, "at", "30 minutes", ["who"], totals, slide="10 minutes", **k)),
        ("sessions", lambda df, **k: windows.sessions(df, "at", "5 minutes", ["who"], totals, **k)),
    ):
        got = run(spark, tmp_path / name, parts, lambda df: make(windows.deduplicated(df, ["id"], "at", "40 minutes")))
        assert told(got) == told(make(whole)) and len(told(got)) > 20


def test_what_comes_too_late_is_left_out(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    parts = [[(1, "a", at(5), 1)], [(2, "a", at(100), 1)], [(3, "a", at(6), 1), (4, "a", at(95), 1)], [(5, "end", at(5_000), 1)]]
    got = run(spark, tmp_path, parts, lambda df: windows.tumbling(df, "at", "30 minutes", ["who"], {"n": F.count("*")}, delay="20 minutes"))
    assert [(r[0], r[3]) for r in told(got)] == [(at(0), 1), (at(90), 2)]


def test_newest_versions(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(20), "w", START + timedelta(minutes=i // 4), rng.randrange(1_000)) for i in range(200)]
    got = run(spark, tmp_path, [rows[i : i + 50] for i in range(0, 200, 50)], lambda df: windows.newest(df, "id", "version", "at", "2 days"), mode="update").collect()
    want = {i: max(r[3] for r in rows if r[0] == i) for i in {r[0] for r in rows}}
    assert {i: max((r.batch, r.version) for r in got if r.id == i)[1] for i in want} == want
    for i in want:  # each one that came out was greater than those before
        seen = [r.version for r in sorted((r for r in got if r.id == i), key=lambda r: r.batch)]
        assert seen == sorted(set(seen))
