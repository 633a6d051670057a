"""Alerts, forecasts and carried samples on a stream, the sink of posts, and results from one pass or of changed files only."""

import datetime as dt
import json
import random

import pytest
from compare import spark_rows
from pyspark.sql import functions as F
from test_units import line

from usageloom.operators import aggregates as agg
from usageloom.operators.clean import clean_usage, priced
from usageloom.operators.fold import folded
from usageloom.plans.usage import NOW, rows
from usageloom.streaming import quota
from usageloom.streaming.state import stateful_session

SAMPLES = "window_id string, seq long, seconds double, used double, until_reset double, enabled boolean"


def run(spark, tmp_path, batches, make, schema, name):
    """What a stream emits of the batches, one after the other, each with a restart."""
    source, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    got = []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        session = stateful_session(spark)
        stream = make(session.readStream.schema(schema).parquet(str(source)))
        put = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / f"{name}-progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got.append([tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{out}/batch={i}").collect()])
    return got


def test_alerts_of_a_tick_come_in_order_and_state_outlives_batches(spark, tmp_path):
    # Rising to exhaustion in the first batches, a reset in the last one; window b is off at first.
    used = [10, 20, 30, 40, 55, 70, 85, 95, 100, 100, 5, 15, 25, 99]
    ticks = [("a", i, 60.0 * i, float(u), 3600.0, True) for i, u in enumerate(used)] + [("b", i, 60.0 * i, float(u), 3600.0, i > 8) for i, u in enumerate(used)]
    batches = [[t for t in ticks if t[1] in part] for part in (range(3), range(3, 8), range(8, 14))]
    for b in batches:
        random.Random(1).shuffle(b)
    got = [x for b in run(spark, tmp_path, batches, lambda s: quota.quota_alerts(s, [50, 20]), SAMPLES, "q") for x in b]
    alerts = lambda w: [(r[1], r[2], r[3]) for r in sorted(got) if r[0] == w and r[2]]
    # Sample 3 is the third rising minute with an end in sight; the forecast stays near until the reset.
    assert alerts("a") == [(2, 3, "predictive"), (4, 2, "50"), (6, 2, "20"), (8, 1, "depleted"), (10, 1, "restored"), (13, 2, "20")]
    assert alerts("b") == [(9, 1, "depleted"), (9, 2, "20"), (10, 1, "restored"), (13, 2, "20")]
    forecasts = {r[1]: r[4:] for r in got if r[0] == "a" and not r[2]}
    assert forecasts[0] == (None, "calculating") and forecasts[4][1] == "high" and forecasts[8][0] == 0 and len(forecasts) == 14


def test_the_forecast_is_that_of_the_batch_ladder():
    assert quota.forecast_of([(0.0, 10.0), (60.0, 40.0)], 9e9) == (None, "calculating")
    assert quota.forecast_of([(60.0 * i, 10.0 + 10 * i) for i in range(5)], 3600.0) == (pytest.approx(5.0), "high")
    assert quota.forecast_of([(60.0 * i, 10.0 + 10 * i) for i in range(5)], 60.0) == (None, "low")
    assert quota.forecast_of([(60.0 * i, 80.0 - 20 * i) for i in range(4)], 9e9) == (None, "stable")
    assert quota.forecast_of([(5.0, 1.0)] * 6, 9e9) == (None, "calculating") and quota.slope_of([]) is None


def test_errors_keep_the_last_good_sample(spark, tmp_path):
    schema = "window_id string, seq long, seconds double, used double, has_error boolean"
    batches = [[("a", 0, 0.0, 1.0, True), ("a", 1, 1.0, 2.0, False)], [("a", 3, 3.0, 9.0, True), ("b", 2, 2.0, 5.0, True), (None, 4, 4.0, 7.0, False)], [("a", 5, 5.0, 4.0, True), (None, 6, 6.0, 0.0, True)]]
    got = run(spark, tmp_path, batches, lambda s: quota.carried_forward(s), schema, "c")
    assert [sorted(b, key=repr) for b in got] == [
        [("a", 0, True, None, None), ("a", 1, False, 2.0, 1)], [("a", 3, True, 2.0, 1), ("b", 2, True, None, None), (None, 4, False, 7.0, 4)], [("a", 5, True, 2.0, 1), (None, 6, True, 7.0, 4)],
    ]


def test_a_batch_that_runs_again_posts_nothing_twice(spark, tmp_path):
    outbox, source, progress = tmp_path / "outbox", str(tmp_path / "in"), tmp_path / "progress"
    spark.dataSource.register(quota.AlertPosts)

    def post(ids):
        spark.createDataFrame([(i, f"body of {i}") for i in ids], "id string, body string").coalesce(2).write.mode("append").parquet(source)
        go()

    def go():
        query = spark.readStream.schema("id string, body string").parquet(source).writeStream.format("alert_posts").option("outbox", str(outbox))
        query.option("checkpointLocation", str(progress)).trigger(availableNow=True).start().awaitTermination()

    told = lambda: sorted((r["batch"], r["id"], r["body"]) for r in quota.posted(spark, str(outbox), "id string, body string").collect())
    assert told() == []
    post(["x", "é"])
    post(["y"])
    want = [(0, "x", "body of x"), (0, "é", "body of é"), (1, "y", "body of y")]
    assert told() == want
    # The stream failed after the sink's commit: its own record of the batch is missing, and the batch runs again.
    for f in ("1", ".1.crc"):
        (progress / "commits" / f).unlink(missing_ok=True)
    go()
    assert told() == want and len(list((outbox / "manifests").glob("*.json"))) == 2
    # What an aborted batch has staged goes, and half a batch, without a manifest, isn't posted.
    writer = quota.PostsWriter(str(outbox))
    Row = spark.createDataFrame([("z", "b")], "id string, body string").first()
    staged = writer.write(iter([Row]))
    assert told() == want
    writer.abort([staged, None, quota.Staged(None)], 7)
    assert not (outbox / "posts" / staged.name).exists() and told() == want
    writer.commit([writer.write(iter([Row])), writer.write(iter([]))], 8)
    assert told() == [*want, (8, "z", "b")]
    assert json.loads((outbox / "manifests" / "1.json").read_text())


def test_one_pass_gives_what_the_single_queries_give(spark, sf_dir):
    clean = rows(spark, sf_dir)
    found = folded(clean, NOW)
    single = {"by_day_model": agg.by_day_model(clean), "by_project": agg.by_project(clean), "heatmap": agg.heatmap(clean), "sessions": agg.sessions(clean), "month_to_date": agg.month_to_date(clean, NOW)}
    for name, want in single.items():
        assert spark_rows(found[name].select(*want.columns)) == spark_rows(want), name
    # All of them read the stored fold, and its own plan has one scan and one keep-last.
    from usageloom.operators.fold import fold

    plan = fold(clean, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1 and plan.count("Window [row_number()") == 1
    nothing = folded(clean.limit(0), NOW)
    assert nothing["heatmap"].count() == 168 and nothing["sessions"].count() == 0


def test_one_changed_file_of_a_hundred_is_read(spark, tmp_path):
    from usageloom.operators.changed_files import changed_result
    from usageloom.sources.usage import parse_lines, read_lines

    logs, store = tmp_path / "logs", str(tmp_path / "store")
    logs.mkdir()
    ts, today = "2025-06-11T14:00:00Z", dt.date(2025, 6, 11)
    for i in range(100):
        (logs / f"{i:03d}.jsonl").write_text("\n".join(line(ts, tokens=(i, 1), key=(str(j % 2), "r")) for j in range(3)) + "\n" if i else "")
    usage = lambda lines: priced(clean_usage(parse_lines(lines), today, 1))
    whole = lambda: spark_rows(agg.by_day_model(usage(read_lines(spark, [str(logs)]))))

    def again():
        found, changed = changed_result(spark, store, [str(logs)], usage)
        return spark_rows(found), sorted(r["path"][-9:] for r in changed.collect())

    first, read = again()
    assert first == whole() and len(read) == 99  # an empty file has nothing to read
    assert again() == (first, [])
    with (logs / "007.jsonl").open("a") as f:
        f.write(line(ts, tokens=(1000, 0), key=("1", "r")) + "\n")
    (logs / "008.jsonl").unlink()
    (logs / "new.jsonl").write_text(line(ts, "claude-opus-4", tokens=(5, 5)) + "\n")
    found, read = again()
    assert found == whole() != first and read == ["007.jsonl", "new.jsonl"]


def test_a_windows_samples_take_two_exchanges_with_the_state():
    from test_tail import Handle

    handle, step = Handle(), quota.Quota([50, 20])
    step.init(handle)
    for batch in range(3):
        given = [{"seconds": 60.0 * i, "seq": i, "used": 10.0 * i, "until_reset": 9e9, "enabled": True} for i in range(3 * batch, 3 * batch + 3)]
        told = [(r["seq"], r["place"], r["alert"]) for r in step.handleInputRows(("w",), iter(given), None) if r["alert"]]
        assert told == [[(2, 3, "predictive")], [(5, 2, "50")], [(8, 2, "20")]][batch] and handle.exchanges == 2 * batch + 2
