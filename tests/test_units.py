"""Single operators on small inputs with known results."""

import datetime as dt
import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from usageloom.functions import formatting as fmt
from usageloom.functions import scalars as fn
from usageloom.functions.models import normal_model
from usageloom.operators import aggregates as agg
from usageloom.operators import dashboard as dash
from usageloom.operators import series
from usageloom.operators.clean import clean_usage, keep_last, priced
from usageloom.operators.result_cache import cached_result, kept_catalog
from usageloom.sources import payloads
from usageloom.sources.usage import log_roots, modified_floor, parse_lines, read_lines
from usageloom.streaming.alerts import alerts
from usageloom.streaming.tail import stored_costs, tail_costs

ROOT = Path(__file__).resolve().parents[1]


def line(ts, model="claude-sonnet-4", tokens=(100, 50), key=("m", "r"), **more):
    usage = dict(zip(("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"), tokens, strict=False))
    record = {"type": "assistant", "timestamp": ts, "requestId": key[1], "message": {"id": key[0], "model": model, "usage": usage}} | more
    return json.dumps(record, separators=(",", ":"))


def parsed(spark, tmp_path, lines, name="a.jsonl"):
    (tmp_path / "logs" / "sub").mkdir(parents=True, exist_ok=True)
    (tmp_path / "logs" / "sub" / name).write_text("\n".join(lines) + "\n")
    return parse_lines(read_lines(spark, [str(tmp_path / "logs")]))


def test_lines_that_are_no_usage_records_go(spark, tmp_path):
    good = "2025-06-11T14:00:00Z"
    lines = [
        line(good), line(good).replace('"type":"assistant"', '"type":"user"'), line(good).replace('"type":"assistant"', '"type": "assistant"'), line("yesterday"), "{broken", "",
        line(good).replace('"usage"', '"used"'), line(good, pad="x" * (1 << 20)),
    ]
    assert parsed(spark, tmp_path, lines).count() == 1


def test_fields_of_a_line(spark, tmp_path):
    lines = [line("2025-06-11T14:00:00.5Z", "anthropic.claude-opus-4-1-20250805", (1.9, -5, True, "7"), cwd="/tmp/MyProject/"), line("2025-06-11T23:30:00-02:00", key=(None, "r"), session_id="s")]
    a, b = sorted(parsed(spark, tmp_path, lines).collect(), key=lambda r: r["ts"])
    assert (a["model"], a["project"], a["session_id"], a["message_key"], a["weekday"], a["hour"]) == ("claude-opus-4", "MyProject", "a", "m:r", 3, 14)
    assert (a["input_tokens"], a["output_tokens"]) == (1, 0)
    assert (b["project"], b["session_id"], b["message_key"], b["day"]) == ("Unknown", "s", None, dt.date(2025, 6, 12))


def test_the_last_of_a_message_counts_by_file(spark, tmp_path):
    ts = "2025-06-11T14:00:00Z"
    parsed(spark, tmp_path, [line(ts, tokens=(100, 50)), line(ts, tokens=(1000, 500)), line(ts, key=(None, None)), line(ts, key=(None, None))])
    rows = clean_usage(parsed(spark, tmp_path, [line(ts, tokens=(7, 0))], "b.jsonl"), dt.date(2025, 6, 11), 1)
    assert sorted((r["input_tokens"], r["output_tokens"]) for r in rows.collect()) == [(7, 0), (100, 50), (100, 50), (1000, 500)]
    summary = agg.cost_summary(priced(rows), dt.date(2025, 6, 11)).first()
    assert summary["today_tokens"] == summary["window_tokens"] == 1807 and summary["today_cost"] == pytest.approx(1207 * 3e-6 + 600 * 1.5e-5)


def test_window_and_cached_rows(spark, tmp_path):
    today = dt.date(2025, 6, 11)
    days = [0, 1, 6, 7, -1]
    usage = parsed(spark, tmp_path, [line(f"{today - dt.timedelta(days=d)}T23:00:00Z", tokens=(0, 0, 5, 0) if d == 1 else (1, 1), key=(str(d), "r")) for d in days])
    assert clean_usage(usage, today, 7).count() == 3 and clean_usage(usage, today, 7, cached_too=False).count() == 2


def test_keep_last_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("k", 1), ("k", 3), (None, 1), (None, 1), (None, 2)], "key string, at int")
    assert sorted(r["at"] for r in keep_last(df, ["key"], ["at"]).collect()) == [1, 1, 2, 3]


def test_stale_files_are_not_opened(spark, tmp_path):
    parsed(spark, tmp_path, [line("2025-06-11T14:00:00Z")])
    old = parsed(spark, tmp_path, [line("2025-06-11T14:00:00Z")], "old.jsonl")
    assert old.count() == 2
    os.utime(tmp_path / "logs" / "sub" / "old.jsonl", (0, 0))
    assert read_lines(spark, [str(tmp_path / "logs")], modified_floor(dt.date.today(), 7)).count() == 1
    assert modified_floor(dt.date(2026, 6, 12), 7) == dt.datetime(2026, 6, 5)


def test_roots_are_distinct_and_in_order():
    env = {"USAGE_LOG_DIRS": "/a, /b/projects/,/a"}
    assert log_roots(["/x", "/a/projects"], env, extra="/x") == ["/x", "/a/projects", "/b/projects"]


def test_tail_reads_what_is_new(spark, tmp_path):
    logs, store = tmp_path / "tail", str(tmp_path / "store")
    logs.mkdir()

    def tokens():
        tail_costs(spark, str(logs), store).awaitTermination()
        return stored_costs(spark, store).agg(F.sum(F.col("input_tokens") + F.col("output_tokens"))).first()[0] or 0

    first, second, ts = logs / "a.jsonl", logs / "b.jsonl", "2025-06-11T14:00:00Z"
    first.write_text(line(ts, tokens=(1000, 0)) + "\n")
    assert tokens() == 1000
    half = line(ts, tokens=(2000, 0), key=("n", "r"))
    with first.open("a") as f:
        f.write(half[:40])
    second.write_text(line(ts, tokens=(5, 0)) + "\n")
    assert tokens() == 1005
    with first.open("a") as f:
        f.write(half[40:] + "\n")
    assert tokens() == 3005 and tokens() == 3005
    first.write_text(line(ts, tokens=(100, 0)) + "\n")
    assert tokens() == 105
    # Written anew, and no line is whole yet: what was stored of the old file no longer counts.
    first.write_text(half[:40])
    assert tokens() == 5
    with first.open("a") as f:
        f.write(half[40:] + "\n" + line(ts, tokens=(1, 0), key=("o", "r")) + "\n")
    assert tokens() == 2006
    second.unlink()
    assert tokens() == 2006  # what a log held stays counted when the log goes
    second.write_text("\n".join(line(ts, tokens=(10, 0), key=(str(i), "r")) for i in range(9)) + "\n")
    assert tokens() == 2091


def test_tail_at_an_interval(spark, tmp_path):
    import time

    logs, store = tmp_path / "tail", str(tmp_path / "store")
    logs.mkdir()
    (logs / "a.jsonl").write_text(line("2025-06-11T14:00:00Z", tokens=(7, 0)) + "\n")
    query = tail_costs(spark, str(logs), store, every_seconds=1)
    try:
        until = time.time() + 120
        for batches, n, want in ((1, 8, 7), (2, 0, 15)):
            while time.time() < until:
                time.sleep(0.5)
                if len(list(tmp_path.glob("store/partials/batch=*/_SUCCESS"))) == batches and stored_costs(spark, store).agg(F.sum("input_tokens")).first()[0] == want:
                    break
            else:
                raise AssertionError(want)
            if n:
                with (logs / "a.jsonl").open("a") as f:
                    f.write(line("2025-06-11T14:00:00Z", tokens=(n, 0), key=("n", "r")) + "\n")
        assert query.isActive
    finally:
        query.stop()


def test_alerts_toggle_with_state(spark, tmp_path):
    source = str(tmp_path / "samples")
    left = [(80, True), (45, True), (40, True), (90, False), (45, True), (90, True), (15, True), (0, True), (100, True)]
    rows = [("session", i, 100.0 - x, on) for i, (x, on) in enumerate(left)]
    frame = spark.createDataFrame(rows, "window_id string, seq long, utilization double, enabled boolean")
    frame.write.parquet(source)
    query = alerts(spark.readStream.schema(frame.schema).parquet(source), [50, 20, 0, 300]).writeStream.format("memory").queryName("fired").outputMode("append")
    query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "progress")).start().awaitTermination()
    assert [(r["seq"], r["alert"]) for r in spark.table("fired").orderBy("seq", "alert").collect()] == [(1, "50"), (6, "20"), (7, "depleted"), (8, "restored")]


@pytest.mark.parametrize(("points", "current", "reset", "minutes", "label"), [
    ([(0, 10), (60, 40)], 40, 9e9, None, "calculating"),
    ([(0, 80), (60, 60), (120, 40), (180, 20)], 20, 9e9, None, "stable"),
    ([(0, 50), (60, 50), (120, 50), (180, 50)], 50, 9e9, None, "stable"),
    ([(0, 10), (60, 20), (120, 30), (180, 40), (240, 50)], 50, 3600, 5.0, "high"),
    ([(0, 10), (60, 20), (120, 30), (180, 40), (240, 50)], 50, 60, None, "low"),
])
def test_forecasts(spark, points, current, reset, minutes, label):
    start = dt.datetime(2025, 6, 11)
    rows = [("w", start + dt.timedelta(seconds=t), float(u), float(reset)) for t, u in points]
    found = series.forecasts(spark.createDataFrame(rows, "key string, ts timestamp_ntz, used double, reset double"), "key", ["ts"], "used", "reset").first()
    assert found["confidence"] == label and (found["minutes"] is None if minutes is None else found["minutes"] == pytest.approx(minutes))


def test_pace(spark):
    cases = [(50.0, 0.5, "onPace", True), (52.0, 0.5, "onPace", False), (55.0, 0.5, "deficit", False), (46.0, 0.5, "reserve", True), (80.0, 0.75, "deficit", False), (30.0, 0.25, "reserve", True), (10.0, 0.99, None, None), (40.0, 2.0, None, None), (50.0, None, None, None)]
    df = spark.createDataFrame([(i, u, None if r is None else r * 604800) for i, (u, r, _, _) in enumerate(cases)], "i int, used double, left double")
    rows = {r["i"]: r["p"] for r in df.select("i", series.pace(F.col("used"), F.col("left"), F.lit(10080)).alias("p")).collect()}
    for i, (_, _, status, lasts) in enumerate(cases):
        assert (rows[i] is None) == (status is None)
        assert status is None or (rows[i]["status"], rows[i]["lasts"]) == (status, lasts)


def test_names_versions_and_texts(spark):
    one = spark.range(1)
    names = {"claude-sonnet-4-5-20250929": "claude-sonnet-4", "claude-opus-4-1": "claude-opus-4", "anthropic.claude-3-5-sonnet-20241022": "claude-3-5-sonnet", "claude-haiku-3-5": "claude-haiku-3-5", "gpt": "gpt"}
    assert list(one.select(*[normal_model(F.lit(x)).alias(f"c{i}") for i, x in enumerate(names)]).first()) == list(names.values())
    pairs = [("1.1.1", "1.1.0", True), ("2.0.0", "1.9.9", True), ("1.1.0", "1.1", True), ("1.2.0-rc1", "1.1.0", True), ("1.0.0", "1.1.0", False), ("1.1", "1.1.0", False), ("1.1.0-beta", "1.1.0", False)]
    assert list(one.select(*[fn.is_newer(F.lit(a), F.lit(b)).alias(f"c{i}") for i, (a, b, _) in enumerate(pairs)]).first()) == [x for _, _, x in pairs]
    shown = one.select(fmt.countdown(F.lit(90061.0)), fmt.total_text(F.lit(5_400_000), F.lit(1500.0)), fmt.day_range(F.lit(dt.date(2025, 6, 1)), F.lit(dt.date(2025, 6, 30))), fmt.pace_label(F.lit("deficit"), F.lit(4.6), F.lit(50.0)), fmt.run_out_label(F.lit(False), F.lit(3700.0)), fmt.remaining_text(F.lit(12.4)), fmt.hour_text(F.lit(7)))
    assert list(shown.first()) == ["1d 1h", "Total: 5.4M tokens · $1.5K", "01/06 – 30/06", "5% in deficit - 50%", "Runs out in 1h 1m", "12%", "07:00"]


def test_csv_export_has_every_day(spark, tmp_path):
    rows = spark.createDataFrame([(dt.date(2025, 6, 11), "m", 100, 50, 4000, 200, 1.2345)], "day date, model string, input_tokens long, output_tokens long, cache_read long, cache_write long, cost double")
    dash.write_csv(dash.daily_axis(rows, dt.date(2025, 6, 11), 7), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")).splitlines()
    assert text[0] == "date,cost_usd,input_tokens,output_tokens,cache_read_tokens,cache_write_tokens" and len(text) == 8
    assert text[-1] == "2025-06-11,1.2345,100,50,4000,200" and all(x.endswith(",0.0000,0,0,0,0") for x in text[1:-1])
    assert dash.export_name(7, dt.date(2025, 6, 11)) == "claude-usage-7d-2025-06-11.csv"


def test_empty_events(spark, sf_dir):
    from usageloom.operators.clean import clean_usage
    from usageloom.sources.usage import usage_of_events

    rows = priced(clean_usage(usage_of_events(spark.read.parquet(f"{sf_dir}/events.parquet").limit(0)), dt.date(2024, 1, 30), 30))
    days = agg.by_day_model(rows)
    axis = dash.daily_axis(days, dt.date(2024, 1, 30), 30)
    assert axis.count() == 30 and dash.is_empty(days).first()[0] and agg.heatmap(rows).agg(F.sum("tokens")).first()[0] == 0
    assert dash.peak_hour(agg.heatmap(rows)).first()[0] == 0 and dash.busiest_weekday(axis).count() == 0
    assert dash.cache_savings(axis, dash.by_model(days)).first()["savings"] == 0 and dash.heat_scale(agg.heatmap(rows)).count() == 168


def test_entry_works_without_the_training_data_parts(tmp_path):
    code = """
import sys
GONE = sys.argv[1:]
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in GONE or any(name.startswith(x + ".") for x in GONE):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.llm is None and e.corpus_pipeline is None and "by_day_model" in e.queries() and set(e.queries()) == set(e.oracle_sql())
"""
    for gone in (["corpus_pipeline", "usageloom.llm"], ["ahocorasick"], ["sentencepiece"], ["public_tokenizers"]):
        subprocess.run([sys.executable, "-c", code, *gone], cwd=ROOT, check=True, timeout=120)


def test_null_keys_and_times_lose_no_rows(spark):
    day = dt.datetime(2025, 6, 11)
    rows = [(1, "a", day, 5.0), (2, "a", None, 6.0), (3, None, day, 7.0), (4, None, None, 8.0), (5, "a", day + dt.timedelta(days=1), 9.0), (6, None, day + dt.timedelta(days=2), 1.0)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, used double")
    before = {r["id"]: r["previous"] for r in series.previous(df, "key", ["ts", "id"], F.to_date("ts"), F.col("used")).collect()}
    assert before == {2: None, 1: 6.0, 5: 5.0, 4: None, 3: 8.0, 6: 7.0}
    kept = {r["id"]: r["carried"] for r in series.carried(df, "key", ["ts", "id"], F.to_date("ts"), F.when(F.col("id") % 3 != 0, F.col("used"))).collect()}
    assert kept == {2: 6.0, 1: 5.0, 5: 9.0, 4: 8.0, 3: 8.0, 6: 8.0}
    told = series.running_forecasts(df.withColumn("reset", F.lit(9e9)), "key", ["ts", "id"], "used", "reset").collect()
    assert sorted(r["id"] for r in told) == [1, 2, 3, 4, 5, 6]


def test_running_forecasts_don_t_depend_on_slices(spark):
    start = dt.datetime(2025, 6, 1)
    rows = [(i, "ab"[i % 7 == 0], start + dt.timedelta(hours=(i * i) % 997), float((i * 37) % 91), 1e6) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, used double, reset double")
    told = {}
    for name, cut in (("day", None), ("whole", F.lit(0)), ("hour", F.date_trunc("hour", "ts"))):
        found = series.running_forecasts(df, "key", ["ts", "id"], "used", "reset", cut)
        told[name] = sorted((r["id"], r["confidence"], None if r["minutes"] is None else round(r["minutes"], 6)) for r in found.collect())
    assert told["day"] == told["whole"] == told["hour"] and len({r[1] for r in told["day"]}) >= 3


def test_hashes_are_of_utf16_units(spark):
    texts = {"ab": "2e9", "a\U0001f600b": "yfx3y"}
    one = spark.range(1)
    assert list(one.select(*[fn.string_hash(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)]).first()) == [texts[t] for t in texts]
    names = one.select(*[fn.directory_name(x).alias(f"c{i}") for i, x in enumerate([fn.composed(F.lit("/x/a\U0001f600b")), fn.composed(F.lit("e\u0301")), F.lit("e\u0301"), fn.composed(F.lit(None).cast("string"))])])
    assert list(names.first()) == ["-x-a--b", "-", "e-", None]


CATALOG = {
    "anthropic": {"models": {
        "claude-opus-4-1": {"cost": {"input": 15, "output": "75"}},
        "claude-sonnet-4-20250514": {"cost": {"input": 3, "output": 15}},
        "claude-sonnet-4-5": {"cost": {"input": 4, "output": 16}},
        "claude-free": {"cost": {"input": None, "output": 1}},
    }},
    "other": {"models": {"some-model": {"cost": {"input": 1, "output": 2}}}},
    "claude-haiku-3-5": {"cost": {"input": 0.8, "output": 4}},
}


def test_price_catalogues(spark):
    found = payloads.price_catalog(spark.createDataFrame([(json.dumps(CATALOG),), ("{",), (None,)], "value string")).collect()
    assert {r["model"]: (round(r["price_in"], 12), round(r["price_out"], 12)) for r in found} == {"claude-opus-4": (1.5e-5, 7.5e-5), "claude-sonnet-4": (3e-6, 1.5e-5), "claude-haiku-3-5": (8e-7, 4e-6)}


@pytest.mark.parametrize(("payload", "want"), [
    ({"five_hour": {"utilization": 12.5, "resets_at": "2025-12-25T12:00:00.000Z"}, "seven_day": {"utilization": 30}, "seven_day_sonnet": {"utilization": 5}}, (12.5, 30, None)),
    ({"seven_day": {"utilization": 42}, "seven_day_routines": None}, (42, 42, 0)),
    ({"seven_day_routines": {"utilization": "x"}, "cowork": {"utilization": 7}, "five_hour": {"utilization": 1}}, (1, None, 0)),
    ({"five_hour": {"utilization": 1}, "cowork": {"utilization": 7}}, (1, None, 7)),
    ({}, (None, None, None)),
    ("no json", None),
    (None, None),
])
def test_rate_payloads(spark, payload, want):
    text = payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    w = spark.createDataFrame([(text,)], "value string").select(payloads.rate_windows(F.col("value")).alias("w")).first()["w"]
    assert (w is None) == (want is None)
    assert w is None or tuple(x and x["utilization"] for x in (w["session"], w["weekly"], w["dailyRoutines"])) == tuple(want)


PANELS = [
    ("Current session\n40% used\nCurrent week (all models)\n10% used", 40, 10),
    ("\x1b[1mCurrent session\x1b[0m\n\x1b[31m40%\x1b[0m used\nCurrent week (all models)\n10% used", 40, 10),
    ("Current session\n12% remaining\nCurrent week\n40% remaining", 88, 60),
    ("Current session: 12.5% used\nCurrent week: 4.2% used", 12.5, 4.2),
    ("Current session\n2% used", 2, 0),
    ("55% of this\n22% of that", 55, 22),
    ("claude | Opus 0% | default\nCurrent session\n45% used\nCurrent week\n9% used", 45, 9),
    ("no figures here", None, None),
    ("", None, None),
    (None, None, None),
]


def test_panels(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PANELS)], "i int, value string")
    p = payloads.panel(F.col("value"))
    assert [(r[1], r[2]) for r in df.select("i", p.session, p.weekly).orderBy("i").collect()] == [p[1:] for p in PANELS]


def test_release_feeds(spark):
    feeds = [json.dumps({"tag_name": "v1.2.0", "assets": [{"name": "a.dmg", "browser_download_url": "u1"}, {"name": "A.ZIP", "browser_download_url": "u2"}]}), json.dumps({"tag_name": "1.3", "assets": []}), "{", None]
    df = spark.createDataFrame(list(enumerate(feeds)), "i int, value string")
    r = payloads.release(F.col("value"))
    assert [tuple(x)[1:] for x in df.select("i", r.version, r.url).orderBy("i").collect()] == [("1.2.0", "u2"), ("1.3", None), (None, None), (None, None)]


def test_results_are_kept_while_the_sources_stay(spark, tmp_path):
    logs, built = tmp_path / "logs", []
    logs.mkdir()
    (logs / "a.jsonl").write_text("x\n")

    def build():
        built.append(1)
        return spark.range(len(built))

    ask = lambda period: cached_result(spark, str(tmp_path / "store"), period, [str(logs)], build).count()
    assert (ask("7d"), ask("7d"), ask("30d"), ask("7d"), len(built)) == (1, 1, 2, 1, 2)
    (logs / "b.jsonl").write_text("y\n")
    assert (ask("7d"), ask("7d"), len(built)) == (3, 3, 3)


def test_catalogue_lives_a_day(spark, tmp_path):
    start, fetched = dt.datetime(2025, 6, 1), []

    def fetch():
        fetched.append(1)
        if len(fetched) == 3:
            raise OSError("no answer")
        return spark.createDataFrame([("m", float(len(fetched)), 2.0)], "model string, price_in double, price_out double")

    at = lambda hours, store="a": kept_catalog(spark, str(tmp_path / store), fetch, start + dt.timedelta(hours=hours)).first()["price_in"]
    assert [at(0), at(23), at(25), at(48)] == [1.0, 1.0, 2.0, 2.0] and len(fetched) == 2
    assert at(80) == 2.0 and len(fetched) == 3  # stale, as fetching fails
    fetched[:] = [1, 1]
    assert kept_catalog(spark, str(tmp_path / "none"), fetch, start).count() == 4  # the fixed prices


@pytest.mark.parametrize(("made", "step"), [(payloads.rate_windows, "from_json("), (payloads.panel, "split(")])
def test_a_payload_is_read_once_a_row(spark, made, step):
    found = spark.range(1).select(F.col("id").cast("string").alias("value")).select(made(F.col("value")).alias("p")).select("p.session", "p.weekly")
    assert found._jdf.queryExecution().optimizedPlan().toString().count(step) == 1
