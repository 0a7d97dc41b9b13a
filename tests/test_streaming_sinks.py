"""Streaming sinks over several micro-batches: upsert with compaction and the
top-n refresh give the batch answer."""

import os

from pyspark.sql import functions as F

from vigilspark.session import scratch_path
from vigilspark.sources import fixtures as FX
from vigilspark.streaming import io

from .conftest import SF_SMALL


def _split_source(spark, n_files=4):
    """The events table written as several files (one micro-batch each)."""
    src = scratch_path(spark, "events-src")
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    ev.withColumn("_f", F.col("event_id") % n_files).repartition(n_files, "_f").drop("_f") \
        .write.parquet(src)
    schema = ev.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), ev


def test_upsert_with_compaction_equals_batch(spark):
    stream, ev = _split_source(spark)
    agg = FX.security_events_from(stream).withColumn("ts", F.col("timestamp").cast("timestamp")) \
        .withWatermark("ts", "400 days").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = io.run_upsert(agg, key_cols=["user_id"], compact_every=2)
    got = {r["user_id"]: r["n"] for r in io.read_upserted(spark, out, ["user_id"]).collect()}
    exp = {r["user_id"]: r["n"] for r in FX.security_events_from(ev).groupBy("user_id")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp
    assert spark.read.parquet(os.path.join(out, "_manifest")).count() >= 1


def test_top_n_over_batches(spark):
    stream, ev = _split_source(spark)
    out = io.run_top_n(stream.select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id").desc()], 7)
    got = [r["event_id"] for r in io.read_latest_version(spark, out).orderBy(F.col("ts").desc()).collect()]
    exp = [r["event_id"] for r in ev.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(7).collect()]
    assert got == exp


def test_rollup_streams_over_five_batches_equal_batch(spark):
    """Slices of time with rows that come late but in time, one client with half of the rows, a
    file without rows and rows without a time: S4 to S6 give what one aggregation gives."""
    import datetime as dt
    from vigilspark.streaming import queries as SQ
    t = dt.datetime(2024, 3, 9, 22, 58)
    schema = "id long, timestamp timestamp_ntz, event_type string, user_id string, blocked boolean, processing_time_ms double, " \
             "prompt string, response string, metadata string"

    def row(k, at):
        kind = ("prompt_injection", "data_leak", "normal_request")[k % 3]
        return (k, at, kind, "hot" if k % 2 else (None if k % 10 == 0 else f"u{k % 7}"), (True, False, None)[k % 3],
                None if k % 11 == 0 else k / 8, "p", "r", "{}" if k % 5 else None)

    slices = [[row(100 * b + k, t + dt.timedelta(minutes=25 * b, seconds=15 * k)) for k in range(100)] for b in range(4)]
    slices[2] += [row(900 + k, t + dt.timedelta(minutes=50, seconds=-k)) for k in range(60)]  # up to a minute before the slice
    slices[3] += [row(990, None)]
    slices.insert(1, [])
    src = scratch_path(spark, "rollup-src")
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    files = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ev = spark.read.schema(schema).parquet(src).where("timestamp is not null")
    lat = F.col("processing_time_ms")
    plans = {
        ("window_start", "user_id"): (SQ.client_minutes, lambda e: e.groupBy(
            F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("window_start"), "user_id").agg(F.count(F.lit(1)).alias("requests"))),
        ("date",): (SQ.daily_stats, lambda e: e.groupBy(F.to_date("timestamp").alias("date")).agg(
            F.count(F.lit(1)), F.count_if("blocked"), F.count_if(F.col("event_type") == "prompt_injection"),
            F.count_if(F.col("event_type") == "data_leak"), F.round(F.avg(lat), 6))),
        ("hour",): (SQ.hourly, lambda e: e.groupBy(F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour")).agg(
            F.count_if("blocked"), F.count_if(~F.col("blocked")), F.round(F.avg(lat), 6), F.min(lat), F.max(lat))),
    }
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for keys, (plan, batch) in plans.items():
        out = io.run_upsert(plan(files()))
        deltas = spark.read.option("basePath", out).parquet(os.path.join(out, "_batch=*"))
        assert deltas.select("_batch").distinct().count() >= 4
        assert order(io.read_upserted(spark, out, list(keys)).collect()) == order(batch(ev).collect())


def test_stream_limiter_over_ordered_batches_equals_batch(spark):
    from vigilspark.operators.limits import rate_limit
    from vigilspark.streaming.limiter import stream_rate_limit
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    src = scratch_path(spark, "events-ordered")
    q = ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0)  # event ids follow time
    part = (F.when(F.col("event_id") <= q[0], 0).when(F.col("event_id") <= q[1], 1)
            .when(F.col("event_id") <= q[2], 2).otherwise(3))
    for k in range(4):  # one file per time slice, written in time order
        ev.where(part == k).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    e = FX.security_events_from(stream).select("id", "user_id", F.col("timestamp").cast("timestamp").alias("ts"))
    out = io.run_append(stream_rate_limit(e, "user_id", "ts", "id", limit=2, unit="day"))
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    b = FX.security_events_from(ev).select("id", "user_id", "timestamp")
    exp = {r["id"]: r["allowed"] for r in rate_limit(b, "user_id", "timestamp", "id", limit=2, unit="day").collect()}
    assert got == exp


def test_audit_stream_drops_replayed_requests(spark):
    from vigilspark.streaming.queries import audit_events_stream
    conv = spark.read.parquet(os.path.join(SF_SMALL, "conversations.parquet"))
    src = scratch_path(spark, "conv-replay")
    conv.coalesce(1).write.parquet(src)
    conv.coalesce(1).write.mode("append").parquet(src)  # the same requests again
    stream = spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = io.run_append(audit_events_stream(FX.prompts_from(stream)))
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() > 0


def test_stream_limiter_reports_late_rows(spark):
    import datetime as dt
    from vigilspark.streaming.limiter import stream_rate_limit
    src = scratch_path(spark, "late-src")
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    schema = "id long, client string, ts timestamp"
    # batch 1: client a, three requests in one minute, then time moves on
    spark.createDataFrame([(1, "a", t), (2, "a", t + dt.timedelta(seconds=1)), (3, "a", t + dt.timedelta(seconds=2)),
                           (4, "b", t + dt.timedelta(hours=1))], schema).coalesce(1).write.parquet(src)
    # batch 2: a request for the long-closed 12:00 window arrives late
    spark.createDataFrame([(5, "a", t + dt.timedelta(seconds=3)), (6, "b", t + dt.timedelta(hours=1, seconds=5))],
                          schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = io.run_append(stream_rate_limit(stream, "client", "ts", "id", limit=2, unit="minute", delay="1 minute"))
    got = {r["id"]: (r["allowed"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert got[1] == (True, False) and got[2] == (True, False) and got[3] == (False, False)
    assert got[4] == (True, False) and got[6] == (True, False)
    assert got[5] == (None, True)  # its window was evicted: reported late, not counted


def test_audit_stream_logs_late_requests_over_many_batches(spark):
    from vigilspark.operators import proxy as PX
    from vigilspark.streaming.queries import audit_events_stream
    p = FX.prompts(spark, SF_SMALL)
    src = scratch_path(spark, "late-audit")
    rows = p.orderBy("ts", "request_id").collect()
    n = len(rows) // 4
    parts = [rows[:n], rows[2 * n:], rows[n:2 * n], rows[:n]]  # time moves on, then late requests, then a replay
    for part in parts:
        spark.createDataFrame(part, p.schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = spark.read.parquet(io.run_append(audit_events_stream(stream, replay_ms=86_400_000)))
    batch = PX.to_events(PX.process_requests(p))
    ids = sorted(r.id for r in batch.select("id").collect())
    assert ids == sorted(r.id for r in got.select("id").collect())
    late = {r.request_id for r in rows[n:2 * n]} & set(ids)
    limited = {r.id for r in got.where("event_type = 'rate_limit'").collect()}
    assert late and late <= limited  # cannot be counted any more: fail closed
    kinds = {r.id: r.event_type for r in batch.collect()}
    assert all(r.event_type == kinds[r.id] for r in got.where(~F.col("id").isin(list(late))).collect())


def test_time_buckets_do_not_depend_on_session_time_zone(spark):
    from vigilspark.plans.registry import queries
    q = queries()
    names = ["requests_hourly", "daily_statistics", "rate_limit", "stream_hourly", "stream_daily_stats"]

    def run():
        return {n: sorted(tuple(r) for r in q[n](spark, SF_SMALL).collect()) for n in names}

    utc = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ny = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == ny


def _limiter_run(spark, batches, **how):
    """(rows, state rows left) of the limiter over one file per batch."""
    from vigilspark.streaming.limiter import stream_rate_limit
    src, ckpt = scratch_path(spark, "limiter-src"), scratch_path(spark, "limiter-ckpt")
    schema = "id long, client string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = io.run_append(stream_rate_limit(stream, "client", "ts", "id", limit=3, delay="1 minute", **how), checkpoint=ckpt)
    left = spark.read.format("statestore").option("path", ckpt).option("stateVarName", "windows").load()
    return spark.read.parquet(out).collect(), left.select("key.client").collect()


def test_limiter_state_of_idle_clients_is_gone(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 12)
    minute = dt.timedelta(minutes=1)
    # clients 0..4 come once; afterwards only client "busy" moves time on
    batches = [[(k, f"c{k}", t + k * dt.timedelta(seconds=1)) for k in range(5)] + [(9, None, None)]]
    batches += [[(10 + k, "busy", t + k * minute)] for k in range(1, 8)]
    rows, left = _limiter_run(spark, batches)
    assert len(rows) == 13 and all(r.allowed and not r.late for r in rows if r.ts is not None)
    assert [(r.allowed, r.late) for r in rows if r.ts is None] == [(None, True)]
    assert {r.client for r in left} <= {"busy"}


def test_limiter_remembers_ids_past_the_window(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 12)
    minute, second = dt.timedelta(minutes=1), dt.timedelta(seconds=1)
    first = [(k, "a", t + k * second) for k in range(6)]
    batches = [first[::-1], first, [(50, "b", t + 4 * minute)], [*first, (7, "a", t + 30 * second)], [(51, "b", t + 20 * minute)],
               [(52, "b", t + 21 * minute)], first[:1]]
    rows, _ = _limiter_run(spark, batches, dedup_ms=300_000)
    of = {}
    for r in rows:
        of.setdefault(r.id, []).append((r.allowed, r.late))
    assert [of[k] for k in (1, 2, 3, 4, 5)] == [[(True, False)]] * 2 + [[(False, False)]] * 3
    assert of[0] == [(True, False), (None, True)]  # its memory had ended: reported again, as late
    assert of[7] == [(None, True)] and of[50] == of[51] == of[52] == [(True, False)]


def test_replays_are_dropped_within_the_watermark(spark):
    from vigilspark.streaming.queries import without_replays
    stream, ev = _split_source(spark)
    again, _ = _split_source(spark)
    twice = stream.union(again).withColumn("at", F.col("ts").cast("timestamp"))
    out = io.run_append(without_replays(twice, "event_id", "at", "400 days"))
    got = spark.read.parquet(out)
    assert got.count() == ev.count() == got.select("event_id").distinct().count()


def test_limiter_spreads_the_windows_of_one_client(spark):
    import datetime as dt
    from vigilspark.streaming.limiter import stream_rate_limit
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(10 * w + k, "busy", t + dt.timedelta(minutes=w, seconds=k)) for w in range(60) for k in range(4)]
    src, ckpt = scratch_path(spark, "limiter-src"), scratch_path(spark, "limiter-ckpt")
    spark.createDataFrame(rows, "id long, client string, ts timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, client string, ts timestamp").parquet(src)
    out = spark.read.parquet(io.run_append(stream_rate_limit(stream, "client", "ts", "id", limit=3, delay="2 hours"), checkpoint=ckpt))
    assert {r.id: r.allowed for r in out.collect()} == {i: i % 10 < 3 for i, _, _ in rows}
    state = spark.read.format("statestore").option("path", ckpt).option("stateVarName", "windows").load()
    assert {r["client"] for r in state.select("key.client").collect()} == {"busy"}
    assert state.select("partition_id").distinct().count() > 2
