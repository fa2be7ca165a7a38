"""Ordered folds, leaky buckets and job phases, over tables and streams."""

import random

import pytest
from citemill.runtime import written
from citemill.streaming import folds, limits, phases

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(times, requests, period, burst):
    """The leaky bucket told in fractions of a request."""
    from fractions import Fraction

    level, last, found = None, 0, []
    for at in times:
        lifted = Fraction(0) if level is None else max(Fraction(0), level - Fraction(requests * (at - last), period) + 1)
        accepted = lifted <= burst
        if accepted:
            level, last = lifted, at
        found.append((accepted, float(lifted)))
    return found


@pytest.mark.parametrize("seed", range(30))
def test_bucket_equals_fractions_and_composes(seed):
    rng = random.Random(seed)
    requests, period, burst = rng.choice([(5, 60, 2), (20, 60, 10), (1, 7, 0), (3, 100, 1)])
    times = [0]
    for _ in range(rng.randint(0, 120)):
        times.append(times[-1] + rng.choice([0, 0, 1, 2, 5, 30, 200]))
    bucket = limits.Bucket(requests, period, burst)
    rows = [{"at": t} for t in times]
    found, end = bucket.run(None, rows)
    assert [(a, round(e, 9)) for a, e in found] == [(a, round(e, 9)) for a, e in plain(times, requests, period, burst)]
    state, k = None, 0
    while k < len(rows):
        cut = rows[k : k + rng.randint(1, 15)]
        summary = bucket.summary(cut)
        assert len(summary[2]) <= 8 * (burst + 2)
        state, k = bucket.apply(summary, state), k + len(cut)
    assert state == end


def test_files_hold_so_many_rows_whatever_the_input(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(folds, "FILE_ROWS", 100)
    kept = []
    monkeypatch.setattr(folds, "written", lambda df: kept.append(written(df)) or kept[-1])
    events = spark.range(3000).selectExpr("'one' who", "timestamp_millis(id * 300) ts", "id")
    found = limits.limited(events, "who", "ts", "id", requests=1, period=1_000_000)
    assert found.count() == 3000 and found.where("accepted").count() == 750
    sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 300


def test_a_hot_key_split_over_files(spark):
    rng = random.Random(4)
    rows = [(rng.choices(["hot", "b", None, "c"], [20, 1, 1, 1])[0], rng.randint(0, 40_000), k) for k in range(1500)]
    events = spark.createDataFrame(rows, "who string, ms long, id long").selectExpr("*", "timestamp_millis(ms) ts", "1 accepted_by").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = limits.limited(events, "who", "ts", "id", requests=5, period=1_000_000, burst=3)
        got = {r.id: (r.accepted, round(r.excess, 9)) for r in found.collect()}
        assert found.columns == [*events.columns, "accepted", "excess"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for who in ("hot", "b", None, "c"):
        own = sorted((ms, k) for w, ms, k in rows if w == who)
        want |= {k: (a, round(e, 9)) for (_, k), (a, e) in zip(own, plain([ms * 1000 for ms, _ in own], 5, 1_000_000, 3), strict=True)}
    assert got == want
    assert limits.limited(events.limit(0), "who", "ts", "id", 5).count() == 0


EVENTS = "run string, at long, seq long, status string, phase string, error string"


def job_events(seed, n=400):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        run = rng.choices(["hot", *[f"r{i}" for i in range(20)]], [20] + [1] * 20)[0]
        status = rng.choices(["queued", "running", None, "completed", "failed", "odd"], [3, 5, 5, 0.3, 0.3, 0.3])[0]
        made.append((run, 1_000_000 * (k // 2 + 1), k, status, rng.choice([None, f"phase {k}"]), rng.choice([None, None, "bad"])))
    return made


def test_replay_splits_one_job_over_files(spark):
    rows = job_events(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        replayed = phases.replay(spark.createDataFrame(rows, EVENTS).repartition(3)).cache()
        got = {r.seq: (r.now, r.now_phase, r.now_error, r.created_at, r.legal) for r in replayed.collect()}
        final = {r.run: r for r in phases.final(replayed).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, last = {}, {}
    for run, at, seq, status, phase, error in rows:
        now, shown, err, created = last.get(run, ("", None, None, None))
        new, legal = phases.step(now, status)
        if legal:
            now, shown, err, created = new, phase or shown, error or err, at if created is None else created
        want[seq], last[run] = (now, shown, err, created, legal), (now, shown, err, created)
    assert got == want and not all(x[-1] for x in got.values())
    assert {run: (r.status, r.phase, r.error, r.created_at) for run, r in final.items()} == {run: x for run, x in last.items() if x[0]}
    assert sum(r.illegal for r in final.values()) <= sum(not x[-1] for x in got.values())


def test_steps():
    assert phases.step("", "queued") == ("queued", True) and phases.step("", "running") == ("", False) == phases.step("", None)
    assert phases.step("queued", "completed") == ("queued", False) and phases.step("running", None) == ("running", True)
    assert phases.step("completed", None) == ("completed", False) and phases.step("failed", "running") == ("failed", False)


def streamed(spark, tmp_path, batches, schema, make):
    """Rows of a stream over files that are read one a batch; a later one only moves the watermark."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    name = f"out_{random.getrandbits(40)}"
    try:
        query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.table(name).collect()


def test_stream_equals_replay_and_jobs_expire_without_an_event(spark, tmp_path):
    rows = job_events(2, 90) + [("end", 60_000_000, 1000, "queued", None, None), ("end", 61_000_000, 1001, "failed", "Failed", "x"), ("waits", 60_000_000, 1002, "queued", None, None)]
    rows.sort(key=lambda r: (r[1], r[2]))
    replayed = {r.seq: (r.now, r.now_phase, r.now_error, r.created_at, r.legal) for r in phases.replay(spark.createDataFrame(rows, EVENTS)).collect()}
    timed = "run string, time timestamp, seq long, status string, phase string, error string"
    as_time = lambda us: __import__("datetime").datetime.fromtimestamp(us / 1e6)
    batches = [[(r[0], as_time(r[1]), *r[2:]) for r in rows[k : k + 40]] for k in range(0, len(rows), 40)]
    batches += [[("other", as_time(10_000_000_000), 5000, "queued", None, None)], [("other", as_time(10_000_100_000), 5001, None, "go", None)]]
    found = streamed(spark, tmp_path, batches, timed, lambda s: phases.stream_phases(s, ttl=100))
    got = {r.seq: (r.status, r.phase, r.error, r.created_at, r.kind == "change") for r in found if r.kind != "expired" and r.run != "other"}
    assert got == replayed
    expired = {r.run: r for r in found if r.kind == "expired"}
    ended = {run for run, *_ in rows} & {r.run for r in phases.final(phases.replay(spark.createDataFrame(rows, EVENTS))).where("status IN ('completed', 'failed')").collect()}
    assert set(expired) == ended and "end" in expired and "waits" not in expired
    assert (expired["end"].status, expired["end"].phase, expired["end"].at) == ("failed", "Failed", 160_000_000)


def test_stream_of_requests_equals_the_table(spark, tmp_path):
    rng = random.Random(6)
    as_time = lambda ms: __import__("datetime").datetime.fromtimestamp(ms / 1000)
    rows = sorted(((rng.choice(["a", "b"]), rng.randint(1, 60_000), k) for k in range(120)), key=lambda r: (r[1], r[2]))
    rows += [("c", 400_000, 500), ("a", 400_100, 501), ("c", 900_000, 502)]
    data = [(w, as_time(ms), k) for w, ms, k in rows]
    bucket = limits.Bucket(2, 1_000_000, 3)
    found = streamed(spark, tmp_path, [data[:50], data[50:100], data[100:121], data[121:122], data[122:]], "who string, ts timestamp, id long", lambda s: limits.stream_limited(s, "who", "ts", "id", bucket))
    table = limits.limited(spark.createDataFrame(data, "who string, ts timestamp, id long"), "who", "ts", "id", 2, 1_000_000, 3).collect()
    assert {r.tie: (r.accepted, r.excess) for r in found} == {r.id: (r.accepted, r.excess) for r in table}


def test_fold_needs_its_methods():
    for call in (lambda f: f.run(None, []), lambda f: f.summary([]), lambda f: f.apply(None, None)):
        with pytest.raises(NotImplementedError):
            call(folds.Fold())
