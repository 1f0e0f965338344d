import datetime as dt
import random

import pytest

from tintframe.streaming import requests, scheduler

DDL = "ts timestamp, key long, kind string, generation long, payload double"
GAP, PREVIEW, FULL = 3000, 2000, 4000
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ZERO = int(START.timestamp() * 1000)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def replay(rows, gap=GAP, preview=PREVIEW, full=FULL):
    """Frames of all sessions, by walking through each one's seconds."""
    out = []
    for key in {r[1] for r in rows}:
        mine = sorted(((int(r[0].timestamp() * 1000), r[3], r[2], r[4]) for r in rows if r[1] == key), key=lambda e: e[:2])
        gate_closed = deferred = False
        values = timer = job = None  # job: [value, time of preview, time of full]
        for now in range(mine[0][0], mine[-1][0] + gap + preview + full + 2000, 1000):
            if timer == now:
                job, timer = [values, now + preview, now + preview + full], None
            if job and job[1] == now:
                out.append((key, *job[0], "preview", now))
            if job and job[2] == now:
                out.append((key, *job[0], "full", now))
                job = None
            for _, generation, kind, payload in (e for e in mine if e[0] == now):
                schedule = False
                if kind in ("begin", "cancel", "load"):
                    timer = job = None
                if kind in ("begin", "end"):
                    gate_closed = kind == "begin"
                    if kind == "end":
                        schedule, deferred = deferred, False
                elif kind != "cancel":
                    values = (generation, payload)
                    deferred |= kind == "load" and gate_closed
                    schedule = not gate_closed
                if schedule:
                    timer, job = now + gap, None
                    if gap == 0:
                        job, timer = [values, now + preview, now + preview + full], None
    return sorted(out)


def story(seed, sessions=4, events=25):
    rng = random.Random(seed)
    kinds = ["change"] * 6 + ["cancel", "begin", "end", "end", "load", "slide"]
    rows, generation = [], 0
    for key in range(sessions):
        second = 0
        for _ in range(events):
            second += rng.choice([0, 1, 1, 2, 3, 5, 9, 12])
            generation += 1
            rows.append((at(second), key, rng.choice(kinds), generation, float(generation)))
    return rows


def frames(df):
    return sorted(tuple(r) for r in df.select("key", "generation", "payload", "pass", "shown_ms").collect())


STORIES = {
    "two inside the gap": ([(0, "change"), (2, "change")], [(1, "preview", 7), (1, "full", 11)]),
    "further apart than the gap": ([(0, "change"), (20, "change")], [(0, "preview", 5), (0, "full", 9), (1, "preview", 25), (1, "full", 29)]),
    "a newer one ends the running one": ([(0, "change"), (6, "change")], [(0, "preview", 5), (1, "preview", 11), (1, "full", 15)]),
    "cancel in the gap, then again": ([(0, "change"), (1, "cancel"), (2, "change")], [(2, "preview", 7), (2, "full", 11)]),
    "cancel between preview and full": ([(0, "change"), (7, "cancel")], [(0, "preview", 5)]),
    "a closed gate": ([(0, "begin"), (1, "change"), (2, "end")], []),
    "a load waits for the gate": ([(0, "begin"), (1, "load"), (4, "change"), (9, "end")], [(2, "preview", 14), (2, "full", 18)]),
    "the gate ends what runs": ([(0, "change"), (6, "begin"), (30, "end")], [(0, "preview", 5)]),
    "a frame comes before an event of its time": ([(0, "change"), (5, "change")], [(0, "preview", 5), (1, "preview", 10), (1, "full", 14)]),
}


@pytest.mark.parametrize("name", STORIES)
def test_stories(spark, name):
    events, want = STORIES[name]
    rows = [(at(s), 7, kind, i, i / 2) for i, (s, kind) in enumerate(events)]
    expected = sorted((7, g, g / 2, p, ZERO + 1000 * s) for g, p, s in want)
    assert replay(rows) == expected
    assert frames(scheduler.schedule(spark.createDataFrame(rows, DDL), gap=GAP, preview=PREVIEW, full=FULL)) == expected


def test_table_and_machine_against_a_replay(spark):
    for seed in range(6):
        rows = story(seed, sessions=8, events=60)
        want = replay(rows)
        assert want == frames(scheduler.schedule(spark.createDataFrame(rows, DDL).repartition(3), gap=GAP, preview=PREVIEW, full=FULL))
        got = []
        for key in {r[1] for r in rows}:
            session = scheduler.Session(GAP, PREVIEW, FULL)
            for ts, _, kind, generation, payload in sorted((r for r in rows if r[1] == key), key=lambda r: (r[0], r[3])):
                got += [(key, *f) for f in session.feed(int(ts.timestamp() * 1000), kind, generation, payload)]
                session = scheduler.Session(GAP, PREVIEW, FULL).restore(session.state())
            got += [(key, *f) for f in session.until(1 << 60)]
        assert sorted(got) == want


def streamed(spark, folder, batches, run, mode):
    """Rows that ``run`` puts out when each list of rows comes as a batch of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", scheduler.ROCKSDB)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*").withWatermark("ts", "5 seconds")
    name = "out" + folder.rsplit("/", 1)[-1].replace("-", "_")
    q = run(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination(240)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name)


LAST = [(at(10**7), None, "change", 0, 0.0)]


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_stream_for_every_cut(spark, tmp_path, cuts):
    rows = story(11)
    ordered = sorted(rows, key=lambda r: (r[0], r[3]))
    size = -(-len(ordered) // cuts)
    batches = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    for b in batches:
        random.Random(cuts).shuffle(b)
    got = streamed(spark, f"{tmp_path}/cut{cuts}", [*batches, LAST], lambda s: scheduler.scheduled(s, gap=GAP, preview=PREVIEW, full=FULL), "append")
    assert frames(got.filter("key is not null")) == replay(rows)


def test_latest_values_in_a_stream(spark, tmp_path):
    rows = story(5)
    batches = [rows[i::4] for i in range(4)]
    seen = streamed(spark, f"{tmp_path}/latest", batches, scheduler.latest_stream, "update").collect()
    last = {}
    for r in seen:
        assert (r.key, r.kind) not in last or last[r.key, r.kind][0] < r.generation
        last[r.key, r.kind] = (r.generation, r.payload)
    want = {(r.key, r.kind): (r.generation, r.payload) for r in requests.latest_values(spark.createDataFrame(rows, DDL)).collect()}
    assert last == want


def test_null_fields_and_empty_tables(spark):
    rows = [(None, 1, "change", 1, 1.0), (at(0), 1, None, None, None), (at(30), None, "change", 2, float("nan"))]
    got = scheduler.schedule(spark.createDataFrame(rows, DDL), gap=GAP, preview=PREVIEW, full=FULL).collect()
    assert sorted((r.key or 0, r.generation, r.payload, r["pass"]) for r in got) == [(0, 2, None, "full"), (0, 2, None, "preview"), (1, 0, None, "full"), (1, 0, None, "preview")]
    assert scheduler.schedule(spark.createDataFrame([], DDL), gap=GAP, preview=PREVIEW, full=FULL).count() == 0


def test_a_drained_table_equals_the_windows(spark, tmp_path):
    rows = story(3)
    df = spark.createDataFrame(rows, DDL)
    got = scheduler.drained(df, lambda s: scheduler.scheduled(s, gap=GAP, preview=PREVIEW, full=FULL), scheduler.FRAMES_DDL, f"{tmp_path}/drained")
    assert frames(got) == replay(rows)
