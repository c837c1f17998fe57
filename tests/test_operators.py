"""Fixed vectors and odd inputs for operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.functions import text, timecode
from cuelake.operators import documents, edits, history, joins, ordering, sets, signal, trees
from cuelake.sources import files, subtitles
from cuelake.streaming import rules


def series(spark, n, base, changes, context="a"):
    return spark.createDataFrame([(context, k, float(changes.get(k, base))) for k in range(n)], "context string, frame long, p double")


@pytest.mark.parametrize(
    ("n", "base", "changes", "cuts"),
    [
        (120, 0.01, {60: 0.9}, [(60, 60, 60)]),
        (80, 0.9, {}, []),
        (120, 0.01, {60: 0.1}, []),
        (120, 0.01, {60: 0.13}, [(60, 60, 60)]),
        (120, 0.01, dict(zip(range(57, 64), (0.2, 0.35, 0.6, 0.9, 0.6, 0.35, 0.2), strict=True)), []),
        (100, 0.01, {40: 0.9, 41: 0.95, 42: 0.92}, [(41, 40, 42)]),
    ],
)
def test_detector(spark, n, base, changes, cuts):
    got = signal.detect(series(spark, n, base, changes)).collect()
    assert [(r["cut_frame"], r["event_start"], r["event_end"]) for r in got] == cuts


def test_plateau_has_its_peak_first(spark):
    rows = signal.robust_z(series(spark, 80, 0.01, {39: 0.9, 40: 0.9, 41: 0.9}))
    assert [r["frame"] for r in signal.local_peaks(rows).collect()] == [39]


def test_short_shots_and_suppression(spark):
    rows = spark.createDataFrame([("a", 20, 0.9), ("a", 21, 0.8), ("a", 40, 0.9)], "context string, frame long, score double")
    kept = {r["frame"]: r["confidence"] for r in signal.short_shots(rows, signal.Detector(false_positive=1.0, false_negative=1.0)).collect()}
    assert sorted(kept) == [20, 40] and kept[20] == 0.9 and 0.5 < kept[40] < 0.9
    near = spark.createDataFrame([("a", 10, 0.8, 0.9, 10.0), ("a", 11, 0.9, 0.8, 9.0), ("a", 20, 0.7, 0.7, 7.0)], "context string, frame long, score double, peak double, prominence double")
    assert sorted(r["frame"] for r in signal.suppress(near, 3).collect()) == [11, 20]


def test_shots(spark):
    cuts = spark.createDataFrame([("a", 40), ("a", 45), ("a", 99)], "context string, cut_frame long")
    frames = spark.createDataFrame([("a", 100)], "context string, n_frames long")
    got = signal.cuts_to_shots(cuts, frames, 25.0).orderBy("shot_no").collect()
    assert [(r["start_frame"], r["end_frame"]) for r in got] == [(0, 40), (41, 45), (46, 99)]
    assert got[-1]["end_us"] == 4_000_000


def test_bad_parameters_are_refused():
    with pytest.raises(ValueError):
        signal.Detector(softness=0).checked()


def test_seconds_to_us(spark):
    texts = ["1.25", "9223372036854.775807", "9223372036854.775808", "999999999999999999999999.0", "-9223372036854.775808", "-999999999999999999999999.0"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(timecode.seconds_to_us(F.col("t")).alias("us"))
    assert [r["us"] for r in rows.collect()] == [1250000, 2**63 - 1, 2**63 - 1, 2**63 - 1, -(2**63), -(2**63)]


def test_trees_with_cycles_and_missing_parents(spark):
    nodes = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "y"), ("y", "Y", "x"), ("o", "O", "gone"), ("s", "S", "s")], "id string, name string, parent string")
    paths = {r["id"]: r["path"] for r in trees.paths(nodes).collect()}
    assert paths["c"] == "C<B<A" and paths["x"] is None and paths["o"] is None
    fixed = {r["id"]: r["parent"] for r in trees.repair(nodes).collect()}
    assert fixed["b"] == "a" and fixed["o"] is None and fixed["s"] is None and fixed["x"] is None
    assert sorted(r["id"] for r in trees.cascade_delete(nodes, nodes.where("id = 'b'")).collect()) == ["a", "o", "s", "x", "y"]


def test_trees_deeper_than_64_levels(spark):
    nodes = spark.createDataFrame([(f"n{k}", str(k), f"n{k - 1}" if k else None) for k in range(100)], "id string, name string, parent string").coalesce(1)
    up = trees.ancestors(nodes).where("id = 'n99'").collect()
    assert sorted((r["depth"], r["ancestor"]) for r in up) == [(d, f"n{99 - d}") for d in range(100)]
    assert {r["id"]: r["parent"] for r in trees.repair(nodes).collect()} == {f"n{k}": f"n{k - 1}" if k else None for k in range(100)}


def test_interval_join_over_bands(spark):
    points = spark.createDataFrame([("a", 5), ("a", 5000), ("b", 5)], "k string, t long")
    spans = spark.createDataFrame([("a", 0, 9000, 1), ("a", 4, 6, 2), ("a", 9, 2, 3)], "k string, start long, end long, id long")
    got = joins.interval_join(points, spans, "k", "t", width=100).select("k", "t", "id").collect()
    assert sorted(map(tuple, got)) == [("a", 5, 1), ("a", 5, 2), ("a", 5000, 1)]


def test_srt_and_ass(spark):
    srt = "﻿WEBVTT\r\n\r\nNOTE x\r\n00:00:01.000 --> 00:00:02.000\r\nno\r\n\r\n1\r\n00:00:01,000 --> 00:00:02,5\r\n<i>Hi</i>\\Nthere\r\n\r\n01:02.000 --> 01:01.000\r\nbackwards\r\n"
    got = subtitles.parse_srt(spark.createDataFrame([("f", srt), ("n", None)], "path string, content string")).collect()
    assert [(r["sequence"], r["start_us"], r["end_us"], r["plain_text"]) for r in got] == [(0, 1_000_000, 2_500_000, "Hi\nthere")]
    ass = "[Events]\nFormat: Start, End, Name, Text\nDialogue: 0:00:01.00,0:00:02.00,Ann,Hello, you\nDialogue: short\n[Fonts]\nDialogue: 0:00:01.00,0:00:02.00,Ann,no\n"
    got = subtitles.parse_ass(spark.createDataFrame([("f", ass)], "path string, content string")).collect()
    assert [(r["speaker"], r["plain_text"], r["end_us"]) for r in got] == [("Ann", "Hello, you", 2_000_000)]


def test_legacy_encodings(spark):
    rows = spark.createDataFrame([("a", bytearray("中文".encode("gbk"))), ("b", bytearray("é".encode())), ("c", None)], "k string, raw binary")
    assert {r["k"]: r["t"] for r in rows.select("k", subtitles.decode_text(F.col("raw")).alias("t")).collect()} == {"a": "中文", "b": "é", "c": None}


def test_rules_hold_no_whole_key(spark):
    times = [("a", t) for t in (0, 5, 9, 10, 19, 20, 21, 50, 61, 61, 70, 71)] + [("b", 3), (None, 1), (None, 2), ("c", None)] + [("d", t) for t in range(25_000)]
    events = spark.createDataFrame(times, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for key in ("a", "b", None, "d"):
        windows = []
        for t in sorted(t for k, t in times if k == key):
            if windows and t < windows[-1][0] + 10:
                windows[-1][1] += 1
            else:
                windows.append([t, 0])
        want += [(key, n, t, more) for n, (t, more) in enumerate(windows)]
    limited = rules.rate_limited(events, "k", "ts", 10)
    got = limited.select("k", "window_no", F.unix_seconds("first_ts"), "suppressed").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert rules.rate_limited(events.where("k = 'a'"), "k", "ts", 0).count() == 12
    values = spark.createDataFrame([("a", n, v) for n, v in enumerate((1.0, 5.0, 11.0, 20.9, None, 21.0))] + [("b", 0, None), ("b", 1, 50.0), (None, 0, 2.0)], "k string, n long, v double")
    told = rules.throttled(values, "k", "n", "v", 10.0)
    assert sorted(map(tuple, told.select("k", "n").collect()), key=repr) == sorted([("a", 0), ("a", 2), ("a", 5), ("b", 0), (None, 0)], key=repr)
    for out in (limited, told):
        assert "collect_list" not in out._jdf.queryExecution().toString()


def test_rate_limit_as_a_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = rules.rate_limited_stream(stream, "event_type", "ts", 3600)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = rules.rate_limited(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", 3600)
    assert got == sorted(map(tuple, batch.select("event_type", F.col("first_ts").cast("timestamp_ntz")).collect()))


def test_trees_of_200_levels(spark):
    nodes = spark.createDataFrame([(f"n{k}", str(k), f"n{k - 1}" if k else None) for k in range(200)], "id string, name string, parent string").coalesce(1)
    assert trees.ancestors(nodes).where("id = 'n199'").count() == 200
    assert trees.cascade_delete(nodes, nodes.where("id = 'n3'")).count() == 3


def test_nearest_of_many_areas(spark):
    areas = spark.createDataFrame([(k, float(k % 50), float(k // 50)) for k in range(1500)], "area long, _x double, _y double")
    points = spark.createDataFrame([(n, n * 1.37 % 50, n * 0.61 % 30) for n in range(60)], "p long, x double, y double")
    got = {r["p"]: r["area"] for r in joins.nearest_point(points, areas, "area", "x", "y").collect()}
    for n in range(60):
        x, y = n * 1.37 % 50, n * 0.61 % 30
        assert got[n] == min(range(1500), key=lambda k: ((x - k % 50) ** 2 + (y - k // 50) ** 2, k))


def test_next_row_far_ahead_and_as_of_over_bands(spark):
    hours = 3_600_000
    rows = spark.createDataFrame([("a", 0, 0, 100), ("a", 1, 50, 60), ("a", 2, 2 * hours, 2 * hours + 5), ("b", 0, 7, 9)], "k string, id long, start long, end long")
    points = spark.createDataFrame([("a", 55), ("a", 70), ("a", 101), ("a", 3 * hours), ("b", 1), ("c", 1)], "k string, t long")
    got = {(r["k"], r["t"]): r["id"] for r in joins.next_active(points, rows, "k", "t", "id", behind=60, width=16).collect()}
    # the first row that starts within 60 before the point or later and has not ended
    assert got == {("a", 55): 0, ("a", 70): 2, ("a", 101): 2, ("a", 3 * hours): None, ("b", 1): 0, ("c", 1): None}
    for width in (None, 16, 10**9):
        back = {(r["k"], r["t"]): r["id"] for r in joins.asof_backward(points, rows, "k", "t", "start", "id", width).collect()}
        assert back == {("a", 55): 1, ("a", 70): 1, ("a", 101): 1, ("a", 3 * hours): 2, ("b", 1): None, ("c", 1): None}
        ahead = {(r["k"], r["t"]): r["id"] for r in joins.asof_forward(points, rows, "k", "t", "start", "id", width).collect()}
        assert ahead == {("a", 55): 2, ("a", 70): 2, ("a", 101): 2, ("a", 3 * hours): None, ("b", 1): None, ("c", 1): None}


def test_long_numbers_sort_by_value(spark):
    names = ["x" + "9" * 25, "x1" + "0" * 25, "x07", "X8", "é2", "e10", "É1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in rows.orderBy(text.natural_key(F.col("n"))).collect()]
    assert got == ["É1", "é2", "e10", "x07", "X8", "x" + "9" * 25, "x1" + "0" * 25]
    placed = {r["n"]: r["position"] for r in ordering.positions(rows.withColumn("key", text.natural_key(F.col("n"))), F.col("key")).collect()}
    assert [placed[n] for n in got] == list(range(len(got)))


def test_detector_over_block_edges(spark, monkeypatch):
    rows = series(spark, 400, 0.01, {k: 0.9 for k in range(37, 400, 61)})
    want = sorted(map(tuple, signal.robust_z(rows).select("frame", "z", "base").collect()))
    monkeypatch.setattr(signal, "BLOCK_WINDOWS", 1)
    assert sorted(map(tuple, signal.robust_z(rows).select("frame", "z", "base").collect())) == want


def test_windowed_medians_like_a_plain_search(spark, monkeypatch):
    import random
    import statistics

    rng = random.Random(4)
    rows = [(c, f, rng.choice([0.1, 0.2, rng.random(), None, float("nan"), 7.0]), "x") for c, n in (("a", 1), ("b", 2), ("c", 61), (None, 5)) for f in range(n)]
    data = spark.createDataFrame(rows, "context string, frame long, p double, base string").repartition(3)
    d = signal.Detector(window=3)
    for cells in (1 << 20, 8):  # one slab, a window a slab
        monkeypatch.setattr(signal, "SLAB_CELLS", cells)
        out = signal.robust_z(data, d)
        got = {(r["context"], r["frame"]): r for r in out.collect()}
        assert len(got) == len(rows) and out.columns.count("base") == 1
        for c in ("a", "b", "c", None):
            line = [got[c, f] for f in range(sum(r[0] == c for r in rows))]
            for k, r in enumerate(line):
                near = line[max(0, k - 3) : k + 4]
                middle = statistics.median(x["logit"] for x in near)
                away = statistics.median(abs(x["logit"] - middle) for x in near)
                assert r["base"] == pytest.approx(statistics.median(x["p"] for x in near))
                assert r["z"] == pytest.approx((r["logit"] - middle) / (1.4826 * away + d.eps))
    assert signal.robust_z(data.limit(0), d).count() == 0


def test_peaks_expand_like_a_plain_walk(spark, monkeypatch):
    import random

    rng = random.Random(6)
    d = signal.Detector()
    rows = [(c, f, rng.choice([0.0, 0.01, 0.05, 0.2, 0.9]) if c != "all" else 0.5, rng.choice([-1.0, 0.0, 1.5, 2.0]) if c == "some" else 0.0) for c, n in (("some", 300), ("none", 250), ("all", 700), ("one", 1)) for f in range(n)]
    data = spark.createDataFrame(rows, "context string, frame long, p double, z double").repartition(3)
    tops = [(c, f, p) for c, f, p, _ in rows if rng.random() < 0.15 and p > 0.01]
    want = []
    for c, f, top in tops:
        line = [r for r in rows if r[0] == c]
        ends = []
        for step in (-1, 1):
            at, last, misses = f + step, f, 0
            while 0 <= at < len(line) and misses < d.patience:
                hit = line[at][2] >= max(d.floor, d.relative * top) or line[at][3] >= d.expand_z
                last, misses = (at, 0) if hit else (last, misses + 1)
                at += step
            ends.append(last)
        want.append((c, f, *ends))
    peaks = spark.createDataFrame(tops, "context string, frame long, p double")
    for frames in (4096, 16):
        monkeypatch.setattr(signal, "ISLAND_FRAMES", frames)
        assert sorted(map(tuple, signal.expand_peaks(data, peaks, d).collect())) == sorted(want)
    assert signal.expand_peaks(data, peaks.limit(0), d).count() == 0 and signal.expand_peaks(data.limit(0), peaks, d).count() == 0


def test_model_file_of_a_detector():
    import json

    model = {
        "model_version": 1, "model_origin": "x", "epsilon": 1e-6, "robust_window_radius": 50, "candidate_probability_threshold": 0.1, "peak_radius": 2, "candidate_robust_threshold": 2.5, "event_probability_floor": 0.03, "event_relative_floor": 0.15,
        "event_robust_floor": 1.5, "event_boundary_patience": 2, "neighbor_radius": 2, "classifier": {"feature_order": documents.FEATURE_ORDER, "intercept": -2.5, "coefficients": [0.55, 0.0, -0.3, -0.6, 2.2, 0.75, 0.75, -0.4, 1.1, -0.12]},
        "calibration": None, "false_positive_cost": 1.0, "false_negative_cost": 2.0, "minimum_event_distance": 3, "short_shot_midpoint": 2.0, "short_shot_softness": 2.0,
    }
    assert signal.Detector.from_model(json.dumps(model)) == signal.Detector()
    with pytest.raises(ValueError):
        signal.Detector.from_model(json.dumps(model | {"more": 1}))


def test_upgrades_refuse_gaps_and_newer_versions(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "a"), (4, 4, "a"), (5, 5, "a"), (6, None, "a")], "id long, version int, x string")
    got = {r["id"]: (r["version"], r["x"], r["error"], r["migrated"]) for r in documents.upgraded(rows, {1: {}, 3: {"x": F.lit("new")}}, 4).collect()}
    assert got[3] == (4, "new", None, True) and got[4] == (4, "a", None, False)
    assert got[1][2] == got[2][2] == got[6][2] == documents.NO_CHAIN and got[5][2] == documents.UNSUPPORTED


def test_snapshots_keep_the_newest(spark):
    saves = [("d", 0, "p", "one"), ("d", 1, "p", "one"), ("d", 2, "p", "two"), ("d", 3, "p", "three"), ("d", 4, "q", "other"), ("e", 0, "p", "one"), ("e", 1, "q", "x"), ("e", 2, "p", "one")]
    rows = spark.createDataFrame(saves, "d string, n long, p string, h string")
    got = sorted((r["d"], r["place"], r["p"], r["h"]) for r in rules.snapshots(rows, "d", "n", "p", "h", 2).collect())
    assert got == [("d", 0, "q", "other"), ("d", 1, "p", "three"), ("e", 0, "q", "x"), ("e", 1, "p", "one")]


def test_progress_stalls_and_ends(spark):
    lines = [("a", 0, 0, "out_time_us=0"), ("a", 1, 1, "out_time_us=5000"), ("a", 2, 2, "out_time_us=500000"), ("a", 3, 3, "out_time=N/A"), ("a", 4, 4, "progress=end"), ("a", 5, 5, "out_time_us=900000"), ("b", 0, 0, "out_time_us=10"), ("b", 1, 30, "fps=1"), ("b", 2, 31, "progress=end")]
    rows = spark.createDataFrame(lines, "job string, n long, s long, line string").withColumn("ts", F.timestamp_seconds("s")).withColumn("d", F.lit(1_000_000).cast("long"))
    got = sorted((r["job"], r["n"], r["kind"], r["progress"]) for r in rules.progress(rows, "job", "n", "ts", "line", "d", 0.01).collect())
    assert got == [("a", 0, "progress", 0.0), ("a", 2, "progress", 0.5), ("a", 4, "end", 0.5), ("b", 0, "progress", 1e-05), ("b", 1, "stalled", 1e-05)]


def test_windows_of_a_stream_drop_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp"
    for n, rows in enumerate([[("a", 10), ("a", 50), ("b", 130)], [("a", 700), ("a", 20)], [("a", 40), ("a", 2000)]]):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    target = tmp_path / "watched"
    target.mkdir()
    query = rules.windowed_counts(spark.readStream.schema(schema).parquet(str(target)), "k", "ts", "60 seconds", "100 seconds").writeStream.format("memory").queryName("late_rows").outputMode("append").start()
    try:
        for n in range(3):
            for part in (tmp_path / f"in{n}").glob("*.parquet"):
                part.rename(target / f"{n}.parquet")
            query.processAllAvailable()
        got = sorted((r["k"], int(r["start"].timestamp()) % 100_000, r["n"]) for r in spark.table("late_rows").select("k", "start", "n").collect())
    finally:
        query.stop()
    # 20 comes in time for no one: the watermark stood at 30 then and passed the window's end at 600 before 40
    assert [(k, n) for k, _, n in got if k == "b"] == [("b", 1)]
    assert sum(n for k, _, n in got if k == "a") == 4


def test_fingerprints_and_names(spark):
    import hashlib

    body = bytes(range(256)) * 10_000
    rows = spark.createDataFrame([("f", bytearray(body), len(body), 1_700_000_000), ("s", bytearray(b"ab"), 2, 5)], "path string, content binary, length long, s long").withColumn("modificationTime", F.timestamp_seconds("s"))
    got = {r["path"]: r["fingerprint"] for r in files.fingerprint(rows).collect()}
    head = lambda n, t: n.to_bytes(8, "little") + t.to_bytes(8, "little")
    assert got["f"] == hashlib.sha256(head(len(body), 1_700_000_000) + body[: 1 << 20] + body[-(1 << 20) :]).hexdigest()
    assert got["s"] == hashlib.sha256(head(2, 5) + b"ab").hexdigest()
    taken = spark.createDataFrame([("a-1.mp4",), ("a-2.mp4",), ("b-1",), ("a-1",)] + [(f"full-{n}.x",) for n in range(1, 1001)], "name string")
    asked = spark.createDataFrame([("a.mp4",), ("a",), ("b",), ("full.x",), (".hidden",)], "name string")
    free = {r["name"]: r["free"] for r in edits.next_free_names(asked, taken).collect()}
    assert free == {"a.mp4": "a-3.mp4", "a": "a-2", "b": "b-2", "full.x": None, ".hidden": "hidden-1"}


def test_scan_tells_of_files_without_cues(spark):
    rows = [("a.srt", bytearray(b"00:00:01,000 --> 00:00:02,000\nHi\n")), ("b.ass", bytearray(b"[Events]\n")), ("c.srt", None), ("d.vtt", bytearray(b""))]
    cues, tracks = subtitles.scan(spark.createDataFrame(rows, "path string, content binary"))
    assert [(r["path"], r["plain_text"]) for r in cues.collect()] == [("a.srt", "Hi")]
    assert {r["path"]: (r["n_cues"], r["notice"]) for r in tracks.collect()} == {"a.srt": (1, None), "b.ass": (0, "no cues"), "c.srt": (0, "unreadable"), "d.vtt": (0, "no cues")}


def test_groups_at_the_tip_and_rows_on_one_side(spark):
    log = spark.createDataFrame([("p", 1, None), ("p", 2, "g"), ("p", 3, "g"), ("p", 4, None), ("p", 5, None), ("p", 6, "g"), ("q", 1, "g")], "project string, n long, grp string")
    got = sorted((r["project"], r["first"], r["last"], r["n"]) for r in history.grouped_tip(log, "project", "n", "grp").collect())
    assert got == [("p", 1, 1, 1), ("p", 2, 3, 2), ("p", 4, 4, 1), ("p", 5, 5, 1), ("p", 6, 6, 1), ("q", 1, 1, 1)]
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k long, v string"), spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert sorted(map(tuple, sets.symmetric_difference_rows(a, b).collect())) == [(2, None), (3, "y")]


def test_ranks_over_ranges(spark):
    rows = spark.createDataFrame([(n, float(n % 7)) for n in range(100)], "id long, v double")
    got = {r["id"]: r["rank"] for r in ordering.competition_rank(rows, "v", "rank").collect()}
    assert all(got[n] == 1 + sum(m % 7 < n % 7 for m in range(100)) for n in range(100))
    assert ordering.positions(rows.limit(0), F.col("v"), F.col("id")).count() == 0


def test_keywords_and_stacks_of_odd_rows(spark):
    held = spark.createDataFrame([("a", ["k2", "k1", " "]), ("b", None), ("c", ["k1"])], "item string, keywords array<string>")
    chosen = spark.createDataFrame([("a", ["k1"]), ("a", ["k1"]), ("d", ["k9"]), ("c", ["k1"])], "item string, given array<string>")
    got = {r["item"]: (r["keywords"], r["changed"]) for r in edits.assign_keywords(held, chosen, "off").collect()}
    assert got == {"a": (["k2"], True), "b": ([], False), "c": ([], True)}
    got = {r["item"]: (r["keywords"], r["changed"]) for r in edits.assign_keywords(held, chosen, "append").collect()}
    assert got["a"] == (["k2", "k1", " "], False) and got["c"] == (["k1"], False) and got["d"] == (["k9"], True)
    stacks = spark.createDataFrame([("w", "i1", n, f"i{n}") for n in (1, 2, 3, 4)], "board string, stack string, ord long, item string")
    one = lambda item: spark.createDataFrame([("w", item)], "board string, item string")
    told = lambda rows: sorted((r["stack"], r["item"]) for r in rows.collect())
    assert told(edits.split_stacks(stacks, one("i3"))) == [("i1", "i1"), ("i1", "i2"), ("i3", "i3"), ("i3", "i4")]
    assert told(edits.split_stacks(stacks, one("i2"), drop=True)) == [("i3", "i3"), ("i3", "i4")]
    assert told(edits.split_stacks(stacks, one("i1"))) == told(stacks)
    assert edits.cancel_stacks(stacks, one("i2")).count() == 0 and edits.cancel_stacks(stacks, one("zz")).count() == 4


def test_calibrated_model(spark):
    rows = spark.createDataFrame([(float(z), *([0.0] * 9)) for z in range(-6, 7)], ", ".join(f"{n} double" for n in signal.FEATURES))
    plain = {r["logit"]: r["score"] for r in signal.score_events(rows, signal.Detector(false_positive=0.0)).collect()}
    held = {r["logit"]: r["score"] for r in signal.score_events(rows, signal.Detector(false_positive=0.0, calibration=(1.3, 0.8, 0.1))).collect()}
    for z, p in plain.items():
        p = min(max(p, 1e-6), 1 - 1e-6)
        assert held[z] == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(p + 1e-6) - 0.8 * math.log(1 - p + 1e-6) - 0.1))))
    with pytest.raises(ValueError, match="calibration"):
        signal.Detector(calibration=(1.0, math.nan, 0.0)).checked()


def test_model_files_with_a_calibration():
    model = {
        "model_version": 1, "model_origin": "x", "epsilon": 1e-6, "robust_window_radius": 50, "candidate_probability_threshold": 0.1, "peak_radius": 2, "candidate_robust_threshold": 2.5, "event_probability_floor": 0.03,
        "event_relative_floor": 0.15, "event_robust_floor": 1.5, "event_boundary_patience": 2, "neighbor_radius": 2, "classifier": {"feature_order": documents.FEATURE_ORDER, "intercept": -2.5, "coefficients": [0.5] * 10},
        "calibration": {"a": 1, "b": 2.5, "c": -0.5}, "false_positive_cost": 1.0, "false_negative_cost": 2.0, "minimum_event_distance": 3, "short_shot_midpoint": 2.0, "short_shot_softness": 2.0,
    }
    assert signal.Detector.from_model(json.dumps(model)).calibration == (1.0, 2.5, -0.5)
    assert signal.Detector.from_model(json.dumps(model | {"calibration": None})).calibration is None
    with pytest.raises(ValueError, match="calibration"):
        signal.Detector.from_model(json.dumps(model | {"calibration": {"a": 1, "b": 2}}))


@pytest.mark.parametrize("n", [1, 24, 50, 51, 99, 100, 2000, 2001, 4300])
def test_windows_equal_one_pass(spark, n):
    """Windows of one pass over all frames, with the first and last repeated, against those made block by block."""
    data = [((k * 37) % 101 / 60 - 0.3, k) for k in range(n)]

    def model(windows):
        assert windows.shape[1:] == (100, 2)
        return windows[:, :, 0] + 0.001 * (windows[:, :1, 1] - windows[:, -1:, 1])

    padded, out = [data[0]] * 25 + data, []
    while len(out) < n:
        padded += [data[-1]] * max(0, 100 - len(padded))
        values = [np.float32(x[0]) + 0.001 * (padded[0][1] - padded[99][1]) for x in padded[:100]]
        odd = any(v < 0 or v > 1 for v in values)
        out += [1 / (1 + math.exp(-v)) if odd else v for v in values[25:75]]
        del padded[:50]
    rows = [("a", k, list(map(float, d))) for k, d in enumerate(data)] + [("b", 0, [0.5, 0.0]), ("b", None, [1.0, 1.0])]
    got = signal.infer_windows(spark.createDataFrame(rows, "context string, frame long, data array<double>").repartition(3), model).collect()
    assert [r["p"] for r in sorted((r for r in got if r["context"] == "a"), key=lambda r: r["frame"])] == pytest.approx(out[:n], abs=1e-6)
    assert [(r["frame"], r["p"]) for r in got if r["context"] == "b"] == [(0, pytest.approx(0.5))]


def test_windows_refuse_gaps(spark):
    rows = spark.createDataFrame([("a", 0, [0.0]), ("a", 2, [0.0])], "context string, frame long, data array<double>")
    with pytest.raises(Exception, match="gaps or repeats"):
        signal.infer_windows(rows, lambda w: w[:, :, 0]).collect()
    assert signal.infer_windows(rows.limit(0), lambda w: w[:, :, 0]).collect() == []


def test_copy_names_beyond_two_digits(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 8, 9, 98, 99, 998)], "n long").select(text.copy_suffix(F.lit("x"), F.col("n")))
    assert [r[0] for r in rows.collect()] == ["x copy01", "x copy09", "x copy10", "x copy99", "x copy100", "x copy999"]


@pytest.mark.parametrize("shape", ["random", "rise", "waves", "copies"])
def test_suppression_in_blocks(spark, monkeypatch, shape):
    """Blocks of few frames, so that what they leave open is dealt out again, against the plain greedy choice."""
    for name, value in (("SETTLE_CELLS", 8), ("SETTLE_GROWTH", 4)):
        monkeypatch.setattr(signal, name, value, raising=False)
    rng = random.Random(shape)
    value = {"random": lambda f: rng.random(), "rise": lambda f: f / 1000, "waves": lambda f: abs(f % 90 - 45) / 45, "copies": lambda f: (f // 20 * 7 % 11) / 11}[shape]
    rows = [(c, f, value(f), 0.0, 0.0) for c in ("a", None) for f in range(-50, 700) if rng.random() < 0.8] + [("a", None, 1.0, 0.0, 0.0), ("b", 5, None, 0.0, 0.0), ("b", 6, 9.0, 0.0, 0.0)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "context string, frame long, score double, peak double, prominence double")
    for distance in (1, 4):
        want = {"b": [5] if distance > 1 else [5, 6]}
        for c in ("a", None):
            kept = []
            for s, f in sorted((-r[2], r[1]) for r in rows if r[0] == c and r[1] is not None):
                if all(abs(f - x) >= distance for x in kept):
                    kept.append(f)
            want[c] = sorted(kept)
        got = {}
        for r in signal.suppress(events, distance).collect():
            got.setdefault(r["context"], []).append(r["frame"])
        assert {c: sorted(f) for c, f in got.items()} == want
    assert "collect_list" not in signal.suppress(events, 4)._jdf.queryExecution().toString()
