"""Queries for event detection (group N of the survey, with A17, E10, F1-F3 and F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.operators import signal
from cuelake.plans.catalog import query
from cuelake.session import table


def series(spark: SparkSession, sf: str) -> DataFrame:
    """(context, frame, p, event_id): each kind of event is a recording, its value the probability."""
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    p = F.least(F.col("value") / 200, F.lit(1.0))
    return table(spark, sf, "events").select(F.col("event_type").alias("context"), (F.row_number().over(order) - 1).cast("long").alias("frame"), p.alias("p"), "event_id")


# the same steps for DuckDB, one CTE for each
_SERIES = """series AS (SELECT event_type AS context, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, greatest(least(value / 200, 1.0), 0.0) AS p, event_id FROM events)"""
_Z = """, l AS (SELECT *, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS logit FROM series),
w AS (SELECT *, list(logit) OVER n AS ls, median(logit) OVER n AS m, median(p) OVER n AS base FROM l WINDOW n AS (PARTITION BY context ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
rows_z AS (SELECT context, frame, p, event_id, logit, base, (logit - m) / (1.4826 * list_median(list_transform(ls, lambda x: abs(x - m))) + 1e-6) AS z FROM w)"""
_PEAKS = """, marked AS (SELECT *, max(p) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS most, max(p) OVER (o ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before FROM rows_z WINDOW o AS (PARTITION BY context ORDER BY frame)),
peaks AS (SELECT context, frame, p FROM marked WHERE p = most AND (before IS NULL OR before < p) AND p >= 0.1 AND z >= 2.5)"""
# a row is reached from a peak if all pairs of neighbours up to it hold one that qualifies
_EXPAND = """, q AS (SELECT k.context, k.frame AS peak, r.frame, (r.p >= greatest(0.03, 0.15 * k.p) OR r.z >= 1.5) AS ok FROM peaks k JOIN rows_z r USING (context)),
stops AS (SELECT a.context, a.peak, min(a.frame) FILTER (a.frame > a.peak) AS hi, max(b.frame) FILTER (b.frame < b.peak) AS lo FROM q a JOIN q b ON a.context = b.context AND a.peak = b.peak AND b.frame = a.frame + 1
    WHERE NOT a.ok AND NOT b.ok GROUP BY ALL),
expanded AS (SELECT q.context, q.peak AS frame, least(min(q.frame) FILTER (q.ok AND q.frame > coalesce(lo, -1)), q.peak) AS start, greatest(max(q.frame) FILTER (q.ok AND q.frame < coalesce(hi, 1e18)), q.peak) AS "end"
    FROM q LEFT JOIN stops s ON q.context = s.context AND q.peak = s.peak GROUP BY q.context, q.peak)"""
_MERGE = """, i AS (SELECT *, max("end") OVER (PARTITION BY context ORDER BY start, "end", frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM expanded),
j AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY context ORDER BY start, "end", frame ROWS UNBOUNDED PRECEDING) - 1 AS interval_no FROM i),
merged AS (SELECT context, CAST(interval_no AS BIGINT) AS interval_no, min(start) AS start, max("end") AS "end" FROM j GROUP BY ALL)"""
_FEATURES = """, mass AS (SELECT *, sum(p) OVER (PARTITION BY context ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mass FROM rows_z),
tops AS (SELECT m.context, m.start AS event_start, m."end" AS event_end, arg_min(r.frame, r.frame) FILTER (r.p = top) AS frame, max(top) AS peak, max(r.z) AS z, sum(r.p) AS area, arg_min(r.p, r.frame) AS p0, arg_max(r.p, r.frame) AS p1
    FROM (SELECT m.*, (SELECT max(p) FROM rows_z r WHERE r.context = m.context AND r.frame BETWEEN m.start AND m."end") AS top FROM merged m) m JOIN rows_z r ON r.context = m.context AND r.frame BETWEEN m.start AND m."end" GROUP BY ALL),
features AS (SELECT t.context, event_start, event_end, t.frame, peak, r.logit, t.z, ln(area + 1e-6) AS log_area, ln(event_end - event_start + 1) AS log_width, peak / (area + 1e-6) AS concentration,
    (peak - p0) / greatest(t.frame - event_start, 1) AS left_slope, (peak - p1) / greatest(event_end - t.frame, 1) AS right_slope, peak - r.base AS prominence, r.mass AS neighbour_mass FROM tops t JOIN mass r ON r.context = t.context AND r.frame = t.frame)"""
_SCORE = """, scored AS (SELECT *, 1 / (1 + exp(-(-2.5 + 0.55 * logit - 0.3 * log_area - 0.6 * log_width + 2.2 * concentration + 0.75 * left_slope + 0.75 * right_slope - 0.4 * abs(left_slope - right_slope) + 1.1 * prominence - 0.12 * neighbour_mass))) AS score FROM features),
passed AS (SELECT * FROM scored WHERE score > 1 / 3.0)"""
_NMS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, peak DESC, prominence DESC, frame) AS k FROM passed),
greedy AS (SELECT context, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM ranked GROUP BY context
    UNION ALL SELECT g.context, r.k, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - r.frame) < 3)) > 0 THEN g.kept ELSE list_append(g.kept, r.frame) END FROM greedy g JOIN ranked r ON r.context = g.context AND r.k = g.k + 1),
kept AS (SELECT context, unnest(arg_max(kept, k)) AS frame FROM greedy GROUP BY context)"""
_SHORT = """, ordered AS (SELECT p.*, row_number() OVER (PARTITION BY p.context ORDER BY p.frame) AS n FROM passed p JOIN kept USING (context, frame)),
walk AS (SELECT context, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS confidence FROM ordered GROUP BY context
    UNION ALL SELECT w.context, o.n, CASE WHEN o.score * coalesce(1 / (1 + exp(-(o.frame - w.last - 2.0) / 2.0)), 1) > 1 / 3.0 THEN o.frame ELSE w.last END, o.frame, o.score * coalesce(1 / (1 + exp(-(o.frame - w.last - 2.0) / 2.0)), 1)
    FROM walk w JOIN ordered o ON o.context = w.context AND o.n = w.n + 1),
final AS (SELECT o.context, o.frame, w.confidence, o.event_start, o.event_end, o.score FROM walk w JOIN ordered o USING (context, n) WHERE w.confidence > 1 / 3.0)"""
_TO_PEAKS = "WITH RECURSIVE " + _SERIES + _Z + _PEAKS
_TO_EVENTS = _TO_PEAKS + _EXPAND + _MERGE + _FEATURES
_ALL = _TO_EVENTS + _SCORE + _NMS + _SHORT


@query("sig_logit", "WITH " + _SERIES + """ SELECT event_id, p, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit FROM series""")
def sig_logit(spark, sf):
    from cuelake.functions.mathx import logit

    p = signal.clean_probability(F.col("p"))
    return series(spark, sf).select("event_id", p.alias("p"), F.round(logit(p), 6).alias("logit"))


@query("win_robust_z", "WITH " + _SERIES + _Z + " SELECT event_id, round(z, 5) AS z FROM rows_z")
def win_robust_z(spark, sf):
    return signal.robust_z(series(spark, sf)).select("event_id", F.round("z", 5).alias("z"))


@query("win_local_peaks", _TO_PEAKS + " SELECT context AS event_type, frame, p FROM peaks")
def win_local_peaks(spark, sf):
    return signal.local_peaks(signal.robust_z(series(spark, sf))).select(F.col("context").alias("event_type"), "frame", "p")


@query("win_neighbor_sum", "WITH " + _SERIES + " SELECT event_id, round(sum(p) OVER (PARTITION BY context ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mass FROM series")
def win_neighbor_sum(spark, sf):
    near = Window.partitionBy("context").orderBy("frame").rowsBetween(-2, 2)
    return series(spark, sf).select("event_id", F.round(F.sum("p").over(near), 6).alias("mass"))


@query("sig_expand", _TO_PEAKS + _EXPAND + ' SELECT context AS event_type, frame, start AS start_frame, "end" AS end_frame FROM expanded')
def sig_expand(spark, sf):
    rows = signal.robust_z(series(spark, sf))
    out = signal.expand_peaks(rows, signal.local_peaks(rows))
    return out.select(F.col("context").alias("event_type"), "frame", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


@query("sig_merge_intervals", _TO_PEAKS + """, i AS (SELECT context, frame - 3 AS start, frame + 3 AS "end", max(frame + 3) OVER (PARTITION BY context ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM peaks),
j AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY context ORDER BY start ROWS UNBOUNDED PRECEDING) - 1 AS k FROM i)
SELECT context AS event_type, CAST(k AS BIGINT) AS interval_no, min(start) AS start_frame, max("end") AS end_frame FROM j GROUP BY ALL""")
def sig_merge_intervals(spark, sf):
    peaks = signal.local_peaks(signal.robust_z(series(spark, sf))).select("context", (F.col("frame") - 3).alias("start"), (F.col("frame") + 3).alias("end"))
    out = signal.merge_intervals(peaks)
    return out.select(F.col("context").alias("event_type"), "interval_no", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


@query("sig_features", _TO_EVENTS + """ SELECT context AS event_type, event_start, event_end, frame, round(logit, 3) AS logit, round(z, 3) AS z, round(log_area, 3) AS log_area, round(log_width, 3) AS log_width, round(concentration, 3) AS concentration,
    round(left_slope, 3) AS left_slope, round(right_slope, 3) AS right_slope, round(abs(left_slope - right_slope), 3) AS asymmetry, round(prominence, 3) AS prominence, round(neighbour_mass, 3) AS neighbour_mass FROM features""")
def sig_features(spark, sf):
    rows = signal.robust_z(series(spark, sf))
    events = signal.event_features(rows, signal.merge_intervals(signal.expand_peaks(rows, signal.local_peaks(rows))))
    return events.select(F.col("context").alias("event_type"), "event_start", "event_end", "frame", *[F.round(n, 3).alias(n) for n in signal.FEATURES])


@query("sig_score", _TO_EVENTS + _SCORE + " SELECT context AS event_type, frame, round(score, 6) AS score FROM passed")
def sig_score(spark, sf):
    rows = signal.robust_z(series(spark, sf))
    events = signal.event_features(rows, signal.merge_intervals(signal.expand_peaks(rows, signal.local_peaks(rows))))
    return signal.score_events(events).select(F.col("context").alias("event_type"), "frame", F.round("score", 6).alias("score"))


@query("sig_score_calibrated", _TO_EVENTS + _SCORE.replace("passed AS (SELECT * FROM scored WHERE score > 1 / 3.0)", "passed AS (SELECT context, frame, 1 / (1 + exp(-(1.3 * ln(least(greatest(score, 1e-6), 1 - 1e-6) + 1e-6) - 0.8 * ln(1 - least(greatest(score, 1e-6), 1 - 1e-6) + 1e-6) - 0.1))) AS score FROM scored)") + " SELECT context AS event_type, frame, round(score, 6) AS score FROM passed WHERE score > 1 / 3.0")
def sig_score_calibrated(spark, sf):
    rows = signal.robust_z(series(spark, sf))
    events = signal.event_features(rows, signal.merge_intervals(signal.expand_peaks(rows, signal.local_peaks(rows))))
    out = signal.score_events(events, signal.Detector(calibration=(1.3, 0.8, 0.1)))
    return out.select(F.col("context").alias("event_type"), "frame", F.round("score", 6).alias("score"))


@query("sig_nms", """WITH RECURSIVE ranked AS (SELECT event_type AS context, frame, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM
    (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame FROM events) WHERE value >= 20),
greedy AS (SELECT context, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM ranked GROUP BY context
    UNION ALL SELECT g.context, r.k, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - r.frame) < 10)) > 0 THEN g.kept ELSE list_append(g.kept, r.frame) END FROM greedy g JOIN ranked r ON r.context = g.context AND r.k = g.k + 1),
kept AS (SELECT context, unnest(arg_max(kept, k)) AS frame FROM greedy GROUP BY context)
SELECT context AS event_type, count(*) AS n_kept, CAST(sum(frame) AS BIGINT) AS frame_sum FROM kept GROUP BY context""")
def sig_nms(spark, sf):
    rows = series(spark, sf).join(table(spark, sf, "events").select("event_id", "value"), "event_id").where("value >= 20")
    rows = rows.withColumn("peak", -F.col("event_id")).withColumn("prominence", F.lit(0.0))
    kept = signal.suppress(rows, 10, score="value")
    return kept.groupBy(F.col("context").alias("event_type")).agg(F.count("*").alias("n_kept"), F.sum("frame").alias("frame_sum"))


@query("sig_short_shot", _ALL + " SELECT context AS event_type, frame, round(confidence, 6) AS confidence FROM final")
def sig_short_shot(spark, sf):
    out = signal.detect(series(spark, sf))
    return out.select(F.col("context").alias("event_type"), F.col("cut_frame").alias("frame"), F.round("confidence", 6).alias("confidence"))


@query("sig_detect", _ALL + " SELECT context AS event_type, frame AS cut_frame, round(confidence, 6) AS confidence, event_start, event_end FROM final")
def sig_detect(spark, sf):
    out = signal.detect(series(spark, sf))
    return out.select(F.col("context").alias("event_type"), "cut_frame", F.round("confidence", 6).alias("confidence"), "event_start", "event_end")


_SHOTS = """, n AS (SELECT context, count(*) AS n FROM series GROUP BY ALL),
ends AS (SELECT DISTINCT f.context, f.frame AS e FROM final f JOIN n USING (context) WHERE f.frame < n.n - 1 UNION SELECT context, n - 1 FROM n),
s AS (SELECT context, e, coalesce(lag(e) OVER (PARTITION BY context ORDER BY e) + 1, 0) AS b, row_number() OVER (PARTITION BY context ORDER BY e) AS k FROM ends)"""


@query("sig_shots", _ALL + _SHOTS + """ SELECT context AS event_type, k AS shot_no, b AS start_frame, e AS end_frame, CAST(floor(b / 25.0 * 1e6 + 0.5) AS BIGINT) AS start_us,
    CAST(floor((CASE WHEN e = n.n - 1 THEN e + 1 ELSE e END) / 25.0 * 1e6 + 0.5) AS BIGINT) AS end_us FROM s JOIN n USING (context)""")
def sig_shots(spark, sf):
    rows = series(spark, sf)
    out = signal.cuts_to_shots(signal.detect(rows), rows.groupBy("context").agg(F.count("*").alias("n_frames")), 25.0)
    return out.withColumnRenamed("context", "event_type")


@query("win_ranges_from_cuts", """WITH s AS (SELECT event_type AS context, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS frame, value FROM events), n AS (SELECT context, count(*) AS n FROM s GROUP BY ALL),
ends AS (SELECT context, frame AS e FROM s JOIN n USING (context) WHERE value >= 100 AND frame < n - 1 UNION SELECT context, n - 1 FROM n)
SELECT context AS event_type, coalesce(lag(e) OVER (PARTITION BY context ORDER BY e) + 1, 0) AS start_frame, e AS end_frame FROM ends""")
def win_ranges_from_cuts(spark, sf):
    rows = series(spark, sf)
    cuts = rows.where("p >= 0.5").select("context", F.col("frame").alias("cut_frame"))
    out = signal.cuts_to_shots(cuts, rows.groupBy("context").agg(F.count("*").alias("n_frames")), 25.0)
    return out.select(F.col("context").alias("event_type"), "start_frame", "end_frame")


@query("agg_event_features", """SELECT user_id, max(value) AS peak, CAST(arg_min(event_id, event_id) FILTER (value = top) AS BIGINT) AS top_event, round(sum(value), 4) AS area, count(*) AS width
FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) GROUP BY user_id""")
def agg_event_features(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.max("value").alias("peak"), F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("top_event"), F.round(F.sum("value"), 4).alias("area"), F.count("*").alias("width")
    )


@query("sig_window_stitch", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 3 = 0 THEN 0 ELSE CAST(x AS DOUBLE) END) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64)
SELECT vec_id % 10 AS context, CAST((vec_id // 10) * 32 + i AS BIGINT) AS frame, round(CASE WHEN list_min(e) < 0 OR list_max(e) > 1 THEN 1 / (1 + exp(-e[17 + i])) ELSE e[17 + i] END, 6) AS p FROM v, range(32) t(i)""")
def sig_window_stitch(spark, sf):
    """Every third window is all zeros, hence no log odds."""
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(x))
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select((F.col("vec_id") % 10).alias("context"), F.expr("vec_id div 10").alias("window_no"), values.alias("values"))
    return signal.stitch_windows(rows, stride=32, head=16).select("context", "frame", F.round("p", 6).alias("p"))


@query("sig_window_infer", f"""WITH {_SERIES}, n AS (SELECT context, max(frame) AS last FROM series GROUP BY 1),
w AS (SELECT context, last, j, unnest(range(100)) AS i FROM n, range(0, 1000000) r(j) WHERE j * 50 <= last),
x AS (SELECT w.context, w.last, j, i, 1.5 * CAST(CAST(s.p AS FLOAT) AS DOUBLE) - 0.2 * CAST(CAST(f.p AS FLOAT) AS DOUBLE) AS v FROM w JOIN series s ON s.context = w.context AND s.frame = least(greatest(j * 50 - 25 + i, 0), last) JOIN series f ON f.context = w.context AND f.frame = least(greatest(j * 50 - 25, 0), last)),
o AS (SELECT *, min(v) OVER g < 0 OR max(v) OVER g > 1 AS odd FROM x WINDOW g AS (PARTITION BY context, j))
SELECT context AS event_type, j * 50 + i - 25 AS frame, round(CASE WHEN odd THEN 1 / (1 + exp(-v)) ELSE v END, 5) AS p FROM o WHERE i BETWEEN 25 AND 74 AND j * 50 + i - 25 <= last""")
def sig_window_infer(spark, sf):
    """A stand-in for a network that looks at a frame and at the first one of its window."""

    def model(windows):
        return 1.5 * windows[:, :, 0].astype(float) - 0.2 * windows[:, :1, 0].astype(float)

    rows = series(spark, sf).select("context", "frame", F.array(F.greatest("p", F.lit(0.0))).alias("data"))
    return signal.infer_windows(rows, model).select(F.col("context").alias("event_type"), "frame", F.round("p", 5).alias("p"))
