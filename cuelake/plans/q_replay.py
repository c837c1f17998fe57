"""Queries for positional edits and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.operators import replay
from cuelake.plans.catalog import query
from cuelake.session import table

# ---- lists edited by index -------------------------------------------------------------------

#: Fifty lists that start with ten items; each event sets or removes one item and sometimes sets another.
_EDITS = """ev AS (SELECT user_id % 50 AS doc, event_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k, event_id * 7 % 40 AS a, event_id * 13 % 30 AS ia, CASE WHEN event_type <> 'click' THEN 'v' || event_id END AS va, CASE WHEN event_id % 3 = 0 THEN (event_id * 7 + 1) % 40 END AS b, event_id * 5 % 30 AS ib, 'w' || event_id AS vb FROM events),
start AS (SELECT doc, list({'i': n, 'v': 'p' || n} ORDER BY n) AS s FROM (SELECT DISTINCT doc FROM ev), range(1, 11) t(n) GROUP BY doc)"""
_REPLAY = """w AS (SELECT doc, CAST(0 AS BIGINT) AS k, s FROM start
    UNION ALL SELECT doc, k, CASE WHEN i2 IS NULL THEN s2 ELSE s2[1:least(p2, len(s2))] || [{'i': i2, 'v': v2}] || s2[least(p2, len(s2)) + 1:] END FROM (
        SELECT doc, k, i2, p2, v2, CASE WHEN i1 IS NULL THEN s1 ELSE s1[1:least(p1, len(s1))] || [{'i': i1, 'v': v1}] || s1[least(p1, len(s1)) + 1:] END AS s2 FROM (
            SELECT w.doc, ev.k, list_filter(s, lambda x: x.i <> a AND (b IS NULL OR x.i <> b)) AS s1,
                   CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN CASE WHEN va IS NOT NULL THEN a END ELSE b END AS i1, CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN ia ELSE ib END AS p1, CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN va ELSE vb END AS v1,
                   CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN b ELSE CASE WHEN va IS NOT NULL THEN a END END AS i2, CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN ib ELSE ia END AS p2, CASE WHEN ia < ib OR (ia = ib AND a < b) OR b IS NULL THEN vb ELSE va END AS v2
            FROM w JOIN ev ON ev.doc = w.doc AND ev.k = w.k + 1))),
f AS (SELECT doc, arg_max(s, k) AS s FROM w GROUP BY doc)"""


def _lists(spark, sf):
    events = table(spark, sf, "events").select((F.col("user_id") % 50).alias("doc"), "event_id", "event_type")
    item = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long")))
    items = events.select("doc").distinct().select("doc", item.alias("item")).select("doc", "item", F.concat(F.lit("p"), F.col("item").cast("string")).alias("value"), F.col("item").alias("pos"))
    n = F.col("event_id")
    a = events.select("doc", "event_id", (n * 7 % 40).alias("item"), F.when(F.col("event_type") != "click", F.concat(F.lit("v"), n.cast("string"))).alias("value"), (n * 13 % 30).alias("at"))
    b = events.where("event_id % 3 = 0").select("doc", "event_id", ((n * 7 + 1) % 40).alias("item"), F.concat(F.lit("w"), n.cast("string")).alias("value"), (n * 5 % 30).alias("at"))
    return items, a.unionByName(b)


@query("hist_replay_positions", f"WITH RECURSIVE {_EDITS}, {_REPLAY} SELECT doc, i - 1 AS pos, s[i].i AS item, s[i].v AS value FROM f, range(1, 41) r(i) WHERE i <= len(s)")
def hist_replay_positions(spark, sf):
    items, log = _lists(spark, sf)
    return replay.replay_positions(items, log, "doc", "item", "value", "pos", "event_id", "at")


@query("hist_diff_positions", f"""WITH RECURSIVE {_EDITS}, {_REPLAY},
old AS (SELECT doc, i - 1 AS at, s[i].i AS item, s[i].v AS value FROM start, range(1, 41) r(i) WHERE i <= len(s)), new AS (SELECT doc, i - 1 AS at, s[i].i AS item, s[i].v AS value FROM f, range(1, 41) r(i) WHERE i <= len(s))
SELECT doc, item, CASE WHEN old.at IS NULL THEN 'insert' WHEN new.at IS NULL THEN 'delete' WHEN old.value = new.value THEN 'move' ELSE 'update' END AS kind, coalesce(old.at, new.at) AS old_index, coalesce(new.at, old.at) AS new_index, TRUE AS undone, TRUE AS redone
FROM old FULL JOIN new USING (doc, item) WHERE old.at IS DISTINCT FROM new.at OR old.value IS DISTINCT FROM new.value""")
def hist_diff_positions(spark, sf):
    """Differences with indices; undoing them gives the lists before again, doing them again those after."""
    items, log = _lists(spark, sf)
    names = ("doc", "item", "value", "pos")
    before = replay.replay_positions(items, log.limit(0), *names, "event_id", "at")
    after = replay.replay_positions(items, log, *names, "event_id", "at")
    changes = replay.positional_diff(before, after, *names)
    sides = {}
    for name, state, other, back in (("undone", after, before, True), ("redone", before, after, False)):
        got = replay.apply_positions(state, changes, *names, back=back)
        sides[name] = got.exceptAll(other.select(got.columns)).unionByName(other.select(got.columns).exceptAll(got)).select("doc").distinct().withColumn(name, F.lit(False))
    out = changes.join(sides["undone"], "doc", "left").join(sides["redone"], "doc", "left")
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "move").otherwise("update")
    return out.select("doc", "item", kind.alias("kind"), "old_index", "new_index", F.coalesce("undone", F.lit(True)).alias("undone"), F.coalesce("redone", F.lit(True)).alias("redone"))


# ---- histories -------------------------------------------------------------------------------


@query("hist_branches", """WITH RECURSIVE e AS (SELECT user_id % 20 AS doc, event_id AS id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k, CASE WHEN event_id % 29 = 0 THEN 'jump' WHEN event_id % 31 = 0 THEN 'save' ELSE 'append' END AS kind, CASE WHEN event_id % 4 > 0 THEN event_type END AS g, event_type || event_id % 5 AS label, event_id * 3 % 45 AS target FROM events),
h AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(f BIGINT, l BIGINT, label VARCHAR, g VARCHAR)[]) AS s, CAST(NULL AS VARCHAR) AS base, CAST(0 AS BIGINT) AS cursor, CAST(0 AS BIGINT) AS saved, FALSE AS active FROM e
    UNION ALL SELECT doc, k, CASE WHEN cut THEN s[2:] ELSE s END, CASE WHEN cut THEN s[1].label ELSE base END, CASE WHEN kind = 'append' THEN len(s) - CAST(cut AS BIGINT) WHEN kind = 'jump' AND active THEN least(target, len(s)) ELSE cursor END,
        CASE WHEN cut THEN CASE WHEN saved > 0 THEN saved - 1 ELSE -1 END WHEN kind = 'save' AND active THEN cursor ELSE saved END, active OR kind = 'append' FROM (
        SELECT *, kind = 'append' AND len(s) > 39 AS cut FROM (
            SELECT doc, k, kind, target, base, cursor, active, CASE WHEN kind = 'append' AND saved > cursor THEN -1 ELSE saved END AS saved,
                   CASE WHEN kind <> 'append' THEN s ELSE s[1:cursor - CAST(merges AS BIGINT)] || [{'f': CASE WHEN merges THEN s[cursor].f ELSE id END, 'l': id, 'label': label, 'g': g}] END AS s FROM (
                SELECT h.doc, e.k, kind, id, g, e.label, target, base, cursor, saved, active, s, coalesce(g IS NOT NULL AND cursor > 0 AND s[cursor].g = g AND cursor = len(s), FALSE) AS merges FROM h JOIN e ON e.doc = h.doc AND e.k = h.k + 1)))),
l AS (SELECT doc, arg_max({'s': s, 'base': base, 'cursor': cursor, 'saved': saved, 'active': active}, k) AS h FROM h GROUP BY doc)
SELECT doc, i AS place, h.s[i].f AS first, h.s[i].l AS last, CASE WHEN i = 0 THEN h.base ELSE h.s[i].label END AS label, h.s[i].g AS "group", i = h.cursor AS current, i > h.cursor AS future, i = h.saved AS saved FROM l, range(0, 40) r(i) WHERE i <= len(h.s) AND h.active""")
def hist_branches(spark, sf):
    n = F.col("event_id")
    kind = F.when(n % 29 == 0, "jump").when(n % 31 == 0, "save").otherwise("append")
    log = table(spark, sf, "events").select((F.col("user_id") % 20).alias("doc"), "event_id", n.alias("entry"), kind.alias("kind"), F.when(n % 4 > 0, F.col("event_type")).alias("g"), F.concat("event_type", (n % 5).cast("string")).alias("label"), (n * 3 % 45).alias("target"))
    return replay.edit_histories(log, "doc", "event_id", "kind", "entry", "g", "label", "target")
