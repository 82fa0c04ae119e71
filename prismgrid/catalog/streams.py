"""Streaming queries: the live look, the last-N buffer and the state machines over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismgrid.catalog import sql
from prismgrid.catalog.windows import ORACLE_SQL as WINDOWS
from prismgrid.sources import raster, shared
from prismgrid.streaming import live

QUERIES, ORACLE_SQL = {}, {}


def folder(spark) -> str:
    """A fresh folder that all executors share."""
    return shared.fresh(spark, "stream")


def source(spark, sf_dir):
    """The events, written as four files with whole sessions and read one file a batch."""
    path = f"{folder(spark)}/in"
    events = raster.read(spark, sf_dir, "events")
    events.repartition(4, F.expr("event_id div 40")).sortWithinPartitions("event_id").write.parquet(path)
    return live.event_stream(spark, path)


def last_n(spark, sf_dir):
    return live.drain(live.last_frames(source(spark, sf_dir)), folder(spark), ["user_id"])


QUERIES["r04_ring_buffer_stream"] = last_n
ORACLE_SQL["r04_ring_buffer_stream"] = WINDOWS["w13_last_n"]

QUERIES["r06_focus_batch"] = lambda spark, sf_dir: live.focus_states(raster.read(spark, sf_dir, "events"))
_ROWS = """rows AS (SELECT event_id // 40 AS session, event_id AS seq, CASE event_type WHEN 'click' THEN 'tap' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'settled' ELSE 'succeeded' END AS kind,
 event_id // 10 - CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS request_id FROM events)"""
ORACLE_SQL["r06_focus_batch"] = f"""WITH {_ROWS}, tap AS (SELECT session, max(seq) AS tap, arg_max(request_id, seq) AS request FROM rows WHERE kind = 'tap' GROUP BY session),
nxt AS (SELECT r.* FROM rows r JOIN tap t ON t.session = r.session AND r.seq > t.tap AND r.request_id = t.request),
rep AS (SELECT session, min(seq) AS at_, arg_min(kind, seq) AS how FROM nxt WHERE kind IN ('succeeded', 'failed') GROUP BY session),
fin AS (SELECT DISTINCT n.session FROM nxt n JOIN rep p ON p.session = n.session WHERE n.kind = 'settled' AND n.seq > p.at_),
st AS (SELECT s.session, CASE WHEN t.tap IS NULL OR f.session IS NOT NULL THEN 'idle' WHEN p.how IS NULL THEN 'focusing' WHEN p.how = 'succeeded' THEN 'focused' ELSE 'failed' END AS state, t.request
 FROM (SELECT DISTINCT session FROM rows) s LEFT JOIN tap t ON t.session = s.session LEFT JOIN rep p ON p.session = s.session LEFT JOIN fin f ON f.session = s.session)
SELECT session, state, CASE WHEN state = 'idle' THEN -1 ELSE request END AS request_id FROM st"""
QUERIES["r06_focus_stream"] = lambda spark, sf_dir: live.drain(live.focus_stream(source(spark, sf_dir)), folder(spark), ["session"])
ORACLE_SQL["r06_focus_stream"] = ORACLE_SQL["r06_focus_batch"]

QUERIES["r07_compare_batch"] = lambda spark, sf_dir: live.compare_steps(raster.read(spark, sf_dir, "events"))
ORACLE_SQL["r07_compare_batch"] = """WITH rows AS (SELECT event_id // 40 AS session, event_id AS seq, CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'captured' WHEN 'signup' THEN 'picked' WHEN 'error' THEN 'cancelled' END AS kind FROM events),
res AS (SELECT session, max(seq) AS at_, arg_max(kind, seq) AS how FROM rows WHERE kind IN ('start', 'cancelled') GROUP BY session),
cap AS (SELECT r.session, min(r.seq) AS shot FROM rows r JOIN res b ON b.session = r.session AND b.how = 'start' AND r.seq > b.at_ WHERE r.kind = 'captured' GROUP BY r.session),
pick AS (SELECT DISTINCT r.session FROM rows r JOIN cap c ON c.session = r.session AND r.seq > c.shot WHERE r.kind = 'picked')
SELECT s.session, CASE WHEN b.session IS NULL OR k.session IS NOT NULL THEN 'idle' WHEN c.shot IS NULL THEN 'awaiting_capture' ELSE 'awaiting_reference' END AS step
FROM (SELECT DISTINCT session FROM rows) s LEFT JOIN (SELECT * FROM res WHERE how = 'start') b ON b.session = s.session LEFT JOIN cap c ON c.session = s.session LEFT JOIN pick k ON k.session = s.session"""
QUERIES["r07_compare_stream"] = lambda spark, sf_dir: live.drain(live.compare_stream(source(spark, sf_dir)), folder(spark), ["session"])
ORACLE_SQL["r07_compare_stream"] = ORACLE_SQL["r07_compare_batch"]


def live_look(spark, sf_dir):
    """The look over a stream of pixels: stateless."""
    path = f"{folder(spark)}/px"
    raster.event_pixels(spark, sf_dir).repartition(3).write.parquet(path)
    graded = live.graded(live.event_stream(spark, path))
    return live.drain(graded, folder(spark), [], "append").select("y", "x", "r", "g", "b")


QUERIES["r01_live_look_stream"] = live_look


def _look_sql() -> str:
    from prismgrid.functions import color as C

    unit = tuple(f"({c} / 255e0)" for c in "rgb")
    picked = ", ".join(f"{C.code(f'255e0 * {C.look(c, True, unit)}')} AS {c}" for c in "rgb")
    return f"SELECT y, x, {picked} FROM ({sql.EVENTS})"


ORACLE_SQL["r01_live_look_stream"] = _look_sql()


def admitted(spark, sf_dir):
    """Bursts as they arrive: at most two of a user wait at once, later ones of that minute are turned away."""
    events = raster.read(spark, sf_dir, "events").select("user_id", "event_id", F.date_trunc("minute", "ts").alias("minute"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id", "minute").orderBy("event_id"))
    return events.withColumn("place", place).groupBy((F.col("place") <= 2).alias("admitted")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["r05_queue"] = admitted
ORACLE_SQL["r05_queue"] = """SELECT place <= 2 AS admitted, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY event_id) AS place FROM events) GROUP BY 1"""


def bracketed(spark, sf_dir):
    """Bracketed bursts: of each exposure step only the frames before its first failure survive."""
    events = raster.read(spark, sf_dir, "events").select(
        F.expr("event_id div 12").alias("burst"), (F.expr("event_id div 4") % 3 * 2 - 2).cast("double").alias("ev"), "event_id", (F.col("event_type") == "error").alias("failed")
    )
    broke = F.min(F.when(F.col("failed"), F.col("event_id"))).alias("broke")
    cut = events.groupBy("burst", "ev").agg(broke)
    kept = events.join(cut, ["burst", "ev"]).filter("broke IS NULL OR event_id < broke")
    return kept.groupBy("burst", "ev").agg(F.count(F.lit(1)).alias("frames"))


QUERIES["r03_bracketed_burst"] = bracketed
ORACLE_SQL["r03_bracketed_burst"] = """WITH e AS (SELECT event_id // 12 AS burst, CAST(event_id // 4 % 3 * 2 - 2 AS DOUBLE) AS ev, event_id, event_type = 'error' AS failed FROM events),
c AS (SELECT burst, ev, min(event_id) FILTER (failed) AS broke FROM e GROUP BY burst, ev)
SELECT e.burst, e.ev, count(*) AS frames FROM e JOIN c ON c.burst = e.burst AND c.ev = e.ev WHERE broke IS NULL OR event_id < broke GROUP BY e.burst, e.ev"""
