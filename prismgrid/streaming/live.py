"""Frame-at-a-time work on streams, and the same as batch plans.

* :func:`graded` is stateless: the live look is a ``select`` on any pixel stream.
* :func:`last_frames` keeps the newest few rows of a key in keyed state, oldest evicted first.
* :func:`focus_states` and :func:`compare_steps` are small state machines; a report that belongs to
  an older request than the one under way is ignored.

Streaming and batch forms give the same rows for the same events (tests hold them together). State
per key is bounded: the kept rows, or one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prismgrid.functions import color

#: What an event type means to the state machines. Fixed values.
FOCUS = {"click": "tap", "purchase": "succeeded", "error": "failed", "view": "settled"}
COMPARE = {"click": "start", "purchase": "captured", "signup": "picked", "error": "cancelled"}


def graded(px: DataFrame) -> DataFrame:
    """The skin-safe look on pixel rows, batch or stream; alpha and other columns stay."""
    unit = tuple(f"({c} / 255e0)" for c in "rgb")
    new = px.withColumns({f"_{c}": F.expr(color.code(f"255e0 * {color.look(c, True, unit)}")) for c in "rgb"})
    return new.drop("r", "g", "b").withColumnsRenamed({f"_{c}": c for c in "rgb"})


def sessions(events: DataFrame) -> DataFrame:
    """``session, seq, kind, request_id``: forty events a session, ten a request."""
    kind = F.create_map(*[x for k, v in FOCUS.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    late = F.when(F.col("event_type") == "signup", 1).otherwise(0)  # a report of the request before
    return events.select(
        F.expr("event_id div 40").alias("session"),
        F.col("event_id").alias("seq"),
        F.coalesce(kind, F.lit("succeeded")).alias("kind"),
        (F.expr("event_id div 10") - late).alias("request_id"),
    )


def focus_step(state: tuple[str, int], kind: str, request: int) -> tuple[str, int]:
    """One event of the tap-to-focus machine."""
    name, current = state
    if kind == "tap":
        return "focusing", request
    if kind in ("succeeded", "failed") and name == "focusing" and request == current:
        return ("focused" if kind == "succeeded" else "failed"), current
    if kind == "settled" and name in ("focused", "failed") and request == current:
        return "idle", -1
    return state


def focus_states(events: DataFrame) -> DataFrame:
    """Batch form: ``session, state, request_id`` after all events.

    Only the last tap counts; then its first report, then its first settling.
    """
    rows = sessions(events)
    tap = rows.filter("kind = 'tap'").groupBy("session").agg(F.max("seq").alias("tap"), F.max_by("request_id", "seq").alias("request"))
    after = rows.join(tap, "session").filter("seq > tap AND request_id = request")
    report = after.filter("kind IN ('succeeded', 'failed')").groupBy("session").agg(F.min("seq").alias("at"), F.min_by("kind", "seq").alias("how"))
    settled = after.filter("kind = 'settled'").join(report, "session").filter("seq > at").select("session", F.lit(True).alias("settled")).distinct()
    done = rows.select("session").distinct().join(tap, "session", "left").join(report, "session", "left").join(settled, "session", "left")
    state = (
        F.when(F.col("tap").isNull() | F.col("settled"), "idle")
        .when(F.col("how").isNull(), "focusing")
        .when(F.col("how") == "succeeded", "focused")
        .otherwise("failed")
    )
    out = done.withColumn("state", state)
    return out.select("session", "state", F.when(F.col("state") != "idle", F.col("request")).otherwise(F.lit(-1)).cast("long").alias("request_id"))


def compare_step(state: str, kind: str | None) -> str:
    """One event of the guided comparison."""
    if kind == "start":
        return "awaiting_capture"
    if kind == "cancelled":
        return "idle"
    if kind == "captured" and state == "awaiting_capture":
        return "awaiting_reference"
    if kind == "picked" and state == "awaiting_reference":
        return "idle"
    return state


def compare_steps(events: DataFrame) -> DataFrame:
    """Batch form of the guided comparison: ``session, step`` after all events."""
    kind = F.create_map(*[x for k, v in COMPARE.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    rows = events.select(F.expr("event_id div 40").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"))
    reset = rows.filter("kind IN ('start', 'cancelled')").groupBy("session").agg(F.max("seq").alias("at"), F.max_by("kind", "seq").alias("how"))
    began = reset.filter("how = 'start'")
    captured = rows.filter("kind = 'captured'").join(began, "session").filter("seq > at").groupBy("session").agg(F.min("seq").alias("shot"))
    picked = rows.filter("kind = 'picked'").join(captured, "session").filter("seq > shot").select("session", F.lit(True).alias("picked")).distinct()
    done = rows.select("session").distinct().join(began, "session", "left").join(captured, "session", "left").join(picked, "session", "left")
    step = (
        F.when(F.col("at").isNull() | F.col("picked"), "idle").when(F.col("shot").isNull(), "awaiting_capture").otherwise("awaiting_reference")
    )
    return done.select("session", step.alias("step"))


def acquired(shots: DataFrame, timeout: int = 5000, waiting: int = 2) -> DataFrame:
    """``burst, kept, span, frames`` of ``shots(burst, i, take, work, failed)``: captures of a burst in order.

    A capture starts when the one before is over and fewer than ``waiting`` (2) frames wait for decoding, which goes
    one by one; it is dropped if that takes longer than ``timeout`` milliseconds, if it takes longer itself, or if it
    fails. ``frames`` are the survivors in order, ``span`` ends with the last capture or decoding. A fold over
    the few shots of a burst.
    """
    if waiting != 2:
        raise ValueError("the fold keeps the last two decodings")
    own = F.array_sort(F.collect_list(F.struct("i", "take", "work", "failed")))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("free"), zero.alias("done"), zero.alias("before"), F.expr("cast(array() as array<long>)").alias("frames"))
    limit = F.lit(timeout).cast("long")

    def step(s, e):
        go = F.greatest(s["free"], s["before"])
        late = go - s["free"] > limit
        good = ~late & (e["take"] <= limit) & ~e["failed"]
        return F.struct(
            F.when(late, s["free"] + limit).otherwise(go + F.least(e["take"], limit)).alias("free"),
            F.when(good, F.greatest(s["done"], go + e["take"]) + e["work"]).otherwise(s["done"]).alias("done"),
            F.when(good, s["done"]).otherwise(s["before"]).alias("before"),
            F.when(good, F.array_append(s["frames"], e["i"])).otherwise(s["frames"]).alias("frames"),
        )

    done = shots.groupBy("burst").agg(own.alias("shots")).withColumn("s", F.aggregate("shots", start, step))
    return done.select("burst", F.size("s.frames").alias("kept"), F.greatest("s.free", "s.done").alias("span"), F.col("s.frames").alias("frames"))


# --- streams --------------------------------------------------------------------------------------


def fold(
    stream: DataFrame, key: str, order: str, start: Any, step: Callable, state: str, output: str, row: Callable
) -> DataFrame:
    """Fold the events of a key in order into bounded state and emit a row per update.

    ``step(state, event)`` gives the next state (a tuple), ``row(key, state)`` the output rows.
    """

    def update(keys, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        value = held.get if held.exists else start
        rows = pd.concat(list(batches))
        for event in rows.sort_values(order, kind="stable").itertuples(index=False):
            value = step(value, event)
        held.update(value)
        yield row(keys[0], value)

    return stream.groupBy(key).applyInPandasWithState(update, output, state, "update", GroupStateTimeout.NoTimeout)


def last_frames(stream: DataFrame, keep: int = 3) -> DataFrame:
    """The newest rows of each user of an event stream: ``user_id, event_id, back`` (1 is newest)."""

    def add(value, event):
        pairs = sorted([*zip(value[0], value[1], strict=True), (int(event.ts.value), int(event.event_id))])[-keep:]
        return [p[0] for p in pairs], [p[1] for p in pairs]

    row = lambda key, v: pd.DataFrame({"user_id": key, "event_id": v[1][::-1], "back": range(1, len(v[1]) + 1)})
    return fold(stream, "user_id", "event_id", ([], []), add, "ts array<long>, ids array<long>", "user_id long, event_id long, back int", row)


def focus_stream(stream: DataFrame) -> DataFrame:
    """Streaming form of :func:`focus_states`."""
    step = lambda v, e: focus_step(v, e.kind, int(e.request_id))
    row = lambda key, v: pd.DataFrame({"session": [key], "state": [v[0]], "request_id": [v[1]]})
    return fold(sessions(stream), "session", "seq", ("idle", -1), step, "name string, request long", "session long, state string, request_id long", row)


def compare_stream(stream: DataFrame) -> DataFrame:
    """Streaming form of :func:`compare_steps`."""
    rows = stream.select(F.expr("event_id div 40").alias("session"), F.col("event_id").alias("seq"), "event_type")
    step = lambda v, e: (compare_step(v[0], COMPARE.get(e.event_type)),)
    row = lambda key, v: pd.DataFrame({"session": [key], "step": [v[0]]})
    return fold(rows, "session", "seq", ("idle",), step, "name string", "session long, step string", row)


def drain(stream: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what its source holds now and return the last rows of each key.

    Every micro-batch is written under its number, so a batch that is replayed after a failure
    replaces itself; ``keys`` empty: append-only rows, all kept.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/out")
    if not keys:
        return rows.drop("batch")
    newest = rows.withColumn("_new", F.max("batch").over(Window.partitionBy(*keys)))
    return newest.filter(F.col("batch") == F.col("_new")).drop("batch", "_new")


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream, a few files a batch (the back-pressure)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
