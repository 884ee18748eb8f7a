"""Notebooks of visited references, pinned citations and tags.

A notebook is an append-only log of events (trail_id, seq, at, action, value);
its state is a fold over them. Nothing is overwritten, so that writers can't
lose one another's entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.errors import EngineError

ACTIONS = {"create": None, "add": "visited_refs", "pin": "pinned_evidence", "tag": "coverage_tags"}
EVENT = "trail_id string, seq bigint, at timestamp, action string, value string"
CITATION = "^[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+:[A-Za-z0-9_./-]+#[A-Za-z0-9_./-]+:\\d+-\\d+$"


def fold(events: DataFrame) -> DataFrame:
    """State of each notebook: ordered lists without repeats or empty values. A
    ``create`` starts it; events before its last ``create`` don't count."""
    born = F.max(F.when(F.col("action") == "create", F.col("seq"))).over(Window.partitionBy("trail_id"))
    live = events.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).withColumn("born", born).where("seq >= born")
    # the first entry of each value, found by key before lists are made
    first = live.withColumn("n", F.row_number().over(Window.partitionBy("trail_id", "action", "value").orderBy("seq")))
    entry = lambda action: F.transform(F.array_sort(F.collect_list(F.when((F.col("action") == action) & (F.col("value") != "") & (F.col("n") == 1), F.struct("seq", "value")))), lambda x: x["value"])
    return first.groupBy("trail_id").agg(
        F.max_by("value", F.when(F.col("action") == "create", F.col("seq"))).alias("objective"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
        *[entry(action).alias(name) for action, name in ACTIONS.items() if name],
    )


def append(spark, path: str, trail_id: str, action: str, value: str, known_refs: DataFrame | None = None) -> None:
    """Adds one event to the log at ``path``. ``add`` needs a reference that is in
    ``known_refs`` (ref) if given, ``pin`` needs the form of a citation."""
    if action not in ACTIONS:
        raise EngineError("INVALID_ARGS", f"unknown action {action}", f"one of {', '.join(ACTIONS)}")
    if action == "pin" and spark.range(1).select(F.lit(value).rlike(CITATION)).first()[0] is not True:
        raise EngineError("INVALID_ARGS", f"not a citation: {value}", "library@version:doc#anchor:start-end")
    if action == "add" and known_refs is not None and known_refs.where(F.col("ref") == value).isEmpty():
        raise EngineError("REF_NOT_FOUND", f"no section for {value}", "search for a related query")
    # the clock orders events; the identity of the row breaks its ties
    now = F.current_timestamp()
    spark.range(1).select(F.lit(trail_id).alias("trail_id"), F.unix_micros(now).alias("seq"), now.alias("at"), F.lit(action).alias("action"), F.lit(value).alias("value")).coalesce(1).write.mode("append").parquet(path)


def read(spark, path: str) -> DataFrame:
    return fold(spark.read.schema(EVENT).parquet(path))


def show(spark, path: str, trail_id: str) -> DataFrame:
    state = read(spark, path).where(F.col("trail_id") == trail_id)
    if state.isEmpty():
        raise EngineError("REF_NOT_FOUND", f"no notebook {trail_id}", "create it first")
    return state
