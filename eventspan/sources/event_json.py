"""The engine's JSON: events in three shapes in, event documents, rule maps and reports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

EVENT = "struct<event_id:string,category:string,label:string,start_sec:double,peak_sec:double,end_sec:double,confidence:double,audio_score:double,video_score:double,sources:array<string>,included_in_gate:boolean>"


def events_of(document: Column) -> Column:
    """The events of a JSON document: a list, an object with `events`, or a single event; any other shape stops the job."""
    x = F.trim(document)
    wrapped = F.get_json_object(x, "$.events")
    single = F.get_json_object(x, "$.category").isNotNull() & F.get_json_object(x, "$.peak_sec").isNotNull()
    text = F.when(x.startswith("["), x).when(wrapped.startswith("["), wrapped).when(single, F.concat(F.lit("["), x, F.lit("]")))
    return F.from_json(F.coalesce(text, F.raise_error(F.concat(F.lit("no events in this JSON: "), F.substring(x, 1, 60)))), f"array<{EVENT}>")


def event_rows(documents: DataFrame, key: str, json: str) -> DataFrame:
    """A row per event with the defaults of missing keys: an id by place, the start 0, the peak the start, the end the peak."""
    e = documents.select(key, F.posexplode(events_of(F.col(json))).alias("place", "e"))
    start = F.coalesce("e.start_sec", F.lit(0.0))
    peak = F.coalesce(F.col("e.peak_sec"), start)
    end = F.coalesce(F.col("e.end_sec"), peak)
    text = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit("")).alias(c)
    return e.select(
        key, F.coalesce(F.when(F.col("e.event_id") != "", F.col("e.event_id")), F.format_string("event_%03d", F.col("place") + 1)).alias("event_id"), text("category"), text("label"),
        start.alias("start_sec"), peak.alias("peak_sec"), end.alias("end_sec"), F.greatest(F.lit(0.0), end - start).alias("duration_sec"), F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"),
        F.col("e.audio_score").alias("audio_score"), F.col("e.video_score").alias("video_score"), F.coalesce("e.sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("e.included_in_gate", F.lit(False)).alias("included_in_gate"),
    )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """path and the columns of event_rows for every *.json file under the folder. A file is a document and read whole."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(folder)
    return event_rows(files.select(F.input_file_name().alias("path"), "value"), "path", "value")


def document(rows: DataFrame, key: str, order: list[Column], event: Column, report: dict[str, Column] | None = None) -> DataFrame:
    """key, json: one document per key with its events in order, whether there are any and any in the gate, and the report's values.
    A document is one value, so a key's events must fit in one; rows are gathered per key only."""
    listed = F.array_sort(F.collect_list(F.struct(*order, event.alias("__e"))))
    g = rows.groupBy(key).agg(listed.alias("l"), *[v.alias(k) for k, v in (report or {}).items()])
    events = F.transform("l", lambda x: x["__e"])
    head = [F.col(k) for k in (report or {})]
    return g.select(key, F.to_json(F.struct(*head, (F.size("l") == 0).alias("no_events_detected"), (~F.exists(events, lambda e: e["included_in_gate"])).alias("no_haptic_events"), events.alias("events"))).alias("json"))


TRACK = StructType([StructField("window_size_ms", LongType()), StructField("events", ArrayType(StructType([StructField("start_ms", LongType()), StructField("type", StringType()), StructField("intensity", LongType()), StructField("avg_audio", DoubleType())])))])


def rule_map(windows: DataFrame, key: str, window_ms: int) -> DataFrame:
    """windows: key, start_ms, type, intensity. key, json: the envelope of a rule track, its track a map from start to intensity."""
    l = F.array_sort(F.collect_list(F.struct("start_ms", "type", "intensity")))
    g = windows.groupBy(key).agg(l.alias("l"))
    track = F.map_from_entries(F.transform("l", lambda x: F.struct(x["start_ms"].cast("string"), x["intensity"])))
    return g.select(key, F.to_json(F.struct(F.lit(window_ms).alias("window_size_ms"), track.alias("track"), F.col("l").alias("events"), F.lit("rule_based").alias("source"))).alias("json"))


def read_rule_map(documents: DataFrame, key: str, json: str) -> DataFrame:
    """key, window_ms, start_ms, intensity: a rule map's track by ascending start; a missing window size is 40."""
    track = F.from_json(F.get_json_object(F.col(json), "$.track"), "map<string,long>")
    size = F.coalesce(F.get_json_object(F.col(json), "$.window_size_ms").cast("long"), F.lit(40).cast("long"))
    rows = documents.select(key, size.alias("window_ms"), F.explode(track).alias("start", "intensity"))
    return rows.select(key, "window_ms", F.col("start").cast("long").alias("start_ms"), "intensity")


def write_documents(docs: DataFrame, path: str, json: str = "json") -> None:
    """One line of JSON per document, as text files any reader of JSON lines takes."""
    docs.select(F.col(json).alias("value")).write.mode("overwrite").text(path)
