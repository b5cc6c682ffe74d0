"""Categories as a table: labels by pool, thresholds, gates; and replies, scales and text lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import CATEGORIES, SCENES, normalize_label

# Labels of the picture and of context, by category.
VIDEO = {"gunshot": ["shooting gun", "playing paintball"], "explosion": ["exploding firecrackers"], "vehicle": ["driving car", "riding a bike", "motorcycling"]}
CONTEXT = {"gunshot": ["gunshot", "gunfire"], "explosion": ["explosion", "boom", "artillery", "cannon"], "vehicle": ["engine_rumble", "vehicle", "tank"]}
# Settings that categories may have of their own, and those in the gate.
HIGH, LOW = {"gunshot": 0.6, "vehicle": 0.35}, {"vehicle": 0.7, "smash": -0.1}
GATED = {"gunshot", "explosion", "smash", "car_crash", "vehicle"}
# Which pools a source's labels are looked up in.
SOURCES = {"audio": ("audio", "context"), "audioset": ("audio", "context"), "context": ("audio", "context"), "video": ("video",), "kinetics": ("video",), "context_token": ("context",)}


def labels_of(spark: SparkSession) -> DataFrame:
    """category, ord, pool, place, label (normalised): a few hundred rows, whatever the data."""
    rows = []
    for ord_, (c, _, audio) in enumerate(CATEGORIES):
        for pool, names in (("audio", audio), ("context", CONTEXT.get(c, [])), ("video", VIDEO.get(c, []))):
            rows += [(c, ord_, pool, i, " ".join(x.lower().split())) for i, x in enumerate(names)]
    return spark.createDataFrame(rows, "category string, ord int, pool string, place int, label string")


def settings_of(spark: SparkSession) -> DataFrame:
    """category, ord, impulsive, in_gate and the category's own thresholds, null where it has none."""
    return spark.createDataFrame([(c, i, flag, c in GATED, HIGH.get(c), LOW.get(c)) for i, (c, flag, _) in enumerate(CATEGORIES)], "category string, ord int, impulsive boolean, in_gate boolean, high double, low double")


def pools(source: Column) -> Column:
    """The pools that a source's labels are looked up in; an unknown source has all."""
    out = F.array(*[F.lit(p) for p in ("audio", "video", "context")])
    for name, known in SOURCES.items():
        out = F.when(source == name, F.array(*[F.lit(p) for p in known])).otherwise(out)
    return out


def match_labels(rows: DataFrame, label: str, source: str) -> DataFrame:
    """rows with `category`: the first one with a label in the source's pools that equals, contains or is contained in the row's.
    Distinct labels, not rows, meet the table of labels, which is broadcast: its size is fixed."""
    names = rows.select(label, source).distinct().withColumn("__n", normalize_label(F.col(label))).withColumn("__p", pools(F.col(source)))
    table = F.broadcast(labels_of(rows.sparkSession).withColumnRenamed("label", "__l"))
    hit = names.join(table, F.array_contains("__p", F.col("pool")) & (F.col("__n") != "") & (F.col("__n").contains(F.col("__l")) | F.col("__l").contains(F.col("__n"))))
    best = hit.groupBy(label, source).agg(F.min(F.struct("ord", "category"))["category"].alias("category"))
    return rows.join(best, [label, source], "left")


def thresholds(settings: DataFrame, high: float, low: float) -> DataFrame:
    """category, high, low: the category's own or the common ones; low is never over high nor under 0."""
    h = F.coalesce("high", F.lit(high))
    return settings.select("category", h.alias("high"), F.greatest(F.least(F.coalesce("low", F.lit(low)), h), F.lit(0.0)).alias("low"))


def linear(x: Column, most: float, out: float) -> Column:
    """0 to `most` as 0 to `out`; what is beyond stays at the end."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(most)) * F.lit(out) / F.lit(most)


def reply_names(x: Column) -> Column:
    """Known scene names in a model's reply: of all {..} and [..] parts that are JSON a list's items and an object's `categories`
    or `category`; of a reply without any such name what stands between commas. In order, once each."""
    found = F.regexp_extract_all(x, F.lit(r"(?s)\{.*?\}|\[.*?\]"), F.lit(0))

    def names(part: Column) -> Column:
        as_list = F.from_json(part, "array<string>")
        key = F.when(F.get_json_object(part, "$.categories").isNotNull(), F.get_json_object(part, "$.categories")).otherwise(F.get_json_object(part, "$.category"))
        of_key = F.when(key.startswith("["), F.from_json(key, "array<string>")).when(~key.startswith("{"), F.array(key))
        none = F.array().cast("array<string>")
        return F.coalesce(F.when(part.startswith("["), as_list).otherwise(of_key), none)

    listed = F.flatten(F.transform(found, names))
    chosen = F.when(F.size(listed) > 0, listed).otherwise(F.split(F.lower(F.trim(x)), ","))
    clean = F.transform(F.filter(chosen, lambda n: n.isNotNull()), lambda n: F.translate(F.lower(F.trim(n)), " -", "__"))
    return F.array_distinct(F.filter(clean, lambda n: n.isin(SCENES)))


def model_runs(enabled: Column, gpu_gb: Column, need: float) -> Column:
    """Struct of whether a scene model runs and why."""
    why = F.when(~enabled, F.lit("switched off")).when(gpu_gb.isNull(), F.lit("no GPU")).when(gpu_gb < need, F.format_string(f"%.0f GB of {need:g}", gpu_gb)).otherwise(F.format_string("%.0f GB", gpu_gb))
    return F.struct((enabled & F.coalesce(gpu_gb >= need, F.lit(False))).alias("runs"), why.alias("why"))
