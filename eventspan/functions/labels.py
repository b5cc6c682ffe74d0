"""Labels, replies and rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories in order, their flag and their audio labels.
CATEGORIES = [
    ("gunshot", True, ["Gunshot, gunfire", "Machine gun", "Cap gun", "Fusillade"]),
    ("explosion", True, ["Explosion", "Artillery fire", "Fireworks", "Burst, pop", "Boom"]),
    ("smash", True, ["Smash, crash", "Breaking", "Shatter", "Crushing", "Slam"]),
    ("car_crash", True, []),
    ("vehicle", False, ["Vehicle", "Engine", "Engine starting", "Accelerating, revving, vroom", "Truck", "Motor vehicle (road)", "Idling", "Tank"]),
]
# Names a scene reply may use.
SCENES = ["gunshot", "explosion", "smash", "car_crash", "vehicle", "engine_start"]

# Parts of labels that tell sudden from lasting sounds and sights.
SUDDEN_AUDIO = ["thunder", "explosion", "gunshot", "gunfire", "machine gun", "fireworks", "bang", "boom", "artillery", "fusillade", "cap gun"]
SUDDEN_VIDEO = ["shooting", "explod", "fire", "smash", "hit", "crash"]
LASTING_AUDIO = ["vehicle", "engine", "truck", "motor vehicle", "idling", "tank", "rain", "wind", "storm"]
LASTING_VIDEO = ["driving", "motorcycl", "riding"]


def keyword_class(label: Column, modality: Column) -> Column:
    """'sudden' before 'lasting', by the modality's words; null for neither."""
    has = lambda words: F.lower(label).rlike("|".join(words))
    audio = modality == "audio"
    return F.when(F.when(audio, has(SUDDEN_AUDIO)).otherwise(has(SUDDEN_VIDEO)), "sudden").when(F.when(audio, has(LASTING_AUDIO)).otherwise(has(LASTING_VIDEO)), "lasting")


def sample_fps(start: Column, end: Column, most: int, shortest: float) -> Column:
    """Frames a second for a scene: more for short ones, never more than `most` frames in all."""
    length = F.greatest(end - start, F.lit(shortest))
    return F.round(F.least(F.when(length <= 4, 8.0).when(length <= 8, 4.0).otherwise(2.0), F.lit(float(most)) / length), 2)


def look_window(start: Column, end: Column, duration: Column, shortest: float) -> Column:
    """Struct of start and end: a window shorter than `shortest` grows around its middle and stays inside the clip."""
    grown = F.greatest(F.lit(0.0), start - (F.lit(shortest) - (end - start)) / 2)
    over = grown + shortest > duration
    a = F.when(over, F.greatest(F.lit(0.0), duration - shortest)).otherwise(grown)
    b = F.when(over, duration).otherwise(grown + shortest)
    long_ = end - start >= shortest
    return F.struct(F.when(long_, start).otherwise(a).alias("start"), F.when(long_, end).otherwise(b).alias("end"))


def prediction_label(x: Column) -> Column:
    return F.regexp_replace(x, "^LABEL_", "")


def normalize_label(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")


def label_category(x: Column) -> Column:
    """The first category one of whose labels equals, contains or is contained in the label; null for none or an empty one."""
    n = normalize_label(x)
    hit = lambda label: n.contains(label.lower()) | F.lit(label.lower()).contains(n)
    tests = [(c, [hit(x) for x in labels]) for c, _, labels in CATEGORIES if labels]
    out = F.when(n == "", F.lit(None).cast("string"))
    for c, t in tests:
        any_ = t[0]
        for x_ in t[1:]:
            any_ = any_ | x_
        out = out.when(any_, F.lit(c))
    return out


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, flag) for i, (c, flag, _) in enumerate(CATEGORIES)], "category string, ord int, impulsive boolean")


def parse_reply(x: Column) -> Column:
    """Known scene names in a comma-separated reply, in order and once each."""
    names = F.transform(F.split(F.lower(F.trim(x)), ","), lambda p: F.translate(F.trim(p), " -", "__"))
    return F.array_distinct(F.filter(names, lambda n: n.isin(SCENES)))


def rule_window(lightning: Column, rain: Column, audio: Column, low: float, high: float, wet: float, loud: float = 100.0, least: int = 16) -> Column:
    """Struct of type and intensity by the first rule that holds; an intensity under `least` is none. The third rule of the
    known order can't be reached after the first and is left out."""
    kind = (
        F.when((lightning > low) & (audio > loud), "thunder_both").when(lightning > high, "thunder_visual").when(rain > wet, "rain").when(audio > least, "audio").otherwise("none")
    )
    level = F.when(kind.startswith("thunder"), 255).when(kind == "rain", rain.cast("int")).when(kind == "audio", audio.cast("int")).otherwise(0)
    return F.struct(F.when(level < least, "none").otherwise(kind).alias("type"), F.when(level < least, 0).otherwise(level).alias("intensity"))
