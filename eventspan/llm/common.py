"""What the operators of this package share: the shared work folder, lineage cuts, salts and word patterns."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 8
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Paths written since the innermost `scratch` began; the first list is of those that stay until `clear`.
_written: list[list[str]] = [[]]


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. One of our own only where none is set and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="eventspan-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/eventspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder. For the end of a job: results that are still to be read
    from it are gone."""
    drop_path(spark, f"{work_dir(spark)}/eventspan/{spark.sparkContext.applicationId}")


class scratch:
    """Tables written inside are removed at the end, but for those written by `keep`, which the surrounding scratch then owns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        _written.append([])
        self.kept: list[str] = []
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        _written[-1].remove(path)
        _written[-2].append(path)
        self.kept.append(path)
        return cut(df, name, path)

    def __exit__(self, *_) -> None:
        for path in _written.pop():
            drop_path(self.spark, path)


def scratched(f):
    """For functions whose result does not read what they write: it is removed when they end."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **options):
        with scratch(df.sparkSession):
            return f(df, *args, **options)

    return run


class frees_shuffles:
    """Shuffle files of the actions inside are removed when each action ends: its result is on shared disk by then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")

    def __exit__(self, *_):
        self.spark.conf.set(CLEANUP, self.was)


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with frees_shuffles(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(m)).cast("int")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column has them, in any case of letters."""
    taken = {c.lower() for c in columns}
    front = "__"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell rows of different id or text apart and sort null ids last: the id and the text's digest."""
    null = F.when(F.col(id_col).isNull(), F.lit("01")).otherwise("00")
    digest = F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text_col).cast("string")), F.lit("")).cast("binary"), 256), 1, 32)
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), F.unhex(F.concat(null, digest))]


def join_shared(left: DataFrame, shared: DataFrame, key: str, share: float = 4.0) -> DataFrame:
    """Left join with the rows of `shared`, which has one for each key that several left rows have and their number in a column
    `n`, which goes. The caller fills in nulls for the other keys.

    A key of more than 1 / (share * partitions) of those rows is hot. There are at most share * partitions such keys, so their
    rows are broadcast; left rows that meet them take no part in the shuffle by key that follows: they are spread by a hash of
    the row. So no task gets the rows of a hot key, at any size.
    """
    spark = left.sparkSession
    shared = cut(shared, "shared-keys")
    most = shared.agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, most / (share * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    take = [c for c in shared.columns if c not in (key, "n")]
    hot = shared.where(F.col("n") > limit)
    if hot.isEmpty():
        return left.join(shared.drop("n"), key, "left")
    row, turn = fresh([*left.columns, *take], "row", "turn")
    found = left.join(F.broadcast(hot.select(key, F.struct(*take).alias(row))), key, "left")
    spread = [F.col(c) for c, kind in left.dtypes if "map<" not in kind]
    found = found.withColumn(turn, F.when(F.col(row).isNotNull(), F.xxhash64(F.spark_partition_id(), *spread)).otherwise(0))
    cold = shared.where(F.col("n") <= limit).select(key, F.lit(0).cast("long").alias(turn), *take)
    out = found.join(cold, [key, turn], "left")
    return out.select(*left.columns, *[F.when(F.col(row).isNotNull(), F.col(f"{row}.{c}")).otherwise(F.col(c)).alias(c) for c in take])


def hot_keys(rows: DataFrame, key: str, share: float = 4.0) -> list:
    """The keys (longs) of more than 1 / (share * partitions) of the rows: at most share * partitions of them."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = max(16.0, rows.count() / (share * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return [r[0] for r in sizes.where(F.col("n") > limit).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """Left join with rows of unique keys. Those of the hot keys, which are few, are broadcast."""
    if not hot:
        return left.join(right, key, "left")
    keys = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"{key} long"))
    cold = left.join(keys, key, "left_anti").join(right, key, "left")
    return cold.unionByName(left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, "left"))


def small(batches: Iterator, rows: int = 500) -> Iterator:
    """Batches of pandas rows in parts of so many. Spark bounds a batch by its bytes, but what is made of it is larger."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def map_texts(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInPandas(run, schema) in small batches, for rows whose doc_id is passed through. It travels as text: pandas would
    turn numbers among nulls into floating point and so change large ones."""
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(lambda batches: run(small(batches)), schema.replace("doc_id long", "doc_id string", 1))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


#: Bits of the filter that says which rows may have one of many keys: 4 MB, whatever the number of rows.
BITMAP = 1 << 25


def bitmap(hashes: DataFrame) -> DataFrame:
    """hashes: one long column. A table of a fixed size with a bit set for each; see may_have."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(BITMAP))
    return hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def may_have(rows: DataFrame, bits: DataFrame, hash_col: str) -> DataFrame:
    """rows with a column `__may`: false only where the hash is none of those the bitmap was made of. When very many bits are set
    more rows are let through, and what follows gets more to do, not other results."""
    bit = F.pmod(F.col(hash_col), F.lit(BITMAP))
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits.withColumnRenamed("bucket", "__bucket").withColumnRenamed("bits", "__bits")), "__bucket", "left")
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.withColumn("__may", F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8))) == 1, F.lit(False))).drop("__bucket", "__bits")
