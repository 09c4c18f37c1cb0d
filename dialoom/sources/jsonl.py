"""JSON lines: any value a line, bad lines set aside; and the sinks of a run."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from dialoom.functions.text import strip
from dialoom.plans.logs import logger

_LINES = StructType([StructField("value", StringType())])


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete `path` with all below it, if it is there."""
    where, fs = _path(spark, path)
    fs.delete(where, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n, in order, of the folders `name`=n in `path`."""
    if not exists(spark, path):
        return []
    where, fs = _path(spark, f"{path.rstrip('/')}/{name}=*")
    return sorted(int(f.getPath().getName().split("=", 1)[1]) for f in fs.globStatus(where) or [])


def ensure_dir(spark: SparkSession, path: str) -> str:
    where, fs = _path(spark, path)
    fs.mkdirs(where)
    return path


def file_size(spark: SparkSession, path: str) -> int:
    """Bytes under `path`; 0 if it isn't there."""
    where, fs = _path(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def backup(spark: SparkSession, path: str, suffix: str = ".bak") -> str | None:
    """A copy beside `path`, or null if there is nothing to copy."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return None
    target, _ = _path(spark, path + suffix)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, fs, target, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    return path + suffix


def cleanup(spark: SparkSession, folder: str, pattern: str = "*.tmp") -> int:
    """Removes files that match in `folder`; how many."""
    if not exists(spark, folder):
        return 0
    where, fs = _path(spark, f"{folder.rstrip('/')}/{pattern}")
    found = [f.getPath() for f in fs.globStatus(where) or []]
    return sum(bool(fs.delete(p, True)) for p in found)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped non-blank lines; none, with the same schema, where `path` is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], _LINES)
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines, valid or not."""
    return lines(spark, path).count()


@F.arrow_udf(BooleanType())
def _is_json(text: pa.Array) -> pa.Array:
    def one(x: str) -> bool:
        try:
            json.loads(x)
        except (ValueError, RecursionError):
            return False
        return True

    return pa.array([None if (x := value.as_py()) is None else one(x) for value in text], pa.bool_())


PAIR_FIELDS = "question string, answer string, source_text string"


def observed(spark: SparkSession, path: str, schema: str = PAIR_FIELDS, *, keep: bool = False) -> tuple[DataFrame, Observation]:
    """Rows as `load` gives them, and counts of the same pass: `lines`, `blank` and `bad` ones.

    The counts are there once an action has read the rows. A file that can't
    be read to its end fails the action, or with `keep` gives the rows before.
    """
    counts = Observation()
    found = [F.count(F.lit(1)).alias("lines"), F.count_if(F.col("value") == "").alias("blank"), F.count_if((F.col("value") != "") & ~F.col("valid")).alias("bad")]
    if exists(spark, path):
        read = spark.read.option("ignoreCorruptFiles", keep).text(path).select(strip(F.col("value")).alias("value"))
    else:
        read = spark.createDataFrame([], _LINES)
    # Blank lines aren't handed to Python; a line is tested once, for its row and for the counts.
    tested = read.withColumn("valid", F.coalesce(_is_json(F.when(F.col("value") != "", F.col("value"))), F.lit(False))).observe(counts, *found)
    rows = tested.where("value <> ''")
    return rows.withColumn("item", F.when(F.col("valid") & F.col("value").startswith("{"), F.from_json("value", schema))), counts


def load(spark: SparkSession, path: str, schema: str = PAIR_FIELDS) -> DataFrame:
    """Rows (value, valid, item): the line, whether it is JSON, and its fields where it is an object.

    Other values than objects keep their line and have no item; bad lines are
    rows that aren't valid, for the reader to count or drop.
    """
    return observed(spark, path, schema)[0]


def load_whole(spark: SparkSession, path: str, schema: str = PAIR_FIELDS) -> tuple[DataFrame, dict[str, int]]:
    """Rows and counts in one job, all or none: no rows, and zeros, if a file can't be read to its end.

    The rows are kept by the executors until they are unpersisted.
    """
    rows, counts = observed(spark, path, schema)
    kept = rows.persist()
    try:
        kept.count()
    except Exception as e:  # an unreadable file is an empty load, as a missing one is
        kept.unpersist()
        logger().error("cannot load %s: %s", path, e)
        return spark.createDataFrame([], rows.schema), {"lines": 0, "blank": 0, "bad": 0}
    return kept, dict(counts.get)


def iterate(spark: SparkSession, path: str) -> Iterator[object]:
    """Values of the valid lines, a partition at a time on the driver; of a file that can't be read to its end, those before that."""
    for row in observed(spark, path, keep=True)[0].where("valid").select("value").toLocalIterator():
        yield json.loads(row["value"])


def save(df: DataFrame, path: str, *, append: bool = False) -> None:
    """One JSON object a row, nulls written; overwrites unless told to append, and commits as a whole."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def save_log(df: DataFrame, path: str, frame: str, level: str = "INFO", order: list[str] | None = None) -> None:
    """Rows as framed text: time, level and `frame`_START, a line for each column, `frame`_END.

    With `order`, each file holds a range of those columns, in order, and
    files follow each other by name: read in name order, they are one log.
    """
    opens = F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(f" - {level} - {frame}_START"))
    body = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    rows = df.orderBy(*order) if order else df
    rows.select(F.concat_ws("\n", opens, *body, F.lit(f"{frame}_END")).alias("value")).write.mode("overwrite").text(path)
