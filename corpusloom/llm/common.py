"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import checkpoint_root

SPACE = r"[\x20\x09-\x0D]+"  # what separates words
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(text_or_empty(text), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def digest_long(*parts: Column) -> Column:
    """Non-negative 32-bit number from the MD5 of the parts; null parts count as ``~``."""
    shown = [F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *shown)), 1, 8), 16, 10).cast("long")


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


_WRITTEN: list[tuple[SparkSession, str]] = []


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the writing are removed once it is done; the folder when ``discard`` is told so, or the driver program ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    held = spark.read.schema(df.schema).parquet(path)
    held._written_path = path
    return held


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._written_path)
        _WRITTEN.remove((df.sparkSession, df._written_path))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
