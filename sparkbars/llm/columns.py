"""Helpers every corpus operator shares: free column names and folds of a document id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds what travels to Python at once by bytes: 10,000 rows of text may be anything from 1 MB to 1 GB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with an operator's own."""
    return docs.select(*[F.col(quoted(n)).alias(n) for n in names])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a missing id."""
    return F.crc32(doc_id.cast("string")) % folds


def verdict_filter(docs: DataFrame, judge: Callable[[Column], Column], keep: Callable[[Column], Column],
                   text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose judged text passes ``keep``, with the columns of ``docs`` untouched."""
    name = free_name(docs, "verdict")
    judged = docs.withColumn(name, judge(F.col(quoted(text))))
    return judged.filter(keep(F.col(name))).select(*[F.col(quoted(c)) for c in docs.columns])
