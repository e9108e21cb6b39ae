"""What the corpus operators share: words, row identity, sizes, input columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.session import scratch_path

#: A word is a run of anything but these six white-space bytes.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Stages:
    """Stored intermediate tables that are deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, label: str) -> str:
        self.paths.append(scratch_path(self.spark, label))
        return self.paths[-1]

    def keep(self, df: DataFrame, label: str = "stage") -> DataFrame:
        """Like ``durable``."""
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def sweep(spark: SparkSession) -> None:
    """Free the disk and memory of finished work.

    Spark deletes shuffle files once a collection of the driver's heap finds them unused.  A
    full collection in an executor gives the part of its heap that is empty back to the
    system, which leaves room for the Python workers of the next step; one task per core asks for it.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash; text NULL becomes empty."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Total length of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(total: int, each: int, least: int) -> int:
    """How many pieces of about ``each`` units hold ``total``, not fewer than ``least``."""
    return max(least, math.ceil(total / each))


def slices(batch, rows: int, size: int):
    """A record batch in slices of at most ``rows`` rows and about ``size`` bytes; a row longer than that is alone."""
    todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
    while todo:
        some = todo.pop()
        if some.num_rows > 1 and some.nbytes > size:
            half = some.num_rows // 2
            todo += [some.slice(half), some.slice(0, half)]
        else:
            yield some


_KEPT: dict = {}
_ASKED: set = set()


def kept(key, make):
    """What ``make`` returns, once per worker process while its tasks ask for the same key.

    Another key takes its place, and so does a task that asks for none: a worker that goes
    on to other work does not carry the caches of the last one.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    _ASKED.add(key)
    return _KEPT[key]


def trim() -> None:
    """Give freed memory back to the system, which the C library otherwise holds for the process's next work."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def map_slices(df: DataFrame, step, schema: str, rows: int = 512, size: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over :func:`slices`, so that a task holds few Python objects at once.

    ``step()`` is called once per task and returns a function from a pyarrow table to a dict of columns.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        _ASKED.clear()
        one = step()
        if not _ASKED:
            _KEPT.clear()
        for batch in batches:
            for some in slices(batch, rows, size):
                out = one(some)
                columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        del one
        trim()

    return df.mapInArrow(run, schema)
