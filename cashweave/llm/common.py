"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators of the contracts: space and the five ASCII controls tab .. carriage return.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, found by exact spelling.

    Other columns, also ones whose names differ only in case, never make a name ambiguous.
    """
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[n]}").alias(n) for n in names])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable, not a copy)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building the filtered array."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return let(parts, lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int")
               - F.when((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == ""), 1).otherwise(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(configured)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a plain path or a URI such as file:// or s3://."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_once(path: str, name: str):
    """An output stream for a new file ``name`` in folder ``path``."""
    where, base = filesystem(path)
    where.create_dir(base, recursive=True)
    return where.open_output_stream(f"{base}/{name}", compression=None)


def read_ranges(path: str, spans: list[tuple[int, int]]):
    """Yield the bytes of each (offset, length) of a file, in the order given."""
    where, base = filesystem(path)
    with where.open_input_file(base) as f:
        for offset, length in spans:
            f.seek(offset)
            yield f.read(length)


def read_all(path: str) -> io.BytesIO:
    where, base = filesystem(path)
    with where.open_input_stream(base, compression=None) as f:
        return io.BytesIO(f.read())


def slices(batches, rows: int = 512):
    """Arrow batches cut to ``rows`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Cache:
    """Two generations of at most ``size`` entries and a batch's own: entries in use move to the young
    one, and a full young one takes the place of the old."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def lacking(self, keys: set) -> set:
        """The keys without an entry; all others are in ``young`` now."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        new = keys - self.young.keys()
        if self.old:
            old, young, rest = self.old, self.young, set()
            for key in new:
                value = old.get(key)
                if value is None:
                    rest.add(key)
                else:
                    young[key] = value
            return rest
        return new

    def drop(self, keys) -> None:
        for key in keys:
            del self.young[key]
