"""Table access, written tables and small helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.snapshot import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later jobs neither recompute it nor
    depend on blocks of an executor that may be lost. ``options`` are the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For tables of large values that are compressed already: small row groups, no second compression.
LARGE_VALUES = {"compression": "none", "parquet.block.size": 16 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_hash(column: str = "text"):
    """A 64-bit hash that tells the texts of equal ids apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


#: Bytes of one Arrow batch of whole texts; Spark's own bound is 64 MB, of which a task and its worker hold several.
BATCH_BYTES = 4 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; batches handed to Python are bounded by ``BATCH_BYTES``, unless the session sets a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


class SharedFiles:
    """Reads and writes plain files below a URI that all executors see.

    ``file:`` URIs and bare paths use the operating system (and can be memory-mapped); other schemes go
    through pyarrow's file systems. A write goes to a name of its own and is renamed when complete, so a
    retried or speculative task leaves either nothing or the whole, identical file.
    """

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.scheme in ("", "file")
        if self.local:
            self.root, self.fs = parsed.path, None
            os.makedirs(self.root, exist_ok=True)
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)
            self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str, chunks) -> None:
        part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        out = open(part, "wb") if self.local else self.fs.open_output_stream(part)
        with out:
            for chunk in chunks:
                out.write(chunk)
        if self.local:
            os.replace(part, f"{self.root}/{name}")
        else:
            self.fs.move(part, f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        """Takes a file away; one that isn't there (any more) is no error."""
        path = f"{self.root}/{name}"
        if self.local:
            if os.path.exists(path):
                os.remove(path)
        else:
            from pyarrow import fs

            if self.fs.get_file_info(path).type != fs.FileType.NotFound:
                self.fs.delete_file(path)

    def map(self, name: str, dtype):
        """The file as a flat array: memory-mapped where the file system allows it."""
        import numpy as np

        path = f"{self.root}/{name}"
        if self.local:
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)
