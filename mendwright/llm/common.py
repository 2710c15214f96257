"""What the operators of this package share: table access, shared storage, row blocks, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classic printable white space of the contracts: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one of our own: in the warehouse, which all executors share, or, in local runs, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = f"file://{tempfile.mkdtemp(prefix='mendwright-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/mendwright-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors. The files go when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/mendwright-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def looked_up(facts: DataFrame, table: DataFrame, keys: list[str], most_sent: int = 200_000, salts: int = 16) -> DataFrame:
    """``facts`` joined with the one row of ``table`` for their keys. Facts may have hot keys: the table is sent to all
    executors if it has up to ``most_sent`` rows; a larger one is repeated ``salts`` times, and the facts are dealt over the copies."""
    table = written(table)
    if table.count() <= most_sent:
        return facts.join(F.broadcast(table), keys)
    salt = free_name(facts, "salt")
    dealt = facts.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns if c not in keys]), F.lit(salts)).cast("int"))
    return dealt.join(table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, salt]).drop(salt)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text as the empty one; extra columns, whatever their names, go no further."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def chunks_for(rows: int, size: int, most_rows: int, most_bytes: int) -> int:
    """Into how many chunks rows are dealt by a hash, so that a chunk has about ``most_rows`` rows and ``most_bytes`` bytes of text at most."""
    return max(1, -(-rows // most_rows), -(-size // most_bytes))


def blocks(frames: Iterator[pd.DataFrame], most_chars: int = 4_000_000, column: str = "text") -> Iterator[pd.DataFrame]:
    """Cuts each batch into blocks of about ``most_chars`` characters, a row at least, so a batch of long texts is worked off piece by piece."""
    for frame in frames:
        if not len(frame):
            continue
        ends = frame[column].str.len().fillna(0).cumsum().to_numpy()
        if ends[-1] <= most_chars:
            yield frame
            continue
        marks = (ends - 1).clip(0) // most_chars
        cuts = np.flatnonzero(np.diff(marks)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
            if b > a:
                yield frame.iloc[a:b]
    trim()


def row_blocks(batch: pa.RecordBatch, column: str = "text", most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The Arrow batch in slices of about ``most_chars`` characters of a column, a row at least."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most_chars:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    yield batch.slice(at)


def trim() -> None:
    """Gives freed memory back to the system, since a worker process outlives its tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Lower-cases A-Z alone, unlike str.lower().
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOWER_BYTES = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_words(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8: bytes split on exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).split()
