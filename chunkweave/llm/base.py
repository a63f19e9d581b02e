"""What the document operators share: byte views of text columns, folds, and tables in the shared folder.

Texts travel as UTF-8 bytes.  ``bytes.lower`` lowers A-Z alone and ``bytes.split`` cuts at
0x20 and 0x09-0x0D alone, which is what the word rules of the operators ask for.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting of a session whose files have fewer row groups than it has cores: how many partitions documents are dealt over. Unset, nothing is dealt.
DEAL = "chunkweave.documents.partitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; dealt anew where the session asks for it by :data:`DEAL`, whatever their number."""
    docs, n = table(spark, sf_dir, "documents"), spark.conf.get(DEAL, None)
    return docs.repartition(int(n)) if n else docs


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text, one at a time; None where the text is null."""
    return (x.as_py() for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True for rows that must not be learned from; a null id is held out, as it has no fold."""
    f = fold(modulus, doc_id)
    return (f == remainder) | (f == -1)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a folder of its own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="chunkweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables stored inside the calls of :func:`settled` that are under way.
_HELD: list[list[DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if _HELD:
        _HELD[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` which no later result reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of ``make``; the tables that it stored on the way are deleted."""
    _HELD.append([])
    try:
        out = stored(make(), name)
    finally:
        held = _HELD.pop()
    for t in held:
        if t is not out:
            dropped(t)
    if _HELD:
        _HELD[-1].append(out)
    return out


@contextlib.contextmanager
def temporary():
    """Tables that operators store inside the block are deleted at its end, those that their results read among them.

    Results are lazy and read such tables, so write or collect them inside the block.
    """
    _HELD.append([])
    try:
        yield
    finally:
        for t in _HELD.pop():
            dropped(t)


#: Most bytes that Python is sent at once, whatever the length of the texts.
BATCH_BYTES = 2 << 20


def small_batches() -> None:
    """Bound by size what the session's Python workers get at once, unless the session has a bound of its own."""
    spark = SparkSession.getActiveSession()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and spark.conf.get(name) == "67108864b":  # Spark's own
        spark.conf.set(name, f"{BATCH_BYTES}b")


#: Per Python worker: what was built there last, and its key.
_BUILT: list = [None, None]


def built(key: tuple, make):
    """``make()`` once per Python worker and key; only the last is kept, as workers outlive queries."""
    if _BUILT[0] != key:
        if _BUILT[0] is not None:
            _BUILT[:] = [None, None]
            _released()
        _BUILT[:] = [key, make()]
        _released()
    return _BUILT[1]


def _released() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
