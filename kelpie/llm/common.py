"""What the text operators share: scratch tables, shipping this package to executors, and Arrow chunks."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer single text is taken alone.
CHUNK_BYTES = 2 << 20


def ship(spark):
    """Let the executors import this package, wherever the driver runs it from (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_kelpie_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "kelpie_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.write(os.path.join(root, "kelpie", "__init__.py"), "kelpie/__init__.py")
        folder = os.path.join(root, "kelpie", "llm")
        for name in sorted(os.listdir(folder)):
            if name.endswith(".py"):
                z.write(os.path.join(folder, name), f"kelpie/llm/{name}")
    sc.addPyFile(path)
    sc._kelpie_shipped = True


def scratch_dir(spark):
    """The shared folder that the cluster names; on a local master (tests) a temporary one where none is named."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(sc, "_kelpie_scratch", None)
        if named is None:
            named = sc._kelpie_scratch = tempfile.mkdtemp(prefix="kelpie-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def written(df, name):
    """df as a Parquet table in the shared folder: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kelpie/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._kelpie_path = path
    for made in _COLLECTING:
        made.append(out)
    return out


_COLLECTING = []


@contextlib.contextmanager
def collecting(made):
    """Append to `made` every table that written() makes meanwhile, for a later discard()."""
    _COLLECTING.append(made)
    try:
        yield
    finally:
        _COLLECTING.remove(made)


def discard(*tables):
    """Delete tables of written() from which everything that is needed has been written on (again: no harm)."""
    for t in tables:
        spark, path = t.sparkSession, t._kelpie_path
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark):
    """Let Spark drop the shuffle files of plans that are done with; else they pile up until a collection happens by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df):
    """df cut from its lineage; for small tables inside an iteration."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def every_column(df):
    """All columns of df in one struct, which no name of an operator's own can clash with."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns))


def quoted(name):
    """A column's name as SQL reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def utf8(arr):
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    import pyarrow as pa

    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    n, k = len(arr), arr.offset
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[k : k + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch, column="text", most=CHUNK_BYTES):
    """Slices of an Arrow batch as (slice, bytes, offsets), each of about `most` bytes of text at the most."""
    if batch.num_rows == 0:
        return
    data, offs = utf8(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    trim()


def trim():
    """Give freed memory back to the system: workers are kept between stages, and what they hold counts for the executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
