"""Shared folder tables and Arrow helpers used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A temporary folder of this machine is used only where the setting is absent and the master is local, as in tests;
    on a cluster each executor would write to its own disk, so there the absent setting is an error.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors of {master} share")
        found = _own.setdefault(spark.sparkContext.applicationId, None) or f"file://{tempfile.mkdtemp(prefix='scanfold-shared-')}"
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table is deleted when the driver's JVM ends, unless it is to be kept; :func:`dropped` deletes it before.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    if not keep:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._scanfold_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later step reads."""
    for df in tables:
        if path := getattr(df, "_scanfold_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def joined_on_hot(rows: DataFrame, table: DataFrame, key: list[str], *, hot: int = 10_000, most: int = 50_000) -> DataFrame:
    """``rows`` joined with ``table``, which has each of ``key`` once and in ``n`` how many of ``rows`` hold it.

    Rows of keys that over ``hot`` rows hold aren't shuffled to one task: there can't be more such keys than rows / ``hot``, and while
    they are ``most`` at most, they are broadcast; beyond that, the join is left to the adaptive split of skewed partitions.
    ``table`` should be a written table, as it is read more than once; its ``n`` isn't returned.
    """
    from pyspark.sql import functions as F

    warm = table.where(F.col("n") > hot)
    many = warm.limit(most + 1).count()
    table = table.drop("n")
    if not 0 < many <= most:
        return rows.join(table, key)
    cold = rows.join(F.broadcast(warm.select(*key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(warm.drop("n")), key).unionByName(cold)


def with_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to send Python 1000 rows at a time unless it names another number: texts are long."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def trim() -> None:
    """Give freed memory back to the system; a worker lives on and would keep what one large batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``column``, and at least a row."""
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        at = np.frombuffer(texts.buffers()[1], dtype=offset_type(texts))[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            end = min(max(end, first + 1), batch.num_rows)
            yield batch.slice(first, end - first)
            first = end
        held += int(at[-1] - at[0])
        if held > 16 * limit:
            held = 0
            trim()
    trim()


def offset_type(array: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, nulls as empty, and the n + 1 offsets of its values."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = offset_type(texts)
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[s : s + n]`` over all pairs of ``starts`` and ``lengths``."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    step = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    step[0] = s[0]
    step[np.cumsum(n)[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return flat[np.cumsum(step)]


class ChunkTable:
    """Distinct-chunk table: every distinct chunk is segmented once, ids are joined back by position.

    ``encode`` maps a list of distinct chunks to a list of id arrays. The table is emptied when it holds
    ``limit`` chunks or about ``most`` bytes, so its memory is bounded however many distinct chunks a partition has
    and however long they are; a chunk of over ``longest`` characters isn't kept at all.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], limit: int = 300_000, most: int = 96 << 20, longest: int = 1024):
        self.encode, self.limit, self.most, self.longest = encode, limit, most, longest
        self.known: dict[str, np.ndarray] = {}
        self.size = 0

    def look_up(self, chunks: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[str]]:
        """The number of the distinct chunk at each position, the ids of each distinct chunk, and these chunks."""
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > self.limit or self.size > self.most:
            self.known, self.size = {}, 0
        known = self.known
        new = [w for w in words if w not in known]
        if not new:
            return coded.indices.to_numpy(), [known[w] for w in words], words
        own = dict(zip(new, self.encode(new), strict=True))
        found = [known[w] if w in known else own[w] for w in words]
        kept = {w: x for w, x in own.items() if len(w) <= self.longest}
        self.size += sum(map(len, kept)) * 5 + 200 * len(kept)
        known.update(kept)
        return coded.indices.to_numpy(), found, words


def chunked(texts: pa.Array, marks: bytes) -> tuple[pa.Array, np.ndarray]:
    """Cut texts before every run of the ASCII bytes ``marks``. Returns all chunks and n + 1 offsets of each text's chunks."""
    body, at = utf8(texts)
    if not len(body):
        return pa.array([], pa.string()), np.zeros(len(at), np.int64)
    table = np.zeros(256, bool)
    table[list(marks)] = True
    mark = table[body]
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start[at[:-1][at[:-1] < at[1:]]] = True
    where = np.flatnonzero(start)
    offsets = np.append(where, len(body)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(body))
    return chunks, np.searchsorted(where, at)
