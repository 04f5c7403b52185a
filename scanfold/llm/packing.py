"""Sequence packing with a fixed number of open windows."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, part long, leftover boolean"
WHITE = b" \t\n\v\f\r"
_models: dict[str, bpe.WordBPE] = {}


class Packer:
    """Bounded-space online packing.

    At most ``windows`` windows are open. A piece goes into the open window that it fills best. When none
    has room, the fullest is topped up with the head of the piece (a document may be cut freely) and emitted.
    """

    def __init__(self, capacity: int = 4096, windows: int = 32, first_id: int = 0):
        self.capacity, self.windows, self.next_id = capacity, windows, first_id
        self.slack: list[int] = []  # ascending, beside the open windows in `open`
        self.open: list[list] = []  # [id, used, pieces]

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Place a document's ids from ``start`` on; yields each window that is emitted, as its id and pieces."""
        at = 0
        while at < len(ids):
            left = len(ids) - at
            if left >= self.capacity:
                yield self.next_id, [(doc, start + at, ids[at : at + self.capacity], 0)]
                self.next_id += 1
                at += self.capacity
                continue
            k = bisect.bisect_left(self.slack, left)
            if k == len(self.slack) and len(self.slack) < self.windows:
                self.slack.append(self.capacity)
                self.open.append([self.next_id, 0, []])
                self.next_id += 1
            elif k == len(self.slack):
                k = 0
            n = min(left, self.slack.pop(k))
            window = self.open.pop(k)
            window[2].append((doc, start + at, ids[at : at + n], window[1]))
            window[1] += n
            at += n
            if window[1] == self.capacity:
                yield window[0], window[2]
            else:
                k = bisect.bisect_left(self.slack, self.capacity - window[1])
                self.slack.insert(k, self.capacity - window[1])
                self.open.insert(k, window)

    def rest(self) -> Iterator[tuple[int, list]]:
        """The windows still open."""
        for number, _, pieces in self.open:
            yield number, pieces


def tokenized(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and n + 1 offsets.

    Where the tokenizer is of the examined kind, neither normalisation nor the split pattern crosses white space, so each
    distinct chunk between white space is merged once; another tokenizer gets whole texts.
    """
    if path not in _models:
        _models[path] = bpe.WordBPE(path)
    if not _models[path].exact:
        found = [np.array(e.ids, np.uint32) for e in _models[path].tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
    chunks, at = common.chunked(texts, WHITE)
    if not len(chunks):
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
    coded = chunks.dictionary_encode()
    ids, size = _models[path].encode(coded.dictionary)
    index = coded.indices.to_numpy()
    lengths = size[index]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return common.ragged(ids.astype(np.uint32), (np.cumsum(size) - size)[index], lengths), ends[at]


def _batches(rows: Iterator[tuple], part: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for (doc, total), start, ids, sequence, offset, leftover in rows:
        held.append((doc, start, len(ids), total, ids.tobytes(), sequence, offset, part, leftover))
        size += held[-1][2] * 4 + 64
        if size > limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _drain(packer: Packer, sources: Iterator[tuple], part: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for doc, start, ids in sources:
            for number, pieces in packer.add(doc, start, ids):
                for d, s, x, o in pieces:
                    yield d, s, x, number, o, False
        for number, pieces in packer.rest():
            for d, s, x, o in pieces:
                yield d, s, x, number, o, True

    return _batches(rows(), part)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096, windows: int = 32, fan_in: int = 64) -> DataFrame:
    """Pack the tokens of all documents into sequences of ``capacity`` ids.

    Returns a row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id,
    offset. Every id of a document, its end id included, lies in exactly one piece. Each partition keeps
    ``windows`` open windows; what is open at its end is merged over ``fan_in`` partitions at a time, until one
    sequence at most is not full. A null or empty text is the end id alone; null ids and repeated rows are
    documents of their own; a very long text is cut over as many sequences as it takes; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    work = common.with_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def sources() -> Iterator[tuple]:
            for batch in common.text_slices(batches, "text"):
                flat, at = tokenized(batch.column("text"), tokenizer)
                for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                    ids = np.append(flat[at[k] : at[k + 1]], np.uint32(end_id))
                    yield (doc, len(ids)), 0, ids

        return _drain(Packer(capacity, windows, part << 28), sources(), part)

    table = common.written(work.mapInArrow(first, SCHEMA), "packed", compression="zstd")
    done, rest, whole = table.where("not leftover"), table.where("leftover"), table
    parts, level = (table.agg(F.max("part")).first()[0] or 0) + 1, 0
    while level == 0 or parts > 1:
        parts, level = -(-parts // fan_in), level + 1

        def merge(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            """Rows come in order of their group; each group fills one window after another, and only that window is held."""

            def pieces() -> Iterator[tuple]:
                for batch in batches:
                    yield from zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "doc_tokens", "start", "ids")), strict=True)

            for part, group in itertools.groupby(pieces(), key=lambda r: r[0]):
                sources = (((doc, total), start, np.frombuffer(ids, np.uint32)) for _, doc, total, start, ids in group)
                yield from _drain(Packer(capacity, 1, level << 56 | part << 28), sources, part)

        grouped = rest.withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        merged = grouped.repartition(min(parts, 4096), "part").sortWithinPartitions("part", "sequence_id", "offset")
        table = common.written(merged.mapInArrow(merge, SCHEMA), "merged", compression="zstd")
        done, rest = done.unionByName(table.where("not leftover")), table.where("leftover")
    return done.unionByName(rest).drop("part", "leftover")
