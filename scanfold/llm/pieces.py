"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
_models: dict[str, Model] = {}


class Model:
    """A sentencepiece model and its table of distinct marked words."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(open(path, "rb").read())
        norm = spec.normalizer_spec
        pieces = [p.piece for p in spec.pieces if p.type in (1, 4, 5)]
        #: Pieces can't cross a marker: a marker stands only at a piece's start, or the piece is markers alone; the text isn't rewritten otherwise.
        self.splits = (
            not any(MARK in p.lstrip(MARK) or " " in p for p in pieces)
            and not any(p.type == 4 for p in spec.pieces)
            and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces
            and norm.escape_whitespaces
            and not norm.precompiled_charsmap
            and not spec.trainer_spec.treat_whitespace_as_suffix
        )
        self.alone = np.array([self.processor.piece_to_id(MARK)], np.int32)
        self.end = self.processor.eos_id()
        self.table = common.ChunkTable(self._segment)

    def _segment(self, words: list[str]) -> list[np.ndarray]:
        """Each word begins with markers, one of which the library adds by itself."""
        found = self.processor.encode([w[1:] for w in words], num_threads=1)
        return [self.alone if w == " " else np.array(x, np.int32) for w, x in zip(words, found, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, without end ids, and n + 1 offsets."""
        texts = texts.cast(pa.string()).fill_null("") if texts.null_count else texts.cast(pa.string())
        if not self.splits:
            ids = [np.array(x, np.int32) for x in self.processor.encode(texts.to_pylist(), num_threads=1)]
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)])
        texts = pc.replace_substring(texts, MARK, " ")
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        chunks, at = common.chunked(marked, b" ")
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        index, ids, _ = self.table.look_up(chunks)
        size = np.array([len(x) for x in ids], np.int64)
        lengths = size[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return common.ragged(np.concatenate(ids), (np.cumsum(size) - size)[index], lengths), ends[at]


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """Ids of every whole text, exactly as the sentencepiece library gives them: (doc_id, ids array<int>).

    When no piece of the model crosses a whitespace marker, each distinct marked word of a worker's table is
    segmented once and its ids are joined back by position; for another model whole texts are segmented. A null
    or empty text has the end id alone. Null ids, repeated rows and other columns are carried or ignored as
    they are; an empty table gives no rows.
    """
    work = common.with_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in common.text_slices(batches, "text"):
            flat, at = own.encode(batch.column("text"))
            if add_end:
                flat, at = np.insert(flat, at[1:], own.end), at + np.arange(len(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The library's decode(ids) of every row: (doc_id, ids, text). Null ids decode to an empty text."""
    work = common.with_small_batches(encoded).select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = model(path).processor
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ids = batch.column("ids")
                flat, at = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
                texts = [processor.decode(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
