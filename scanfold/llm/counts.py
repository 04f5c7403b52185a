"""Token counts of a unigram vocabulary, without the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_counters: dict[str, Counter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from a sentencepiece file: its pieces in order, log scores by rank.

    The ranks follow Zipf's law; scores are multiples of 1/1024, so that sums of them are exact in any order and
    ties are true ties. Entry 0 is the unknown piece; the 256 byte pieces are kept for bytes of unknown characters.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    found: list[tuple[str, float]] = []
    rank = 0
    for i in range(m.get_piece_size()):
        if m.is_byte(i) or m.is_unknown(i) or m.is_control(i):
            found.append((m.id_to_piece(i), -20.0))
        else:
            rank += 1
            found.append((m.id_to_piece(i), -round(1024 * math.log(rank + 1)) / 1024))
    return found


def library_tokenizer(path: str):
    """The same vocabulary as a Unigram model of the tokenizers library, to compare with."""
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.Unigram(vocabulary(path), unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(MARK), normalizers.Replace(" ", MARK)])
    return t


class Counter:
    """Count-only Viterbi over the matches that an Aho-Corasick automaton enumerates.

    Tie rule of the tokenizers library: among equal sums the match that begins first, so the longest, stays; a
    single unknown character is tried after the vocabulary, only where no piece is that character alone.
    """

    def __init__(self, path: str):
        import ahocorasick

        words = vocabulary(path)
        self.special = {w for w, _ in words[:3]}
        usable = [(w, s) for i, (w, s) in enumerate(words) if i]
        self.automaton = ahocorasick.Automaton()
        for w, s in usable:
            self.automaton.add_word(w, (len(w), s))
        self.automaton.make_automaton()
        self.single = {w for w, _ in usable if len(w) == 1}
        self.unknown = min(s for _, s in words) - UNKNOWN_PENALTY
        self.splits = not any(MARK in w.lstrip(MARK) or " " in w for w, _ in usable)
        self.table = common.ChunkTable(self._all)

    def best(self, word: str) -> tuple[int, float]:
        """The number of pieces of the best segmentation, and its score. Each unknown character counts its UTF-8 bytes."""
        if self.single.issuperset(word):
            # every place ends a match; the automaton tells a place's matches one after another, the longest first
            score, pieces, place, top, count = [0.0], [0], 0, -math.inf, 0
            for end, (size, s) in self.automaton.iter(word):
                if end != place:
                    score.append(top)
                    pieces.append(count)
                    place, top = end, -math.inf
                start = end + 1 - size
                if (x := score[start] + s) > top:
                    top, count = x, pieces[start] + 1
            return (count, top) if word else (0, 0.0)
        n = len(word)
        score, pieces = [0.0] + [-math.inf] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):
            ends[end + 1].append(match)
        for e in range(1, n + 1):
            top, count = -math.inf, 0
            for size, s in sorted(ends[e], reverse=True):
                if (x := score[e - size] + s) > top:
                    top, count = x, pieces[e - size] + 1
            c = word[e - 1]
            if c not in self.single and (x := score[e - 1] + self.unknown) > top:
                top, count = x, pieces[e - 1] + len(c.encode())
            score[e], pieces[e] = top, count
        return pieces[n], score[n]

    def _all(self, words: list[str]) -> list[tuple[int, float]]:
        return [self.best(w.replace(" ", MARK)) for w in words]

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece counts and scores of whole texts."""
        texts = texts.cast(pa.string()).fill_null("") if texts.null_count else texts.cast(pa.string())
        texts = pc.replace_substring(texts, MARK, " ")
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        if not self.splits:
            both = [self.best(t.replace(" ", MARK)) for t in marked.to_pylist()]
            return np.array([n for n, _ in both], np.int64), np.array([s for _, s in both], np.float64)
        chunks, at = common.chunked(marked, b" ")
        if not len(chunks):
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        index, best, _ = self.table.look_up(chunks)
        sums = []
        for k, kind in ((0, np.int64), (1, np.float64)):
            ends = np.concatenate([[0], np.cumsum(np.array([b[k] for b in best], kind)[index])])
            sums.append(ends[at[1:]] - ends[at[:-1]])
        return sums[0], sums[1]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The number of unigram pieces of every whole text: (doc_id, n_tokens long, score double), score that of the best segmentation.

    A null or empty text has 0 pieces and score 0. Null ids, ties and repeated rows are counted row by row; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    work = common.with_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in common.text_slices(batches, "text"):
            n, score = own.count(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, n_tokens long, score double")
