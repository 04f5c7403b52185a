"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
SLICE = 192 << 10


class Profiler:
    """Bundles of bound, permuted letter vectors.

    Every letter has a random vector of +1 and -1, drawn from its code point alone; what stands between letters is
    one blank. The n-gram abc is the product of a's vector rolled twice, b's rolled once and c's; a document is the
    sum of its n-grams.
    """

    def __init__(self, dims: int = 1024, n: int = 3, seed: int = 7):
        self.dims, self.n, self.seed = dims, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.kind: dict[int, bool] = {}

    def _vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            self.letters[code] = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dims, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def _is_letter(self, code: int) -> bool:
        if code not in self.kind:
            self.kind[code] = chr(code).isalpha()
        return self.kind[code]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """texts x dims sums of n-gram vectors, and which texts have a letter."""
        return self.profile(texts)[:2]

    def profile(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``bundle``, and each text's size class: the binary logarithm of how many n-grams, equally frequent, would say as much."""
        lows = [(t or "").lower() for t in texts]
        codes = np.frombuffer("".join(f"\n{t}\n" for t in lows).encode("utf-32-le", "surrogatepass"), np.uint32)
        found, at = np.unique(codes, return_inverse=True)
        letter = np.array([self._is_letter(int(c)) for c in found], bool)
        number = np.where(letter, np.cumsum(letter), 0)
        own = [0, *(int(c) for c in found[letter])]
        ids = number[at]
        doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lows])
        # runs of what isn't a letter become one blank
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0) | (doc[1:] != doc[:-1])
        ids, doc = ids[keep], doc[keep]
        out, size = np.zeros((len(texts), self.dims), np.float32), np.zeros(len(texts), np.int64)
        has = np.bincount(doc[ids > 0], minlength=len(texts)) > 0
        if len(ids) < self.n:
            return out, has, size
        width = len(own)
        gram = ids[: len(ids) - self.n + 1].astype(np.int64)
        for k in range(1, self.n):
            gram = gram * width + ids[k : len(ids) - self.n + 1 + k]
        same = (doc[: len(gram)] == doc[self.n - 1 :]) & (gram > 0)
        if self.n > 1:  # a blank may only stand at an n-gram's edges
            inner = np.ones(len(gram), bool)
            for k in range(1, self.n - 1):
                inner &= ids[k : len(gram) + k] > 0
            same &= inner
        gram, of = gram[same], doc[: len(same)][same]
        grams, index = np.unique(gram, return_inverse=True) if width**self.n > 1 << 21 else _dense(gram, width**self.n)
        if not len(grams):
            return out, has, size
        table = np.stack([self._vector(c) for c in own])
        bound = np.ones((len(grams), self.dims), np.int8)
        rest = grams.copy()
        for k in range(self.n):
            bound *= np.roll(table, k, axis=1)[rest % width]
            rest //= width
        counts = np.bincount(of * len(grams) + index, minlength=len(texts) * len(grams)).reshape(len(texts), -1)
        own = counts.astype(np.float64)
        alike = own.sum(axis=1) ** 2 / np.maximum((own * own).sum(axis=1), 1)
        return counts.astype(np.float32) @ bound.astype(np.float32), has, np.log2(np.maximum(alike, 1)).astype(np.int64)


def _dense(gram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(size, bool)
    seen[gram] = True
    grams = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[grams] = np.arange(len(grams), dtype=np.int32)
    return grams, place[gram].astype(np.int64)


#: Unit vectors are summed, and scores counted, in whole numbers of such parts, so the order of rows doesn't matter; sums of 2 ** 38 rows of a label fit 64 bits.
PARTS = 2**24
#: A label's share of rows to learn from is a whole number of such parts.
SHARES = 2**62


def sampling_steps(per_label: int, rows: int) -> int:
    """How many of ``SHARES`` parts of a label's ``rows`` give about ``per_label`` of them; one at least."""
    return SHARES if rows <= per_label else max(1, per_label * SHARES // rows)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _sums(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for label, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([x], pa.list_(pa.int64()))], names=["lang", "sums"])


def _batched(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in common.text_slices(batches, column, SLICE):
        for first in range(0, batch.num_rows, 128):
            yield batch.slice(first, 128)


class LanguageModel:
    """Prototypes of languages; each is the bundle of the unit vectors of its documents.

    ``limits``: the least score of a text of each label, by size class; a class without a row has that of the next smaller one.
    """

    def __init__(self, labels: list[str], prototypes: np.ndarray, dims: int, n: int, limits: np.ndarray | None = None):
        self.labels, self.prototypes, self.dims, self.n, self.limits = labels, prototypes, dims, n, limits

    @classmethod
    def fit(
        cls, docs: DataFrame, *, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int | None = None, dims: int = 1024, n: int = 3, limits: bool = False, most_labels: int = 10_000
    ) -> LanguageModel:
        """Learn from every row that has a label and a text. More than ``most_labels`` labels are an error: such a column names something else than languages.

        ``per_label`` asks for a sample instead: about so many rows of each label at most, chosen by a hash of the text and the id,
        if there is one. A label's share is counted in steps of 2 ** -62 and is one step at least, so none is too large to be learned.

        Rows with a null label or text teach nothing, and rows that repeat teach each time. Texts aren't shuffled: each task sends
        one sum for each label it saw, 16 tasks add them, and the driver gets a count and one prototype for each label. With
        ``limits`` the same rows are judged once more, each by the others of its label; three quarters of the score that 99 % of a
        label's rows of one size class reach is the least for that class, and no least is below three standard deviations of the
        score of texts that share no n-gram. All scores are counted, in steps of 2 ** -24.
        """
        labelled = common.with_small_batches(docs).where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
        own_id = F.col(id_col).cast("string") if id_col in docs.columns else F.lit(None).cast("string")
        work = labelled.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), own_id.alias("id"))
        rows = labelled.groupBy(F.col(label_col).cast("string").alias("lang")).count().limit(most_labels + 1).collect()
        sizes = {r["lang"]: r["count"] for r in rows}
        if len(sizes) > most_labels:
            raise ValueError(f"{label_col} has more than {most_labels} labels")
        if not sizes:
            return cls([], np.zeros((0, dims), np.float32), dims, n)
        if per_label is not None:
            share = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, sampling_steps(per_label, v))))
            work = work.where(F.pmod(F.xxhash64("text", "id"), F.lit(SHARES)) < share[F.col("lang")]).repartition(16)
        work = work.drop("id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiler, sums = Profiler(dims, n), {}
            for batch in _batched(batches, "text"):
                bundles, has = profiler.bundle(batch.column("text").to_pylist())
                own, parts = np.array(batch.column("lang").to_pylist(), object), np.round(_units(bundles).astype(np.float64) * PARTS).astype(np.int64)
                for label in set(own[has]):
                    sums[label] = sums.get(label, 0) + parts[has & (own == label)].sum(axis=0)
            yield from _sums(sums)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for label, x in zip(batch.column("lang").to_pylist(), batch.column("sums").flatten().to_numpy().reshape(-1, dims), strict=True):
                    sums[label] = sums.get(label, 0) + x
            yield from _sums(sums)

        shape = "lang string, sums array<long>"
        totals = {r["lang"]: np.array(r["sums"], np.int64) for r in work.mapInArrow(run, shape).repartition(16, "lang").mapInArrow(add, shape).collect()}
        labels = sorted(totals)
        stacked = np.stack([totals[x] for x in labels]).astype(np.float64) if labels else np.zeros((0, dims))
        model = cls(labels, _units(stacked).astype(np.float32), dims, n)
        if limits:
            model.limits = cls._limits(work, labels, totals, dims, n)
        return model

    @staticmethod
    def _limits(rows: DataFrame, labels: list[str], totals: dict[str, np.ndarray], dims: int, n: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiler = Profiler(dims, n)
            for batch in _batched(batches, "text"):
                bundles, has, size = profiler.profile(batch.column("text").to_pylist())
                units, own = _units(bundles).astype(np.float64), np.array(batch.column("lang").to_pylist(), object)
                others = _units(np.stack([totals[x] if ok else np.zeros(dims) for x, ok in zip(own, has, strict=True)]) - np.round(units * PARTS))
                score = np.floor((units * others).sum(axis=1) * PARTS).astype(np.int64)
                keep = has & others.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own[keep], pa.string()), pa.array(size[keep], pa.int64()), pa.array(score[keep], pa.int64())], names=["lang", "size", "score"])

        # the percentile between two ranks, from counts by score: an aggregate that keeps a group's scores has no room for all rows of a language
        group = Window.partitionBy("lang", "size")
        counted = rows.mapInArrow(run, "lang string, size long, score long").groupBy("lang", "size", "score").count()
        upto = counted.select("lang", "size", "score", F.sum("count").over(group.orderBy("score")).alias("upto"), (F.sum("count").over(group) - 1).alias("last"))
        at = lambda rank: F.min(F.when(F.col("upto") > F.least(F.expr(rank), F.col("last")), F.col("score")))
        low, high = at("last div 100"), at("last div 100 + 1")
        found = upto.groupBy("lang", "size").agg(((low + (high - low) * F.max(F.col("last") % 100) / 100) / PARTS).alias("low")).collect()
        least = 3 / np.sqrt(dims)
        out = np.full((len(labels), 64), np.nan)
        for r in found:
            out[labels.index(r["lang"]), r["size"]] = max(least, 0.75 * r["low"])
        for row in out:
            known = np.flatnonzero(~np.isnan(row))
            row[:] = row[known[np.maximum(np.searchsorted(known, np.arange(64), "right") - 1, 0)]] if len(known) else least
        return out

    def judge(self, profiler: Profiler, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text, and the cosine with its prototype, from 0 to 1."""
        return self._judged(*profiler.bundle(texts))

    def _judged(self, bundles: np.ndarray, has: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNKNOWN] * len(has), [0.0] * len(has)
        cosines = np.clip(_units(bundles) @ self.prototypes.T, 0, 1)
        best = cosines.argmax(axis=1)
        return [self.labels[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], [float(c[b]) if h else 0.0 for c, b, h in zip(cosines, best, has, strict=True)]

    def predict(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, lang_pred, score) for every row; only the text is looked at.

        A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing was learned.
        Ties go to the label first in order. Null ids and repeated rows are judged row by row; very long texts are bundled
        whole; other columns are ignored, whatever their names; an empty table gives no rows.
        """
        work, own = common.with_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiler = Profiler(own.dims, own.n)
            for batch in _batched(batches, "text"):
                labels, scores = own.judge(profiler, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return work.mapInArrow(run, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

    def kept(self, docs: DataFrame, *, text_col: str = "text", least: float | None = 0.0) -> DataFrame:
        """The rows, with all their columns, whose language is known with a score of ``least`` or more; None: with the model's ``limits``.

        Rows without a text or a letter go; repeated rows are judged alike, row by row; ids and other columns are carried along;
        very long texts are judged whole; an empty table stays empty, and a model that learned nothing keeps nothing.
        """
        own, place = self, {x: k for k, x in enumerate(self.labels)}
        if least is None and self.labels and self.limits is None:
            raise ValueError("the model was fitted without limits")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            profiler = Profiler(own.dims, own.n)
            for batch in _batched(batches, text_col):
                bundles, has, size = profiler.profile(batch.column(text_col).to_pylist())
                labels, scores = own._judged(bundles, has)
                yield batch.filter(pa.array([bool(ok) and x in place and s >= (own.limits[place[x], k] if least is None else least) for x, s, k, ok in zip(labels, scores, size, has, strict=True)], pa.bool_()))

        return common.with_small_batches(docs).mapInArrow(run, docs.schema)
