"""Exact top-k inner products with an impact-ordered index, read score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


class ImpactIndex:
    """Postings of a block of integer vectors.

    For each dimension the vectors are ordered by component and cut into segments of equal quantised impact; the
    ids of a segment lie together. A query takes segments of all dimensions in descending order of the product of
    its own component and the segment's impact, measured from the smallest product that dimension allows.
    """

    def __init__(self, vectors: np.ndarray, levels: int = 96):
        self.vectors = vectors
        n, dims = vectors.shape
        lo, hi = vectors.min(axis=0), vectors.max(axis=0)
        width = np.maximum(1, -(-(hi - lo + 1) // levels))
        level = (vectors - lo) // width
        self.lo, self.hi = lo, hi
        #: Of each dimension: ids in ascending order of impact, and the least and the greatest component of each id's segment.
        self.ids, self.low, self.high = [], [], []
        segment_dim, self.cuts, low, high = [], [], [], []
        for d in range(dims):
            order = np.argsort(level[:, d], kind="stable")
            down = lo[d] + level[order, d] * width[d]
            up = np.minimum(down + width[d] - 1, hi[d])
            cuts = np.flatnonzero(np.diff(level[order, d], prepend=-1))
            self.ids.append(order)
            self.low.append(down)
            self.high.append(up)
            self.cuts.append(np.append(cuts, n).tolist())
            segment_dim.append(np.full(len(cuts), d))
            low.append(down[cuts])
            high.append(up[cuts])
        self.segment_dim, self.segment_low, self.segment_high = map(np.concatenate, (segment_dim, low, high))

    def search(self, query: np.ndarray, k: int, skip: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of every vector that may be among the ``k`` best besides those marked in ``skip``.

        Sums hold each vector's least possible gain from the segments read. Rounds of segments are read in descending
        order of their greatest gain, until what all unread ones can still add, together with the width of those
        read, proves that only few vectors can reach the k-th best sum; these are rescored.
        """
        n, q = len(self.vectors), query.astype(np.int64)
        base = np.where(q > 0, q * self.lo, q * self.hi)
        own = q[self.segment_dim]
        most = np.where(own > 0, own * self.segment_high, own * self.segment_low) - base[self.segment_dim]
        wide = np.abs(own) * (self.segment_high - self.segment_low)
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        dim, top, wide = self.segment_dim[order], most[order], wide[order]
        # In each dimension segments come in descending order: its next unread one bounds what it can still add.
        by_dim = np.argsort(dim, kind="stable")
        follows = np.append(dim[by_dim[1:]] == dim[by_dim[:-1]], False)
        drop = top.copy()
        drop[by_dim] -= np.where(follows, np.append(top[by_dim[1:]], 0), 0)
        after = drop.sum() - np.cumsum(drop)
        sums = np.zeros(n, np.int64)
        sums[skip] = -(2**62)
        slack, read = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        few, done, step = max(4 * k, n // 64), 0, max(1, len(order) // rounds)
        possible = ~skip
        while n - np.count_nonzero(skip) > k and done < len(order):
            now = slice(done, min(len(order), done + (step if done else 4 * step)))
            counts, ids, gains = np.bincount(dim[now], minlength=len(q)), [], []
            for d in np.flatnonzero(counts).tolist():
                cuts, a, b = self.cuts[d], int(read[d]), int(read[d] + counts[d])
                if q[d] > 0:
                    part, values = slice(cuts[len(cuts) - 1 - b], cuts[len(cuts) - 1 - a]), self.low[d]
                else:
                    part, values = slice(cuts[a], cuts[b]), self.high[d]
                ids.append(self.ids[d][part])
                gains.append(q[d] * values[part] - base[d])
            np.add.at(sums, np.concatenate(ids), np.concatenate(gains))
            read += counts
            np.maximum.at(slack, dim[now], wide[now])
            done = now.stop
            possible = sums >= np.partition(sums, n - k)[n - k] - after[done - 1] - slack.sum()
            if np.count_nonzero(possible) <= few:
                break
        at = np.flatnonzero(possible & ~skip)
        return at, self.vectors[at] @ q


def top_k(
    vectors: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, scale: int = 256, block: int = 131_072, least: int = 4096
) -> DataFrame:
    """The ``k`` best inner products of each query with all other rows: query_id, rank, vec_id, score.

    Components become floor(``scale`` * x). Queries are the rows whose id is divisible by ``every``. The index is cut into
    blocks of about ``block`` rows, or of ``least`` at least where more blocks are needed to keep every core busy. A block is one
    task's: it builds its index once and streams all queries past it, a batch at a time, and answers each with ``k`` rows. No side is
    broadcast, no task holds more than a block and a batch. Queries are copied to each block, so the work is exhaustive in blocks,
    and within a block the index stops on proof.

    Ties go to smaller ids. Vectors that are null, or hold a null or non-finite component, and rows without an id take no
    part; a shorter vector counts as if zeros followed; repeated ids are rows of their own, but none answers a query of
    its own id; scores that might not fit a long are an error; other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    x = F.col(vector_col)
    # read as floats, components become exact doubles
    whole = F.transform(x.cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))
    bad = F.exists(x.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    total = rows.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total // block), min(cores, total // least))
    index = rows.select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("cb"), F.lit(0).alias("kind"), "id", "v")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).select(each.alias("cb"), F.lit(1).alias("kind"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block: its vectors, then the queries."""
        cb, held, index = None, [], None
        for batch in batches:
            block_of = batch.column("cb").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(block_of) != 0) | (np.diff(batch.column("kind").to_numpy()) != 0)) + 1).tolist(), batch.num_rows]
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if block_of[a] != cb:
                    cb, held, index = block_of[a], [], None
                if part.column("kind")[0].as_py() == 0:
                    held.append(part)
                elif held:
                    if index is None:
                        ids, own = _matrix(pa.Table.from_batches(held))
                        index = ImpactIndex(own)
                    for i, q in zip(*_matrix(pa.Table.from_batches([part]), own.shape[1]), strict=True):
                        at, score = index.search(q, k, ids == i)
                        best = np.lexsort((ids[at], -score))[:k]
                        out.append((np.full(len(best), i), ids[at[best]], score[best]))
            columns = [np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    laid = common.with_small_batches(index.unionByName(queries)).repartitionById(blocks, F.col("cb"))
    near = laid.sortWithinPartitions("cb", "kind").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in ascending order of ids; vectors are cut or filled with zeros to ``dims``, which the other side's zeros make good."""
    lists = t.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ids, flat = t.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(at)
    width = dims or max(1, int(sizes.max(initial=1)))
    v = np.zeros((len(ids), width), np.int64)
    row, place = np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(at[:-1], sizes)
    fits = place < width
    v[row[fits], place[fits]] = flat[fits]
    if len(v) and int(np.abs(v.astype(np.float64)).max()) ** 2 * width >= 2**60:
        raise ValueError("components too large for scores of 64 bits")
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]
