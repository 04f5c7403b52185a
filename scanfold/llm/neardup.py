"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
#: Texts of more bytes are hashed in pieces of about so many.
PIECE = 1 << 20
_ROUND = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))

#: A set of shingles: 128 bits of each, as two arrays in ascending order of the first.
Shingles = tuple[np.ndarray, np.ndarray]
NONE: Shingles = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """128 bits of each word, from its BLAKE2b digest; short words are remembered while they are few."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[bytes, bytes] = {}
        self.limit = limit

    def hashes(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words x 2 hashes of all words, A-Z as a-z, and where each text's words begin; words end at ``at``, the texts' edges."""
        inside = ~_SPACE[body]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = at[:-1][at[:-1] < at[1:]]
        first[edges] = inside[edges]
        ends = at[1:][at[:-1] < at[1:]] - 1
        last[ends] = inside[ends]
        starts = np.flatnonzero(first)
        sizes = np.flatnonzero(last) + 1 - starts
        if not len(starts):
            return np.zeros((0, 2), np.uint64), np.zeros(len(at), np.int64)
        data, offsets = _LOWER[body[inside]], np.concatenate([[0], np.cumsum(sizes)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        if len(known) + len(distinct) > self.limit:
            known.clear()
        found = []
        for w in distinct:
            h = known.get(w)
            if h is None:
                h = hashlib.blake2b(w, digest_size=16).digest()
                if len(w) <= 64:
                    known[w] = h
            found.append(h)
        table = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
        return table[coded.indices.to_numpy(zero_copy_only=False)], np.searchsorted(starts, at)


_words = Words()


def _windows(words: np.ndarray, n: int) -> list[np.ndarray]:
    """Both hashes of every run of ``n`` words."""
    out = []
    for lane, k in enumerate(_ROUND):
        w = words[:, lane]
        x = w.copy()
        for j in range(1, n):
            x = _mix(x[: len(w) - j] * k + w[j:]) if len(w) > j else x[:0]
        out.append(x)
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> Shingles:
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two shingles that share the first half
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
    keep = np.ones(len(a), bool)
    keep[1:] = ~same | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _whole(words: np.ndarray) -> Shingles:
    """The only shingle of a text of fewer words than a shingle has."""
    out = []
    for lane, k in enumerate(_ROUND):
        x = words[:1, lane]
        for j in range(1, len(words)):
            x = _mix(x * k + words[j, lane])
        out.append(_mix(x + np.uint64(len(words))))
    return out[0], out[1]


def _long_set(body: np.ndarray, n: int) -> Shingles:
    """The set of one long text, piece by piece; a piece ends at white space, and the last words of one go before the next."""
    parts, carry, at, short = [], np.zeros((0, 2), np.uint64), 0, True
    while at < len(body):
        end = min(len(body), at + PIECE)
        while end < len(body):
            gap = np.flatnonzero(_SPACE[body[end : end + PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(body), end + PIECE)
        words, _ = _words.hashes(body[at:end], np.array([0, end - at]))
        words = np.concatenate([carry, words])
        if len(words) >= n:
            parts.append(_distinct(*_windows(words, n)))
            short = False
        carry, at = words[max(0, len(words) - n + 1) :] if n > 1 else words[:0], end
    if short:
        return _whole(carry) if len(carry) else NONE
    # merged by ranges of the first hash, so that no second copy of all is sorted at once
    cuts = np.arange(1, 32, dtype=np.uint64) << np.uint64(59)
    edges = [[0, *np.searchsorted(a, cuts).tolist(), len(a)] for a, _ in parts]
    total, size = sum(len(a) for a, _ in parts), 0
    out = np.empty(total, np.uint64), np.empty(total, np.uint64)
    for r in range(32):
        a, b = _distinct(*(np.concatenate([p[lane][e[r] : e[r + 1]] for p, e in zip(parts, edges, strict=True)]) for lane in (0, 1)))
        out[0][size : size + len(a)], out[1][size : size + len(a)] = a, b
        size += len(a)
    return out[0][:size], out[1][:size]


def shingle_sets(texts: pa.Array, words: int) -> list[Shingles]:
    """Each text's distinct shingles, 128 bits of each drawn from digests of its words.

    A-Z count as a-z; words are what lies between spaces and the controls 9 to 13. A text with fewer than
    ``words`` words has its whole sequence as its only shingle; one without words has none. A long text is hashed
    in pieces, so that it takes a few times its own size of memory at most.
    """
    body, at = common.utf8(texts)
    if not len(body):
        return [NONE] * (len(at) - 1)
    if len(body) > 2 * PIECE:
        return [_long_set(body[a:b], words) if b > a else NONE for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    hashed, where = _words.hashes(body, at)
    both = _windows(hashed, words)
    found = []
    for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True):
        if b - a >= words:
            found.append(_distinct(both[0][a : b - words + 1], both[1][a : b - words + 1]))
        else:
            found.append(_whole(hashed[a:b]) if b > a else NONE)
    return found


def circulant_minhash(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates from two permutations: the first spreads shingles over 2 ** 32 places, the second, shifted circularly by k, gives coordinate k."""
    shift = np.arange(size, dtype=np.uint32)[:, None]
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 512):
        places = (_mix(shingles[a : a + 512] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
        h = places[None, :] + shift
        t = np.empty_like(h)
        for right, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(h, np.uint32(right), out=t)
            np.bitwise_xor(h, t, out=h)
            if by is not None:
                np.multiply(h, np.uint32(by), out=h)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def banding(threshold: float, rows: int = 5, miss: float = 1e-7) -> tuple[int, int]:
    """Bands and rows with which a pair at the threshold shares no band with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: row, doc_id, n_shingles, h1 and h2 (a digest of the set), keys (one for each band), sig (a byte of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in common.text_slices(batches, "text", 1 << 19):
            n, digests, keys, sig = [], [], [], []
            for a, b in shingle_sets(batch.column("text"), words):
                n.append(len(a))
                h = hashlib.blake2b(a.tobytes(), digest_size=16)
                h.update(b.tobytes())
                digests.append(h.digest())
                if len(a):
                    low = circulant_minhash(a, bands * rows)
                    grid, key = low.reshape(bands, rows), salt.copy()
                    for k in range(rows):
                        key = _mix(key * _ROUND[0] + grid[:, k])
                    keys.append(key.view(np.int64))
                    sig.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                else:
                    keys.append(np.zeros(0, np.int64))
                    sig.append(b"")
            at = np.cumsum([0, *map(len, keys)])
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys)))
            out = [pa.array(n, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists, pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *out], names=["row", "doc_id", "n_shingles", "h1", "h2", "keys", "sig"])

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary")


def roles(pairs: DataFrame) -> DataFrame:
    """What each text has to do with ``pairs`` (a, b): (rep, a, part, role), role 0 as the first of them, 1 as the second.

    A first text goes to a part for each 256 of its partners, so none with many partners is one task's work.
    """
    cut = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("long").alias("cuts"))
    both = pairs.join(cut, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cuts")).alias("part"))
    return both.select(F.col("b").alias("rep"), "a", "part", F.lit(1).alias("role")).unionByName(both.select(F.col("a").alias("rep"), "a", "part", F.lit(0).alias("role")).distinct())


def confirmed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (a, b) whose full shingle sets have at least ``percent`` of their union in common; ``rows`` are :func:`roles` with texts."""
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None
        for batch in common.text_slices(batches, "text", 1 << 19):
            left, right = [], []
            sets = shingle_sets(batch.column("text"), words)
            for rep, a, part, role, s in zip(*(batch.column(c).to_pylist() for c in ("rep", "a", "part", "role")), sets, strict=True):
                if role == 0:
                    held, head = (a, part), s
                elif held == (a, part) and _linked(head, s, percent):
                    left.append(a)
                    right.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.select("rep", "text", "a", "part", "role").mapInArrow(run, "a long, b long")


def _linked(x: Shingles, y: Shingles, percent: int) -> bool:
    """Is ``percent`` of the union common? Shingles count as common only where all 128 bits agree."""
    small, large = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
    n = len(x[0]) + len(y[0])
    if not len(small[0]) or 100 * len(small[0]) < percent * len(large[0]):
        return False
    at = np.minimum(np.searchsorted(large[0], small[0]), len(large[0]) - 1)
    shared = int(((large[0][at] == small[0]) & (large[1][at] == small[1])).sum())
    return shared > 0 and 100 * shared >= percent * (n - shared)


def confirmed_in_cells(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The same for pairs (key, i, j, a, b): each cell of two blocks gets its texts once, however many pairs it has.

    A task holds the sets of one cell, of two blocks at most, and tests the pairs that follow them.
    """
    cell = ["key", "i", "j"]
    ends = pairs.select(*cell, F.explode(F.array("a", "b")).alias("rep")).distinct().join(texts, "rep")
    null = F.lit(None)
    rows = ends.select(*cell, F.lit(0).alias("kind"), "rep", "text", null.cast("long").alias("a"), null.cast("long").alias("b")).unionByName(
        pairs.select(*cell, F.lit(1).alias("kind"), null.cast("long").alias("rep"), null.cast("string").alias("text"), "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in common.text_slices(batches, "text", 1 << 19):
            left, right = [], []
            sets = shingle_sets(batch.column("text"), words)
            for *now, kind, rep, a, b, s in zip(*(batch.column(c).to_pylist() for c in (*cell, "kind", "rep", "a", "b")), sets, strict=True):
                if now != at:
                    at, held = now, {}
                if kind == 0:
                    held[rep] = s
                elif _linked(held.get(a, NONE), held.get(b, NONE), percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    rows = rows.repartition(*cell).sortWithinPartitions(*cell, "kind")
    return rows.select(*cell, "kind", "rep", "text", "a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) and the smallest node it is connected with, by alternating large and small stars.

    Each round is a table in the shared folder; nothing but two sums of a round reaches the driver.
    """
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = common.written(small, "stars")
        common.dropped(now)
        now = after


def _crossing(inside: DataFrame, found: DataFrame, sig: DataFrame, threshold: float, size: int) -> DataFrame:
    """Pairs (key, i, j, a, b) of a bucket whose members aren't yet in one component, where the signatures don't rule the link out; each pair in one cell.

    Buckets are cut in blocks, and a task compares two blocks; only pairs whose matching share lies within five
    standard deviations of the threshold, or above, go on to the exact test.
    """
    named = inside.join(found, inside["rep"] == found["node"], "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", F.ceil(F.col("n") / 512).cast("int").alias("blocks"))
    rows = named.join(mixed, "key").join(sig, "rep")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "rep", "root", "n_shingles", "sig", block.alias("block"), other)
    rows = rows.select("key", "rep", "root", "n_shingles", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tested(held: list[tuple]) -> pa.RecordBatch:
            rep, root, n = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            block, i, j = (np.array([h[k] for h in held], np.int64) for k in (5, 6, 7))
            sig = np.frombuffer(b"".join(h[4] for h in held), np.uint8).reshape(len(held), -1)
            out = []
            for x in np.flatnonzero(block == i):
                ok = (root != root[x]) & ((block == j) & ((i != j) | (rep > rep[x]))) & (np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]) - 1e-9)
                y = np.flatnonzero(ok)
                if len(y):
                    share = (sig[y] == sig[x]).mean(axis=1)
                    out += [(min(rep[x], r), max(rep[x], r)) for r in rep[y[share >= least]]]
            here = [pa.array([held[0][k]] * len(out), t) for k, t in ((0, pa.int64()), (6, pa.int32()), (7, pa.int32()))]
            return pa.RecordBatch.from_arrays([*here, *(pa.array([int(p[k]) for p in out], pa.int64()) for k in (0, 1))], names=["key", "i", "j", "a", "b"])

        held, at = [], None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (r[0], r[6], r[7]) != at:
                    if held:
                        yield tested(held)
                    held, at = [], (r[0], r[6], r[7])
                held.append(r)
        if held:
            yield tested(held)

    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, i int, j int, a long, b long")
    return found.groupBy("a", "b").agg(F.min("key").alias("key"), F.min_by("i", "key").alias("i"), F.min_by("j", "key").alias("j"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = 5, percent: int = 80, rows: int = 5, miss: float = 1e-7
) -> DataFrame:
    """Classes of near-duplicate documents: (row, doc_id, n_shingles long, component_id long, kept, first boolean), a row for each row of ``docs``.

    Documents are linked when 100 * common >= ``percent`` * union of their sets of distinct ``words``-word shingles;
    every link is confirmed on full sets, in which a shingle is 128 bits drawn from digests of its words. Candidates share
    a band of circulant MinHash; a pair at the threshold has none with a probability of at most ``miss``. Equal sets are
    one class from the start. Within a bucket all members are tested against the smallest, and then those that are still in
    different components against one another, in blocks of bounded size. A pair goes untested only if its signatures agree
    more than five standard deviations less than those of a pair at the threshold would.

    Null, empty and blank texts have no words and are linked with nothing. Rows without an id have a null component_id and are
    kept. ``kept`` tells whether the id is the component's smallest; ``first`` marks exactly one row of each component, one of
    the smallest id, also where ids or whole rows repeat: nodes are rows, so each row is judged by its own text. ``row`` is the
    caller's ``row_col``, unique longs in a table that doesn't change between reads; without it rows are numbered in a written
    copy of ids and texts. Very long texts are hashed in pieces, in a few times their own size of memory. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    threshold = percent / 100
    bands, rows = banding(threshold, rows, miss)
    number = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    work = common.with_small_batches(docs).select(number.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = [] if row_col else [work := common.written(work, "numbered", compression="zstd")]
    sig = common.written(signatures(work, words, bands, rows), "signatures")
    member = common.written(sig.select("row", "doc_id", "n_shingles", "h1", "h2"), "members")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    earliest = F.min(F.struct("doc_id", "row"))
    classes = common.written(full.groupBy("h1", "h2").agg(F.min("row").alias("rep"), earliest.alias("early"), F.count("*").alias("n")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    placed = reps.select(F.explode("keys").alias("key"), F.col("row").alias("rep"))
    buckets = placed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    inside = common.written(placed.join(buckets, "key"), "buckets")
    stars = inside.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    # every member of a bucket has a role here; texts are joined once, and the second round reads what is left of them
    per = roles(stars).groupBy("rep").agg(F.collect_list(F.struct("a", "part", "role")).alias("roles"))
    texts = common.written(work.select(F.col("row").alias("rep"), "text").join(per, "rep"), "texts", compression="zstd")
    links = common.written(confirmed(texts.select("rep", "text", F.inline("roles")), words, percent), "links")
    found = components(links)
    marks = reps.select(F.col("row").alias("rep"), "n_shingles", "sig")
    more = common.written(_crossing(inside.select("key", "rep"), found, marks, threshold, bands * rows), "crossing")
    if not more.isEmpty():
        before, found = found, components(links.unionByName(confirmed_in_cells(more, texts.select("rep", "text"), words, percent)))
        common.dropped(before)
    named = classes.join(found, classes["rep"] == found["node"], "left").select("h1", "h2", "n", "early", F.coalesce("root", "rep").alias("root"))
    named = common.written(named, "roots")
    by_root = named.groupBy("root").agg(F.min("early").alias("early"), F.count("*").alias("n"))
    judged = common.joined_on_hot(named.select("h1", "h2", "n", "root"), by_root, ["root"]).select("h1", "h2", "n", "early")
    judged = common.written(judged, "judged")
    common.dropped(sig, classes, inside, texts, links, more, found, named, *own)
    none = F.lit(None).cast("struct<doc_id:bigint,row:bigint>").alias("early")
    in_class = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = member.where(~in_class).select("row", "doc_id", "n_shingles", none)
    both = common.joined_on_hot(member.where(in_class), judged, ["h1", "h2"]).select("row", "doc_id", "n_shingles", "early").unionByName(alone)
    component = F.coalesce("early.doc_id", "doc_id")
    return both.select(
        "row", "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
        (F.col("early").isNull() | (F.col("row") == F.col("early.row"))).alias("first"),
    )
