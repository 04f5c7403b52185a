"""Byte-pair merges of many distinct words at once, as the tokenizers library makes them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import common

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NONE = np.int64(1) << np.int64(62)
L, N, OTHER, STRANGE = 0, 1, 2, 3


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class WordBPE:
    """Ids of white-space separated chunks under a lower-casing byte-pair model with word ends.

    Words of code points below 384 are split and merged in arrays, a merge of the lowest rank, leftmost first, in
    every word at a time; chunks with anything else, with an apostrophe or a special token's sign go to the library.
    ``exact`` tells whether the tokenizer is of the kind that this reproduces; else the library gets all chunks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        model, kinds = spec["model"], json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        made = {a + b for a, b in merges}
        self.exact = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
            and len(made) == len(merges) and len(vocab) < 65536 and json.dumps(PATTERN)[1:-1] in kinds and '"Lowercase"' in kinds and '"NFC"' in kinds and '"add_prefix_space": false' in kinds
            and all(t["special"] and not t["normalized"] and t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        if not self.exact:
            return
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bits = 18
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(keys)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            while self.keys[slot] != 0xFFFFFFFF:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot] = key, rank
        self.kind = np.full(384, STRANGE, np.int8)
        import regex

        for c in [*range(33, 127), *range(0xA1, 384)]:
            if c not in (0x27, 0xAD, 0x130):
                self.kind[c] = L if regex.match(r"\p{L}", chr(c)) else N if regex.match(r"\p{N}", chr(c)) else OTHER
        self.lower = np.arange(384, dtype=np.uint32)
        for c in range(384):
            if len(chr(c).lower()) == 1:
                self.lower[c] = ord(chr(c).lower())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 without one."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slots = self._slot(keys)
        found = self.keys[slots]
        rank = np.where(found == keys, self.ranks[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != 0xFFFFFFFF))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            rank[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != 0xFFFFFFFF)]
        return rank

    def merge(self, symbols: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """All merges of ``words`` words; ``word`` tells, in ascending order, each symbol's. Returns ids in order of words, and lengths."""
        done_s, done_w = [], []
        rank = np.full(len(symbols), NONE, np.int64)
        if len(symbols) > 1:
            same = word[1:] == word[:-1]
            r = self.rank_of(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(same & (r >= 0), r, NONE)
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            keyed = np.where(rank == NONE, NONE, (rank << np.int64(32)) | np.arange(len(rank)))
            best = np.minimum.reduceat(keyed, starts)
            ready = best == NONE
            at = (best[~ready] & np.int64(0xFFFFFFFF)).astype(np.int64)
            symbols[at] = self.merged[best[~ready] >> np.int64(32)]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            # the symbol before and the merged one have new neighbours
            rank[at] = -2
            before = at - 1
            before = before[(before >= 0)]
            before = before[word[before] == word[before + 1]]
            rank[before] = -2
            if ready.any():
                out = np.repeat(ready, np.diff(np.append(starts, len(symbols))))
                done_s.append(symbols[out])
                done_w.append(word[out])
                keep &= ~out
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            new = np.flatnonzero(rank == -2)
            if len(new):
                right = np.minimum(new + 1, len(symbols) - 1)
                same = (word[right] == word[new]) & (right > new)
                r = self.rank_of(symbols[new], symbols[right])
                rank[new] = np.where(same & (r >= 0), r, NONE)
        if not done_s:
            return np.zeros(0, np.int32), np.zeros(words, np.int64)
        s, w = np.concatenate(done_s), np.concatenate(done_w)
        return s[np.argsort(w, kind="stable")], np.bincount(w, minlength=words)

    def encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and the number of each chunk's."""
        n = len(chunks)
        if not self.exact:
            each = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(chunks.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *each]), np.array([len(x) for x in each], np.int64)
        codes, at = _code_points(chunks)
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        of = np.repeat(np.arange(n), np.diff(at))
        kind = np.where(codes < 384, self.kind[np.minimum(codes, 383)], STRANGE)
        odd = ~white & ((kind == STRANGE) | (codes == 60))  # 60 may begin a special token
        strange = np.zeros(n, bool)
        strange[of[odd]] = True
        keep = ~white & ~strange[of]
        codes, of, kind = self.lower[np.minimum(codes[keep], 383)], of[keep], kind[keep]
        first = np.ones(len(codes), bool)
        first[1:] = (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == N)
        piece = np.cumsum(first) - 1
        owner = of[first]
        # code points below 2048 are one or two bytes
        wide = codes >= 128
        size = 1 + wide.astype(np.int64)
        end = np.cumsum(size)
        data = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        data[end - 1] = np.where(wide, 0x80 | (codes & 63), codes)
        data[end[wide] - 2] = 0xC0 | (codes[wide] >> 6)
        word = np.repeat(piece, size)
        symbols = self.inner[data]
        if len(data):
            last = np.append(np.flatnonzero(word[1:] != word[:-1]), len(data) - 1)
            symbols[last] = self.final[data[last]]
        ids, lengths = self.merge(symbols, word, len(owner))
        total = np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)
        slow = np.flatnonzero(strange)
        if not len(slow):
            return ids, total
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(chunks.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
        total[slow] = [len(x) for x in found]
        every = np.zeros(int(total.sum()), np.int32)
        chosen = np.repeat(strange, total)
        every[~chosen], every[chosen] = ids, np.concatenate(found)
        return every, total


def _code_points(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and n + 1 offsets."""
    body, at = common.utf8(chunks)
    lead = (body & 0xC0) != 0x80
    codes = np.frombuffer(bytes(body).decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(lead)])[at]
