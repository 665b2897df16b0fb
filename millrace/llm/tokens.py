"""Token ids of whole texts for one byte-level BPE file with word ends, many documents at once.

The file gives vocabulary and merges; the same ids come out as from the `tokenizers` library. Each
distinct word of a chunk is merged once, all words side by side in arrays. Texts with characters
outside the plain Latin range go through the library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from millrace.llm import kernels as K

_SPACE, _LETTER, _NUMBER, _OTHER, _OUT = 0, 1, 2, 3, 4
_END = 0x250  # first code point outside the range handled here


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below _END."""
    kind, low = np.full(_END, _OUT, np.uint8), np.arange(_END, dtype=np.int32)
    for c in range(_END):
        s, cat = chr(c), unicodedata.category(chr(c))
        small = s.lower()
        if len(small) != 1 or ord(small) >= _END or (ord(small) < 128) != (c < 128):
            continue
        low[c] = ord(small)
        if c in (9, 10, 11, 12, 13, 32):
            kind[c] = _SPACE
        elif cat[0] == "L":
            kind[c] = _LETTER
        elif cat[0] == "N":
            kind[c] = _NUMBER
        elif cat[0] not in "ZC":
            kind[c] = _OTHER
    return kind, low


KIND, LOW = _classes()


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands
    for itself, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Merges:
    """Pair -> (rank, merged id), as an open-addressing table read by arrays of pairs."""

    SIZE_BITS = 19

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        size = 1 << self.SIZE_BITS
        self.key, self.rank = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int32)
        self.merged = merged
        slot = self._slot(pairs)
        for r, (k, s) in enumerate(zip(pairs.tolist(), slot.tolist(), strict=True)):
            while self.key[s] >= 0:
                s = (s + 1) % size
            self.key[s], self.rank[s] = k, r

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SIZE_BITS)).astype(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        slot = self._slot(pairs)
        key = self.key[slot]
        out = np.where(key == pairs, self.rank[slot], 1 << 30)
        rest = np.flatnonzero((key != pairs) & (key >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.key)
            key = self.key[slot[rest]]
            hit = key == pairs[rest]
            out[rest[hit]] = self.rank[slot[rest[hit]]]
            rest = rest[~hit & (key >= 0)]
        return out


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs, merged = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(vocab[a] << 20 | vocab[b])
            merged.append(vocab[a + b])
        self.merges = Merges(np.array(pairs, np.int64), np.array(merged, np.int64))
        self.library = Tokenizer.from_file(path)

    def merge(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of n words (word: which word each is of). Returns ids and their counts per word."""
        done_sym, done_word = [], []
        none = 1 << 30
        while len(sym):
            rank = np.full(len(sym), none, np.int32)
            rank[:-1] = self.merges.ranks(sym[:-1] << 20 | sym[1:])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            rank[first[1:] - 1] = none
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            live = np.repeat(best < none, size)
            hit = (rank == np.repeat(best, size)) & live
            run = np.flatnonzero(hit[1:] & hit[:-1])
            if len(run):  # a a a: every second one, from the left
                idx = np.flatnonzero(hit)
                begin = np.flatnonzero(np.diff(idx, prepend=-2) != 1)
                within = np.arange(len(idx)) - np.repeat(begin, np.diff(np.append(begin, len(idx))))
                hit[idx[within % 2 == 1]] = False
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            at = np.flatnonzero(hit)
            sym[at] = self.merges.merged[rank[at]]
            live[at + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (null: empty), and how many each has."""
        texts = K.Texts(column)
        data = texts.data
        kind = KIND[np.minimum(data, 127)]
        high = np.flatnonzero(data >= 128)
        odd = np.zeros(texts.n, bool)
        if len(high):
            lead = high[(data[high] >= 0xC2) & (data[high] <= 0xC9)]
            cp = ((data[lead].astype(np.int32) & 31) << 6) | (data[lead + 1] & 63)
            inside = cp < _END
            lead, cp = lead[inside], cp[inside]
            kind[high] = _OUT
            kind[lead] = kind[lead + 1] = KIND[cp]
            low = LOW[cp]
            data = data.copy()
            data[lead], data[lead + 1] = 0xC0 | (low >> 6), 0x80 | (low & 63)
        data = K.LOWER[data]
        bad = np.flatnonzero(kind == _OUT)
        odd[np.searchsorted(texts.start, bad, "right") - 1] = True
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token
        odd[np.searchsorted(texts.start, special, "right") - 1] = True
        if odd.any():
            for i in np.flatnonzero(odd):
                kind[texts.start[i] : texts.end[i]] = _SPACE
        before = np.concatenate(([np.uint8(_SPACE)], kind[:-1]))
        begins = (kind != _SPACE) & ((kind != before) | ((kind == _NUMBER) & ((data & 0xC0) != 0x80)))
        quote = np.flatnonzero((data == 39) & begins)
        if len(quote):
            pad = np.concatenate((data, np.zeros(3, np.uint8)))
            one, two = pad[quote + 1], pad[quote + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long_ = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            p = quote[short | long_]
            begins[p + 1] = False
            after = p + np.where(short[short | long_], 2, 3)
            begins[after[kind[after] != _SPACE]] = True
        start = np.flatnonzero(begins)
        stop = np.flatnonzero((kind == _SPACE) & (before != _SPACE))
        end = np.minimum(np.append(start[1:], len(data)), np.append(stop, len(data))[np.searchsorted(stop, start)])
        words = K.Words.__new__(K.Words)
        words.start, words.end = start, end
        h = K.word_hashes(data, words)
        order = np.argsort(h)
        new = np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        size = (end - start)[first]
        offset = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(offset - start[first], size)
        sym = self.inner[data[at]]
        if len(first):
            sym[offset + size - 1] = self.last[data[end[first] - 1]]
        flat, count = self.merge(sym, np.repeat(np.arange(len(first)), size), len(first))
        base = np.cumsum(count) - count
        per_word = count[which]
        total = np.concatenate(([0], np.cumsum(per_word)))
        ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - base[which], per_word)]
        w0, w1 = np.searchsorted(start, texts.start), np.searchsorted(start, texts.end)
        counts = total[w1] - total[w0]
        if odd.any():
            parts, at = [], total[w0]
            for i in range(texts.n):
                if odd[i]:
                    got = self.library.encode(texts.bytes_of(i).decode("utf-8", "replace"), add_special_tokens=False).ids
                    parts.append(np.array(got, np.int64))
                    counts[i] = len(got)
                else:
                    parts.append(ids[at[i] : at[i] + counts[i]])
            ids = np.concatenate(parts)
        return ids, counts
