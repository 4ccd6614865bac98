"""Byte-level BPE over a whole corpus by speculation and verification.

A word is cut greedily into the longest vocabulary entries; this is only a guess. A guess is the BPE result exactly
if every two neighbours in it could stand beside each other, that is if no merge of higher priority would have
crossed their border. That test needs no merging and is done for all distinct pairs of a batch at once with numpy.
Only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import regex

#: The pattern that splits a text into the words that are merged on their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for a text of ASCII characters only, for which the standard library's faster engine will do.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = "/opt/tokenizers"
FILE = "byte_bpe_50k.json"
#: A worker's memory of words is emptied beyond so many; this affects speed only.
MEMORY = 400_000
NONE = np.int64(1) << np.int64(60)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder of one vocabulary file in the tokenizers JSON format whose ids follow the order of its merges."""

    def __init__(self, folder: str = TOKENIZER_DIR, file: str = FILE):
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = _byte_of_char()
        vocab = {bytes(of[c] for c in k): v for k, v in model["vocab"].items() if all(c in of for c in k)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.pair: dict[tuple[int, int], int] = {}
        texts = model["vocab"]
        for a, b in merges:
            x, y, z = texts[a], texts[b], texts[a + b]
            self.pair[x, y] = z
            self.left[z], self.right[z] = x, y
        self.vocab, self.byte = vocab, [vocab[bytes([b])] for b in range(256)]
        keys = np.array([x * size + y for x, y in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.made = size, keys[order], np.array(list(self.pair.values()), dtype=np.int64)[order]
        self.by_first: dict[int, list[int]] = {}
        lengths: dict[int, set[int]] = {}
        for k in vocab:
            lengths.setdefault(k[0], set()).add(len(k))
        self.by_first = {b: sorted(n, reverse=True) for b, n in lengths.items()}
        self.any_split, self.ascii_split = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.merged_words = self.proposed_words = 0

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, vocab = [], 0, len(data), self.vocab
        while i < n:
            for m in self.by_first[data[i]]:
                if i + m <= n and (t := vocab.get(data[i : i + m])) is not None:
                    out.append(t)
                    i += m
                    break
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of left and right tokens: could each pair be neighbours in a BPE result?

        Both tokens are taken apart in the reverse order of their merges; the pair fails if at some moment the two
        pieces at the border had a merge that came before the one that was in fact done next.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        good, limit, live = np.ones(len(a), bool), np.full(len(a), NONE), np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < top)
            good[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            later_left = x > y  # the later merge is undone first; a token of one byte can't be undone
            can_x, can_y = self.right[x] != x, self.left[y] != y
            open_x = (later_left & can_x) | (~later_left & ~can_y & can_x)
            open_y = (~later_left & can_y) | (later_left & ~can_x & can_y)
            limit[live[open_x]] = x[open_x]
            a[live[open_x]] = self.right[x[open_x]]
            limit[live[open_y]] = y[open_y] + 1
            b[live[open_y]] = self.left[y[open_y]]
            live = live[open_x | open_y]
        return good

    def merge(self, data: bytes) -> list[int]:
        """Exact merging with a heap over a linked list: n log n also for a word of a million bytes."""
        ids = [self.byte[b] for b in data]
        n, pair = len(ids), self.pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pair.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            made, i, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := pair.get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (m, i, made, ids[k]))
            if (h := before[i]) >= 0 and (m := pair.get((ids[h], made))) is not None:
                heapq.heappush(heap, (m, h, ids[h], made))
        return [t for t in ids if t >= 0]

    def learn(self, new: list[str]) -> None:
        """Encodes distinct words and remembers them."""
        if len(self.known) > MEMORY:
            self.known.clear()
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        guess = [self.propose(d) for d in data]
        self.proposed_words += len(new)
        counts = np.array([len(g) for g in guess])
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        bad = np.zeros(len(guess), bool)
        if len(inside):
            pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            good = self.fits(pairs // self.size, pairs % self.size)
            bad[owner[inside[~good[back]]]] = True
        self.merged_words += int(bad.sum())
        for i, w in enumerate(new):
            self.known[w] = tuple(self.merge(data[i])) if bad[i] else tuple(guess[i])

    def split_all(self, texts: Iterable[str | None]) -> list[list[str]]:
        parts = [(self.ascii_split if t.isascii() else self.any_split)(t) if t else [] for t in texts]
        new = {w for p in parts for w in p} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = {w for p in parts for w in p}
        if new:
            self.learn(list(new))
        return parts

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty give an empty list."""
        known = self.known
        return [[t for w in p for t in known[w]] for p in self.split_all(texts)]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        known = self.known
        return [sum([len(known[w]) for w in p]) for p in self.split_all(texts)]


_made: dict[tuple[str, str], SpeculativeBpe] = {}


def encoder(folder: str = TOKENIZER_DIR, file: str = FILE) -> SpeculativeBpe:
    """One encoder per worker process."""
    if (folder, file) not in _made:
        _made[folder, file] = SpeculativeBpe(folder, file)
    return _made[folder, file]
