"""A BPE vocabulary compiled from a tokenizer file, and the test whether two tokens can stand side by side."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

#: Above every merge rank.
NEVER = 1 << 30


def tokenizer_file(name: str) -> str:
    """Place of one of the public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession, path: str):
    """The file's bytes as a broadcast (a vocabulary of a fixed size, about 2 MB): executors need not see the driver's folders."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


class Vocab:
    """Tokens are numbered: 0-255 bytes, then (with a word-end mark) 256-511 bytes that end a word, then merges by rank.

    left, right: what a token was merged from (itself for a base symbol). rank: its merge's rank, -1 for a base
    symbol. pairs: merge of two tokens -> merged token. ids: the file's id of each token.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        chars = byte_chars()
        base = chars + ([c + self.suffix for c in chars] if self.suffix else [])
        number = {name: i for i, name in enumerate(base)}
        left, right, self.pairs = list(range(len(base))), list(range(len(base))), {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = number[a], number[b]
            self.pairs[x, y] = number.setdefault(a + b, len(number))
            left.append(x)
            right.append(y)
        self.base = len(base)
        self.left, self.right = left, right
        self.ids = np.fromiter((model["vocab"][x] for x in number), np.uint32, len(number))
        self.names = list(number)
        key = np.fromiter((x * (1 << 20) + y for x, y in self.pairs), np.int64, len(self.pairs))
        order = np.argsort(key)
        self.pair_key = key[order]
        self.pair_rank = np.fromiter(self.pairs.values(), np.int64, len(key))[order] - self.base
        self.lefts, self.rights = np.array(left), np.array(right)
        self.ranks = np.maximum(np.arange(len(left)) - self.base, -1)
        self._compatible: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's text together yields a, b again.

        Runs the merges backwards along a's right edge and b's left edge: the border falls if a merge of
        two tokens that stand there at the same time comes before either is merged away from it. Of equal
        merges the leftmost comes first.
        """
        got = self._compatible.get((a, b))
        if got is None:
            got = self._compatible[a, b] = self._apart(a, b)
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
        return got

    def _apart(self, a: int, b: int) -> bool:
        base, until_a, until_b = self.base, NEVER, NEVER
        while True:
            merged = self.pairs.get((a, b))
            if merged is not None and merged - base < until_a and merged - base <= until_b:
                return False
            if a > b and a >= base:
                until_a, a = a - base, self.right[a]
            elif b >= base:
                until_b, b = b - base, self.left[b]
            else:
                return True

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs at once."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            key = a * (1 << 20) + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            fall = (rank < until_a) & (rank <= until_b)
            out[live[fall]] = False
            down_a = (a > b) & (a >= self.base)
            down_b = ~down_a & (b >= self.base)
            until_a, until_b = np.where(down_a, a - self.base, until_a), np.where(down_b, b - self.base, until_b)
            a, b = np.where(down_a, self.rights[a], a), np.where(down_b, self.lefts[b], b)
            keep = ~fall & (down_a | down_b)
            live, a, b, until_a, until_b = live[keep], a[keep], b[keep], until_a[keep], until_b[keep]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging by rank, leftmost first, over a heap and a linked list: n log n for any length."""
        n, base = len(symbols), self.base
        tok, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m - base, i, tok[i], tok[i + 1]) for i in range(n - 1) if (m := self.pairs.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = nxt[i] if tok[i] == x else n
            if j >= n or tok[j] != y:
                continue
            tok[i], tok[j] = rank + base, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for p, q in ((prv[i], i), (i, nxt[i])):
                if p >= 0 and q < n and (m := self.pairs.get((tok[p], tok[q]))) is not None:
                    heapq.heappush(heap, (m - base, p, tok[p], tok[q]))
        return [t for t in tok if t >= 0]

    def symbols(self, piece: bytes) -> list[int]:
        """Base symbols of a word; with a word-end mark the last one carries it."""
        return [*piece[:-1], piece[-1] + 256] if self.suffix and piece else list(piece)


@lru_cache(maxsize=4)
def _compiled(raw: bytes) -> Vocab:
    return Vocab(raw)


def compiled(shipped) -> Vocab:
    """The vocabulary, once per worker."""
    return _compiled(shipped.value)
