"""Token counts by linear longest match.

The vocabulary's trie has, for each node, a failure link and the number of pieces that greedy longest match would have
popped by the time it follows the link; so each byte of a word is read once and no piece is ever built."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: Words whose counts a worker remembers; when there are more, it starts afresh. About 200 MB.
REMEMBERED = 1_500_000
UNKNOWN = -1


class LongestMatch:
    """Pieces of a word: first one of `initial`, then some of `continuing`, each the longest that fits."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        token = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                u = root
                for c in piece:
                    v = self.next[u].get(c)
                    if v is None:
                        v = self.next[u][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    u = v
                token[u] = u > 1
        self.fail = [UNKNOWN] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if token[v]:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z != UNKNOWN and c not in self.next[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                if z != UNKNOWN:
                    self.fail[v], self.pops[v] = self.next[z][c], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1, the unknown piece, where no pieces make it up."""
        u = n = 0
        following, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while (v := following[u].get(c)) is None:
                n += pops[u]
                u = fail[u]
                if u == UNKNOWN:
                    return 1
            u = v
        while u != 1:
            n += pops[u]
            u = fail[u]
            if u == UNKNOWN:
                return 1
        return n


class Counts(dict):
    """Pieces by word, counted when first asked for."""

    def __init__(self, matcher: LongestMatch) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.matcher.count(word)
        return n


_loaded: dict[str, Counts] = {}


def loaded(path: str) -> Counts:
    """Counts over a vocabulary of ranks, a base64 piece and a number in each line; one for each Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        _loaded[path] = Counts(LongestMatch(pieces, pieces))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row: greedy longest-match pieces of each word of the whole text.

    vocabulary: path of a file of ranks, there on every executor. Words are runs of characters other than ASCII white
    space; they are matched byte by byte. A word that no pieces make up counts as one unknown piece. Null and empty texts
    have no words. Repeated rows are counted each time; an empty table gives an empty one; other columns play no part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded(vocabulary).__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").encode().split()
                n_words.append(len(words))
                n_tokens.append(sum(map(known, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
