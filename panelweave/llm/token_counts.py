"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. A node has a failure link, the node that matching goes on from when
no edge fits, and the number of pieces that are popped on the way; both are worked out
beforehand, so a word is counted in one pass over its characters and no piece is ever built.

A word is matched greedily, longest piece first, from its word mark on. A character that no
piece begins with costs one byte piece per UTF-8 byte. Words are runs of
``[^\\x20\\x09-\\x0D]``. Null and blank texts have no words and no pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import quoted
from panelweave.llm.tokens import vocabulary_path

MARK = "▁"
MEMO = 1_000_000  # words remembered by a task before it starts afresh


def read_pieces(name: str) -> list[str]:
    """The ordinary pieces of a sentence-piece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in plain]


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        weight = [0]
        # Every character of the vocabulary can stand alone, as bytes where it is no piece itself.
        pieces = {p: 1 for p in pieces if p}
        for c in {c for p in pieces for c in p}:
            pieces.setdefault(c, len(c.encode("utf-8", "replace")))
        for piece, cost in pieces.items():
            node = 0
            for c in piece:
                if c not in self.edges[node]:
                    self.edges[node][c] = len(self.edges)
                    self.edges.append({})
                    weight.append(0)
                node = self.edges[node][c]
            weight[node] = cost
        self.link = [0] * len(self.edges)
        self.popped = [0] * len(self.edges)
        level = [0]
        while level:
            below = []
            for node in level:
                for c, child in self.edges[node].items():
                    below.append(child)
                    if weight[child]:  # a piece: popped whole, matching starts afresh
                        self.popped[child] = weight[child]
                        continue
                    at, popped = self.link[node], self.popped[node]
                    while c not in self.edges[at]:
                        popped += self.popped[at]
                        at = self.link[at]
                    self.link[child], self.popped[child] = self.edges[at][c], popped
            level = below

    def count(self, text: str) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for c in text:
            while c not in edges[node]:
                if node == 0:
                    total += len(c.encode("utf-8", "replace"))
                    break
                total += popped[node]
                node = link[node]
            else:
                node = edges[node][c]
        while node:
            total += popped[node]
            node = link[node]
        return total


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, n_words, n_pieces`` per document."""

    @F.pandas_udf("n_words long, n_pieces long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, memo = Automaton(read_pieces(vocabulary)), {}
        for texts in batches:
            out = []
            for body in texts:
                words = body.encode("utf-8", "replace").split() if body else []
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(words).difference(memo):
                    memo[w] = automaton.count(MARK + w.decode())
                out.append((len(words), sum(map(memo.__getitem__, words))))
            yield pd.DataFrame(out, columns=["n_words", "n_pieces"])

    found = docs.select(quoted(doc_id).cast("bigint").alias("doc_id"), count(quoted(text).cast("string")).alias("found"))
    return found.select("doc_id", "found.n_words", "found.n_pieces")
