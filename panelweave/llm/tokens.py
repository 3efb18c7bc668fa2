"""Token ids of whole texts by a public byte-level BPE file, with words remembered.

White space cuts a text into pieces that the tokenizer's own pre-tokenizer never joins, so a
piece seen before needs no second encoding. New pieces are encoded together by a fast
encoder over the same vocabulary; whatever is unusual (runs of blanks, letters outside the
Latin blocks, special-token strings, control characters) goes to ``tokenizers`` itself.
Both ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np

MEMO = 200_000  # pieces remembered before the memory starts afresh
TOGETHER = 50_000  # pieces looked up at a time
HEAD = "\x00"  # before a piece that no blank precedes
PLAIN = bytes([9, 10, 13, *range(32, 127)])
NOT_LATIN = re.compile(r"[^¡-¬®-ɏ]")
MARK = " \x00"  # between pieces of one call: never in a usual piece, always two ids of its own


def unusual(text: str) -> bool:
    """Whether a blank may join its neighbours, or the text holds what fast pieces are not trusted with."""
    if "  " in text or text[-1] == " " or "<|" in text or any(p in text for p in ("\n \n", "\t \n", "\r \n", "\n \t", "\t \t", "\r \t", "\n \r", "\t \r", "\r \r")):
        return True
    rest = text.encode("utf-8", "surrogatepass").translate(None, PLAIN)
    return bool(rest) and bool(NOT_LATIN.search(rest.decode("utf-8", "replace")))


def vocabulary_path(name: str) -> str:
    """A full path as it is, a bare name among the installed public files."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTokenizer:
    """``ids(text)`` as an uint32 array."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        import public_tokenizers
        import tiktoken

        self.path = vocabulary_path(name)
        with open(self.path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t != "<|endoftext|>"}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = np.array(self.fast.encode_ordinary(MARK), np.uint32)
        assert len(self.mark) == 2
        self.forget()

    @cached_property
    def exact(self):
        """Read when the first unusual text comes: a worker without any does not hold the vocabulary twice."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.start[0] = 0

    def _learn(self, pieces: list[str]) -> None:
        """Append the ids of new pieces: ``" " + piece``, or the rest of a piece that begins with HEAD."""
        known = len(self.code)
        spelled = "".join(f"{p[1:] if p[:1] == HEAD else ' ' + p}{MARK}" for p in pieces)
        ids = np.array(self.fast.encode_ordinary(spelled), np.uint32)
        ends = np.nonzero(ids == self.mark[1])[0]
        assert len(ends) == len(pieces)
        keep = np.ones(len(ids), bool)
        keep[ends] = keep[ends - 1] = False
        ids = ids[keep]
        base = self.start[known]
        while base + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while known + len(pieces) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[base : base + len(ids)] = ids
        self.start[known + 1 : known + 1 + len(pieces)] = base + np.cumsum(np.diff(ends, prepend=-1) - 2)
        self.code.update(zip(pieces, range(known, known + len(pieces))))

    def _lookup(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece's ids end."""
        new = set(pieces).difference(self.code)
        if new:
            if len(self.code) + len(new) > MEMO:
                self.forget()
                new = set(pieces)
            self._learn(list(new))
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        first, length = self.start[codes], self.start[codes + 1] - self.start[codes]
        upto = np.cumsum(length)
        return self.flat[np.repeat(first - upto + length, length) + np.arange(upto[-1])], upto

    def all_ids(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; texts are looked up some at a time."""
        at = 0
        while at < len(texts):
            pieces: list[str] = []
            direct: dict[int, np.ndarray] = {}  # whole texts
            heads: dict[int, np.ndarray] = {}  # first pieces that are not remembered
            counts: list[int] = []
            while at < len(texts) and len(pieces) < TOGETHER:
                text = texts[at]
                before = len(pieces)
                if text and unusual(text):
                    direct[len(counts)] = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
                elif text:
                    head, *rest = text.split(" ")
                    if head[:1].isalpha():
                        pieces.append(HEAD + head)
                    elif head:
                        heads[len(counts)] = np.array(self.fast.encode_ordinary(head), np.uint32)
                    pieces += rest
                counts.append(len(pieces) - before)
                at += 1
            flat, upto = self._lookup(pieces) if pieces else (np.empty(0, np.uint32), np.empty(0, np.int64))
            ends = np.concatenate([[0], upto])[np.cumsum([0, *counts])]
            for i in range(len(counts)):
                own = direct[i] if i in direct else flat[ends[i] : ends[i + 1]]
                yield np.concatenate([heads[i], own]) if i in heads else own

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.all_ids([text]))


def task_tokenizer(name: str) -> PieceTokenizer:
    """The worker process keeps a tokenizer and what it remembers from task to task."""
    kept = sys.__dict__.setdefault("_kept_tokenizers", {})
    if name not in kept:
        kept[name] = PieceTokenizer(name)
    return kept[name]
