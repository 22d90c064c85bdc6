"""Ids of a sentence-piece BPE vocabulary for many texts, encoding every different word once.

Such a vocabulary writes a blank as U+2581. If no piece holds that sign after another one, no merge crosses the start of a
run of blanks, and a text's ids are those of its words (a run of blanks and what follows up to the next) put together.
"""

from __future__ import annotations

import re

import numpy as np

BLANK = "▁"
MAX_KNOWN = 250_000  # words kept; the store starts anew beyond
MAX_POOL = 1 << 21  # their ids
_WORD = re.compile(" +[^ ]*")


class SentencePieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(size)]
        #: What each id spells.
        self.spelled = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace(BLANK, " ").encode() for k, n in enumerate(names)]
        emitted = [n for k, n in enumerate(names) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        if any(BLANK in n.lstrip(BLANK) for n in emitted) or self.model.encode("a  b ") != self.model.encode("a") + self._ids(["  b", " "])[0] + self._ids([" "])[0]:
            raise ValueError("words of this vocabulary can't be encoded one by one")
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.offset, self.length = np.zeros(MAX_KNOWN, np.int64), np.zeros(MAX_KNOWN, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0

    def _ids(self, words: list[str]) -> list[list[int]]:
        """The model itself puts a blank before a text, and none is left of a text of blanks: those go behind a letter."""
        plain = self.model.encode([w[1:] for w in words], num_threads=1)
        before = len(self.model.encode("x"))
        return [self.model.encode("x" + w)[before:] if not w.strip(" ") else ids for w, ids in zip(words, plain)]

    def _add(self, words: list[str]) -> None:
        found = self._ids(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        at = len(self.number)
        while at + len(words) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.offset, self.length))
        self.pool[self.used:self.used + len(flat)] = flat
        self.offset[at:at + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[at:at + len(words)] = lengths
        self.number.update(zip(words, range(at, at + len(words))))
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many belong to each. Give about 1 MB of text at a time."""
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        words = [w for own in split for w in own]
        if len(self.number) > MAX_KNOWN or self.used > MAX_POOL:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self._add(new)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        lengths = self.length[numbers]
        through = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.offset[numbers] - through[:-1], lengths) + np.arange(through[-1])]
        ends = np.cumsum([0] + [len(own) for own in split])
        return ids, np.diff(through[ends])
