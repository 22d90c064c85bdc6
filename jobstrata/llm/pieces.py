"""Token ids of many texts, encoding every different piece of text once.

A text is cut before every blank that an ASCII letter or digit or a Latin-1 letter follows. A byte-level vocabulary's
own pre-tokenizer always starts a new word there, so the ids of the pieces, one after another, are the ids of the text.
Pieces are told apart by two independent 64-bit polynomial hashes, looked up for whole batches of texts at a time; only
pieces not seen before reach the tokenizer, joined to one text. Tokens spell bytes, which tells whose ids are whose.
"""

from __future__ import annotations

import re

import numpy as np

from jobstrata.llm.polyhash import PolyHash, mix

MAX_KNOWN = 800_000  # pieces kept; the store starts anew beyond
_SLOTS = 1 << 21  # well above the pieces; a key's upper 21 bits choose its slot
_ROOM = MAX_KNOWN * 3 // 2
_STARTS_WORD = np.zeros(256, bool)
_STARTS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_INNER = re.compile(rb" (?:[0-9A-Za-z]|\xC3[^\x97\xB7])")
_HASH, _CHECK = PolyHash(11), PolyHash(12)


class Pieces:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():  # byte-level vocabularies write each byte as one character
            self.bytes_of[number] = len(token.encode()) if token in special else len(token)
        self._clear()

    def _clear(self) -> None:
        self.slot_key, self.slot_piece = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.known = 0
        self.check = np.zeros(_ROOM, np.uint64)
        self.offset, self.length = np.zeros(_ROOM, np.int32), np.zeros(_ROOM, np.int32)
        self.pool, self.used = np.zeros(1 << 19, np.uint32), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1: linear probing, all keys a step at a time."""
        found = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), (keys >> np.uint64(43)).astype(np.int64)
        while len(open_):
            piece = self.slot_piece[slot]
            hit = (piece >= 0) & (self.slot_key[slot] == keys[open_])
            found[open_[hit]] = piece[hit]
            going = (piece >= 0) & ~hit
            open_, slot = open_[going], (slot[going] + 1) & (_SLOTS - 1)
        return found

    def _insert(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        open_, slot = np.arange(len(keys)), (keys >> np.uint64(43)).astype(np.int64)
        while len(open_):
            free = np.flatnonzero(self.slot_piece[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slot_key[slot[won]], self.slot_piece[slot[won]] = keys[open_[won]], pieces[open_[won]]
            going = np.ones(len(open_), bool)
            going[won] = False
            open_, slot = open_[going], (slot[going] + 1) & (_SLOTS - 1)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, texts: list[bytes], keys: np.ndarray, checks: np.ndarray) -> None:
        ids, lengths = [], np.zeros(len(texts), np.int64)
        inner = [k for k, t in enumerate(texts) if _INNER.match(t)]
        outer = [k for k, t in enumerate(texts) if not _INNER.match(t)]  # begins a text: nothing may stand before it
        for k, own in zip(outer, self._ids([texts[k].decode() for k in outer])):
            ids.append(own)
            lengths[k] = len(own)
        for at in range(0, len(inner), 1024):
            some = [texts[k] for k in inner[at:at + 1024]]
            own = self._ids([b"".join(some).decode()])[0]
            ends, through = np.cumsum([len(t) for t in some]), np.cumsum(self.bytes_of[own])
            cuts = np.searchsorted(through, ends) + 1
            if (through[cuts - 1] != ends).any():
                raise ValueError("a token crosses pieces: the vocabulary isn't byte-level")
            ids.append(own)
            lengths[inner[at:at + 1024]] = np.diff(np.concatenate([[0], cuts]))
        order = np.array(outer + inner, np.int64)
        flat = np.concatenate(ids or [np.empty(0, np.uint32)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        numbers = self.known + np.arange(len(texts))
        self.offset[numbers[order]] = self.used + np.cumsum(lengths[order]) - lengths[order]
        self.length[numbers] = lengths
        self.check[numbers] = checks
        self._insert(keys, numbers.astype(np.int32))
        self.known, self.used = self.known + len(texts), self.used + len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many belong to each. Give about 1 MB of text at a time; a
        longer text is handled on its own."""
        raws = [t.encode() for t in texts]
        raw = b"".join(raws)
        if len(texts) == 1 and len(raw) > 1 << 23:
            own = self._ids(texts)[0]
            return own, np.array([len(own)], np.int64)
        data = np.frombuffer(raw, np.uint8)
        begins = np.cumsum([0] + [len(r) for r in raws])
        after = np.concatenate([data[1:], np.zeros(2, np.uint8)])
        latin = (after[:-1] == 0xC3) & (after[1:] != 0x97) & (after[1:] != 0xB7)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = (data == 32) & (_STARTS_WORD[after[:-1]] | latin)
        cut[begins] = True
        cuts = np.flatnonzero(cut)
        starts, ends = cuts[:-1], cuts[1:]
        sizes = (ends - starts).astype(np.uint64)
        keys = mix(_HASH.stretch(_HASH.prefix(data), starts, ends) + sizes)
        checks = mix(_CHECK.stretch(_CHECK.prefix(data), starts, ends) ^ sizes)
        if self.known + len(keys) > _ROOM or self.known > MAX_KNOWN:
            self._clear()
        if len(keys) > MAX_KNOWN:
            own = self._ids(texts)
            return np.concatenate(own), np.array([len(o) for o in own], np.int64)
        found = self._find(keys)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            _, first = np.unique(keys[new], return_index=True)
            new = new[first]
            self._add([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], keys[new], checks[new])
            found = self._find(keys)
        if (self.check[found] != checks).any():  # one hash agrees, the other doesn't: no piece is trusted
            own = self._ids(texts)
            return np.concatenate(own), np.array([len(o) for o in own], np.int64)
        lengths = self.length[found].astype(np.int64)
        through = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.offset[found] - through[:-1], lengths) + np.arange(through[-1])]
        return ids, np.diff(through[np.searchsorted(starts, begins)])
