"""Byte-level BPE ids by the tokenizers library, through a bounded cache of pre-split words."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from .common import span_hashes


class WordCachedEncoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    BPE works inside pre-split words, so the library encodes each distinct word once and a text is the concatenation of
    its words' ids. Plain texts are split, hashed and put together as numpy arrays; a word is known by a 64-bit hash of
    its characters and length, in an open-addressing table that is asked for all words of a batch at once. Texts with characters beyond Latin-1 (where pattern engines may differ), with a special
    token's string or with something like an English contraction go to the library whole. At most ``limit`` words are
    kept; a full table is emptied.
    """

    CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]")
    CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
    #: Kinds of Latin-1 characters: blank, other white space, letters, numbers, anything else.
    KIND = np.array([0 if c == 32 else 1 if c in (9, 10, 13) else 2 if chr(c).isalpha() else 3 if chr(c).isnumeric() else 4 for c in range(256)], np.uint8)

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.line_end = vocabulary["\u010a"]  # how byte-level tokens write a line end; a blank is U+0120
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.n_known = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    def _plain(self, text: str) -> bytes | None:
        """A text's Latin-1 bytes, if its words can be found here."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if self.CONTROL.search(text) or self.CONTRACTION.search(text) or any(s in text for s in self.special):
            return None
        return raw

    @classmethod
    def split(cls, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the words of plain texts start (data holds the texts, off where each starts and the end).

        The pattern is that of byte-level BPE: letters, numbers or other characters in a row, each with the one blank
        before; of white space that something follows, the last character is for itself (or is that blank).
        """
        kind = cls.KIND[data]
        white = kind < 2
        first = np.zeros(len(data) + 1, bool)
        first[off] = True
        begins = first[:-1].copy()
        before, now = kind[:-1], kind[1:]
        begins[1:] |= np.where(white[1:], ~white[:-1], np.where(white[:-1], before == 1, before != now))
        last = white.copy()  # the last of two or more white characters, with something after it in the same text
        last[:-1] &= ~white[1:] & ~first[1:-1]
        last[-1:] = False
        last[1:] &= white[:-1] & ~first[1:-1]
        last[:1] = False
        return np.flatnonzero(begins | last)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        raw = [self._plain(t) for t in texts]
        whole = [i for i, x in enumerate(raw) if x is None]
        for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        own = [i for i, x in enumerate(raw) if x]
        if not own:
            return out
        joined = b"".join(raw[i] for i in own)
        off = np.cumsum([0, *(len(raw[i]) for i in own)])
        data = np.frombuffer(joined, np.uint8)
        start = self.split(data, off)
        end = np.append(start[1:], len(data))
        code, words = pd.factorize(span_hashes(data, start, end))
        place = np.empty(len(words), np.int64)
        place[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if self.n_known > self.limit:
            self._forget()
        words |= words == 0  # zero marks free places of the table
        index = self._find(words)
        new = np.flatnonzero(index < 0)
        if len(new):
            a, b = start[place[new]], end[place[new]]
            order = self._learn(joined, a, b, self.KIND[data[a]], self.KIND[data[b - 1]])
            index[new[order]] = np.arange(self.n_known, self.n_known + len(new))
            self._keep(words[new[order]])
        at = index[code]
        n, begin = self.length[at], self.start[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)].astype("<u4").tobytes()
        cut = 4 * total[np.searchsorted(start, off)]
        for i, a, b in zip(own, cut.tolist(), cut[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of words are; -1 for unknown words."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (keys & mask).view(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, self.place[slot], -1).astype(np.int64)
        left = np.flatnonzero((held != keys) & (held != 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & int(mask)
            held, own = self.keys[slot], keys[left]
            out[left] = np.where(held == own, self.place[slot], -1)
            on = (held != own) & (held != 0)
            left, slot = left[on], slot[on]
        return out

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Give unknown, distinct words a place in the table; of those that meet at a free one, one stays."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).view(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = keys[free]
            stays = self.keys[slot] == keys
            self.place[slot[stays]] = places[stays]
            keys, places, slot = keys[~stays], places[~stays], slot[~stays] + 1 & mask

    def _keep(self, keys: np.ndarray) -> None:
        """Know the words that were learned last, in their order; at most half of the table is used."""
        n = self.n_known + len(keys)
        if 2 * n > len(self.keys):
            used = self.keys != 0
            old, places = self.keys[used], self.place[used]
            size = 1 << (4 * n - 1).bit_length()
            self.keys, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(old, places)
        self._put(keys, np.arange(self.n_known, n, dtype=np.int32))
        self.n_known = n

    def _learn(self, text: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Encode new words, given as spans of Latin-1 text with the kinds of their first and last characters; gives the
        order in which their ids are kept. Words of letters go in long runs: those with a blank before them one after
        another, as the token with the blank begins each, the others with line ends between them."""
        kinds = [np.flatnonzero((first == 0) & (last == 2)), np.flatnonzero(first == 2), np.flatnonzero((first != 2) & ((first != 0) | (last != 2)))]
        words = [[text[x:y] for x, y in zip(start[k].tolist(), end[k].tolist())] for k in kinds]
        encode, ids, lengths = self.tokenizer.encode_batch_fast, [], []
        for kind, between in ((0, b""), (1, b"\n")):
            parts = [words[kind][a : a + 1000] for a in range(0, len(words[kind]), 1000)]
            for part, e in zip(parts, encode([between.join(x).decode("latin-1") for x in parts], add_special_tokens=False)):
                own = np.array(e.ids, np.uint32)
                if kind:
                    cut = np.flatnonzero(own == self.line_end)
                    sizes = np.diff(cut, prepend=-1, append=len(own)) - 1
                    own = np.delete(own, cut)
                else:
                    sizes = np.diff(np.flatnonzero(self.blank_first[own]), append=len(own))
                if len(sizes) != len(part) or sizes.min() < 1:
                    raise ValueError("the library splits words otherwise than the pattern says")
                ids.append(own)
                lengths.append(sizes)
        rest = [e.ids for e in encode([x.decode("latin-1") for x in words[2]], add_special_tokens=False)]
        ids.append(np.array([i for x in rest for i in x], np.uint32))
        lengths.append(np.array([len(x) for x in rest], np.int64))
        self._add(np.concatenate(ids), np.concatenate(lengths))
        return np.concatenate(kinds)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = self.n_known
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[n : n + len(lengths)] = self.n_ids + np.cumsum(lengths) - lengths
        self.length[n : n + len(lengths)] = lengths
        self.n_ids += len(ids)


_encoders: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordCachedEncoder(path)
    return _encoders[path]


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
