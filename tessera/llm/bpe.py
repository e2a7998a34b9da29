"""Encode and decode text columns with the tokenization automaton of a word-level BPE file."""

from __future__ import annotations

import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_automaton
from .common import slices, texts_of, with_fields

#: The word-level tokenizer's pre-split pattern (fixed value) with its classes spelled out for lower-case usual characters.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
WORDS = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^\t\n\r {_LETTERS}{_NUMBERS}]+")
#: Any character beyond those that all normalisers and pattern engines treat alike.
UNUSUAL = regex.compile(r"[^\t\n\r\x20-\x7e¡-ÿ]")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Pre-splits texts as the tokenizer file says and runs their distinct words through the automaton, all in step.

    Of up to ``limit`` words the number of ids, their decimal string and the decoded labels are kept; a full table is
    emptied before the next batch. Special tokens' strings in a text become their ids, as the library does it by default.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.automaton, self.limit = bpe_automaton.load(path), limit
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.automaton.labels.update({i: t for t, i in self.special.items()})
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.unmap = {c: b for b, c in bpe_automaton.byte_alphabet().items()}
        self.known: dict[str | bytes | int, tuple[int, str, str]] = {}

    def words(self, text: str) -> list[str | bytes | int]:
        """The pre-split words of a text, with the ids of special tokens between them."""
        if not UNUSUAL.search(text) and "<|" not in text:
            return WORDS.findall(text.lower())
        out: list[str | bytes | int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                split = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))
                out += [bytes(self.unmap[c] for c in w) for w, _ in split if w]
        return out

    def learn(self, words: set[str | bytes | int]) -> None:
        plain = [w for w in words if not isinstance(w, int)]
        ids, off = self.automaton.encode([w.encode() if isinstance(w, str) else w for w in plain])
        ids, off, label = ids.tolist(), off.tolist(), self.automaton.labels.__getitem__
        for w, a, b in zip(plain, off, off[1:]):
            self.known[w] = b - a, " ".join(map(str, ids[a:b])), " ".join(map(label, ids[a:b]))
        for w in words.difference(plain):
            self.known[w] = 1, str(w), label(w)

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text its number of ids, the decimal ids and the decoded labels, each joined by one space."""
        if len(self.known) > self.limit:
            self.known.clear()
        split = [self.words(t) for t in texts]
        known = self.known
        self.learn(set().union(*split).difference(known))
        out = []
        for words in split:
            if words:
                n, ids, labels = zip(*map(known.__getitem__, words))
                out.append((sum(n), " ".join(ids), " ".join(labels)))
            else:
                out.append((0, "", ""))
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """Add ids (array<int>) and decoded (string) of a text column; null text is taken as empty.

    Columns of these names are replaced (not the text's own: that is an error); all others stay. Equal rows give equal
    rows, an empty table an empty one; the text column may be the only one.
    """
    path = path or word_bpe()
    if column in ("ids", "decoded"):
        raise ValueError(f"the text column can't be named {column}")
    kept = [c for c in df.columns if c not in ("ids", "decoded")]
    kept_columns, text_at = [f"`{c}`" for c in kept], kept.index(column)

    def run(it):
        own = codec(path)
        for batch in slices(it):
            found = own.run(texts_of(batch, text_at))
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array([[int(x) for x in ids.split()] for _, ids, _ in found], pa.list_(pa.int32())), pa.array([x for _, _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "ids", "decoded"])

    fields = with_fields(df.select(kept_columns).schema, "ids array<int>, decoded string")
    return df.select(kept_columns).mapInArrow(run, fields)


def text_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text; more columns are ignored): doc_id, n_tokens, sha256 of the decimal ids and of the
    decoded text. A null text is empty and has no tokens; a null doc_id stays null; repeated rows are repeated."""
    from hashlib import sha256

    path = path or word_bpe()

    def run(it):
        own = codec(path)
        for batch in slices(it):
            rows = own.run(texts_of(batch, 1))
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sha256(r[1].encode()).hexdigest() for r in rows]),
                pa.array([sha256(r[2].encode()).hexdigest() for r in rows]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
