"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docketlake.llm.base import map_batches

#: How byte-level BPE splits a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same in terms of re, several times as fast, for a text of Latin letters, whose classes are the same there.
LATIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def split_pieces(text: str) -> list[str]:
    return (PIECES if _NOT_LATIN.search(text) else LATIN_PIECES).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file: bytes of each id, ranks of merges, special strings.

    The file is of byte-level BPE with the split of PIECES, no prefix space and no normaliser, and its added
    tokens stand for their exact strings; others are refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letters = spec["model"], byte_letters()
    steps = [spec.get("pre_tokenizer") or {}, *(spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or any(s.get("add_prefix_space") for s in steps):
        raise ValueError("not a byte-level BPE file without normaliser and prefix space")
    if any(t.get(flag) for t in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("an added token takes in what stands around it")
    as_bytes = lambda token: bytes(letters[c] for c in token)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "ids": {as_bytes(t): i for t, i in model["vocab"].items()},
        "ranks": {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)},
        "special": {t["content"]: t["id"] for t in spec.get("added_tokens", [])},
    }


class PrefixBPE(dict):
    """Encodes and decodes with one vocabulary. The dictionary itself caches pieces of text: ids (as int32
    bytes) and decoded bytes. It keeps the first `limit` pieces; others are computed again."""

    def __init__(self, vocabulary: dict, limit: int = 300_000):
        super().__init__()
        self.ids, self.ranks, self.special, self.limit = vocabulary["ids"], vocabulary["ranks"], vocabulary["special"], limit
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.suffixes = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self.merged(token) == [token]:  # a token that merging its bytes never makes ends no encoding
                self.suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self.suffixes.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Merge the best-ranked neighbours again and again: what BPE is defined as. For short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        a, b = self.bytes[left], self.bytes[right]
        found = self.merged(a + b) == [a, b]
        if len(self.pairs) < 2 * self.limit:
            self.pairs[left << 32 | right] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """The last token of each prefix is the one suffix token that is compatible with the last token before it."""
        last, sizes, pairs = [-1] * (len(data) + 1), [0] * (len(data) + 1), self.pairs
        for end, (token, size) in self.suffixes.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if size == end:
                    last[end], sizes[end] = token, size
                elif before >= 0:
                    fits = pairs.get(before << 32 | token)
                    if self.compatible(before, token) if fits is None else fits:
                        last[end], sizes[end] = token, size
        if data and last[-1] < 0:
            raise ValueError(f"the vocabulary lacks a byte of {data[:40]!r}")
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def __missing__(self, piece: str) -> tuple[bytes, bytes]:
        ids = self.encode_piece(piece.encode("utf-8"))
        found = array("i", ids).tobytes(), b"".join([self.bytes[i] for i in ids])
        if len(self) < self.limit and len(piece) <= 64:
            self[piece] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Ids of a text, and the text that they decode to."""
        found: list[tuple[bytes, bytes]] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                found.append((array("i", [self.special[part]]).tobytes(), part.encode()))
            else:
                found += map(self.__getitem__, split_pieces(part))
        return np.frombuffer(b"".join([f[0] for f in found]), dtype=np.int32), b"".join([f[1] for f in found]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """Text of any sequence of ids; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


_encoders: dict[str, PrefixBPE] = {}


def _encoder(path: str, vocabulary: dict) -> PrefixBPE:
    """One encoder, with its caches, for all tasks of a Python worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PrefixBPE(vocabulary)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs without the text column, with its ids and the text decoded from them.

    The vocabulary is read once and broadcast; its size is the tokenizer's, whatever the input. A null
    text counts as empty and gives no ids; a null id or other column stays as it is, and rows that repeat are encoded
    alike. A very long text takes one pass over it, piece by piece. An empty table gives an empty result. Special strings inside a text become their one id, as the
    tokenizers library does by default. Columns named like the results are replaced.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_path))
    kept = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(tokenizer_path, vocabulary.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = [bpe.encode(t or "") for t in part.column(len(kept)).to_pylist()]
                ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32), np.concatenate([f[0] for f in found]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array([f[1] for f in found], pa.string())], names=[*kept, ids_col, decoded_col])

    source = docs.select(*kept, text_col)
    return map_batches(source, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]))
