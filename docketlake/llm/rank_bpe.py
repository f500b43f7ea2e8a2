"""Byte-level BPE from a rank file: padded matrices of pieces, one merge a row and round, and decoding."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docketlake.llm import bpe
from docketlake.llm.base import map_batches, mix

#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max
#: Pieces up to this many bytes go in matrices of at most CELLS cells; longer ones have a row of their own.
LONGEST, CELLS = 512, 1 << 21
#: Pieces of a text that are handled at a time.
SLICE = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token; a rank is the token's id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PairTable:
    """Hash table from pairs of ids to the id they merge into: open addressing, a quarter full at most."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.bits = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        self.mask = np.int64((1 << int(64 - self.bits)) - 1)
        self.keys, self.values = np.full(int(self.mask) + 1, -1, dtype=np.int64), np.full(int(self.mask) + 1, NONE, dtype=np.int32)
        keys, values = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that the pairs merge into, NONE where they do not or where an id is below 0."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), NONE, dtype=np.int32)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slots(keys.take(live))
        while len(live):
            held = self.keys.take(at)
            hit = held == keys.take(live)
            out[live[hit]] = self.values.take(at[hit])
            more = ~hit & (held >= 0)
            live, at = live[more], (at[more] + 1) & self.mask
        return out


class RankBPE(dict):
    """Encodes and decodes with one rank file. The dictionary itself numbers the pieces it has met; `found` holds their ids as int32
    bytes. Once it has more than `limit` pieces it starts afresh."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 300_000):
        super().__init__()
        self.ranks, self.limit = ranks, limit
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(ranks)
        self.pieces: Callable[[str], list[str]] = bpe.split_pieces if pattern == bpe.PIECES.pattern else regex.compile(pattern).findall
        self.pattern = regex.compile(pattern)
        self.found: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self.found) + len(self.new)
        self.new.append(piece)
        return code

    def _learn(self) -> None:
        """Encode the pieces that are new: whole tokens by look-up, the rest by length in matrices."""
        data = [p.encode("utf-8") for p in self.new]
        done: list[bytes] = [b""] * len(data)
        rest = []
        for k, piece in enumerate(data):
            rank = self.ranks.get(piece)
            if rank is None:
                rest.append(k)
            else:
                done[k] = np.int32(rank).tobytes()
        rest.sort(key=lambda k: len(data[k]))
        while rest:
            longest = len(data[rest[0]])
            if longest > LONGEST:
                for k in rest:
                    done[k] = self.encode_long(data[k]).tobytes()
                break
            width = max(4, 1 << (longest - 1).bit_length())
            part = list(itertools.takewhile(lambda k: len(data[k]) <= width, rest[: max(1, CELLS // width)]))
            for k, ids in zip(part, self.encode_rows([data[k] for k in part], width), strict=True):
                done[k] = ids
            rest = rest[len(part) :]
        self.found += done
        self.new.clear()

    def _bytes_of(self, data: bytes) -> np.ndarray:
        ids = self.single.take(np.frombuffer(data, dtype=np.uint8))
        if len(ids) and ids.min() < 0:
            raise ValueError("the rank file lacks a byte")
        return ids

    def encode_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of each row. All rows lie in one matrix, padded with -1; in every round each row that still merges loses one place, so the
        matrix stays without gaps at a width less by one, and rows that are done leave it."""
        sizes = np.array([len(r) for r in rows])
        m = np.full((len(rows), width), -1, dtype=np.int32)
        m[np.arange(width) < sizes[:, None]] = self._bytes_of(b"".join(rows))
        ranks = self.pairs(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(rows), width - 1)
        out: list[bytes] = [b""] * len(rows)
        own = np.arange(len(rows))
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(m), dtype=np.int64)
            best = ranks[np.arange(len(m)), at] if ranks.shape[1] else np.full(len(m), NONE)
            for k in np.flatnonzero(best == NONE).tolist():
                row = m[k]
                out[own[k]] = row[row >= 0].tobytes()
            live = best != NONE
            if not live.any():
                return out
            m, ranks, own, at, best = m[live], ranks[live], own[live], at[live], best[live]
            n, w = m.shape
            every = np.arange(n)
            m[every, at] = best
            keep = np.ones((n, w), dtype=bool)
            keep[every, at + 1] = False
            m = m[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, w - 2)
            for side in (at - 1, at):  # the pairs that the new id stands in
                k = np.flatnonzero((side >= 0) & (side < w - 2))
                ranks[k, side[k]] = self.pairs(m[k, side[k]], m[k, side[k] + 1])

    def encode_long(self, data: bytes) -> np.ndarray:
        """Ids of one long piece. A round merges the leftmost pair of least rank and its next equals, as far as none of them makes a pair
        of lower rank, which would have its turn first."""
        ids = self._bytes_of(data)
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            runs = np.flatnonzero(np.diff(at, prepend=-9) > 1)  # of pairs that overlap, every second one merges
            at = at[(np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))) % 2 == 0]
            new = np.full(len(at), best, dtype=np.int32)
            beside = np.where(np.diff(at, prepend=-9) == 2, best, ids[at - 1])
            beside[at == 0] = -1
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            early = np.flatnonzero((self.pairs(beside, new) < best) | (self.pairs(new, after) < best))
            if len(early):
                at = at[: early[0] + 1]
            ids[at] = best
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            now = at - np.arange(len(at))
            for side in (now - 1, now):
                k = side[(side >= 0) & (side < len(ranks))]
                ranks[k] = self.pairs(ids[k], ids[k + 1])
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as int32 bytes."""
        if len(self) > self.limit:
            self.clear()
            self.found.clear()
        coded: list[np.ndarray] = []
        for text in texts:
            if len(text) <= SLICE:
                pieces = self.pieces(text)
                coded.append(np.fromiter(map(self.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
            else:
                found, parts = (m[0] for m in self.pattern.finditer(text)), []
                while pieces := list(itertools.islice(found, SLICE)):
                    parts.append(np.fromiter(map(self.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
                coded.append(np.concatenate(parts))
        self._learn()
        return [b"".join(map(self.found.__getitem__, codes.tolist())) for codes in coded]

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of any sequence of ids; unknown ids give nothing."""
        known = len(self.bytes)
        return b"".join([self.bytes[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids) if 0 <= i < known])


_encoders: dict[tuple[str, str], RankBPE] = {}


def _encoder(path: str, pattern: str, ranks: dict[bytes, int]) -> RankBPE:
    """One encoder, with its pieces, for all tasks of a Python worker."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = RankBPE(ranks, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", batch_chars: int = 1 << 20) -> DataFrame:
    """docs without the text column, with its ids and the bytes decoded from them.

    The pieces that `pattern` finds are encoded separately; no string is special. The distinct new pieces of about `batch_chars`
    characters are encoded together. The rank file is read once and broadcast; its size is the vocabulary's, whatever the input. A null
    or empty text gives no ids; a null id or other column stays as it is, and rows that repeat are encoded alike. A very long text is
    taken piece by piece. An empty table gives an empty result. Columns named like the results are replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    kept = [c for c in docs.columns if c not in (text_col, ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(rank_path, pattern, ranks.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            ends = np.cumsum([len(t) for t in texts]) // batch_chars
            for first, last in itertools.pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]):
                coded = coder.encode(texts[first:last])
                ids = np.frombuffer(b"".join(coded), dtype=np.int32)
                places = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                back = [coder.decode(ids[a:b]) for a, b in itertools.pairwise(places.tolist())]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(places, ids), pa.array(back, pa.binary())], names=[*kept, ids_col, decoded_col])

    source = docs.select(*kept, text_col)
    return map_batches(source, run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.BinaryType())]))
