"""Byte-level BPE with a two-tier lookup.

A text is cut by the tokenizer's pattern into pre-tokens. Tier one: a minimal perfect hash over the
vocabulary (built once on the driver, of the vocabulary's size, and broadcast) resolves a pre-token that is
itself a token. Tier two: any other pre-token is merged bottom-up; its parts form a linked list of bytes,
and a heap holds the rank of every mergeable neighbour pair, lowest rank and leftmost first. Results of
pre-tokens, and of the pieces between lone spaces, are remembered per worker in tables of bounded size (the older
half goes when they are full), so memory stays bounded and results do not depend on it. Texts are taken from a batch about a megabyte
at a time, and their ids and bytes leave as Arrow buffers; a text that cannot be split into pre-tokens (one very long word) holds about
160 bytes for each of its bytes while it is merged. Pieces need a pattern none of whose
matches runs over a lone space but with that space as its first character; GPT-2's family is like that. Work is a single scan without shuffles; a lost task is simply run again.

Token ids are stored as little-endian unsigned 32-bit integers in one binary value.

Defined results: a null or empty text has no tokens and decodes to the empty string; input columns
named like a result (``n_tokens``, ``token_ids``, ``decoded``) are replaced; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.textblocks import text_blocks

REMEMBERED = 200_000
NOTHING: dict[int, int] = {}


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id, from a file of base64 tokens and ranks on the driver."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be 0..n-1")
    return [tokens[i] for i in range(len(tokens))]


class PerfectHash:
    """Hash and displace: every key of a fixed set has a slot of its own among as many slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = n // 3 + 1
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        taken, shifts = np.zeros(n, dtype=bool), np.arange(min(n, 4096))
        self.displace, self.key_at = [(0, 0)] * self.buckets, [0] * n
        free = None
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if not own:
                break
            if len(own) == 1:
                if free is None:
                    free = np.flatnonzero(~taken).tolist()
                slot = free.pop()
                self.displace[bucket] = (0, (slot - self._start(hashes[own[0]], 0)) % n)
                self.key_at[slot] = own[0]
                continue
            self.displace[bucket], slots = self._fit([hashes[i] for i in own], taken, shifts)
            taken[slots] = True
            for i, slot in zip(own, slots, strict=True):
                self.key_at[slot] = i

    def _start(self, h: int, stride: int) -> int:
        return ((h >> 18) + stride * ((h >> 37) | 1)) % self.n

    def _fit(self, hashes: list[int], taken: np.ndarray, shifts: np.ndarray) -> tuple[tuple[int, int], list[int]]:
        for stride in range(1 << 16):
            starts = np.array([self._start(h, stride) for h in hashes])
            if len(np.unique(starts)) < len(starts):
                continue
            for base in range(0, self.n, len(shifts)):
                slots = (starts[:, None] + (base + shifts)[None, :]) % self.n
                good = np.flatnonzero(~taken[slots].any(axis=0))
                if len(good):
                    return (stride, base + int(good[0])), slots[:, good[0]].tolist()
        raise ValueError("keys with equal hashes")

    def candidate(self, key: bytes) -> int:
        """The only key number that ``key`` can be (a foreign key gets some number too)."""
        h = xxhash.xxh64_intdigest(key)
        stride, shift = self.displace[h % self.buckets]
        return self.key_at[(self._start(h, stride) + shift) % self.n]


def white_space_pattern(pattern: str) -> str:
    """``pattern`` with \\s and \\S by the Unicode property, as other regex engines read them."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PreTokens(dict):
    """pre-token -> token ids as bytes; absent ones are worked out on first use."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash):
        super().__init__()
        self.tokens, self.perfect = tokens, perfect
        ranks = {t: i for i, t in enumerate(tokens)}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        self.pair_of_bytes = [[ranks.get(bytes([a, b])) for b in range(256)] for a in range(256)]
        # Two neighbouring parts merge into the token that they spell, whose id is also the merge's rank: by left part, then right part.
        self.edge = len(tokens)
        self.merged: list[dict[int, int]] = [NOTHING] * (len(tokens) + 1)
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = ranks.get(t[:cut]), ranks.get(t[cut:])
                if left is not None and right is not None:
                    if self.merged[left] is NOTHING:
                        self.merged[left] = {}
                    self.merged[left][right] = i

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.resolve(pre_token)
        if len(pre_token) <= 48:
            if len(self) >= REMEMBERED // 8:
                self.clear()
            self[pre_token] = ids
        return ids

    def resolve(self, pre_token: str) -> bytes:
        piece = pre_token.encode("utf-8", "surrogatepass")
        at = self.perfect.candidate(piece)
        return self.packed[at] if self.tokens[at] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> bytes:
        merged, of_bytes, n = self.merged, self.pair_of_bytes, len(piece)
        shift = n.bit_length()  # entries of usual pieces stay small integers
        mask = (1 << shift) - 1
        # At place n, which place -1 is too, stands a part that merges with nothing.
        ids = [*map(self.byte_id.__getitem__, piece), self.edge]
        pair = [of_bytes[a][b] for a, b in zip(piece, piece[1:])]  # noqa: B905  of the part that begins here with the next
        heap = [r << shift | i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        pair += (None, None)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            top = heappop(heap)
            i, r = top & mask, top >> shift
            if pair[i] != r:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            before[end] = i
            ids[i], pair[gone], ids[gone] = r, None, None
            new = pair[i] = merged[r].get(ids[end])
            if new is not None:
                heappush(heap, new << shift | i)
            left = before[i]
            new = pair[left] = merged[ids[left]].get(r)
            if new is not None:
                heappush(heap, new << shift | left)
        ids.pop()
        packed = self.packed
        return b"".join([packed[i] for i in ids if i is not None])


class BlankAtEdge(Exception):
    """A piece that white space joins to its neighbours."""


class Encoder(dict):
    """piece that follows a lone space -> token ids of both."""

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str):
        super().__init__()
        self.pre_tokens = PreTokens(tokens, perfect)
        self.letters_join = r" ?\p{L}+" in pattern
        self.marks_part = self.letters_join and r" ?[^\s\p{L}\p{N}]+" in pattern
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(white_space_pattern(pattern)).findall

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.pre_tokens.__getitem__, self.split(text)))

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if self.letters_join and piece.isalpha():
                ids = self.pre_tokens.resolve(" " + piece)
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                raise BlankAtEdge
            elif self.marks_part and piece[-1] in ",.;:!?" and piece[:-1].isalpha():
                ids = self[piece[:-1]] + self.pre_tokens[piece[-1]]
            else:
                first, *rest = self.split(" " + piece)
                # A word before a comma is remembered with the same word before a blank.
                word = first[1:]
                head = self[word] if self.letters_join and word.isalpha() and first[0] == " " else self.pre_tokens[first]
                ids = b"".join([head, *map(self.pre_tokens.__getitem__, rest)])
        if len(piece) <= 48:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self.whole(text)
        try:
            return b"".join([self.whole(first), *map(self.__getitem__, rest)])
        except BlankAtEdge:
            return self.whole(text)


_encoders: dict[int, Encoder] = {}


def _encoder(model) -> Encoder:
    """One encoder per worker and broadcast model."""
    if model.value["uid"] not in _encoders:
        _encoders.clear()
        _encoders[model.value["uid"]] = Encoder(model.value["tokens"], model.value["perfect"], model.value["pattern"])
    return _encoders[model.value["uid"]]


def _binary(values: list[bytes]) -> pa.Array:
    """Values laid end to end, without a Python object for each in what leaves the worker."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(values))])


def _decoded(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


class Tokenizer:
    """Encoding and decoding of DataFrame columns by the ranks in ``path`` (read on the driver)."""

    def __init__(self, spark, path: str, pattern: str):
        tokens = read_ranks(path)
        uid = hash((path, pattern, len(tokens), tokens[-1]))
        self.model = spark.sparkContext.broadcast({"uid": uid, "tokens": tokens, "perfect": PerfectHash(tokens), "pattern": pattern})

    def encode(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``n_tokens`` and ``token_ids``."""
        return self._encoded(docs, text_col, decode=False)

    def round_trip(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``decode(encode(docs))`` in one pass."""
        return self._encoded(docs, text_col, decode=True)

    def _encoded(self, docs: DataFrame, text_col: str, decode: bool) -> DataFrame:
        model = self.model
        results = ["token_ids", "n_tokens", *(["decoded"] if decode else [])]
        own = docs.drop(*results)
        at = own.columns.index(text_col)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = _encoder(model).encode
            for batch in batches:
                for begin, end, texts in text_blocks(batch.column(at)):
                    ids = [encode(t) if t else b"" for t in texts]
                    found = [_binary(ids), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if decode:
                        found.append(_binary([_decoded(x, model.value["tokens"]) for x in ids]))
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, *found], names=[*batch.schema.names, *results])

        schema = own.withColumn(text_col, F.col(text_col).cast("string")).schema.add("token_ids", "binary").add("n_tokens", "long")
        return own.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(of, schema.add("decoded", "binary") if decode else schema)

    def decode(self, encoded: DataFrame, ids_col: str = "token_ids") -> DataFrame:
        """``encoded`` with ``decoded``, the bytes of its token ids."""
        model = self.model

        def texts(column: pa.Array) -> pa.Array:
            return pa.array([_decoded(x, model.value["tokens"]) if x else b"" for x in column.to_pylist()], pa.binary())

        return encoded.drop("decoded").withColumn("decoded", F.arrow_udf(texts, "binary")(F.col(ids_col)))
