"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

Bytes are read as Latin-1 characters, so one Aho-Corasick automaton finds every token at every
position of a pre-token in a single pass. Encoding takes the longest token at each position that is
compatible with the token before it, falls back to shorter prefixes, and steps back when none fits;
a position that failed once is never tried again, which bounds the work by the length.

Edge cases: a null text is empty; an empty text has no ids; strings of special tokens are plain
text; null ids and repeated rows pass as they are; an empty table gives an empty table. Other
columns are kept by ``round_trip`` and not read.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Merges
from .common import BoundedCache, id_and_text

# Fixed value: the pattern of pre-tokens for which texts may be cut before a space that no white space follows.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 8 << 20
CHUNK_LIMIT = 400_000
PIECE_LIMIT = 200_000


class ByteBpe:
    """One vocabulary of ranked byte strings, with the pattern that cuts texts into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = np.array(sorted(ranks.values()), dtype=np.int64)
        self.token_bytes = pa.array(sorted(ranks, key=ranks.__getitem__), pa.large_binary())
        self.whole = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.merges = Merges(self.whole)
        self.rank = [self.whole[token] for token in self.merges.strings]
        self.pattern = regex.compile(pattern)
        self.cuts = pattern == CUT_PATTERN
        self.automaton = ahocorasick.Automaton()
        for token, number in self.merges.built.items():
            self.automaton.add_word(token, number)
        self.automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self.pieces = BoundedCache(self._piece_ids, PIECE_LIMIT)
        self.chunks = BoundedCache(self._chunk_ids, CHUNK_LIMIT)

    def shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token itself, or -1."""
        if token not in self._shorter:
            text, built = self.merges.strings[token], self.merges.built
            prefixes = (text[:n] for n in range(len(text) - 1, 0, -1))
            self._shorter[token] = next((built[p] for p in prefixes if p in built), -1)
        return self._shorter[token]

    def split(self, piece: str) -> list[int]:
        """Token numbers of one pre-token, given as Latin-1 characters."""
        lengths, compatible, pair = self.merges.lengths, self.merges.compatible, self.merges.pairs.get
        greedy = [token for _, token in self.automaton.iter_long(piece)]
        tokens: list[int] = []
        at, before = 0, -1
        for token in greedy:
            if before >= 0:
                fits = pair(before << 24 | token)
                if not (compatible(before, token) if fits is None else fits):
                    break
            tokens.append(token)
            at += lengths[token]
            before = token
        else:
            return greedy
        # Ends come in order, so the last match that begins at a position is the longest.
        size, longest = len(piece), [-1] * len(piece)
        for end, match in self.automaton.iter(piece):
            longest[end - lengths[match] + 1] = match
        shorter, dead = self._shorter, bytearray(size + 1)
        while True:
            end = at + lengths[token]
            if not dead[end]:
                fits = pair(before << 24 | token) if tokens else True
                if compatible(before, token) if fits is None else fits:
                    tokens.append(token)
                    at, before = end, token
                    if at == size:
                        return tokens
                    token = longest[at]
                    continue
            fewer = shorter.get(token)
            token = self.shorter(token) if fewer is None else fewer
            if token < 0:
                # Nothing fits here: no encoding ends at this position, so the token before it goes.
                dead[at] = 1
                token = tokens.pop()
                at -= lengths[token]
                before = tokens[-1] if tokens else -1
                fewer = shorter.get(token)
                token = self.shorter(token) if fewer is None else fewer
                # Its shorter prefixes follow; with none left the next turn steps back again.
                while token < 0:
                    dead[at] = 1
                    token = tokens.pop()
                    at -= lengths[token]
                    before = tokens[-1] if tokens else -1
                    token = self.shorter(token)

    def _piece_ids(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1")
        rank = self.whole.get(letters)
        ids = [self.rank[t] for t in self.split(letters)] if rank is None else [rank]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk_ids(self, chunk: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.pattern.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each whole text.

        With the pattern the cuts are made for, a pre-token never goes on past a space that is followed by another
        character than white space, so texts are cut before such spaces. Arrow cuts them and finds the different
        chunks; only these are looked up one by one. Texts of any other pattern are matched whole.
        """
        if not self.cuts:
            return [self._chunk_ids(t or "") for t in texts.to_pylist()]
        if not len(texts):
            return []
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = words.flatten().dictionary_encode()
        known, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        text_starts = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        # A word that is empty or begins with white space belongs to the chunk before it.
        goes_on = np.fromiter((not w or w[0].isspace() for w in known), bool, len(known))[code]
        begins = ~goes_on
        begins[text_starts[:-1]] = True
        first = np.zeros(len(code), bool)
        first[text_starts[:-1]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(code)))
        # Two names for each word, with and without the space before it, then names of their own for longer chunks.
        names = 2 * code[starts] + first[starts]
        longer: dict[str, int] = {}
        for place in np.flatnonzero(sizes > 1).tolist():
            at, size = int(starts[place]), int(sizes[place])
            chunk = ("" if first[at] else " ") + " ".join([known[c] for c in code[at : at + size].tolist()])
            names[place] = longer.setdefault(chunk, 2 * len(known) + len(longer))
        chunks = list(longer)
        different, places = np.unique(names, return_inverse=True)
        cached = self.chunks
        found = [cached[chunks[n - 2 * len(known)] if n >= 2 * len(known) else known[n >> 1] if n & 1 else " " + known[n >> 1]]
                 for n in different.tolist()]
        ids = pa.array(found, pa.large_binary()).take(pa.array(places))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        bounds = ends[np.searchsorted(starts, text_starts)].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        numbers = np.frombuffer(b"".join(ids), dtype="<u4")
        found = self.token_bytes.take(pa.array(np.searchsorted(self.ranks, numbers)))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) if len(found) else np.zeros(1, np.int64)
        bounds = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
        data = memoryview((found.buffers()[2] if len(found) else None) or b"")
        return [bytes(data[i:j]) for i, j in zip(bounds, bounds[1:])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES; a longer value goes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(edges, edges[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``ids``: the encoded whole text, four bytes per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for part in (p for batch in batches for p in _slices(batch, "text")):
            ids = codec.encode_all(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``bytes``: what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for part in (p for batch in batches for p in _slices(batch, "ids")):
            found = codec.decode_all([ids or b"" for ids in part.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes decoded from them."""

    def digests(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for part in (p for batch in batches for p in _slices(batch, "text")):
            ids = codec.encode_all(part.column("text"))
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), counts, digests(ids), digests(codec.decode_all(ids))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
