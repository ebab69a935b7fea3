"""Token counts at every prefix of a text by dynamic programming over the vocabulary.

For each prefix the table holds the last token of its encoding and the number of tokens. The last
token of a prefix is the one piece that ends there and is compatible with the last token of the
prefix before it; there is exactly one. No piece holds a space mark after another character, so a
text falls into parts that begin with a run of space marks; parts are independent, and one table
per different part serves all texts. What is kept per text is one signed byte per character: the
change of the count. Counts at any prefix, the longest prefix within a budget and the total follow
without encoding again.

Edge cases: a null text is empty; an empty text has no tokens and an empty table; a text of
spaces counts its space marks; null ids and repeated rows pass as they are; an empty table gives
an empty table. Other columns are not read.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges
from .common import BoundedCache, id_and_text

MARK = "▁"
PART_LIMIT = 600_000
TOKEN_LIMIT = 4096


def _fallback(character: str) -> int:
    """An unknown character never merges and costs one token per byte."""
    return len(character.encode("utf-8", "surrogatepass"))


class PrefixCounter:
    """Prefix tables for one sentencepiece BPE vocabulary with byte fallback."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = [i for i in range(pieces.get_piece_size()) if not (
            pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
        order = sorted(ids, key=lambda i: (-pieces.get_score(i), i))
        ranks = {pieces.id_to_piece(i): rank for rank, i in enumerate(order)}
        if any(MARK in piece.lstrip(MARK) for piece in ranks):
            raise ValueError("a piece with an inner space mark: texts cannot be cut at spaces")
        self.merges = Merges(ranks)
        self.automaton = ahocorasick.Automaton()
        for piece, number in self.merges.built.items():
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.parts = BoundedCache(self._part, PART_LIMIT)

    def counts(self, part: str) -> list[int]:
        """Tokens of every prefix of one part, by the table over its prefixes."""
        size, lengths, compatible = len(part), self.merges.lengths, self.merges.compatible
        known = self.merges.pairs.get
        last, counts = [-1] * (size + 1), [0] * (size + 1)
        open_end = 1
        for at, token in self.automaton.iter(part):
            while open_end <= at:
                counts[open_end] = counts[open_end - 1] + _fallback(part[open_end - 1])
                open_end += 1
            if open_end == at + 1:
                start = open_end - lengths[token]
                before = last[start]
                fits = before < 0 or known(before << 24 | token)
                if compatible(before, token) if fits is None else fits:
                    last[open_end], counts[open_end] = token, counts[start] + 1
                    open_end += 1
        while open_end <= size:
            counts[open_end] = counts[open_end - 1] + _fallback(part[open_end - 1])
            open_end += 1
        return counts

    def _part(self, part: str) -> bytes:
        counts = self.counts(part)
        return bytes([(after - before) & 255 for before, after in zip(counts, counts[1:])])

    def deltas(self, text: str) -> bytes:
        """Change of the token count at every character of the marked text (one mark, then the text)."""
        if not text:
            return b""
        words = text.replace(" ", MARK).split(MARK)
        if "" not in words:
            return b"".join([self.parts[MARK + word] for word in words])
        table, marks = [], ""
        for word in words:
            marks += MARK
            if word:
                table.append(self.parts[marks + word])
                marks = ""
        if marks:
            table.append(self.parts[marks])
        return b"".join(table)


@lru_cache(maxsize=2)
def counter(model: str) -> PrefixCounter:
    return PrefixCounter(model)


def prefix_table(deltas: bytes) -> np.ndarray:
    """Tokens of each prefix of 1, 2, ... characters of the text; its dummy space is counted."""
    return np.cumsum(np.frombuffer(deltas, dtype=np.int8), dtype=np.int64)[1:]


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, from its table alone.

    Counts can fall when a longer piece completes, so the last fitting prefix is sought, not the
    first that does not fit.
    """
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def store_prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ``deltas``: the whole prefix table of each text, one byte per character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model)
        for batch in batches:
            found = [table.deltas(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "deltas"])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, deltas binary")


def token_counts(docs: DataFrame, model: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Per document: bytes, tokens, whether over ``limit``, and where a cut to ``limit`` falls.

    ``kept_chars`` is the longest prefix of at most ``limit`` tokens, ``kept_tokens`` its count;
    both are read from the prefix table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                counts = prefix_table(table.deltas(text))
                total = int(counts[-1]) if len(counts) else 0
                kept = longest_within(counts, limit) if total > limit else len(counts)
                size = len(text) if text.isascii() else len(text.encode("utf-8"))
                rows.append((size, total, total > limit, kept, int(counts[kept - 1]) if kept else 0))
            columns = list(zip(*rows)) or [(), (), (), (), ()]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars", "kept_tokens"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, kept_chars bigint, kept_tokens bigint")
