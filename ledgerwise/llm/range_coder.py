"""Token-id files compressed by an adaptive range coder that mixes contexts of order 0, 1 and 2.

A file is a run of blocks of ``BLOCK`` ids. Every block starts from an empty model and has the crc32 of
its ids, so a block can be read alone and damage is found; a last block beside whole ones is filled up with
zeros. Blocks of one file are coded side by
side in arrays, one id of each block per step; that is only how the work is done, the blocks stay independent.

Model of one block: the id that followed the last two ids when they were last seen (order 2), the
id that followed the last one (order 1), the counts of the ids so far (order 0), and behind them all ids
alike. Orders 2 and 1 carry a confidence, how often in a row they were right. Both confidences, and whether the
two agree, pick the mixing weights: adaptive counts of which of the four was right. Weights and counts of order 0
are renewed at the positions ``REFRESH``; between them an encoder, which knows all ids, looks up whole chunks at once.
The range coder keeps 48 bits; carries are added into the words at the end.

``write_ids`` orders documents by id and writes one file per ``SEGMENT`` ids and partition; ``read_ids`` reads
the files back, several documents per block and several blocks per document as they come.

Edge cases: a null text is empty and has the end id alone; null ids come first; rows with equal ids
follow by a hash of the text; an empty table has no files and gives an empty table; a damaged block raises an
error; other columns are not read.
"""

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .common import id_and_text, slices
from .store import Mapped, write_arrays

BLOCK = 2048
SIDE_BY_SIDE = 2048
SEGMENT = BLOCK * SIDE_BY_SIDE
# Positions of a block at which counts and shares are renewed.
REFRESH = (0, 32, 64, 128, 256, 512, 768, 1024, 1280, 1536, 1792)
MOST_IDS = 1 << 16
# Shares are 4096ths; one of them is 1 << 16 units of the range, so that every new id has a place.
_SHARES, _UNIT_BITS, _TOTAL_BITS = 1 << 12, 16, 28
_WINDOW_BITS = 48
_WINDOW, _ONE, _TWO = (1 << _WINDOW_BITS) - 1, 1 << 32, 1 << 16
_BITS1, _BITS2, _BLOCK_BITS = 10, 11, 11
_SURE = 3
_KINDS, _STATES = 4, 32
# Numbers of a state in a table of shares: the ends of the shares, then one per kind.
_PLACES = 1 + _KINDS
_OBSERVED = 24
# A kind's begin in shares, below its units in a table; a part that is a whole share has as many units as that.
_BEGIN_BITS = 13
_PART = _BEGIN_BITS + _UNIT_BITS
# Fields of 14 bits for three ends: one in each, their uppermost bits, and where the product of such bits and ``_EACH`` has their sum.
_FIELD = 14
_EACH = 1 | 1 << _FIELD | 1 << 2 * _FIELD
_REACHED, _SUM = _EACH << _FIELD - 1, 3 * _FIELD - 1


def _slots(last, before) -> tuple[np.ndarray, np.ndarray]:
    """Places of the contexts of order 1 and 2 in a block's tables."""
    one = last * 40503
    return one >> 3 & (1 << _BITS1) - 1, one + before * 30011 >> 2 & (1 << _BITS2) - 1


def _first_counts() -> np.ndarray:
    """Weights per state and kind (order 2, order 1, order 0, new) before anything is seen."""
    state = np.arange(_STATES)
    sure2, sure1, differ = state >> 2 & 3, state & 3, state < 16
    two = np.array([4, 40, 70, 90])[sure2]
    one = np.where(differ, np.array([6, 20, 40, 60])[sure1] * (100 - two) // 100, 0)
    rest = 100 - two - one
    return np.stack([two, one, rest // 2, rest - rest // 2], axis=1)


class Shares:
    """Adaptive mixing weights: how often, in each state of confidence, each kind was right."""

    def __init__(self, n: int):
        self.n = n
        self.counts = np.tile(_first_counts().T, (1, n)).astype(np.float64)

    def table(self, seen: int) -> np.ndarray:
        """Per block and state ``_PLACES`` numbers: packed, the ends of the shares of order 2, 1 and 0; then for each kind,
        packed, the begin of its share and the units of one part of it (order 2 and 1: the whole share; order 0: one id seen;
        new: one id)."""
        least = np.ones((_KINDS, 1, _STATES))
        least[1, :, 16:] = 0
        least[2] = seen > 0
        counts = self.counts.reshape(_KINDS, self.n, _STATES) * (least > 0)
        total = counts[0] + counts[1] + counts[2] + counts[3]
        # Whole numbers far below 2 ** 53: the whole parts of these quotients are exact.
        counts *= _SHARES - least.sum(axis=0)
        counts /= total
        two, one, zero, _ = counts.astype(np.int64) + least.astype(np.int64)
        one += two
        zero += one
        found = np.empty((self.n, _STATES, _PLACES), dtype=np.int64)
        found[:, :, 0] = two | one << _FIELD | zero << 2 * _FIELD
        found[:, :, 1] = two << _PART
        found[:, :, 2] = two | one - two << _PART
        found[:, :, 3] = one | np.maximum((zero - one << _UNIT_BITS) // max(seen, 1), 1) << _BEGIN_BITS
        found[:, :, 4] = zero | _SHARES - zero << _BEGIN_BITS
        return found.ravel()

    def add(self, places: np.ndarray) -> None:
        """Count what was found, given as places in the table."""
        found = np.bincount(places.ravel(), minlength=self.n * _STATES * _PLACES).reshape(-1, _PLACES)
        self.counts += _OBSERVED * found[:, 1:].T


def _chunks(size: int) -> list[tuple[int, int]]:
    starts = [s for s in REFRESH if s < size]
    return list(zip(starts, [*starts[1:], size]))


def _guesses(ids: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For every position the entry a decoder would find in the slot: the id that followed last time,
    and above 16 bits how often in a row the slot was right. Found by sorting, all positions at once."""
    n, size = ids.shape
    key = np.sort(slots << _BLOCK_BITS | np.arange(size, dtype=np.int32), axis=1)
    place = ((key & BLOCK - 1) + np.arange(0, n * size, size)[:, None]).ravel()
    value = ids.ravel().take(place)
    group = key >> _BLOCK_BITS
    follows = np.zeros((n, size), dtype=bool)
    np.equal(group[:, 1:], group[:, :-1], out=follows[:, 1:])
    follows = follows.ravel()[1:]
    found = np.zeros(len(value), dtype=np.int32)
    np.multiply(value[:-1], follows, out=found[1:])
    once, twice, often = (np.zeros(len(value), dtype=bool) for _ in range(_SURE))
    np.logical_and(follows, (value == found)[:-1], out=once[1:])
    np.logical_and(once[1:], once[:-1], out=twice[1:])
    np.logical_and(twice[1:], twice[:-1], out=often[1:])
    sure = once.view(np.int8) + twice.view(np.int8) + often.view(np.int8)
    found += sure.astype(np.int32) << 16
    entry = np.empty(len(value), dtype=np.int32)
    entry[place] = found
    return entry.reshape(n, size)


class _Earlier:
    """How often every id stands in its block's ids of the positions before a renewal, and how many smaller ones."""

    def __init__(self, ids: np.ndarray):
        n, size = ids.shape
        key = np.sort((ids.astype(np.uint32) << _BLOCK_BITS) | np.arange(size, dtype=np.uint32), axis=1)
        place = ((key & BLOCK - 1) + np.arange(0, n * size, size)[:, None]).ravel()
        value = key >> _BLOCK_BITS
        new = np.ones((n, size), dtype=bool)
        np.not_equal(value[:, 1:], value[:, :-1], out=new[:, 1:])
        # Different ids are numbered in ascending order, block by block.
        number = np.cumsum(new.ravel())
        number -= 1
        self.group = np.empty((n, size), dtype=np.int64)
        self.group.ravel()[place] = number
        self.count = np.zeros(number[-1] + 1, dtype=np.int64)
        self.upto = np.zeros(len(self.count) + 1, dtype=np.int64)

    def find(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places among the ``start`` ids added so far, in ascending order, of the ids of a chunk."""
        group = np.ascontiguousarray(self.group[:, start:end])
        return self.upto.take(group) - start * np.arange(len(group))[:, None], self.count.take(group)

    def add(self, start: int, end: int) -> None:
        self.count += np.bincount(self.group[:, start:end].ravel(), minlength=len(self.count))
        np.cumsum(self.count, out=self.upto[1:])


def _plan(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of every id's interval, one row per position. All ids are known here, so a whole
    chunk between two renewals is looked up at once."""
    n, size = ids.shape
    wide = ids.astype(np.int32)
    last = np.zeros((n, size + 2), dtype=np.int32)
    last[:, 2:] = wide
    slots1, slots2 = _slots(last[:, 1:-1], last[:, :-2])
    entry1, entry2 = _guesses(wide, slots1), _guesses(wide, slots2)
    guess1, guess2 = entry1 & 0xFFFF, entry2 & 0xFFFF
    state = ((entry2 >> 14 & 12) + (entry1 >> 16) + ((guess1 == guess2).view(np.int8) << 4)).astype(np.int64)
    state += np.arange(0, n * _STATES, _STATES)[:, None]
    state *= _PLACES
    not2 = wide != guess2
    kinds = not2.view(np.int8) * (1 + 2 * (wide != guess1).view(np.int8))
    earlier = _Earlier(ids)
    begin, width = np.empty((n, size), dtype=np.int64), np.empty((n, size), dtype=np.int64)
    shares = Shares(n)
    for start, end in _chunks(size):
        first, count = earlier.find(start, end)
        missed = kinds[:, start:end] == 3
        known = missed & (count > 0)
        new = missed & (count == 0)
        places = state[:, start:end] + kinds[:, start:end]
        places -= known
        places += 1
        part = shares.table(start).take(places)
        base = part & (1 << _BEGIN_BITS) - 1
        base <<= _UNIT_BITS
        part >>= _BEGIN_BITS
        first *= known
        first += wide[:, start:end] * new
        first *= part
        np.add(base, first, out=begin[:, start:end])
        count -= 1
        count *= known
        count += 1
        np.multiply(count, part, out=width[:, start:end])
        shares.add(places)
        earlier.add(start, end)
    return begin.T, width.T


# Blocks planned at once, so that their arrays stay in the processor's cache, and blocks coded at once.
_PLANNED, _CODED = 64, 1024


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code rows of ids (blocks x positions); returns all 16-bit words block by block, and words per block."""
    some = [_encode(ids[i : i + _CODED]) for i in range(0, len(ids), _CODED)]
    return np.concatenate([words for words, _ in some]), np.concatenate([counts for _, counts in some])


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, size = ids.shape
    begin, width = np.empty((size, n), dtype=np.int64), np.empty((size, n), dtype=np.int64)
    for i in range(0, n, _PLANNED):
        begin[:, i : i + _PLANNED], width[:, i : i + _PLANNED] = _plan(ids[i : i + _PLANNED])
    low, span = np.zeros(n, dtype=np.int64), np.full(n, _WINDOW + 1)
    # Up to two words a position and two at the end; a word may hold a carry in bit 16 for now.
    words, filled = np.empty((n, size + 1, 2), dtype=np.int32), np.empty((n, size + 1, 2), dtype=bool)
    for step in range(size):
        unit = span >> _TOTAL_BITS
        low += unit * begin[step]
        span = unit * width[step]
        one, two = span < _ONE, span < _TWO
        filled[:, step, 0], filled[:, step, 1] = one, two
        words[:, step, 0] = low >> 32
        words[:, step, 1] = low >> 16 & 0xFFFF
        # What leaves the window goes; a carry stays as long as no word goes with it.
        shift = one.astype(np.int64)
        keep = shift - 1
        keep |= _WINDOW
        shift += two
        shift <<= 4
        low <<= shift
        low &= keep
        span <<= shift
    last = low + 0xFFFF >> 16
    words[:, size, 0], words[:, size, 1], filled[:, size] = last >> 16, last & 0xFFFF, True
    filled = filled.reshape(n, -1)
    flat = words.reshape(n, -1)[filled]
    while (carry := flat >> 16).any():
        flat &= 0xFFFF
        flat[:-1] += carry[1:]
    return flat.astype(np.uint16), filled.sum(axis=1).astype(np.uint32)


def _order0(ordered: np.ndarray) -> np.ndarray:
    """Per block, of its ids so far in ascending order, at each place packed: id, first place, places."""
    n, seen = ordered.shape
    packed = np.empty((n, seen), dtype=np.int64)
    for i in range(0, n, _PLANNED):
        some = ordered[i : i + _PLANNED]
        new = np.ones(some.shape, dtype=bool)
        np.not_equal(some[:, 1:], some[:, :-1], out=new[:, 1:])
        starts = np.flatnonzero(new)
        counts = np.diff(starts, append=some.size)
        runs = starts - starts // seen * seen
        runs <<= 16
        runs |= some.ravel().take(starts)
        runs |= counts << 32
        packed[i : i + _PLANNED] = np.repeat(runs, counts).reshape(some.shape)
    return packed.ravel()


# In a damaged block a span can come to nothing; it is the block's sum that tells.
@np.errstate(divide="ignore")
def decode(words: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ids of all blocks, ``size`` of each."""
    n = len(counts)
    words = np.append(words, np.zeros(4, dtype=np.uint16)).astype(np.uint32)
    pairs = words[:-1] << 16 | words[1:]
    at = np.cumsum(counts.astype(np.int64)) - counts
    code = pairs[at].astype(np.int64) << 16 | words[at + 2]
    at += 3
    span = np.full(n, _WINDOW + 1)
    row0 = np.arange(n, dtype=np.int64)
    # Contexts and entries are of 32 bits; only the low bits of the hashes count, so they may overflow.
    row1, row2 = row0 << _BITS1, (n << _BITS1) + (row0 << _BITS2)
    slots, tables = np.empty((2, n), dtype=np.int64), np.zeros((n << _BITS1) + (n << _BITS2), dtype=np.int32)
    # By kind, the guesses of orders 2 and 1; the others have none.
    guesses = np.zeros((_KINDS, n), dtype=np.int32)
    two_guesses = guesses[:2]
    row_state = row0.astype(np.int32) * _STATES
    last = before = np.zeros(n, dtype=np.int32)
    ids, ordered = np.empty((n, size), dtype=np.uint16), np.empty((n, size), dtype=np.uint16)
    shares = Shares(n)
    for start, end in _chunks(size):
        table = shares.table(start)
        order0 = _order0(ordered[:, :start]) if start else np.zeros(1, dtype=np.int64)
        chunk = np.empty((end - start, n), dtype=np.uint16)
        row_seen = row0 * start
        places = np.empty((end - start, n), dtype=np.int64)
        for step in range(start, end):
            slot1, slot2 = _slots(last, before)
            np.add(slot2, row2, out=slots[0])
            np.add(slot1, row1, out=slots[1])
            entries = tables.take(slots)
            np.bitwise_and(entries, 0xFFFF, out=two_guesses)
            entries >>= 16
            state = (guesses[0] == guesses[1]).astype(np.int32)
            state <<= 2
            state += entries[0]
            state <<= 2
            state += entries[1]
            state += row_state
            state *= _PLACES
            state = state.astype(np.int64)
            unit = span >> _TOTAL_BITS
            place = code // unit
            # All three ends are compared at once: a bit stays where the share is not below the end. Their sum is the kind.
            kind = place >> _UNIT_BITS
            kind *= _EACH
            kind += _REACHED
            kind -= table.take(state)
            kind &= _REACHED
            kind *= _EACH
            kind >>= _SUM
            kind &= 3
            state += 1
            which = np.add(state, kind, out=places[step - start])
            part = table.take(which)
            # Units before the share of this kind, units of one place in it, and the place.
            base = part & (1 << _BEGIN_BITS) - 1
            base <<= _UNIT_BITS
            part >>= _BEGIN_BITS
            place -= base
            place //= part
            # Id, first place and places packed: those of order 0, else of a new id or of a whole share.
            found = order0.take(row_seen + place, mode="clip")
            place *= 65537
            place += 1 << 32
            found -= place
            found *= kind == 2
            found += place
            # Orders 2 and 1 have their guesses instead of the id.
            kind *= n
            kind += row0
            now = found.astype(np.int32)
            now &= 0xFFFF
            now += guesses.take(kind, mode="clip")
            begin = found >> 16
            begin &= 0xFFFF
            begin *= part
            begin += base
            begin *= unit
            code -= begin
            found >>= 32
            found *= part
            found *= unit
            span = found
            more = np.add(span < _ONE, span < _TWO, dtype=np.int64)
            fill = pairs.take(at, mode="clip").astype(np.int64)
            at += more
            more <<= 4
            fill >>= 32 - more
            code <<= more
            code |= fill
            span <<= more
            # An entry that was right is surer, another one is replaced.
            entries += 1
            np.minimum(entries, _SURE, out=entries)
            entries *= two_guesses == now
            entries <<= 16
            entries += now
            tables[slots] = entries
            chunk[step - start] = now
            before, last = last, now
        shares.add(places)
        for i in range(0, n, _PLANNED):
            ids[i : i + _PLANNED, start:end] = ordered[i : i + _PLANNED, start:end] = chunk[:, i : i + _PLANNED].T
            if end < size:
                ordered[i : i + _PLANNED, :end].sort(axis=1)
    return ids


def pack_ids(ids: np.ndarray) -> dict[str, np.ndarray]:
    """The blocks of a run of ids as arrays of a file."""
    if len(ids) and int(ids.max()) >= MOST_IDS:
        raise ValueError("ids beyond 16 bits")
    ids = ids.astype(np.uint16)
    sums = [zlib.crc32(ids[i : i + BLOCK].tobytes()) for i in range(0, len(ids), BLOCK)]
    size = min(BLOCK, max(len(ids), 1))
    # A last block beside whole ones is filled up, so that all are coded in one go.
    rows = np.append(ids, np.zeros(-len(ids) % size, np.uint16)).reshape(-1, size)
    words, counts = encode(rows) if len(rows) else (np.zeros(0, np.uint16), np.zeros(0, np.uint32))
    return {"words": words, "block_words": counts, "block_crc": np.array(sums, dtype=np.uint32),
            "n_ids": np.array([len(ids)], dtype=np.int64)}


def unpack_ids(arrays) -> np.ndarray:
    """All ids of a file, every block checked."""
    words, counts, size = arrays["words"], arrays["block_words"], int(arrays["n_ids"][0])
    ids = decode(words, counts, min(BLOCK, size)).ravel()[:size] if size else np.zeros(0, np.uint16)
    for i, wanted in enumerate(arrays["block_crc"].tolist()):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != wanted:
            raise ValueError(f"block {i} is damaged")
    return ids


CHUNK_LIMIT = 1_500_000
# Chunks encoded in one text, and texts in one call.
_JOINED, _TEXTS = 128, 32


def _byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, equal words encoded once.

    The tokenizer must drop white space and never join text across it; chunks between spaces and line ends then
    encode alone as they do in the text. New chunks go to the library many in one text, with a special token between
    them, at which it cuts a text before anything else; a chunk that might hold one is encoded alone.
    Where the tokenizer file says that it lower-cases, cuts between letters and marks and works on bytes, Arrow cuts
    chunks into a word of plain letters and marks behind it; words and marks are then looked up and known apart, and
    a new word goes to the library's merge model at once.
    """

    # Letters that neither normal forms nor lower-casing turn into anything else, then marks that start no ending.
    _CHUNK = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[" + re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~") + "]*)$"
    # The steps of such a tokenizer, and the end of the pattern it cuts by.
    _STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
    _CUTS = "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # By character, the bytes of plain letters as the vocabulary writes them.
        letters = _byte_characters()
        self.spelled = [c if c < 128 else chr(c).encode().decode("latin-1").translate(letters) for c in range(256)]
        self.plain = self._is_plain(json.loads(self.tokenizer.to_str()))
        marks = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                 if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (marks[-1][0], marks[-1][1].content) if marks else (-1, "")

    def _is_plain(self, file: dict) -> bool:
        before = (file.get("normalizer") or {}).get("normalizers", [])
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return [step["type"] for step in before + cuts] == self._STEPS and cuts[0]["pattern"].get("Regex", "").endswith(self._CUTS)

    def _merge(self, words: list[str]) -> None:
        """Learn words of plain lower-case letters."""
        tokenize, spelled = self.model.tokenize, self.spelled
        ids, ends = [], [0]
        for word in words:
            ids += [token.id for token in tokenize(word if word.isascii() else word.translate(spelled))]
            ends.append(2 * len(ids))
        raw = np.array(ids, dtype="<u2").tobytes()
        self.known.update(zip(words, [raw[i:j] for i, j in zip(ends, ends[1:])]))

    def _ids(self, parts: pa.Array, learn: Callable[[list[str]], None]) -> pa.Array:
        """Ids of each part; of equal ones and of those known before none is looked at again."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        places = [i for i, ids in enumerate(found) if ids is None]
        learn([names[i] for i in places])
        for i in places:
            found[i] = self.known[names[i]]
        return pa.array(found, pa.binary()).take(coded.indices)

    def _ask(self, chunks: list[str]) -> None:
        joined = [c for c in chunks if self.mark[0] not in c] if self.mark else []
        alone = [c for c in chunks if self.mark[0] in c] if self.mark else chunks
        for start in range(0, len(joined), _JOINED * _TEXTS):
            parts = [joined[i : i + _JOINED] for i in range(start, min(start + _JOINED * _TEXTS, len(joined)), _JOINED)]
            for part, found in zip(parts, self.tokenizer.encode_batch_fast([self.mark.join(p) for p in parts], add_special_tokens=False)):
                ids = np.array(found.ids, dtype="<u2")
                raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.mark_id) * 2).tolist()
                for chunk, begin, end in zip(part, [0, *(c + 2 for c in cuts)], [*cuts, len(raw)], strict=True):
                    self.known[chunk] = raw[begin:end]
        for start in range(0, len(alone), 4096):
            part = alone[start : start + 4096]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[chunk] = np.array(found.ids, dtype="<u2").tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text. Arrow cuts the texts and finds the different chunks; only these are looked at."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        if len(self.known) > CHUNK_LIMIT:
            self.known.clear()
        if self.plain:
            cut = pc.extract_regex(chunks, self._CHUNK)
            words, marks = pc.utf8_lower(pc.struct_field(cut, [0])), pc.struct_field(cut, [1])
            ids = pc.binary_join_element_wise(self._ids(words, self._merge), self._ids(marks, self._ask), b"")
            other = pc.is_null(cut)
            ids = pc.replace_with_mask(ids, other, self._ids(chunks.filter(other), self._ask))
        else:
            ids = self._ids(chunks, self._ask)
        all_ids = ids.cast(pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(all_ids.buffers()[1], dtype=np.int64, count=len(all_ids) + 1)
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = all_ids.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(data[i:j]) for i, j in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# Bytes of text handled at once; a longer text goes alone.
_SLICE_BYTES = 1 << 23


FILES = "part bigint, segment bigint, n_ids bigint, n_bytes bigint"


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, parts: int | None = None) -> tuple[DataFrame, str]:
    """Encode all texts and write them in ascending order of doc_id.

    Returns one row per file (part, segment, n_ids, n_bytes) and the folder. Sorting by ranges keeps
    partitions even; rows of one id are told apart by their text, so none gathers in one task.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = id_and_text(docs).repartitionByRange(parts, *keys).sortWithinPartitions(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], dtype="<u2").tobytes()
        segment, held, ids, nulls, sizes, size = 0, [], [], [], [], 0

        def written_file(held, ids, nulls, sizes) -> pa.RecordBatch:
            arrays = pack_ids(np.frombuffer(b"".join(held), dtype="<u2"))
            arrays |= {"doc_id": np.array(ids, dtype=np.int64), "no_id": np.array(nulls, dtype=np.uint8),
                       "doc_ids": np.array(sizes, dtype=np.int64)}
            n_bytes = write_arrays(f"{folder}/{part:06d}-{segment:06d}", arrays)
            return pa.RecordBatch.from_pylist([{"part": part, "segment": segment, "n_ids": int(arrays["n_ids"][0]), "n_bytes": n_bytes}])

        for batch in batches:
            for some in slices(batch, _SLICE_BYTES):
                for doc_id, found in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text"))):
                    found += end
                    first = True
                    # A document goes on in the next file where this one is full; its row there has no start.
                    while found:
                        take = found[: (SEGMENT - size) * 2]
                        held.append(take)
                        ids.append(doc_id or 0)
                        nulls.append((doc_id is None) + (0 if first else 2))
                        sizes.append(len(take) // 2)
                        size += len(take) // 2
                        found, first = found[len(take) :], False
                        if size == SEGMENT:
                            yield written_file(held, ids, nulls, sizes)
                            segment, held, ids, nulls, sizes, size = segment + 1, [], [], [], [], 0
        if size:
            yield written_file(held, ids, nulls, sizes)

    files = spark.createDataFrame(ordered.mapInArrow(run, FILES).collect(), FILES)
    return files, folder


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, crc32 of the
    ids as little-endian unsigned 32-bit integers."""
    # One row per file; the sums of whole parts are few and go over one ordered window.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.max("segment").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", "last", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    count = max(1, files.select("part").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for row in batch.to_pylist():
                at, open_row = row["start"], None
                for segment in range(row["last"] + 1):
                    file = Mapped(f"{folder}/{row['part']:06d}-{segment:06d}")
                    ids = unpack_ids(file.arrays).astype("<u4")
                    found, place = [], 0
                    for doc_id, flags, size in zip(file["doc_id"].tolist(), file["no_id"].tolist(), file["doc_ids"].tolist()):
                        part = ids[place : place + size].tobytes()
                        place += size
                        if flags & 2:
                            open_row = [open_row[0], open_row[1], open_row[2] + size, zlib.crc32(part, open_row[3])]
                        else:
                            if open_row:
                                found.append(open_row)
                            open_row = [None if flags & 1 else doc_id, at, size, zlib.crc32(part)]
                        at += size
                    yield rows(found)
                if open_row:
                    yield rows([open_row])

    return parts.repartition(count, "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def size_report(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Ids, bytes of the files and bits per id."""
    return files.agg(F.sum("n_ids").alias("n_ids"), F.sum("n_bytes").alias("n_bytes"), (F.sum("n_bytes") * 8 / F.sum("n_ids")).alias("bits_per_id"))
