"""Monotone integer sequences in Elias-Fano form, with access and successor search on whole arrays."""

import numpy as np

_ONE = np.uint64(1)
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _EIGHTS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def _bit_places() -> np.ndarray:
    """Place of the set bit of each rank in each byte, at byte * 8 + rank."""
    places = np.zeros((256, 8), dtype=np.int64)
    for byte in range(256):
        found = [i for i in range(8) if byte >> i & 1]
        places[byte, : len(found)] = found
    return places.ravel()


_PLACES = _bit_places()


def _trailing_zeros(words: np.ndarray) -> np.ndarray:
    """Zeros below the lowest set bit; 64 in a word without one."""
    return np.bitwise_count((words & (~words + _ONE)) - _ONE).astype(np.int64)


class EliasFano:
    """``n`` non-decreasing values: low bits packed, high bits as unary gaps in a bit vector.

    The numbers of ones and zeros before each word of the bit vector make selection a bisection over
    words and a search inside one word. All arrays may be memory-mapped.
    """

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, arrays: dict[str, np.ndarray], n: int, bits: int, top: int):
        self.low, self.high, self.ones, self.zeros = (arrays[f] for f in self.FIELDS)
        self.n, self.bits, self.top = n, bits, top

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // max(1, n)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(bits)).astype(np.int64)
        top = int(high[-1]) if n else 0
        places = high + np.arange(n)
        flags = np.zeros((n + top + 1 + 63) // 64 * 64, dtype=np.uint8)
        flags[places] = 1
        words = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(words).astype(np.uint32)
        ones = (np.cumsum(counts, dtype=np.uint32) - counts).astype(np.uint32)
        zeros = (np.arange(len(words), dtype=np.uint32) * np.uint32(64) - ones).astype(np.uint32)
        return (
            {"low": _pack(values & np.uint64((1 << bits) - 1), bits), "high": words, "ones": ones, "zeros": zeros},
            {"n": n, "bits": bits, "top": top},
        )

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        at = np.asarray(at, dtype=np.int64)
        place = self._select(self.ones, self.high, at)
        return ((place - at) << self.bits) | self._low(at)

    def with_next(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at the given positions and at those after them."""
        at = np.asarray(at, dtype=np.int64)
        place = self._select(self.ones, self.high, at)
        # The next set bit mostly lies in the same word.
        after = place + 1
        word = after >> 6
        rest = self.high[np.minimum(word, len(self.high) - 1)] >> (after & 63).astype(np.uint64)
        after += _trailing_zeros(rest)
        far = np.flatnonzero(rest == 0)
        if len(far):
            after[far] = self._select(self.ones, self.high, at[far] + 1)
        return ((place - at) << self.bits) | self._low(at), ((after - at - 1) << self.bits) | self._low(at + 1)

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value that is not smaller than each wanted one, n if there is none,
        and whether the two are equal."""
        wanted = np.asarray(wanted, dtype=np.int64)
        equal = np.zeros(len(wanted), dtype=bool)
        if not self.n:
            return np.zeros(len(wanted), dtype=np.int64), equal
        high = wanted >> self.bits
        beyond = high > self.top
        high = np.minimum(high, self.top)
        # The values with this high part begin behind its zero, counted from one.
        place = np.zeros(len(wanted), dtype=np.int64)
        later = high > 0
        place[later] = self._select(self.zeros, self.high, high[later] - 1, zeros=True) + 1
        at = place - high
        # As many values have this high part as ones follow; mostly they end in the same word.
        shift = place & 63
        rest = self.high[place >> 6] >> shift.astype(np.uint64)
        run = _trailing_zeros(~rest)
        far = np.flatnonzero(run + shift >= 64)
        if len(far):
            run[far] = self._select(self.zeros, self.high, high[far], zeros=True) - place[far]
        self._bisect_runs(at, run, wanted & ((1 << self.bits) - 1), equal)
        at[beyond] = self.n
        equal[beyond] = False
        return at, equal

    def _bisect_runs(self, at: np.ndarray, run: np.ndarray, low: np.ndarray, equal: np.ndarray) -> None:
        """Move each place along its run of one high part to the first value with low bits not below the wanted ones."""
        rows = np.flatnonzero(run)
        first, end, low = at[rows], at[rows] + run[rows], low[rows]
        while len(rows):
            middle = (first + end) >> 1
            value = self._low(middle)
            # The place where a search ends has been looked at, unless it is the end of the run.
            equal[rows.take(np.flatnonzero(value == low))] = True
            smaller = value < low
            first = np.where(smaller, middle + 1, first)
            end = np.where(smaller, end, middle)
            at[rows] = first
            going = np.flatnonzero(first < end)
            rows, first, end, low = (x.take(going) for x in (rows, first, end, low))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), dtype=np.int64)
        first = at * self.bits
        word = first >> 6
        first &= 63
        shift = first.view(np.uint64)
        value = self.low[word]
        value >>= shift
        # The next word's bits come above those of this one; with no shift they all fall out.
        word += 1
        rest = self.low[word]
        rest <<= shift ^ np.uint64(63)
        rest <<= _ONE
        value |= rest
        value &= np.uint64((1 << self.bits) - 1)
        return value.view(np.int64)

    @staticmethod
    def _select(before: np.ndarray, words: np.ndarray, rank: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Place of the set bit, or the zero, with each rank; ``before`` counts such bits ahead of each word."""
        word = np.searchsorted(before, rank.astype(np.uint32), side="right") - 1
        left = (rank - before[word]).astype(np.uint64)
        value = words[word]
        if zeros:
            np.invert(value, out=value)
        # Set bits up to each byte, in that byte.
        upto = value - (value >> _ONE & _PAIRS)
        upto = (upto & _FOURS) + (upto >> np.uint64(2) & _FOURS)
        upto += upto >> np.uint64(4)
        upto &= _EIGHTS
        upto *= _BYTES
        # Whole bytes before the bit: those up to which no more bits are set than the rank.
        whole = left * _BYTES
        whole |= _TOPS
        whole -= upto
        whole &= _TOPS
        shift = np.bitwise_count(whole).astype(np.uint64) << np.uint64(3)
        upto <<= np.uint64(8)
        left -= upto >> shift & np.uint64(255)
        value >>= shift
        value &= np.uint64(255)
        value <<= np.uint64(3)
        value += left
        word <<= 6
        word += shift.view(np.int64)
        word += _PLACES.take(value.view(np.int64))
        return word


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Fixed-width fields in 64-bit words, one word of slack behind them."""
    words = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if not bits or not len(values):
        return words
    first = np.arange(len(values), dtype=np.int64) * bits
    word, shift = first >> 6, (first & 63).astype(np.uint64)
    # Fields ascend, so those that begin in one word are neighbours.
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    words[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
    spill = np.flatnonzero(shift + np.uint64(bits) > 64)
    words[word[spill] + 1] |= values[spill] >> (np.uint64(64) - shift[spill])
    return words
