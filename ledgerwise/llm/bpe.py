"""Byte-pair merges by rank, and the compatibility of adjacent tokens.

A sequence of tokens is the result of the merges exactly when every adjacent pair of it is: each
pair's concatenation merges back into just these two tokens. ``Merges.compatible`` answers that for
one pair without merging, by undoing the youngest merge at the seam again and again: the pair is
wrong if at some step the two pieces at the seam would have merged before the step undone.
"""

PAIR_LIMIT = 400_000
_NO_LIMIT = 1 << 62


class Merges:
    """A vocabulary whose tokens are strings; two neighbours merge if their join is a token.

    Tokens are numbered by age: single characters first, then the others by rank. ``left`` and
    ``right`` hold the two halves of a token's last merge. Tokens that the merges cannot build
    have no number in ``built``.
    """

    def __init__(self, ranks: dict[str, int]):
        single = [t for t in ranks if len(t) == 1]
        merged = sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__)
        self.strings = single + merged
        self.number = {token: n for n, token in enumerate(self.strings)}
        self.lengths = [len(token) for token in self.strings]
        self.left = list(range(len(self.strings)))
        self.right = list(self.left)
        self.built = {token: n for n, token in enumerate(single)}
        self.pairs: dict[int, bool] = {}
        for token in merged:
            self._find_halves(token)

    def _find_halves(self, token: str) -> None:
        number, built = self.number[token], self.built
        for cut in range(1, len(token)):
            left, right = built.get(token[:cut]), built.get(token[cut:])
            if left is not None and right is not None and self._holds(left, right, number):
                self.left[number], self.right[number] = left, right
                built[token] = number
                return

    def _holds(self, a: int, b: int, limit: int = _NO_LIMIT) -> bool:
        """Whether the seam between a and b stays open by merges older than ``limit``."""
        strings, number, left, right, lengths = self.strings, self.number, self.left, self.right, self.lengths
        while True:
            joined = number.get(strings[a] + strings[b])
            if joined is not None and joined < limit:
                return False
            if lengths[a] == 1 and lengths[b] == 1:
                return True
            if lengths[b] == 1 or (lengths[a] > 1 and a > b):
                limit, a = a, right[a]
            else:
                # Of two equal merges the left one comes first, and the seam is left of b's.
                limit, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the concatenation of two built tokens merges into exactly these two."""
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._holds(a, b)
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def merge(self, text: str) -> list[str]:
        """The plain merge loop, lowest rank first and leftmost among equals: for tests."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [(self.number.get(x + y, _NO_LIMIT), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))]
            rank, at = min(ranks)
            if rank == _NO_LIMIT:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
