"""The last token of every prefix under byte-pair merging.

A sequence of tokens is an encoding exactly if every token is the encoding of its own symbols and
every two neighbours are the encoding of theirs. So the encoding of a prefix ends with the one token
that fits the last token of the shorter prefix before it, and the states of all prefixes of a word
follow from left to right, whatever comes after.

The symbols of a text are its characters; the last one of a word may carry a mark (``end``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from math import inf

KEPT_PAIRS = 200_000


class Merges:
    """``rank(a, b)`` is the priority (smaller first, leftmost among equals) with which two neighbouring tokens
    merge, or None; ``known`` has the tokens of more than one symbol that can arise."""

    def __init__(self, rank: Callable[[str, str], float | None], known, end: str = ""):
        self.rank, self.known, self.end = rank, known, end
        # Endings of tokens, with whether they are tokens themselves.
        self.endings: dict[str, bool] = {t[i:]: False for t in known for i in range(len(t))}
        self.endings.update(dict.fromkeys(known, True))
        self._sides: dict[str, tuple[list, list] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}

    def symbols(self, text: str) -> list[str]:
        if self.end and len(text) > len(self.end) and text.endswith(self.end):
            cut = len(text) - len(self.end) - 1
            return [*text[:cut], text[cut:]]
        return list(text)

    def merged(self, symbols: Sequence[str]) -> list[tuple]:
        """The merges one by one; each token as (string, rank, left, right)."""
        parts: list[tuple] = [(s, -inf, None, None) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank(a[0], b[0]) for a, b in zip(parts, parts[1:])]
            best = min((r, i) for i, r in enumerate([inf if r is None else r for r in ranks]))
            if best[0] == inf:
                break
            i = best[1]
            parts[i:i + 2] = [(parts[i][0] + parts[i + 1][0], best[0], parts[i], parts[i + 1])]
        return parts

    def sides(self, token: str) -> tuple[list, list] | None:
        """None if the token is not the encoding of its own symbols. Else its first and its last parts, from the
        symbol to the whole, each with the rank at which it merged into the next."""
        if token in self._sides:
            return self._sides[token]
        parts = self.merged(self.symbols(token))
        got = None
        if len(parts) == 1:
            got = ([], [])
            for side, child in zip(got, (2, 3)):
                node, until = parts[0], inf
                while node is not None:
                    side.append((node[0], until))
                    until, node = node[1], node[child]
                side.reverse()
        self._sides[token] = got
        return got

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the symbols of both ends with these two tokens: no pair of parts that meet at the
        boundary merges before one of them merges into its own token."""
        got = self._fits.get((a, b))
        if got is not None:
            return got
        left, right = self.sides(a)[1], self.sides(b)[0]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank(x, y)
            if r is not None and r < x_until and r <= y_until:
                got = False
                break
            if x_until == y_until == inf:
                got = True
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self._fits) >= KEPT_PAIRS:
            self._fits.clear()
        self._fits[a, b] = got
        return got

    def extend(self, path: str, tokens: list[str], starts: list[int], upto: int, mark: str = "") -> None:
        """Carry the states on to the first ``upto`` symbols of ``path``, the last of them marked.
        ``tokens[i]`` and ``starts[i]``: the last token of the encoding of the first i + 1 symbols, and how many
        symbols lie before it."""
        ending, sides, known_fits, fits = self.endings.get, self.sides, self._fits.get, self.fits
        for end in range(len(tokens) + 1, upto + 1):
            tail = mark if end == upto else ""
            for start in range(end - 1, -1, -1):
                token = path[start:end] + tail
                whole = ending(token)
                if whole or start == end - 1:
                    if start == 0:
                        ok = sides(token) is not None
                    else:
                        pair = (tokens[start - 1], token)
                        ok = known_fits(pair)
                        if ok is None:
                            ok = sides(token) is not None and fits(*pair)
                    if ok:
                        tokens.append(token)
                        starts.append(start)
                        break
                if whole is None:
                    break  # no longer token ends so
            if len(tokens) < end:
                raise ValueError(f"no token ends at {end} of {path!r}")

    @staticmethod
    def encoding(tokens: Sequence[str], starts: Sequence[int], end: int) -> list[str]:
        """The encoding of the first ``end`` symbols, read back through the states."""
        out = []
        while end:
            out.append(tokens[end - 1])
            end = starts[end - 1]
        return out[::-1]


class Kept(dict):
    """Values by word, computed in sorted batches and kept in two generations of at most ``most`` words: when the
    younger is full it becomes the older, so frequent words stay."""

    def __init__(self, most: int, make: Callable[[list[str]], Iterable[tuple[str, object]]]):
        self.most, self.make, self.older = most, make, {}

    def hold(self, words: set[str]) -> None:
        """Afterwards all of ``words`` have their values."""
        new = words - self.keys()
        if len(self) + len(new) > self.most:
            self.older = dict(self)
            self.clear()
            new = words
        older = self.older.get
        missing = []
        for w in new:
            value = older(w)
            if value is None:
                missing.append(w)
            else:
                self[w] = value
        self.update(self.make(sorted(missing)))


def shared(before: str, path: str) -> int:
    """Length of the common beginning."""
    n = 0
    for a, b in zip(before, path):
        if a != b:
            break
        n += 1
    return n
