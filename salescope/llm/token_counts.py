"""Token counts of a ``sentencepiece`` BPE model by dynamic programming over prefixes.

The count of a prefix is one more than the count of the shorter prefix before its last token (see
``merges``), so one pass over a text gives the exact number of tokens of every prefix: the total,
the longest prefix within a budget and the count of any cut follow without encoding again.

No token crosses a place between two characters that stand together in no piece. The model's pieces
say where that is: before a run of blanks, at a line feed, and between letters or digits and the
signs that no piece joins to them. The counts of the stretches between such places add up to those
of the text. New stretches of a batch are taken in sorted order and share the states of their common
beginnings; totals are kept for later texts up to a fixed number.

Supported are models without normalisation that put a blank before the text, as the named one does;
another is refused. A character outside the vocabulary counts one token for each of its UTF-8 bytes.

Defined results: null text is empty text and has no token; a cut beyond the end counts the whole
text. Extra columns pass through; columns named like the output are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame

from salescope.llm.common import groups, with_columns
from salescope.llm.merges import Kept, Merges, shared

BLANK = "▁"
KEPT = 200_000


class Counter:
    """Token counts of texts and of their prefixes."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = {library.id_to_piece(i): -library.get_score(i) for i in range(library.get_piece_size())
                  if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
        probe = " \t a   ﬁ \n"
        if library.normalize(probe) != BLANK + probe.replace(" ", BLANK) or any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces) \
                or not any(library.is_byte(i) for i in range(library.get_piece_size())):
            raise ValueError("only models without normalisation, with byte fallback and with blanks leading their pieces are supported")
        self.single = pieces.__contains__
        self.merges = Merges(lambda a, b: pieces.get(a + b), pieces)
        self.stretches = re.compile(_pattern(pieces)).findall
        self.kept = Kept(KEPT, self.totals)

    def cut(self, text: str) -> list[str]:
        return self.stretches(BLANK + text.replace(" ", BLANK)) if text else []

    def states(self, stretches: list[str]):
        """(stretch, counts of its prefixes from one character to all); sorted stretches share the states of their
        common beginnings."""
        before, tokens, starts, counts = "", [], [], []
        for stretch in stretches:
            same = shared(before, stretch)
            del tokens[same:], starts[same:], counts[same:]
            self.merges.extend(stretch, tokens, starts, len(stretch))
            for i in range(same, len(stretch)):
                token, start = tokens[i], starts[i]
                own = 1 if len(token) > 1 or self.single(token) else len(token.encode("utf-8"))
                counts.append(own + (counts[start - 1] if start else 0))
            yield stretch, counts
            before = stretch

    def totals(self, stretches: list[str]):
        for stretch, counts in self.states(stretches):
            yield stretch, counts[-1]

    def every_prefix(self, stretch: str) -> list[int]:
        return next(self.states([stretch]))[1]

    def count_batch(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        parts = list(map(self.cut, texts))
        self.kept.hold(set().union(*parts))
        return [sum(map(self.kept.__getitem__, p)) for p in parts]

    def prefixes(self, text: str) -> list[int]:
        """Counts of all prefixes of the text, from none to all of its characters."""
        out, total = [], 0
        for s in self.cut(text):
            out += [total + n for n in self.every_prefix(s)]
            total = out[-1]
        return [0, *out[1:]]  # the first place is the blank before the text

    def within(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens."""
        parts = self.cut(text)
        self.kept.hold(set(parts))
        ends = list(accumulate(map(self.kept.__getitem__, parts)))
        whole = bisect_right(ends, budget)
        at = sum(map(len, parts[:whole]))
        if whole < len(parts):
            before = ends[whole - 1] if whole else 0
            counts = self.every_prefix(parts[whole])
            at += max((i + 1 for i, n in enumerate(counts) if before + n <= budget), default=0)
        return max(0, at - 1)


def _pattern(pieces) -> str:
    """Stretches: runs of letters and digits, or of other signs, with the blanks before them. A sign that a piece joins
    to an ASCII letter counts as a letter, another letter that a piece joins to a sign counts as a sign."""
    joined = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if BLANK not in (a, b)}
    plain = re.compile(r"[^\W_]").fullmatch
    as_letter: set[str] = set()
    as_sign: set[str] = set()
    letter = lambda c: c in as_letter or c not in as_sign and plain(c) is not None
    while across := [(a, b) if letter(a) else (b, a) for a, b in joined if letter(a) != letter(b)]:
        for x, y in across:
            if x.isascii():
                as_letter.add(y)
            else:
                as_sign.add(x)
    signs, letters = ("".join(map(re.escape, sorted(c))) for c in (as_sign, as_letter))
    word, other = f"[^\\W_{signs}]", f"[^\\w{BLANK}\n{letters}]"
    word = f"(?:{word}|[{letters}])" if letters else word
    return f"{BLANK}*(?:{word}+|(?:{other}|[_{signs}])+)|{BLANK}+|\n"


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    return Counter(model)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def count(df: DataFrame, model: bytes, *, text: str = "text", budget: int = 4096) -> DataFrame:
    """All rows with ``n_tokens`` of the whole text and ``kept_chars``: the length in characters of its longest
    prefix with at most ``budget`` tokens."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # one file of fixed size

    def start():
        own = counter(sent.value)

        def rows(batch):
            counts, kept = [], []
            for part in groups(batch):
                decoded = [t.decode("utf-8", "replace") for t in part]
                counts += (n := own.count_batch(decoded))
                kept += [len(t) if k <= budget else own.within(t, budget) for t, k in zip(decoded, n)]
            return counts, kept

        return rows

    return with_columns(df, text, [("n_tokens", "long"), ("kept_chars", "long")], start)


def prefix_counts(df: DataFrame, model: bytes, *, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """All rows with ``out``: array<int>, whose place i + 1 has the number of tokens of the first i characters."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        own = counter(sent.value)
        return lambda batch: ([own.prefixes(t.decode("utf-8", "replace")) for t in batch],)

    return with_columns(df, text, [(out, "array<int>")], start)
