"""BPE encoding and decoding with the vocabulary of a ``tokenizers`` JSON file.

A text is cut at special tokens, normalised and cut into words as the file says. The distinct new
words of a batch form a trie, walked depth first in sorted order: the state of a node (the last
token of the encoding of its prefix, see ``merges``) is computed once for all words below it, the
stack of states is cut back to the common prefix when the walk goes on to the next branch, and a
word's ids are read back from its last node. Encodings of words are kept for later batches, up to a
fixed number; words not met for long are dropped and computed anew.

Supported are files with a byte-level BPE model with an end-of-word suffix, NFC, white space folding
and lower-casing, without a decoder (whose decoded text is the token strings joined by blanks), as
the named vocabulary has; another file is refused. Texts whose characters all lie below U+0250
take a short way through NFC and a pattern; any other text is normalised and cut by the library's
own components, so that rare characters follow its Unicode tables.

Defined results: null text encodes to an empty list and decodes to an empty text; null ids decode to
an empty text. Extra columns pass through; columns named like the output are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from salescope.llm.common import groups, with_columns
from salescope.llm.merges import Kept, Merges, shared

END = "</w>"
KEPT_WORDS = 150_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others take the letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file; ``source`` is its JSON text."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if (model["type"], model["end_of_word_suffix"], model["continuing_subword_prefix"], kinds, [c["type"] for c in cuts], spec["decoder"]) != (
                "BPE", END, None, ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None) or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            raise ValueError("only byte-level BPE files with word ends, NFC, lower-casing and no decoder are supported")
        library = Tokenizer.from_str(source)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab: dict[str, int] = model["vocab"]
        order = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.merges = Merges(lambda a, b: order.get((a, b)), self.vocab, END)
        self.letters = byte_letters()
        self.kept = Kept(KEPT_WORDS, self.walk)
        self.plain = re.compile("[\x00-ɏ]*")

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if self.plain.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            return self.pattern.findall(text.lower())
        back = {c: b for b, c in enumerate(self.letters)}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.cut(self.normalize(text))]

    def walk(self, words: list[str]):
        """(word, ids) of each word, in one walk through their trie."""
        spelled = sorted(("".join([self.letters[b] for b in w.encode("utf-8")]), w) for w in words)
        before, tokens, starts = "", [], []  # the path from the root and the states along it
        for path, word in spelled:
            same = shared(before, path)
            del tokens[same:], starts[same:]
            self.merges.extend(path, tokens, starts, len(path))
            # The end of the word is one more branch, whose symbol is the last letter with the end mark.
            last_tokens, last_starts = tokens[:-1], starts[:-1]
            self.merges.extend(path, last_tokens, last_starts, len(path), END)
            ids = [self.vocab[t] for t in Merges.encoding(last_tokens, last_starts, len(path))]
            yield word, array("i", ids).tobytes()
            before = path

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        parts: list[list[str | int]] = []
        special = self.special
        for text in texts:
            if self.at_special and "<" in text and len(pieces := self.at_special.split(text)) > 1:
                parts.append([w for p in pieces for w in ([special[p]] if p in special else self.words(p))])
            else:
                parts.append(self.words(text))
        kept = self.kept
        kept.hold({w for p in parts for w in p if w.__class__ is str})
        return [b"".join([kept[w] if w.__class__ is str else np.int32(w).tobytes() for w in p]) for p in parts]


class Decoder:
    def __init__(self, source: str):
        spec = json.loads(source)
        if spec["decoder"] is not None:
            raise ValueError("only files without a decoder are supported")
        self.strings = dict(chain(((i, t) for t, i in spec["model"]["vocab"].items()), ((t["id"], t["content"]) for t in spec["added_tokens"])))

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    return Codec(source)


@lru_cache(maxsize=2)
def decoder(source: str) -> Decoder:
    return Decoder(source)


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, source: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows with ``out``: array<int>, the ids of the whole text without added special tokens."""
    sent = df.sparkSession.sparkContext.broadcast(source)  # one file of fixed size

    def start():
        own = codec(sent.value)

        def rows(batch):
            got = [ids for part in groups(batch) for ids in own.encode_batch([t.decode("utf-8", "replace") for t in part])]
            ends = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
            return (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32))),)

        return rows

    return with_columns(df, text, [(out, "array<int>")], start)


def encode_and_decode(df: DataFrame, source: str, *, text: str = "text", out: str = "ids", back: str = "decoded") -> DataFrame:
    """All rows with ``out``, the ids, and ``back``, the text decoded from them, in one pass: a task has one worker."""
    sent = df.sparkSession.sparkContext.broadcast(source)

    def start():
        own, strings = codec(sent.value), decoder(sent.value)

        def rows(batch):
            ids, texts = [], []
            for part in groups(batch):
                coded = own.encode_batch([t.decode("utf-8", "replace") for t in part])
                ids += coded
                texts += [strings.decode(np.frombuffer(x, np.int32).tolist()) for x in coded]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))), texts

        return rows

    return with_columns(df, text, [(out, "array<int>"), (back, "string")], start)


def decode(df: DataFrame, source: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows with ``out``: the text the library's decode gives, special tokens included."""
    from pyspark.sql import types as T

    sent = df.sparkSession.sparkContext.broadcast(source)
    kept = [f for f in df.schema.fields if f.name.lower() != out.lower()]

    def run(batches):
        own = decoder(sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            made = [own.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, out])

    return df.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))
