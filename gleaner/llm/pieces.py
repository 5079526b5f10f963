"""Byte-level BPE by pre-token: how many pieces, or which ids, each pre-token of a text has.

A byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in order, and its length is
the sum of theirs.  The split is the tokenizer's own: for texts of the characters of PLAIN its pattern, written for
Python's `re`; for others, on which regular-expression engines may disagree, the library's pre-tokenizer.  Of a
tokenizer that normalises, or that splits in another way than this pattern, a text is one pre-token.

Where all ids are wanted, nothing is gained by a table of pre-tokens: the same merges then run in a rank-based encoder
(tiktoken) made from the library's own vocabulary, provided that it is installed and that its merges are in the order of their ids;
else the library encodes the texts.
"""

from __future__ import annotations

import json
import re
from array import array

#: Within PLAIN, [^\W\d_] is \p{L}, \d is \p{N} and \s is white space, as in the tokenizer's pattern
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: ASCII, Latin, Greek and Cyrillic letters and common marks; no fractions, superscripts or rare spaces.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-±´-¸º»¿-ſΑ-ΡΣ-ωА-я‐-‧‰-⁞€]*")

#: The fixed split pattern of this tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranked(library):
    """An encoder by merge ranks over the library's vocabulary, or None where ranks and ids differ in order."""
    try:
        import tiktoken
    except ImportError:
        return None
    model = json.loads(library.to_str())["model"]
    vocab, letters = model["vocab"], byte_letters()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or any(a >= b for a, b in zip(made, made[1:])) or any(c not in vocab or (made and vocab[c] >= made[0]) for c in letters):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """One tokenizer: pre-tokens, pieces of a pre-token, ids of a text (32-bit numbers, little-endian)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.byte_level = self.library.normalizer is None and _splits_alike(self.library)
        self.ranked = ranked(self.library) if self.byte_level else None

    def _parts(self, text: str) -> tuple[list[str], list[str]]:
        """The text between its special strings, and these."""
        if self.special is not None and any(s in text for s in self.specials):
            return self.special.split(text), self.special.findall(text)
        return [text], []

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens (and special strings) whose pieces add up to the text's."""
        if not text:
            return []
        if not self.byte_level:
            return [text]
        parts, marks = self._parts(text)
        out: list[str] = []
        for i, part in enumerate(parts):
            if part:
                out += SPLIT.findall(part) if PLAIN.fullmatch(part) else [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
            if i < len(marks):
                out.append(marks[i])
        return out

    def sizes(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(e.ids) for e in self.library.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def encoded(self, text: str) -> bytes:
        """Ids of the text, four bytes each."""
        if self.ranked is None:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        parts, marks = self._parts(text)
        out = []
        for i, part in enumerate(parts):
            if part:
                ids = self.ranked.encode_ordinary(part) if PLAIN.fullmatch(part) else self.library.encode(part, add_special_tokens=False).ids
                out.append(array("I", ids).tobytes())
            if i < len(marks):
                out.append(array("I", [self.specials[marks[i]]]).tobytes())
        return b"".join(out)

    def plain_ids(self, text: str) -> list[int]:
        """Ids of the text where special strings are plain text."""
        if self.ranked is not None and PLAIN.fullmatch(text):
            return self.ranked.encode_ordinary(text)
        self.library.encode_special_tokens = True
        try:
            return self.library.encode(text, add_special_tokens=False).ids
        finally:
            self.library.encode_special_tokens = False


def _splits_alike(library) -> bool:
    """Whether the tokenizer's own split is the one of PATTERN, as far as an awkward text shows."""
    text = "I'll say: it's 2019 (or '20)  \t\n  don't  we?  x_y \n\n end "
    if library.pre_tokenizer is None:
        return False
    return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == SPLIT.findall(text)


_made: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's instance."""
    if path not in _made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = Pieces(path)
    return _made[path]


def texts_of(part, raw, bounds) -> list[str]:
    data = memoryview(raw)
    return [str(data[a:b], "utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
