"""Token ids of texts by a public tokenizer file, remembered by word.

The tokenizer ``word_bpe_49k.json`` lower-cases, drops white space and merges within words only,
so a text's ids are those of its words one after another.  A word is encoded once by the
tokenizer's model and kept (as bytes, in a table of bounded size).  White-space chunks
with characters beyond ASCII and Latin-1 letters, whose normal form takes more care, and those that may
hold a special token go through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

KEEP, KEEP_CHARS = 400_000, 48

# The pre-tokenizer's own pattern, for lower-case texts of ASCII and Latin-1 letters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Lower-case word -> its ids as bytes."""

    def __init__(self, model, dtype) -> None:
        super().__init__()
        self.model, self.dtype, self.letters = model, dtype, byte_letters()

    def __missing__(self, word: str) -> bytes:
        text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(text)], self.dtype).tobytes()
        if len(word) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """:meth:`encode` gives the ids of a text as bytes."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = _Words(self.tokenizer.model, self.dtype)

    def encode(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text.lower())))
        parts, plain = [], []
        for chunk in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
                plain.append(chunk)
                continue
            if plain:
                parts.append(b"".join(map(self.words.__getitem__, _SPLIT.findall(" ".join(plain).lower()))))
                plain = []
            parts.append(np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes())
        parts.append(b"".join(map(self.words.__getitem__, _SPLIT.findall(" ".join(plain).lower()))))
        return b"".join(parts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each Python worker; it is kept from task to task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
