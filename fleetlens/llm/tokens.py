"""Tokens of whole texts by public tokenizers, with each distinct stretch between safe cuts encoded once per worker.

A cut is safe where the tokenizer's pre-tokenizer always ends a piece and no character on one side can change the
pieces on the other. Between safe cuts a stretch has the same ids wherever it stands, so ids come from a dictionary.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

CACHE_ENTRIES = 1_200_000  # about 250 MB; the dictionary is emptied beyond this; it only saves time


@lru_cache(maxsize=4)
def tokenizer(path: str, special_as_text: bool = False):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = special_as_text
    return loaded


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cached(dict):
    """stretch -> what ``make`` gives for it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, stretch):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[stretch] = self.make(stretch)
        return out


# Where letters and punctuation part safely: ASCII and Latin-1 letters only, no special token, no apostrophe (which may
# take letters with it). The continuation bytes 0x80-0xBF follow 0xC3 here.
_ODD = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\xc2\xc4-\xff]|\xc3[\x97\xb7]|<\|")
_PARTS = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff \t\n\r]+")


def _parts(data: bytes) -> list[bytes]:
    if _ODD.search(data):  # only white space parts safely
        return data.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").split(b" ")
    data = data.lower()
    if b"'" not in data:
        return _PARTS.findall(data)
    out = []
    for word in data.split():
        if b"'" in word:
            out.append(word)
        else:
            out += _PARTS.findall(word)
    return out


class WordIds:
    """Ids of a lower-casing tokenizer that drops white space, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        loaded = tokenizer(path)
        model = loaded.model  # a part of ASCII letters alone is one piece as it stands

        def make(part: bytes) -> bytes:
            text = part.decode("utf-8", "replace")
            if part.isalpha() and part.islower():
                return array("I", [t.id for t in model.tokenize(text)]).tobytes()
            return array("I", loaded.encode(text, add_special_tokens=False).ids).tobytes()

        self.ids = Cached(make)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, _parts(text.encode("utf-8", "replace"))))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


BLANK = "\u0120"  # how byte-level vocabularies write the byte of a blank

# Before white space, after a character that is surely none: byte-level pieces never hold white space after other characters.
_BEFORE_SPACE = re.compile(r"(?<=[!-~\xc0-\xff])(?=[ \t\n\r])")


def stretches(text: str) -> list[str]:
    return _BEFORE_SPACE.split(text) if text else []


@lru_cache(maxsize=2)
def stretch_counts(path: str) -> Cached:
    """stretch -> number of ids of a byte-level tokenizer; special tokens in a text are ordinary text."""
    loaded = tokenizer(path, True)
    model = loaded.model

    def make(stretch: str) -> int:
        word = stretch[1:] if stretch[0] == " " else stretch
        if word.isascii() and word.isalpha():  # one piece; the blank before it is the letter that stands for its byte
            return len(model.tokenize(BLANK + word if word is not stretch else word))
        return len(loaded.encode(stretch, add_special_tokens=False).ids)

    return Cached(make)
