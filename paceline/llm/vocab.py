"""Pre-tokens of the two public tokenizers, found without the library where that is proven to agree.

Both split rules look at letters, numbers and white space only. Below U+0180 (without U+0130, whose
lower case leaves the range) those classes are stated here from the Unicode database, all text is
already in composed form, and the library's split agrees (tests hold them together). Texts with
any other character go through the library itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from tokenizers import Tokenizer

RANGE = [chr(c) for c in range(0x180) if c != 0x130]
LETTERS = "".join(c for c in RANGE if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in RANGE if unicodedata.category(c)[0] == "N")
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
OUTSIDE = re.compile("[^\x00-įı-ſ]")
#: The suffixes that both split rules cut off first.
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_RULE = re.compile(
    f"{SUFFIXES}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
WORD_RULE = re.compile(f"{SUFFIXES}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Pre-tokens that a worker remembers before it starts afresh; some 200 bytes each.
REMEMBERED = 800_000


@cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def special(path: str) -> re.Pattern | None:
    """Matches the special strings, which the library cuts out of texts before anything else."""
    found = sorted((x.content for x in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def pieces(path: str, text: str) -> list[str]:
    """Ordinary stretches at even places, special strings at odd ones."""
    rule = special(path)
    return rule.split(text) if rule and "<|" in text else [text]


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabularies: printable bytes are themselves, the rest follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


@cache
def merges(path: str):
    return tokenizer(path).model


def merged(path: str, pre_token: str) -> list[int]:
    """The ids of one pre-token, by the library's merges alone."""
    letters = pre_token if pre_token.isascii() and pre_token.isalnum() else pre_token.encode().decode("latin-1").translate(byte_letters())
    return [t.id for t in merges(path).tokenize(letters)]


@cache
def memory(path: str, use: str) -> dict:
    """What this worker has learned about pre-tokens, over all its tasks."""
    return {}
