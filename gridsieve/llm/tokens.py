"""Encoding with the tokenizers library, one library call per distinct unit of text.

A unit is a word of Latin letters or a run of ASCII punctuation, each with at most one leading space and
cut only where the byte-level pre-tokenizer cuts too; a run of white space; or any other run without
white space. The ids of a text are those of its units, and a bounded cache saves most calls: natural
text repeats its words.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

# Characters with the Unicode property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters only, without the two arithmetic signs between them.
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
# ASCII punctuation without the apostrophe, which may open a contraction.
MARKS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
UNIT = re.compile(
    f" ?[{LATIN}]++(?![^{MARKS}{WHITE_SPACE}])| ?[{MARKS}]++(?![^{LATIN}{WHITE_SPACE}])"
    f"| ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
)
#: The cache keeps the first so many units of at most so many characters; later ones are encoded again.
CACHED_CHARS = 48
CACHED_UNITS = 350_000


def forget(cache: dict, new: list[str]) -> None:
    """Takes units out again that are too long, or that came when the cache was full."""
    full = len(cache) > CACHED_UNITS
    for unit in new:
        if full or len(unit) > CACHED_CHARS:
            del cache[unit]


class UnitEncoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cache = self.cache
        units = [UNIT.findall(text) if text else [] for text in texts]
        new = list(set().union(*units).difference(cache))
        for unit, encoding in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            cache[unit] = array("I", encoding.ids).tobytes()
        encoded = [b"".join(map(cache.__getitem__, own)) for own in units]
        forget(cache, new)
        return encoded


@lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)
