"""Exact tokenizer ids at cache speed.

A pretoken's ids depend on nothing around it, so a text is cut where pretokens surely end (before a
space between two other characters, or between Latin letters and plain punctuation), each distinct unit
is encoded once per Python worker by the tokenizers library, and the ids' bytes are joined. A text that holds the
string of a special token is encoded whole by the library, which gives such a string the token's id.
"""

from __future__ import annotations

import array
import re
from functools import lru_cache

from kinlake.llm.common import WHITE

#: Letters that no normaliser splits, recomposes or folds to more than one.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: How many units a worker keeps (about 60 MB); beyond, the cache starts afresh, which costs time only.
CACHE_UNITS = 250_000
#: Longer units are rarely seen again, and are not kept.
KEPT_LENGTH = 12

_PURE = re.compile(f" ?[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte: itself where printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


_BYTES = _byte_letters()

#: Byte-level BPE keeps a single leading space with the next pretoken; the last of several blanks too.
_BYTE = re.compile(rf" ?[{_LETTERS}]+(?=[ \n.,;:!?)]|\Z)|[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]+")
#: The word BPE drops white space, so that units are what stands between.
_WORD = re.compile(rf"[{_LETTERS}]+(?=[ \n.,;:!?)]|\Z)|[^{WHITE}]+")


class _Units(dict):
    """Unit -> its ids' bytes. What is missing is encoded, and kept unless it is long; a full cache starts afresh."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = ids
        return ids


class CachedEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        #: A vocabulary that looks for special tokens in the normalised text gets every text whole.
        self.whole = any(t.normalized for t in added)
        self.tokenize = self.tokenizer.model.tokenize
        self.lower = self.tokenizer.normalizer is not None
        self.find = (_WORD if self.lower else _BYTE).findall
        self.units = _Units(self._encoded)

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.whole or any(s in text for s in self.special):
            return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.units.__getitem__, self.find(text)))

    def _encoded(self, unit: str) -> bytes:
        """A unit of Latin letters is one pretoken, which goes straight to the model; others take the whole way."""
        if _PURE.fullmatch(unit):
            s = (unit.lower() if self.lower else unit).encode().decode("latin-1").translate(_BYTES)
            return array.array("I", [t.id for t in self.tokenize(s)]).tobytes()
        return array.array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One per Python worker and vocabulary file."""
    return CachedEncoder(path)


@lru_cache(maxsize=8)
def vocabulary_size(path: str) -> int:
    """How many ids a vocabulary has, special tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def vocabulary(name: str) -> str:
    """Where this machine keeps a public tokenizer's file; called on the executors too."""
    import public_tokenizers

    return public_tokenizers.path(name)
