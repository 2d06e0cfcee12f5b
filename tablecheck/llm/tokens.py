"""Token ids of whole texts with a public tokenizer, at the speed of a word cache."""

from __future__ import annotations

import os
from array import array

import numpy as np
import regex

# Texts of these characters only (ASCII, Latin letters) have one spelling under the tokenizer's normalizer, lower-case
# one by one, and white space always parts their tokens; so each run without white space can be encoded by itself.
_PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*+")

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")  # fixed value: the tokenizer's own split
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies spell as themselves
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Known(dict):
    """Ids of words and of their parts; a word that is not there yet is encoded. At most ``limit`` are kept."""

    def __init__(self, whole, limit: int):
        super().__init__()
        self.whole, self.limit = whole, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self._part(word) if word.isalpha() else b"".join([self.get(part) or self._part(part) for part in _PARTS.findall(word)])
        self[word] = found
        return found

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        found = self[part] = array("I", [token.id for token in self.whole(spelled)]).tobytes()
        return found


class WordIds:
    """Ids of texts by a tokenizer that drops white space; bytes of little-endian unsigned 32-bit numbers.

    Words are encoded when they are met first and kept, at most ``limit`` of them. Texts with other
    characters than the plain ones go through the tokenizer as they are.
    """

    def __init__(self, content: bytes, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = _Known(self.tokenizer.model.tokenize, limit)

    @classmethod
    def of(cls, held: dict) -> "WordIds":
        """That of a broadcast ``{"content": ..}``: a worker process makes and fills it once for all its tasks."""
        if "made" not in held:
            held["made"] = cls(held["content"])
        return held["made"]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        ids, other = self.known.__getitem__, []
        for i, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                out[i] = b"".join(map(ids, text.lower().split()))
            else:
                other.append(i)
        for i, found in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out
