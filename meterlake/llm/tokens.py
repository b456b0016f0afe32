"""Ids of whole texts by the tokenizers library, with the library asked once for each distinct word."""

from __future__ import annotations

from array import array

import numpy as np

from meterlake.llm.bpe import Memo, WordVocabulary

#: Words kept in each of the two generations; about 120 MB a worker.
LIBRARY_WORDS = 300_000


class LibraryEncoder:
    """text -> ids as little-endian unsigned integers of ``width`` bytes, as ``Tokenizer.encode`` without special tokens.

    The file splits a text into words that are encoded independently, so each distinct word goes to the library once
    and its ids are kept. Texts with characters outside the plain set, or with special strings, go to the library whole.
    """

    def __init__(self, path: str, words: int = LIBRARY_WORDS):
        self.vocabulary = WordVocabulary(path)
        self.library = self.vocabulary._library
        self.library.no_truncation()
        self.library.no_padding()
        self.size = len(self.vocabulary.pieces)
        self.width = 2 if self.size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._memo = Memo(self._library_ids, words)

    def _library_ids(self, text: str) -> bytes:
        return array("HI"[self.width // 4], self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get, plain = self._memo.__getitem__, self.vocabulary.plain_words
        return [b"".join(map(get, words)) if (words := plain(t)) is not None else self._library_ids(t) for t in texts]
