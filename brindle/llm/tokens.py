"""Whole-text token ids, fast: distinct words are encoded once and remembered.

The word tokenizer used here never lets a token cross white space, so a text's ids are the ids of its words in order.
An :class:`Encoder` keeps a bounded table from word to ids, in two generations: when the younger one is full it takes the
older one's place, so words that come often stay. A word of letters with a tail of ASCII punctuation, already
in normal form, goes straight to the tokenizer's model, as two pieces; any other word goes through the whole tokenizer.
So does a word with the string of an added token in it, which the library turns into that token's id, as its default is
(``special_as_text`` makes such strings ordinary text).
"""

from __future__ import annotations

import os.path
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

from . import common

#: ASCII punctuation and symbols: a run of them is one piece.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_TAIL_BYTES = _TAIL.encode()
#: Words and pieces of words remembered at most in a generation, and bytes of the longest remembered word.
MEMO_WORDS, MEMO_PIECES, MEMO_BYTES = 100_000, 200_000, 64


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian bytes of ``dtype``; equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = byte_letters()
        self.lead = os.path.commonprefix(self.added)  # what any added token begins with
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def _pack(self, ids: list[int]) -> bytes:
        made = array(self.code, ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= MEMO_PIECES:
                self.older_pieces, self.pieces = self.pieces, {}
            found = self.older_pieces.get(piece)
            if found is not None:
                self.pieces[piece] = found
                return found
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = self._pack([t.id for t in self.model.tokenize(letters)])
        return found

    def _word(self, word: bytes) -> bytes:
        """Ids of a word that the younger generation doesn't have."""
        ids = self.older.get(word)
        if ids is not None:
            self._keep(word, ids)
            return ids
        core = word.rstrip(_TAIL_BYTES)
        if core.isalpha():  # ASCII letters, the usual case
            ids = self._piece(core.lower().decode())
            if len(core) < len(word):
                ids += self._piece(word[len(core) :].decode())
            if len(word) <= MEMO_BYTES:
                self._keep(word, ids)
            return ids
        text = word.decode("utf-8", "replace")
        core = text.rstrip(_TAIL)
        low = core.lower()
        if self.added and self.lead in text and any(t in text for t in self.added):
            ids = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        elif core.isalpha() and (core.isascii() or (unicodedata.is_normalized("NFC", core) and unicodedata.is_normalized("NFC", low) and len(low) == len(core) and "Σ" not in core and unicodedata.is_normalized("NFC", text))):
            tail = text[len(core) :]
            ids = self._piece(low) + (self._piece(tail) if tail else b"")
        elif not core and text:
            ids = self._piece(text)
        else:
            ids = self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= MEMO_BYTES:
            self._keep(word, ids)
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(self.words) >= MEMO_WORDS:
            self.older, self.words = self.words, {}
        self.words[word] = ids

    def encode(self, text: bytes | None) -> bytes:
        """All ids of a whole UTF-8 text; null gives none."""
        if not text:
            return b""
        known, word = self.words, self._word
        out = []
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = word(w)
                known = self.words  # a new generation may have begun
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, until another operator uses the worker."""
    return Encoder(path)


common.keeps(encoder.cache_clear)


def word_tokenizer() -> str:
    """Where the public word tokenizer lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
