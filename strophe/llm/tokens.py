"""Token ids of whole texts from tokenizer files, fast enough for a large corpus.

The library encodes every distinct piece of text once per worker; a text is then put together
from the ids of its pieces. Pieces are cut only where the tokenizer itself cuts, so the ids are
those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END = 1
_SPACES = " \t\n\r\x0b\x0c"
#: White space that Python or the tokenizer's patterns know besides the six above.
_ODD_CODES = (
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)
_ODD = re.compile(f"[{''.join(map(chr, _ODD_CODES))}]")
_ODD_ASCII = "\0\x1c\x1d\x1e\x1f"
_RARE_SPACES = "\t\r\x0b\x0c"
_PIECES = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")
#: The tokenizers' own cuts, with the letters and numbers of Latin-1 spelled out.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_CUT_SPACED = re.compile(
    rf"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
)
_CUT_BARE = re.compile(rf"{_ENDINGS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: The printable stand-ins of bytes in byte-level vocabularies, by the published rule: printable
#: Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_STAND_INS = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


class _Cache(dict):
    """Piece to id bytes. It takes the first ``limit`` pieces, which the frequent ones are among,
    and starts anew after as many misses; it only saves work.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.missed = encode, limit, 0

    def __missing__(self, piece):
        value = self.encode(piece)
        if len(self) < self.limit:
            self[piece] = value
        else:
            self.missed += 1
            if self.missed > self.limit:
                self.clear()
                self.missed = 0
        return value


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _has_odd(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in _ODD_ASCII)
    return "\0" in text or _ODD.search(text) is not None


def _has_double_space(text: str) -> bool:
    if any(c in text for c in _RARE_SPACES):
        return True
    return any(two in text for two in ("  ", "\n\n", " \n", "\n "))


class PieceEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    ``spaces`` says whether the tokenizer keeps white space (a space belongs to the word after
    it) or drops it and ignores case.
    """

    def __init__(self, path: str, spaces: bool, limit: int = 750_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spaces = spaces
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.typecode = "H" if self.dtype.itemsize == 2 else "I"
        self.end = np.array([END], self.dtype).tobytes()
        self.cache = _Cache(self._spaced if spaces else self._bare, limit)

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def _token(self, piece: str) -> bytes:
        """One pre-token, straight to the library's model."""
        if not piece.isalpha() or not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_STAND_INS)
        return array(self.typecode, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _bare(self, piece: str) -> bytes:
        if _is_latin(piece):  # a text with other letters comes as it is
            piece = piece.lower()
        if piece.isascii() and piece.isalpha():
            return array(self.typecode, [t.id for t in self.model.tokenize(piece)]).tobytes()
        if not _is_latin(piece) or "<|" in piece:
            return self._library(piece)
        cut = _CUT_BARE.findall(piece)
        if len(cut) == 1:
            return self._token(piece)
        return b"".join(map(self.cache.__getitem__, cut))

    def _spaced(self, piece: str) -> bytes:
        """A leading NUL stands for 'no space before'; without it and without a line end, one is."""
        if piece.isascii() and piece.isalpha():
            tokens = self.model.tokenize(_STAND_INS[32] + piece)
            return array(self.typecode, [t.id for t in tokens]).tobytes()
        full = piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece
        if not _is_latin(full) or "<|" in full:
            return self._library(full)
        cut = _CUT_SPACED.findall(full)
        if len(cut) <= 1:
            return self._token(full)
        keys = [c[1:] if c[0] == " " and len(c) > 1 and c[1] != "\n" else "\0" + c for c in cut]
        return b"".join(map(self.cache.__getitem__, keys))

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` and the end id, as little-endian integers of ``dtype``."""
        if not text:
            return self.end
        if _has_odd(text):
            return self._library(text) + self.end
        cache = self.cache
        if not self.spaces:
            if _is_latin(text):  # case rules beyond Latin-1 are left to the library
                text = text.lower()
            return b"".join(map(cache.__getitem__, text.split())) + self.end
        if _has_double_space(text):
            pieces = ["\0" + piece for piece in _PIECES.findall(text)]
        else:
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]
        return b"".join(map(cache.__getitem__, pieces)) + self.end


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaces: bool) -> PieceEncoder:
    """One encoder per worker process, kept from task to task."""
    key = (path, spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, spaces)
    return _ENCODERS[key]
