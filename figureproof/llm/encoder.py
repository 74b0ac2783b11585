"""Byte-pair encoding of whole texts with a public tokenizer file.

The library's own split of a text is its slow part. For a byte-level BPE file
the split is a fixed rule and every piece is encoded by itself, so a text is
split by vector comparisons of its characters' classes, pieces are looked up in
a bounded per-worker table, and only new ones reach the library's model. Any other kind of file takes the library's plain path.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from array import array

import numpy as np

#: Entries of the piece table of one Python worker; it starts anew beyond them.
MAX_PIECES = 900_000

_ENCODERS: dict[tuple, "Encoder"] = {}


def encoder(path: str, specials_as_text: bool = False) -> "Encoder":
    """One encoder per worker process, file and treatment of special tokens' strings in a text."""
    key = (path, specials_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, specials_as_text)
    return _ENCODERS[key]


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level BPE files are written in."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


# classes of characters: others, letters, numbers, white space, and those that this Python's Unicode does not
# know (the library's may), whose texts go to the library whole
_LETTER, _NUMBER, _SPACE, _UNKNOWN = 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    category = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out[[c for c, m in enumerate(category) if m[0] == "L"]] = _LETTER
    out[[c for c, m in enumerate(category) if m[0] == "N"]] = _NUMBER
    out[[c for c, m in enumerate(category) if m == "Cn"]] = _UNKNOWN
    out[_WHITE] = _SPACE
    return out


def split(text: str) -> list[str] | None:
    """Pieces of a text as ``public_tokenizers.PATTERN`` finds them, for texts without apostrophes.

    None if a character is not known.

    A piece is a run of one class with the blank in front of it; of a run of
    white space before a word all but the last character is a piece, and that
    one too unless it is a blank.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[cp]
    if kind.max() == _UNKNOWN:
        return None
    new = np.empty(len(cp), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(cp))
    space = kind[at] == _SPACE
    words = at[~space]
    words = words - ((words > 0) & (cp[words - 1] == 32))
    a, b = at[space], stop[space]
    final, several = b == len(cp), b - a > 1
    runs = a[final | several | (cp[a] != 32)]
    lasts = b[~final & several & (cp[b - 1] != 32)] - 1
    starts = np.sort(np.concatenate([words, runs, lasts])).tolist()
    return [text[i:j] for i, j in zip(starts, [*starts[1:], len(cp)])]


class _Pieces(dict):
    """The ids of a piece of text; new pieces go to the library's model."""

    def __init__(self, model, letters: dict[int, str], code: str):
        super().__init__()
        self._tokenize, self._letters, self._code = model.tokenize, letters, code

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode("utf-8").decode("latin-1").translate(self._letters)
        ids = self[piece] = array(self._code, [t.id for t in self._tokenize(written)]).tobytes()
        return ids


class Encoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as numpy."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocab_size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._added = [t["content"] for t in spec.get("added_tokens") or ()]
        pre = spec.get("pre_tokenizer") or {}
        self._split = None
        if (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and not spec["model"].get("dropout") and not spec.get("truncation")):
            import public_tokenizers
            import regex
            self._split = regex.compile(public_tokenizers.PATTERN).findall
        self._letters = _byte_letters()
        self._pieces = _Pieces(self.tokenizer.model, self._letters, self._code)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian integers of ``self.dtype``; null is the empty text."""
        if not text:
            return b""
        pieces = None
        if self._split is not None and not any(t in text for t in self._added):
            pieces = split(text)
            if pieces is not None and "'" in text:
                pieces = self._split(text)
        if pieces is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self._pieces) > MAX_PIECES:
            self._pieces.clear()
        return b"".join(map(self._pieces.__getitem__, pieces))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)
