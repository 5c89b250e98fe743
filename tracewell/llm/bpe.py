"""Piece-wise byte-pair encoding on top of the ``tokenizers`` library.

Both vocabularies split a text into pieces before any merge happens, and a
piece's ids depend on the piece alone.  So a text is cut by an equivalent
pattern, every distinct piece is encoded once by the library and remembered,
and the text's ids are the concatenation.  Texts with characters for which the
pattern is not known to be equivalent go through the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

# Characters up to U+02AF, general punctuation and currency signs.
# Below U+02B0 the letters, numbers and spaces are exactly those listed in
# _LETTER, _NUMBER and _SPACE, and every character is its own canonical composition.
_PLAIN = "\x00-ʯ‐-‧‰-⁞₠-₿"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Pre-tokenizer patterns over the plain characters; letters, the most frequent, are tried first.
WORD_PIECES = f"[{_LETTER}]+|{_ENDINGS}|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+"
BYTE_PIECES = f" ?[{_LETTER}]+|{_ENDINGS}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

# The byte alphabet of byte-level vocabularies: printable Latin-1 characters stand for
# themselves, the other bytes for the characters from U+0100 on.
_PRINTABLE = frozenset((*range(33, 127), *range(161, 173), *range(174, 256)))
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_LETTERS = {b: b if b in _PRINTABLE else 256 + _OTHERS.index(b) for b in range(256)}

#: Pieces kept per generation, and characters of text cut at a time.
CACHE_PIECES = {"word": 300_000, "byte": 600_000}
CHUNK_CHARS = 1_000_000


class PieceCache(dict):
    """piece -> ids; a missing piece is taken from the generation before, or merged."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most = merge, most
        self.old: dict[str, bytes] = {}
        self.weight = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece)
        self[piece] = ids
        self.weight += 1 + len(piece) // 32
        if self.weight > self.most:
            self.old, self.weight = dict(self), 0
            self.clear()
        return ids


class PieceEncoder:
    """Encoder of whole texts to the bytes of their little-endian ids.

    kind "word": lower-cased pieces without white space.  kind "byte":
    byte-level pieces that keep it.  typecode "I" gives 32-bit ids and "H"
    16-bit ids, for vocabularies that fit.
    """

    def __init__(self, path: str, kind: str, typecode: str = "I"):
        from tokenizers import Tokenizer

        if kind not in ("word", "byte"):
            raise ValueError(f"unknown kind of vocabulary: {kind}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = kind == "word"
        self.typecode = typecode
        self.width = array(typecode).itemsize
        self.pieces = re.compile(WORD_PIECES if kind == "word" else BYTE_PIECES).findall
        self.strange = re.compile(f"[^{_PLAIN}]").search
        # A cut is only made in front of a space between two other characters: a piece starts there.
        self.cut = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])").search
        self.ids_of = PieceCache(self.merge, CACHE_PIECES[kind]).__getitem__

    def odd(self, text: str, lowered: str) -> bool:
        """Whether the pattern may not be equivalent, or a special token may occur."""
        return "<|" in text or not lowered.isascii() and self.strange(lowered) is not None

    def merge(self, piece: str) -> bytes:
        """Ids of one piece of plain characters; it needs no further normalizing or cutting."""
        if piece.isascii() and piece.isalnum():
            letters = piece
        elif piece.isascii() and piece[0] == " " and piece[1:].isalnum():
            letters = chr(_BYTE_LETTERS[0x20]) + piece[1:]
        else:
            letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array(self.typecode, [token.id for token in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.ids_of, self.pieces(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; a null text is an empty one."""
        if not text:
            return b""
        lowered = text.lower() if self.lower else text
        if self.odd(text, lowered):
            return self._whole(text)
        if len(lowered) <= CHUNK_CHARS:
            return self._plain(lowered)
        return b"".join(map(self._plain, self.chunks(lowered)))

    def chunks(self, text: str) -> Iterator[str]:
        """Parts of a long text that can be cut into pieces separately."""
        start = 0
        while len(text) - start > CHUNK_CHARS:
            found = self.cut(text, start + CHUNK_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]


_ENCODERS: dict[tuple[str, str, str], PieceEncoder] = {}


def encoder(path: str, kind: str, typecode: str = "I") -> PieceEncoder:
    """The worker process's encoder; its piece cache outlives a task."""
    key = (path, kind, typecode)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, kind, typecode)
    return _ENCODERS[key]
