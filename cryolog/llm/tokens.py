"""Token ids of whole texts by a public tokenizer file, cached by pre-token.

Both vocabularies used here cut a text by a published pattern before they merge anything, so the ids of a text are the
ids of its pieces one after another.  A text of Latin letters, digits and common marks is cut here by that pattern, and
its pieces come from a bounded cache in front of the library's BPE model; any other text, and one that may hold a special
token, goes through the library's whole encoder.  Where no piece holds white space, many texts together (``encode_all``)
look up a word between white space once for all of its places.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

_ENTRIES, _LONGEST, _TOGETHER = 1_000_000, 48, 8 << 20
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_OPEN: dict[tuple[str, bool], "TextEncoder"] = {}

# fixed values: letters, and the patterns of the two vocabularies over them
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_ORDINARY = re.compile(rf"[\x00-\x1b\x20-\x7f{_LETTERS}‐-‧€]*")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_WITH_SPACE = re.compile(rf"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WITHOUT_SPACE = re.compile(rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE, by its published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


class _Pieces(dict):
    """Ids by piece; when it is full, new ones stay out, and once many have, it starts anew."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.left_out, self.entries = merge, 0, _ENTRIES

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece)
        if len(self) < self.entries:
            if len(piece) <= _LONGEST:
                self[piece] = ids
        else:
            self.left_out += 1
            if self.left_out > 10 * self.entries:
                self.clear()
                self.left_out = 0
        return ids


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``spaces``: whether the vocabulary encodes the space before a word with it (byte-level BPE, case kept) or drops
    white space and lower-cases.
    """

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.spaces = self.tokenizer.model, spaces
        self.cut = (_WITH_SPACE if spaces else _WITHOUT_SPACE).findall
        self.pieces = _Pieces(self._merged)
        self.plain = False  # whether special tokens' strings are plain text, also for the library's tokenizer

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()
        ids = [t.id for t in self.model.tokenize(piece.replace(" ", "Ġ") if plain else piece.encode().decode("latin-1").translate(_ALPHABET))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self._ordinary(text):
            return self.whole(text)
        return self._of(text if self.spaces else text.lower())

    def _ordinary(self, text: str) -> bool:
        return ("<|" not in text or self.plain) and _ORDINARY.fullmatch(text) is not None

    def _of(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, for a vocabulary that drops white space; _TOGETHER characters at a time, or one text."""
        size, group = 0, []
        for text in texts:
            if group and size + len(text) > _TOGETHER:
                yield from self._encode_group(group)
                size, group = 0, []
            group.append(text)
            size += len(text)
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        ordinary = [self._ordinary(t) for t in texts]
        words = pc.ascii_split_whitespace(pa.array([t.lower() if o else "" for t, o in zip(texts, ordinary, strict=True)], pa.large_string()))
        found = words.flatten().dictionary_encode()
        known = [self.pieces.get(w) or self._word(w) for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        places = found.indices.to_numpy()
        ids = np.frombuffer(b"".join(known), "<u4")[common.ranges((np.cumsum(lengths) - lengths)[places], lengths[places])]
        ends = np.concatenate([[0], np.cumsum(lengths[places])])[words.offsets.to_numpy()].tolist()
        for text, o, a, b in zip(texts, ordinary, ends[:-1], ends[1:], strict=True):
            yield ids[a:b] if o else np.frombuffer(self.whole(text), "<u4")

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # letters alone are one piece
            return self.pieces[word]
        return self.pieces[word[:-1]] + self.pieces[word[-1]] if word[:-1].isalpha() else self._of(word)


def encoder(path: str, spaces: bool) -> TextEncoder:
    """One encoder for a worker process, so that its cache outlives a task."""
    if (path, spaces) not in _OPEN:
        _OPEN[path, spaces] = TextEncoder(path, spaces)
    return _OPEN[path, spaces]
