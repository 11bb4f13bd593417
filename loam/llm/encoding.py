"""Whole texts to token ids with the tokenizers library, remembering the ids of recurring pieces.

A byte-level BPE first cuts a text by a pattern and then merges bytes inside each part, so equal
parts have equal ids. Texts are cut before single spaces and around line ends, which no part reaches
across when no other white space is next to them, and between letters, digits and other signs of
ASCII. Such pieces recur, and a table of words numbers them for a whole batch at once. A new piece is
cut into parts by the tokenizer's own pattern, and a new part is merged by the library. Where a piece is not surely cut as the library does it (white
space at its ends, characters that are classed in several ways), its whole text goes to the
library's encode.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Table, padded, slabs

#: The tokenizer's pattern in Python's classes: contractions, letters, digits, other signs, white space.
PART = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
#: The printable character that stands for each byte, as in all byte-level vocabularies.
_plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in _plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _plain)}


#: Of each byte: 1 for letters, 2 for digits, 3 for other signs in ASCII, between which parts always end; 0 where that
#: isn't sure: white space, the apostrophe (of contractions), control characters and bytes of longer characters.
_KIND = np.array([0 if b <= 32 or b >= 127 or b == 39 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_NEW = object()


class _Known(dict):
    """What ``learn`` makes of each key, in two generations of at most ``limit`` / 2 keys. When the young one
    is full it becomes the old one, and what was not asked for since the last time is forgotten."""

    def __init__(self, learn, limit: int) -> None:
        super().__init__()
        self.learn, self.half, self.old = learn, max(1, limit // 2), {}

    def __missing__(self, key):
        made = self.old.pop(key, _NEW)
        if made is _NEW:
            made = self.learn(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = made
        return made


class Encoder:
    """Ids, and the characters that tokens cover, of many texts at once. ``limit`` bounds the pieces remembered
    (about 150 bytes each)."""

    def __init__(self, path: str, limit: int = 400_000, special: tuple[str, ...] = ()) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.library = Tokenizer.from_file(path)
        if special:
            self.library.add_special_tokens(list(special))
        self.library.encode_special_tokens = not special
        self.library.post_processor = processors.ByteLevel(trim_offsets=False)  # tokens cover their spaces
        self.special = special
        self.model = self.library.model
        self.model._resize_cache(0)  # ours remembers more
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.parts = _Known(self._part, max(2, limit // 4))
        self.table = Table(self._learn, limit)
        # of each piece: where its ids begin below, how many they are (-1: not sure), whether it was seen again
        self.begin, self.count, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.held, self.filled = np.zeros(4096, np.int32), 0
        #: Bytes of each token.
        self.bytes = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, k in self.library.get_vocab().items():
            self.bytes[k] = len(token)  # a character for each byte
        for k, token in self.library.get_added_tokens_decoder().items():
            self.bytes[k] = len(token.content.encode())

    def _part(self, part: str) -> bytes | None:
        """Ids of one part of the pattern; None if it may not be one."""
        if part.isascii():
            if not part.isprintable() and part != "\n":
                return None
            tokens = self.model.tokenize(BYTES[10] if part == "\n" else part.replace(" ", BYTES[32]))
        elif (part[1:] if part[0] == " " else part).isalpha():
            tokens = self.model.tokenize(part.encode().decode("latin-1").translate(BYTES))
        else:
            return None
        return array("i", [x.id for x in tokens]).tobytes()

    def _parts_of(self, piece: str) -> list[str] | None:
        """The parts of what is between two cuts; None if the cuts may not be the library's."""
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha() or piece == "\n":
            return [piece]
        if not core or core[0].isspace() or core[-1].isspace():
            return None
        return PART.findall(piece)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keeps the ids of new pieces."""
        raw, parts_of, known, out, count = data.tobytes(), self._parts_of, self.parts, [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            try:
                piece = raw[a:b].decode()
            except UnicodeDecodeError:
                count.append(-4)
                continue
            if self.special and "<|" in piece:
                found = array("i", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
            elif (parts := parts_of(piece)) is None:
                found = None
            elif len(parts) == 1:
                found = self._part(piece)
            else:
                found = [known[x] for x in parts]
                found = None if None in found else b"".join(found)
            if found is None:
                count.append(-4)
            else:
                out.append(found)
                count.append(len(found))
        ids, new = np.frombuffer(b"".join(out), np.int32), np.array(count, np.int32) // 4
        while self.filled + len(ids) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.filled : self.filled + len(ids)] = ids
        own = np.maximum(new, 0)
        self.begin = np.concatenate([self.begin, self.filled + np.cumsum(own, dtype=np.int64) - own])
        self.count, self.again = np.concatenate([self.count, new]), np.concatenate([self.again, np.zeros(len(new), bool)])
        self.filled += len(ids)

    def _forget(self) -> None:
        """Keeps the pieces that were seen again since the last time, the newer ones if these are too many."""
        kept = np.flatnonzero(self.again)[-max(1, self.table.limit // 2) :]
        self.table.keep(kept)
        own = np.maximum(self.count[kept], 0)
        ids = self.held[_ranges(self.begin[kept], own)]
        self.held, self.filled = np.concatenate([ids, np.zeros(4096, np.int32)]), len(ids)
        self.begin, self.count, self.again = np.cumsum(own, dtype=np.int64) - own, self.count[kept], np.zeros(len(kept), bool)

    def encode(self, texts: pa.Array, spans: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
        """For some texts after the other (null: empty): their ids, one text's after the other's; the bounds of each
        text's; with ``spans``, the characters (from, to) of its text that each token covers; characters of each text.

        Bytes that aren't UTF-8 count as U+FFFD, as Python replaces them.
        """
        for _, raw, bounds in slabs(texts):
            data, n = padded(raw), len(raw)
            line, cut = data[:n] == 10, data[:n] == 32
            cut |= line
            cut[1:] |= line[:-1]
            if not self.special:  # they stay in one piece
                kind = _KIND[data[:n]]
                cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            inner = bounds[:-1][bounds[:-1] < n]
            cut[inner] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], n) if n else starts
            first = np.searchsorted(starts, bounds)
            before = self.table.count
            numbers = self.table.numbers(data, starts, ends)
            self.again[numbers[numbers < before]] = True
            count = self.count[numbers]
            # texts that the library encodes as a whole: two line ends together, one at the begin, or a piece that isn't sure
            odd = np.zeros(len(bounds) - 1, bool)
            of = lambda places, bounds=bounds: np.searchsorted(bounds, places, "right") - 1
            double = np.flatnonzero(line[1:] & line[:-1])
            odd[of(double)[of(double) == of(double + 1)]] = True
            odd[of(inner[line[inner]])] = True
            odd[of(starts[count < 0])] = True
            count = np.maximum(count, 0)
            stops = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[first]
            ids = self.held[_ranges(self.begin[numbers], count)]
            character = np.cumsum(data[:n] & 0xC0 != 0x80, dtype=np.int64)  # characters up to each byte
            chars = np.concatenate([[0], character])[bounds]
            size, covered = np.diff(chars), None
            if spans:
                length = self.bytes[ids]
                end = np.cumsum(length)
                base = np.concatenate([[0], end])[stops[:-1]]
                text = np.repeat(np.arange(len(size)), np.diff(stops))
                end += (bounds[:-1] - base)[text]
                covered = np.empty((len(ids), 2), np.int64)
                sure = ~odd[text]  # of other texts, the bytes may not add up
                covered[sure, 0] = character[(end - length)[sure]] - 1
                covered[sure, 1] = character[end[sure] - 1]
                covered -= chars[text][:, None]
            if odd.any():
                parts, places = [], []
                for k, strange in enumerate(odd.tolist()):
                    if strange:
                        text = raw[bounds[k] : bounds[k + 1]].decode(errors="replace")
                        e = self.library.encode(text, add_special_tokens=False)
                        size[k] = len(text)
                        parts.append(np.array(e.ids, np.int32))
                        places.append(np.array(e.offsets, np.int64).reshape(-1, 2) if spans else None)
                    else:
                        parts.append(ids[stops[k] : stops[k + 1]])
                        places.append(covered[stops[k] : stops[k + 1]] if spans else None)
                ids, stops = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                covered = np.concatenate(places) if spans else None
            if self.table.full:
                self._forget()
            yield ids, stops, covered, size

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return next(self.encode(pa.array([text])))[0].astype("<u4").tobytes()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text and the characters (from, to) that each token covers."""
        ids, _, covered, _ = next(self.encode(pa.array([text]), True))
        return ids.astype("<u4"), covered


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one after the other."""
    stops = np.cumsum(counts, dtype=np.int64)
    return np.repeat(begins - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special: tuple[str, ...] = ()) -> Encoder:
    """One for each Python worker, for the tokenizer used last: what it remembers serves all its tasks."""
    if (path, special) not in _encoders:
        _encoders.clear()
        _encoders[path, special] = Encoder(path, special=special)
    return _encoders[path, special]
