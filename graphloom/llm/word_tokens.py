"""Token ids of whole texts, the same as the tokenizer library's own, with each distinct word encoded once.

Both vocabularies cut a text into words first and never join two of them in one token, so
the ids of a word can be kept. Texts are cut by vectorised rules over their bytes; what
the rules don't cover goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .kernels import loads, names, text_of, text_slices

#: Words that a Python worker remembers of a vocabulary at most; beyond it, it starts anew.
REMEMBERED = 1_000_000
SLICE = 1 << 21

_LETTER, _DIGIT, _SPACE, _OTHER, _ODD = range(5)
#: Byte classes: ASCII, and the letters whose UTF-8 form starts with C3.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(1, 9), *range(14, 28), *range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = _OTHER


def valid(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with bytes that aren't UTF-8 replaced by U+FFFD."""
    try:
        data.tobytes().decode()
        return offsets, data
    except UnicodeDecodeError:
        rows = [text_of(data[a:b].tobytes()).encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.frombuffer(b"".join(rows), np.uint8)


def _rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run of ``count``, one run after the other."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - count), count)


class Words:
    """Ids kept by word; a vocabulary says where words begin and encodes new ones."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.name, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # names in order, and the word of each
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a word's ids
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of its bytes
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.held = np.zeros(1 << 16, np.uint8), 0

    def edges(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def hard(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Rows that the rules don't cover."""
        raise NotImplementedError

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all words, count of each)``."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _learn(self, names_: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        raw = data.tobytes()
        ids, counts = self.encode([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        size = end - start
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        while self.held + size.sum() + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.held : self.held + size.sum()] = data[spread(start, size)]
        where = np.searchsorted(self.name, names_)
        self.place = np.insert(self.place, where, np.arange(len(self.count), len(self.count) + len(counts)))
        self.name = np.insert(self.name, where, names_)
        self.start, self.count = np.append(self.start, self.used + np.cumsum(counts) - counts), np.append(self.count, counts)
        self.at, self.size = np.append(self.at, self.held + np.cumsum(size) - size), np.append(self.size, size)
        self.used += len(ids)
        self.held += int(size.sum())

    @staticmethod
    def _unlike(data: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray, other_size: np.ndarray) -> np.ndarray:
        """Whether the words at ``start`` of ``data`` differ from those at ``at`` of ``other``, whose names are equal; names of up to eight bytes are one-to-one."""
        out = (size != other_size) & (np.maximum(size, other_size) > 8)
        left = np.flatnonzero(~out & (size > 8))
        mine, theirs, step = loads(data), loads(other) if other is not data else None, 0
        theirs = mine if theirs is None else theirs
        while len(left):
            k = np.minimum(step, size[left] - 8)
            out[left] |= mine[start[left] + k] != theirs[at[left] + k]
            step += 8
            left = left[size[left] > step]
        return out

    def _quick(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, bounds, rows to do anew)``: the last have a word whose name belongs to another word."""
        n, again = len(data), np.zeros(len(offsets) - 1, bool)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), again
        edge = self.edges(offsets, data)
        edge[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        size = end - start
        unique, first, inverse = np.unique(names(data, start, end), return_index=True, return_inverse=True)
        same = first[inverse]
        unlike = self._unlike(data, start, size, data, start[same], size[same])
        if len(self.count) + len(unique) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.name, unique)
        known = at < len(self.name)
        known[known] = self.name[at[known]] == unique[known]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(unique[new], start[first[new]], end[first[new]], data)
            at = np.searchsorted(self.name, unique)
        entry = self.place[at]
        if known.any():
            k = np.flatnonzero(known)
            other = self._unlike(data, start[first[k]], size[first[k]], self.raw[: self.held + 8], self.at[entry[k]], self.size[entry[k]])
            unlike |= np.isin(inverse, k[other])
        if unlike.any():
            again = _rows_of(offsets, start[unlike])
        entry = entry[inverse]
        counts = self.count[entry]
        ids = self.ids[spread(self.start[entry], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, offsets)], again

    def slice(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all rows, where each row begins and the end)`` of valid UTF-8."""
        hard = self.hard(offsets, data) if len(data) else np.zeros(len(offsets) - 1, bool)
        sizes = np.diff(offsets)
        while True:
            easy = (offsets, data) if not hard.any() else (np.concatenate([[0], np.cumsum(np.where(hard, 0, sizes))]), data[np.repeat(~hard, sizes)])
            ids, bounds, again = self._quick(*easy)
            if not again.any():
                break
            hard = hard | again
        if not hard.any():
            return ids, bounds
        parts, counts, at = [], np.diff(bounds), 0
        for i in np.flatnonzero(hard).tolist():
            own = np.array(self.encode_whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()), np.uint32)
            parts += [ids[at : bounds[i]], own]
            counts[i], at = len(own), bounds[i]
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(counts)])

    def rows(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, bounds)`` of bounded runs of rows; nulls are empty."""
        for row, offsets, data in text_slices(column, SLICE):
            yield row, *self.slice(*valid(offsets, data))


class ByteLevel(Words):
    """A byte-level BPE of the ``tokenizers`` library with its usual word rule (contractions, letters, digits, other signs, white space).

    ``special`` tells whether the strings of special tokens in a text are those tokens, as the
    library takes them by default, or plain text.
    """

    def __init__(self, path: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.marks = sorted({t[:2] for t in added}) if special else []
        # The byte-level alphabet: printable bytes are shown as themselves, the others by the characters from U+0100 on.
        plain = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0))
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.width = np.array([len(self.whole.id_to_token(i)) for i in range(self.whole.get_vocab_size())], np.int64)

    def hard(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        odd = _KIND[data] == _ODD
        odd &= data != 0x27
        after = np.concatenate([[False], data[:-1] == 0xC3])
        odd |= (data >= 0x80) & (data < 0xC0) & ~after
        odd |= after & ((data == 0x97) | (data == 0xB7))
        for m in self.marks:
            odd[:-1] |= (data[:-1] == m[0]) & (data[1:] == m[-1])
        at = np.flatnonzero(odd)
        return _rows_of(offsets, at) if len(at) else np.zeros(len(offsets) - 1, bool)

    def edges(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        kind = _KIND[data]
        kind[data == 0x27] = _OTHER
        n = len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        before = np.concatenate([[_SPACE], kind[:-1]])
        edge = kind != before
        space = kind == _SPACE
        # A single space belongs to the word behind it; of a run before a word, its last sign stands apart.
        plain = np.concatenate([[False], data[:-1] == 32])
        edge &= ~(plain & ~space & ~begins[:-1])
        inner = space[:-1] & ~begins[1:-1]
        edge[1:] |= inner & space[1:] & np.concatenate([~space[2:] & ~begins[2:-1], [False]])
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            self._contractions(data, kind, begins, edge, quote, plain)
        return edge

    @staticmethod
    def _contractions(data: np.ndarray, kind: np.ndarray, begins: np.ndarray, edge: np.ndarray, quote: np.ndarray, plain: np.ndarray) -> None:
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        stops = np.concatenate([begins, [True, True]])
        # One is read only where a word ends before the sign; behind other signs or a space it is one of them.
        free = begins[quote] | np.isin(kind[quote - 1], (_LETTER, _DIGIT)) | ((kind[quote - 1] == _SPACE) & ~plain[quote])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~stops[quote + 1]
        short = free & inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = [(114, 101), (118, 101), (108, 108)]  # re, ve, ll
        long = free & inside & ~stops[quote + 2] & np.logical_or.reduce([(one == a) & (two == b) for a, b in pair])
        for which, k in ((short, 2), (long, 3)):
            at = quote[which]
            edge[at] = True
            edge[at + 1] = False
            stop = at + k
            stop = stop[stop < len(edge)]
            edge[stop] = True
        # A space behind a contraction still opens its own word, which the classes have said already.

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # Words are cut already, so the library's merges run without its own word rule; where one ends is told by the tokens' sizes.
        text = b"".join(words).decode("latin-1").translate(self.shown)
        stop = np.cumsum([len(w) for w in words])
        cuts = [0, *stop.tolist()]
        apart = [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        found = self.merges.encode_batch_fast(["\n".join(apart[i : i + 500]) for i in range(0, len(apart), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        last = np.searchsorted(np.cumsum(self.width[ids]), stop)
        return ids, np.diff(last + 1, prepend=0)

    def encode_whole(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def token_bytes(self) -> list[bytes]:
        """What each id stands for."""
        back = {ord(c): b for b, c in self.shown.items()}
        return [self.whole.id_to_token(i).translate(back).encode("latin-1") for i in range(self.whole.get_vocab_size())]


class Pieces(Words):
    """A ``sentencepiece`` model without normalisation that puts a space before each text; rows are texts with that space.

    No piece holds a space or line end behind another sign, so words begin at runs of spaces and at line ends.
    """

    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.whole.id_to_piece(i) for i in range(self.whole.vocab_size())]
        if any(self.SPACE in p.lstrip(self.SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("pieces of this model join words")
        self.alone = self.whole.piece_to_id(self.SPACE)

    def hard(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        odd = data == 0
        # The sign that stands for a space, as a sign of the text.
        odd[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        at = np.flatnonzero(odd)
        return _rows_of(offsets, at) if len(at) else np.zeros(len(offsets) - 1, bool)

    def edges(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        edge = data == 32
        edge[1:] &= data[:-1] != 32
        edge |= data == 10
        return edge

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The library adds a space, which a word already has or, behind a line end, hasn't.
        texts = [w.decode() for w in words]
        found = self.whole.encode([w[1:] if w[0] == " " else w for w in texts], num_threads=1)
        found = [[self.alone] if w == " " else f if w[0] == " " else f[1:] for w, f in zip(texts, found, strict=True)]
        counts = np.array([len(f) for f in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, counts.sum()), counts

    def encode_whole(self, text: str) -> list[int]:
        return self.whole.encode(text[1:])

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.whole.is_byte(i) else p.replace(self.SPACE, " ").encode() for i, p in enumerate(self.pieces)]


_kept: dict[tuple, Words] = {}


def vocabulary(kind: type[Words], path: str, *more: bool) -> Words:
    """The vocabulary of a file in this worker."""
    key = (kind.__name__, path, *more)
    if key not in _kept:
        _kept[key] = kind(path, *more)
    return _kept[key]


def public_path(name: str) -> str:
    """Place of a vocabulary: a path as it is, a plain name among the public tokenizers."""
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)
