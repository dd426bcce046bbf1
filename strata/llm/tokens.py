"""Exact token ids of many texts with the ``tokenizers`` library, each distinct word encoded once.

Both vocabularies split a text before they merge, and never merge across the
places where this module cuts, so the ids of a text are the ids of its pieces
one after the other:

* ``cut="space"`` (byte-level BPE): before a space between two characters that
  are not white space.  Such a space always opens a new pre-token.
* ``cut="white"`` (BPE that drops white space): at ASCII white space.

Texts repeat their words, so a task encodes each distinct piece once.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np

#: White space that the plain split at spaces can't take: two in a row, or any kind but space and newline.
_UNUSUAL = re.compile(rb" [ \n]|\n[ \n]|[\t\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file; its special strings inside a text get their own ids, as the library does."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class _Index(dict):
    """Piece -> number, in the order in which pieces come; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


class PieceEncoder:
    """Encodes blocks of texts; remembers at most about ``max_pieces`` distinct pieces.

    New pieces are encoded some at a time as one text (``RUN``: a longer text costs
    the library more for each piece), and its ids are parted
    again: where the pieces are cut before a space, by the ids of tokens that
    begin with a space (no piece has another one); else by the ids that end a
    word where a piece is one word for certain (ASCII letters alone), and by a mark after each
    piece where not.  Pieces for which that would not hold, and those with a special string,
    are encoded one by one.
    """

    #: Set before the key of a piece that is encoded by itself (the first of its text, or one of
    #: a text with unusual white space); never part of UTF-8.
    OPENS = b"\xff"
    MARK = "^"
    #: New pieces that are encoded as one text.
    RUN = 16

    def __init__(self, path: str, cut: str, max_pieces: int = 700_000):
        if cut not in ("space", "white"):
            raise ValueError(f"cut must be 'space' or 'white', not {cut!r}")
        self.tokenizer, self.cut, self.max_pieces = load_tokenizer(path), cut, max_pieces
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        size = self.tokenizer.get_vocab_size()
        self.closes = None
        if cut == "space":
            self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        else:
            mark = self._ids([self.MARK])[0]
            assert len(mark) == 1
            self.mark = mark[0]
            suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            if suffix:
                closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
                if all(len(x) == 1 and closes[x[0]] for x in self._ids(list(string.ascii_letters))):
                    self.closes = closes
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0  # of ids
        self.begin, self.length = np.empty(0, np.int64), np.empty(0, np.int64)  # of each piece, in ids
        self.seen = np.empty(0, np.int64)  # occurrences of each piece

    def _forget(self) -> None:
        """Keep the pieces met more than once, if they are few enough."""
        kept = np.flatnonzero(self.seen > 1)
        if len(kept) > self.max_pieces // 2:
            return self._clear()
        keys, old = list(self.index), self.index
        self.index = _Index()
        self.index.update(zip([keys[k] for k in kept], range(len(kept))))
        begin, length = self.begin[kept], self.length[kept]
        before = np.concatenate([[0], np.cumsum(length)])
        self.ids = self.ids[np.repeat(begin - before[:-1], length) + np.arange(before[-1])]
        self.used, self.begin, self.length = len(self.ids), before[:-1], length
        self.seen = np.ones(len(kept), np.int64)
        old.clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: bytes) -> list[bytes]:
        """Keys of the pieces of a text; under ``space`` the leading space of a usual piece goes unsaid."""
        if self.cut == "white":
            return text.split()
        if _UNUSUAL.search(text):
            first, *rest = _INNER_SPACE.split(text.decode())
            return [self.OPENS + first.encode(), *[self.OPENS + b" " + x.encode() for x in rest]]
        found = text.split(b" ")
        found[0] = self.OPENS + found[0]
        return found

    def _learn(self, new: list[bytes]) -> None:
        special = self.special.search if self.special.search(b" ".join(new)) else lambda x: None
        if self.cut == "space":
            odd = np.array([x[:1] == self.OPENS or special(x) is not None for x in new])
            texts = [(x[1:] if x[:1] == self.OPENS else b" " + x).decode() for x in new]
        else:
            mark = self.MARK.encode()
            odd = np.array([mark in x or special(x) is not None for x in new])
            texts = [x.decode() for x in new]
        # pieces that are one word for certain
        single = np.array([x.isalpha() for x in new]) & ~odd if self.closes is not None else np.zeros(len(new), bool)
        alone = np.flatnonzero(odd).tolist()
        lens, flats = np.zeros(len(new), np.int64), [np.empty(0, np.uint32)]
        order = []
        for group, marked in ((single, False), (~odd & ~single, self.cut == "white")):
            glue = "" if self.cut == "space" else f" {self.MARK} " if marked else " "
            together = np.flatnonzero(group).tolist()
            for i in range(0, len(together), 1000):
                part = together[i:i + 1000]
                some = [texts[k] for k in part]
                joined = [glue.join(some[j:j + self.RUN]) + glue for j in range(0, len(some), self.RUN)]
                ids = np.fromiter(chain.from_iterable(self._ids(joined)), np.uint32)
                if marked:
                    size = np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.mark)])) - 1
                    ids = ids[ids != self.mark]
                elif self.cut == "white":
                    size = np.diff(np.concatenate([[-1], np.flatnonzero(self.closes[ids])]))
                else:
                    size = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
                if len(size) != len(part):
                    raise AssertionError("pieces and their ids differ in number")
                lens[part] = size
                order += part
                flats.append(ids)
        for k, found in zip(alone, self._ids([texts[k] for k in alone])):
            lens[k] = len(found)
            order.append(k)
            flats.append(np.array(found, np.uint32))
        flat = np.concatenate(flats)
        # flat holds the pieces in ``order``; pieces are found by their place in it
        order = np.array(order, np.int64)
        place = np.empty(len(new), np.int64)
        place[order] = np.concatenate([[0], np.cumsum(lens[order])[:-1]])
        at = self.used
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[at:at + len(flat)] = flat
        self.used += len(flat)
        self.begin = np.concatenate([self.begin, at + place])
        self.length = np.concatenate([self.length, lens])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, each followed by ``end_id``, as one array, and the number per text."""
        if len(self.index) > self.max_pieces:
            self._forget()
        numbers, counts = [], np.empty(len(texts), np.int64)
        get = self.index.__getitem__
        for k, text in enumerate(texts):
            found = self.pieces(text)
            counts[k] = len(found)
            numbers.append(np.fromiter(map(get, found), np.int32, len(found)))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._learn(new)
        word = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        self.seen += np.bincount(word, minlength=len(self.index))
        begin, length = self.begin[word], self.length[word]
        before = np.concatenate([[0], np.cumsum(length)])  # ids before each piece
        at = before[np.cumsum(counts)] + np.arange(len(texts))  # place of each text's end id
        out = np.empty(int(before[-1]) + len(texts), np.uint32)
        keep = np.ones(len(out), bool)
        keep[at] = False
        out[at] = end_id
        out[keep] = self.ids[np.repeat(begin - before[:-1], length) + np.arange(before[-1])]
        return out, np.diff(np.concatenate([[-1], at]))


@lru_cache(maxsize=4)
def piece_encoder(path: str, cut: str) -> PieceEncoder:
    """One encoder per Python worker: what it has learnt serves the worker's next tasks too."""
    return PieceEncoder(path, cut)
