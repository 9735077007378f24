"""Token ids of whole texts by a given vocabulary file, with repeated pieces encoded once per worker.

A text is cut at single spaces between non-space characters, where neither pre-tokenizer of the two formats
joins its pieces, so the ids of the pieces in order are the ids of the text. Pieces seen before are looked up;
new ones go to the tokenizers library together, a special token between them.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np

#: Pieces kept per worker (about 250 MB); beyond that those seen once are dropped.
CACHED_PIECES = 1_000_000
#: Longer pieces are encoded each time.
LONGEST_PIECE = 48
FIRST = "\ud800"  # cannot occur in a text: marks a piece that has no space before it
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")

#: The characters that byte-level BPE shows for bytes: printable ones stand for themselves, the others follow from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SHOWN_SPACE = chr(SHOWN_BYTES[32])
#: Letters up to here keep their form under NFC, and each lower-cases by itself (but U+0130).
LAST_LATIN = "\u024f"


def latin_word(piece: str) -> bool:
    word = piece[1:] if piece[:1] == FIRST else piece
    return word.isalpha() and (word.isascii() or max(word) <= LAST_LATIN and "\u0130" not in word)


def latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class PieceEncoder:
    """`keep_spaces`: the format has a space in front of a word as part of its token (else spaces are dropped)."""

    def __init__(self, path: str, keep_spaces: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain, self.cutting = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.keep_spaces = keep_spaces
        specials = sorted((t.content, i) for i, t in self.cutting.get_added_tokens_decoder().items() if t.special)
        self.separator, self.separator_id = specials[0]
        #: In a format without case, texts of Latin-1 are lower-cased first: fewer pieces, same ids.
        self.caseless = "Lowercase" in str(self.plain.normalizer)
        self.lines_are_spaces = not keep_spaces and all(
            self.plain.encode(x, add_special_tokens=False).ids == self.plain.encode(x.replace("\n", " "), add_special_tokens=False).ids
            for x in ("a\nb", "it\n's 1\n2", "end.\n\n- \nnext", "\n", "\nx\n"))
        self.model = self.plain.model
        self.direct = self.words_are_pieces()
        self.forget()

    def words_are_pieces(self) -> bool:
        """Whether a run of letters is one piece of byte-level BPE, so that the model alone gives its ids."""
        shown = f"{type(self.model).__name__} {self.plain.pre_tokenizer}"
        return shown.startswith("BPE") and "ByteLevel" in shown and all(
            self.word_ids(p) == self.plain.encode(self.text_of(p), add_special_tokens=False).ids for p in ("Word", FIRST + "Größe", "élan", FIRST + "x"))

    def word_ids(self, piece: str) -> list[int]:
        """Ids of a piece of Latin letters, by the merges of the model without normalizer and pre-tokenizer."""
        first = piece[:1] == FIRST
        word = piece[1:] if first else piece
        if self.caseless:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(SHOWN_BYTES)
        if self.keep_spaces and not first:
            word = SHOWN_SPACE + word
        return [t.id for t in self.model.tokenize(word)]

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.seen = np.zeros(1 << 14, np.int64)

    def shrink(self) -> None:
        """Keep the pieces met most: at most half of the bound stays."""
        n, least = len(self.index), 2
        while np.count_nonzero(self.seen[:n] >= least) > CACHED_PIECES // 2:
            least *= 2
        old, flat, start, size, seen = self.index, self.flat, self.start, self.size, self.seen
        self.forget()
        kept = [(piece, k) for piece, k in old.items() if seen[k] >= least]
        for a, b in slices(len(kept), 10_000):
            part = kept[a:b]
            parts = [flat[start[k] : start[k] + size[k]] for _, k in part]
            self.remember([piece for piece, _ in part], np.concatenate(parts), size[[k for _, k in part]])

    def text_of(self, piece: str) -> str:
        if piece[:1] == FIRST:
            return piece[1:]
        return " " + piece if self.keep_spaces else piece

    def ids_of(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The new pieces in another order, their ids one after the other, and how many each has.

        Latin words go to the model; the rest to the tokenizer, many in one call, cut at the special token.
        """
        if not self.direct:
            return pieces, *self.tokenized(pieces)
        words, others = [], []
        for p in pieces:
            (words if latin_word(p) else others).append(p)
        found = list(map(self.word_ids, words))
        ids, sizes = self.tokenized(others)
        return (
            words + others, np.concatenate([np.fromiter(chain.from_iterable(found), np.uint32), ids]),
            np.concatenate([np.fromiter(map(len, found), np.int64, len(found)), sizes]))

    def tokenized(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the whole tokenizer, and how many each has."""
        parts, sizes = [], []
        for a, b in slices(len(pieces), 500):
            texts = [self.text_of(p) for p in pieces[a:b]]
            joined = self.separator.join(texts)
            if joined.count("<|") == len(texts) - 1 == joined.count("|>"):
                ids = np.asarray(self.cutting.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.separator_id)
                if len(cuts) == len(texts) - 1:
                    sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    parts.append(np.delete(ids, cuts))
                    continue
            found = [np.asarray(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            sizes.append(np.array([len(x) for x in found], np.int64))
            parts += found
        return (np.concatenate(parts), np.concatenate(sizes)) if sizes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        k, n = len(self.index), len(pieces)
        while k + n > len(self.start):
            self.start, self.size, self.seen = (np.resize(x, 2 * len(x)) for x in (self.start, self.size, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.size[k : k + n], self.seen[k : k + n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(ids)
        self.index.update(zip(pieces, range(k, k + n)))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of remembered pieces one after the other, and the end of each."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def learn(self, missing: list[str]) -> None:
        """Encode unseen pieces; a word with marks behind it is made from the word and the marks."""
        whole = [p for p in missing if p[-1:].isalnum()]
        composed, words, marks = [], [], []
        for piece in [p for p in missing if not p[-1:].isalnum()]:
            m = WORD_AND_MARKS.fullmatch(piece[1:] if piece[:1] == FIRST else piece)
            if m and m[1].lower().isalpha():  # lower case of a few letters brings marks with it
                composed.append(piece)
                words.append(piece[: len(piece) - len(m[2])])
                marks.append(FIRST + m[2])
            else:
                whole.append(piece)
        whole = list(dict.fromkeys([*whole, *(p for p in (*words, *marks) if p not in self.index)]))
        self.remember(*self.ids_of(whole))
        if composed:
            index = self.index
            ids, ends = self.gather(np.array([index[p] for pair in zip(words, marks) for p in pair], np.int64))
            self.remember(composed, ids, np.diff(np.concatenate([[0], ends[1::2]])))

    def pieces(self, text: str) -> list[str]:
        if self.caseless and latin_1(text):
            text = text.lower()
        if self.lines_are_spaces:
            text = text.replace("\n", " ")
        out = text.split(" ")
        if self.keep_spaces:
            out[0] = FIRST + out[0]
        return out

    def odd(self, pieces: list[str]) -> set[str]:
        """Pieces around which a plain split at spaces may be wrong (empty, or with white space at an end), or too long to keep."""
        if self.keep_spaces:
            return {p for p in pieces if not p or len(p) > LONGEST_PIECE or p != p.strip()}
        return {p for p in pieces if len(p) > LONGEST_PIECE}

    def alone(self, text: str) -> np.ndarray:
        """Ids of a text with spaces or pieces of an unusual kind, without the cache."""
        cut = SAFE_SPACE.split(text) if self.keep_spaces else [text]
        cut = [FIRST + cut[0], *cut[1:]]
        short = [p for p in dict.fromkeys(cut) if len(p) <= LONGEST_PIECE and p not in self.index]
        self.learn(short)
        parts = []
        for p in cut:
            if len(p) <= LONGEST_PIECE:
                k = self.index[p]
                parts.append(self.flat[self.start[k] : self.start[k] + self.size[k]])
            else:
                parts.append(self.ids_of([p])[1])
        return np.concatenate(parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is the empty text. No cycles arise here, so the many lists are not searched for them."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.encoded(texts)
        finally:
            if collecting:
                gc.enable()

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > CACHED_PIECES:
            self.shrink()
        texts = [t or "" for t in texts]
        cut = [self.pieces(t) for t in texts]
        every = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(at < 0).tolist()
        missing = list(dict.fromkeys(every[i] for i in new))
        out: list = [None] * len(texts)
        odd = self.odd(missing)
        if odd:
            for i, pieces in enumerate(cut):
                if not odd.isdisjoint(pieces):
                    out[i] = self.alone(texts[i])
                    cut[i] = []
            every = list(chain.from_iterable(cut))
            self.learn(list(dict.fromkeys(p for p in every if p not in self.index)))
            at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        elif new:
            self.learn(missing)
            at[new] = [self.index[every[i]] for i in new]
        np.add.at(self.seen, at, 1)
        ids, ends = self.gather(at)
        ends = np.concatenate([[0], ends])
        a = 0
        for i, pieces in enumerate(cut):
            b = a + len(pieces)
            if out[i] is None:
                out[i] = ids[ends[a] : ends[b]]
            a = b
        return out


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keep_spaces: bool) -> PieceEncoder:
    """The worker's encoder, kept between tasks."""
    key = (path, keep_spaces)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, keep_spaces)
    return _encoders[key]


def release() -> None:
    """Let go of the encoders of a worker that goes on to other work."""
    _encoders.clear()


def slices(n: int, step: int) -> Iterator[tuple[int, int]]:
    return ((a, min(n, a + step)) for a in range(0, n, step))
