"""Splitting text into the words of a lower-casing word-end BPE, and remembering their ids.

A text is cut at white space first. Neither normalisation nor any alternative of the word
pattern reaches across white space, so a piece between white space can be encoded alone and
its ids remembered; natural text repeats its pieces, so few of them are encoded.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate, chain

import numpy as np
import regex

from .common import ragged_take

# Fixed values of the tokenizer file: its word pattern and its two special tokens.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: No piece holds a space, so many pieces are split in one call with a space between them.
GAP = " "
WORD_OR_GAP = regex.compile(f"{WORD.pattern}|{GAP}")
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: str.split() also splits at these, which the pattern takes for symbols.
SEPARATORS = re.compile("[\x1c-\x1f]")
WHITE = re.compile("[\x20\x09-\x0d]+")
#: Below this code point NFC changes nothing and lower-casing is letter by letter.
LATIN_END = "ɐ"
#: Ids are looked up for texts of about so many pieces at once.
TAKE_PIECES = 1 << 16


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def pieces_of(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [p for p in WHITE.split(text) if p]
    return text.split()


class Numbers(dict):
    """Numbers strings as they are first asked for, and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = n = len(self)
        return n


class PieceIds:
    """Ids of pieces, kept up to `limit` pieces per worker.

    `encode_words` maps a list of distinct words to all their ids in a row and the number of each; `tokenizer` is the
    library's object, asked for normalisation and splitting outside plain Latin.
    """

    def __init__(self, tokenizer, encode_words, limit: int = 600_000, decoded: list[bytes] | None = None):
        self.tokenizer, self.encode_words, self.limit, self.decoded = tokenizer, encode_words, limit, decoded
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.reset()

    def reset(self) -> None:
        self.rows, self.words = Numbers(), Numbers()
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.texts: list[bytes] = []
        # a gap has no ids; special tokens are words named by their id
        for key in (GAP, *self.specials.values()):
            self.words[key] = len(self.words)
        self.word_lengths = np.array([0] + [1] * len(self.specials), np.int64)
        self.word_starts = np.cumsum(self.word_lengths) - self.word_lengths
        self.word_flat = np.array([*self.specials.values()], np.uint32)

    def _split(self, piece: str) -> list:
        """Words as strings, special tokens as ids; of a piece that isn't plain."""
        out: list = []
        for part in SPECIAL.split(piece):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                clean = self.tokenizer.normalizer.normalize_str(part)
                out += [w if w.isascii() else unicodedata.normalize("NFC", w) for w in WORD.findall(clean)] if max(clean) < LATIN_END else self._library_words(clean)
        return out

    def _library_words(self, clean: str) -> list[str]:
        """The library's own split, turned back from byte letters."""
        back = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)]

    def _learn(self) -> None:
        """Encode the pieces met since the last call."""
        new = self.rows.new
        odd = [k for k, p in enumerate(new) if "<|" in p or not (p.isascii() or max(p) < LATIN_END)]
        splits = [self._split(new[k]) for k in odd]
        for k in odd:
            new[k] = ""
        # the plain pieces, empty ones in the place of odd ones, then the odd ones
        found = WORD_OR_GAP.findall(GAP.join(new).lower())
        for words in splits:
            found.append(GAP)
            found += words
        codes = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        del found
        if self.words.new:
            ids, lengths = self.encode_words(self.words.new)
            self.word_starts = np.concatenate((self.word_starts, len(self.word_flat) + np.cumsum(lengths) - lengths))
            self.word_lengths = np.concatenate((self.word_lengths, lengths))
            self.word_flat = np.concatenate((self.word_flat, ids))
            self.words.new.clear()
        added = ragged_take(self.word_starts, self.word_lengths, self.word_flat, codes)
        bounds = np.concatenate(([0], np.cumsum(self.word_lengths[codes])[codes == self.words[GAP]], [len(added)]))
        begins, lengths = bounds[:-1].copy(), np.diff(bounds)
        begins[odd], lengths[odd] = begins[len(new) :], lengths[len(new) :]
        begins, lengths = begins[: len(new)], lengths[: len(new)]
        if self.decoded is not None:
            spell, listed = self.decoded.__getitem__, added.tolist()
            self.texts += [b" ".join(map(spell, listed[lo : lo + n])) for lo, n in zip(begins.tolist(), lengths.tolist())]
        self.starts, self.lengths = np.concatenate((self.starts, len(self.flat) + begins)), np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, added))
        new.clear()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        """The ids of each text, and the rows of its pieces (for `spell`)."""
        if len(self.rows) > self.limit or len(self.words) > 2 * self.limit:
            self.reset()
        row = self.rows.__getitem__
        rows = [list(map(row, pieces_of(t))) for t in texts]
        if self.rows.new:
            self._learn()
        ids, lo = [], 0
        while lo < len(rows):
            hi, taken = lo, 0
            while hi < len(rows) and taken < TAKE_PIECES:
                taken += len(rows[hi])
                hi += 1
            ids += self._take(rows[lo:hi], taken)
            lo = hi
        return ids, rows

    def _take(self, rows: list[list[int]], n: int) -> list[np.ndarray]:
        """The ids of a few texts, looked up together."""
        every = np.fromiter(chain.from_iterable(rows), np.int64, n)
        ids = ragged_take(self.starts, self.lengths, self.flat, every)
        ends = np.concatenate(([0], np.cumsum(self.lengths[every])))
        bounds = ends[[0, *accumulate(map(len, rows))]].tolist()
        return [ids[lo:hi] for lo, hi in zip(bounds, bounds[1:])]

    def spell(self, rows: list[int]) -> bytes:
        """The decoded text of pieces, as UTF-8."""
        texts = self.texts
        return b" ".join([t for t in map(texts.__getitem__, rows) if t])
