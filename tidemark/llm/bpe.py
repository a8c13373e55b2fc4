"""Byte-pair encoding by a pair occurrence index, and decoding.

All new words of a buffer of texts are laid out in one array of symbols. An index maps each
mergeable pair, by its rank, to every position where it occurs. Active ranks are applied in
ascending order: each merge takes all its positions at once, closes the gap in the linked
neighbours and files the pairs that arise under their own ranks. A pair that a merge creates
always has a later rank (checked when the file is read), so one ascending sweep equals
merging word by word.

Input: any documents frame; null text counts as empty, an empty text has no ids. A very long text is a buffer
of its own. Rows are independent, so repeated rows and ids and ties change nothing; an empty table gives no rows.
Extra columns may be kept; columns named ids or decoded give way to the results.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, whole_text, worker_state
from .words import PieceIds, byte_letters

#: Texts are encoded in buffers of about so many characters.
BUFFER_CHARS = 6_000_000


class MergeTable:
    """The merges of a tokenizer file as arrays, for words of bytes with a word-end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        if spec["type"] != "BPE" or spec["end_of_word_suffix"] != "</w>" or spec["unk_token"] is not None:
            raise ValueError("expected a byte-pair file with </w> word ends and no unknown token")
        vocab = spec["vocab"]
        self.size = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(self.size, -1, np.int64)
        made[self.product] = np.arange(len(pairs))
        if (np.maximum(made[left], made[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        self.spelling = [b""] * self.size
        for token, i in vocab.items():
            self.spelling[i] = token.encode()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1. Negative symbols are gaps."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.order[at], -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each word."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        # one gap in front of each word and one behind all
        begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1
        sym = np.full(int(lengths.sum()) + len(raw) + 1, -1, np.int64)
        data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
        sym[:] = self.inner[data]
        ends = begins + lengths - 1
        sym[ends] = self.last[data[ends]]
        sym[begins - 1] = -1
        sym[-1] = -1
        nxt = np.arange(1, len(sym) + 1)
        prv = np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(rank: np.ndarray, at: np.ndarray) -> None:
            """Add positions to the lists of their pairs."""
            keep = rank >= 0
            rank, at = rank[keep], at[keep]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            rank, at = rank[by], at[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            bounds = [0, *cuts.tolist(), len(rank)]
            names = rank[bounds[:-1]].tolist()
            for r, lo, hi in zip(names, bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[lo:hi])
                else:
                    index[r] = [at[lo:hi]]
                    heapq.heappush(heap, r)

        file(self.ranks(sym[:-1], sym[1:]), np.arange(len(sym) - 1))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[sym[at] == a]
            after = nxt[at]
            ok = sym[after] == b
            at, after = at[ok], after[ok]
            if a == b and len(at) > 1:
                at, after = _left_to_right(at, after)
            if not len(at):
                continue
            sym[at] = self.product[r]
            sym[after] = -2
            beyond = nxt[after]
            nxt[at] = beyond
            prv[beyond] = at
            before = prv[at]
            file(self.ranks(np.concatenate((sym[before], sym[at])), np.concatenate((sym[at], sym[beyond]))), np.concatenate((before, at)))
        live = sym >= 0
        ids = sym[live].astype(np.uint32)
        cut = np.concatenate(([0], np.cumsum(live)))
        return ids, cut[ends + 1] - cut[begins]


def _left_to_right(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping occurrences of a doubled symbol those that a scan from the left takes."""
    keep, taken = np.ones(len(at), bool), -1
    for i, (p, q) in enumerate(zip(at.tolist(), after.tolist())):
        if p == taken:
            keep[i] = False
        else:
            taken = q
    return at[keep], after[keep]


#: Pieces that a worker remembers, with ids and spelling: about 250 MB.
REMEMBERED = 250_000


def _worker(path: str) -> PieceIds:
    """One encoder per worker process; its memory of pieces outlives a task."""
    return worker_state(("bpe", path), lambda: _encoder(path))


def _encoder(path: str) -> PieceIds:
    from tokenizers import Tokenizer

    table = MergeTable(path)
    tokenizer = Tokenizer.from_file(path)
    spelling = table.spelling + [b""] * 64
    for i, t in tokenizer.get_added_tokens_decoder().items():
        spelling[i] = t.content.encode()
    return PieceIds(tokenizer, table.encode_words, limit=REMEMBERED, decoded=spelling)


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id or the `keep` columns, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text that they decode to.

    `path` is the tokenizer file as every worker sees it.
    """
    kept = docs.select(packed(docs, keep or [doc_id], "ids", "decoded"), whole_text(text).alias("__whole"))
    schema = kept.drop("__whole").schema.add("ids", "binary").add("decoded", "string")

    def run(batches):
        worker = _worker(path)
        for batch in batches:
            texts = batch.column("__whole")
            lo, done = 0, 0
            sizes = pa.compute.utf8_length(texts).to_numpy(zero_copy_only=False)
            while lo < batch.num_rows:
                hi, done = lo, 0
                while hi < batch.num_rows and (hi == lo or done + sizes[hi] <= BUFFER_CHARS):
                    done += sizes[hi]
                    hi += 1
                ids, rows = worker.encode(texts[lo:hi].to_pylist())
                cols = [batch.column("__row").slice(lo, hi - lo), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([worker.spell(r).decode() for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["__row", "ids", "decoded"])
                lo = hi

    return unpacked(kept.mapInArrow(run, schema), "ids", "decoded")
