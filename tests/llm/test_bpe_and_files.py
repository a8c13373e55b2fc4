import io
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tidemark.llm import bpe, token_files  # noqa: E402
from tidemark.llm.common import scratch_path  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "Hello <|endoftext|>World's ÀÉ é İ ½ ' s't don't a b   x <|startoftext|>",
    "", "   ", "\x1c a\x1cb \x85x\xa0y", "ΣΑΣ aaaa aaaaa ééé é á 日本語 テスト 😀😀 ﬁ İİ", "x" * 3000,
    "<|endoftext|><|endoftext|>a<|x", "\x00\x01 a​b k'LL 'Re", "१२३ ٣ Ⅷ ²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n=200, seed=2):
    rng = random.Random(seed)
    pools = [(1, 128), (0x80, 0x300), (0x300, 0x3000), (0x1F000, 0x1FA00)]
    return ["".join(chr(rng.randrange(*rng.choice(pools))) for _ in range(50)) for _ in range(n)]


def test_pair_index_equals_the_library(library):
    worker = bpe._worker(PATH)
    texts = HARD + random_texts()
    ids, rows = worker.encode(texts)
    for text, got, pieces in zip(texts, ids, rows):
        want = library.encode(text, add_special_tokens=False).ids
        assert got.tolist() == want, text
        assert worker.spell(pieces).decode() == library.decode(want, skip_special_tokens=False)


def test_memory_is_reset_without_change(library):
    worker = bpe._worker(PATH)
    limit, worker.limit = worker.limit, 1
    try:
        for _ in range(3):
            got = worker.encode(["the quick brown fox"])[0][0]
            assert got.tolist() == library.encode("the quick brown fox", add_special_tokens=False).ids
    finally:
        worker.limit = limit


def test_encode_decode_odd_rows(spark, odd_docs, clashing, no_docs, library):
    got = {(r.doc_id, r.decoded): r.ids for r in bpe.encode_decode(odd_docs, PATH).collect()}
    for r in odd_docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        key = (r.doc_id, library.decode(want, skip_special_tokens=False))
        assert np.frombuffer(got[key], "<u4").tolist() == want
    assert bpe.encode_decode(no_docs, PATH).count() == 0
    assert bpe.encode_decode(clashing, PATH).count() == 11


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        assert token_files.from_planes(token_files.to_planes(ids, bits), n, bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [1, 8])
def test_shard_round_trip_and_random_access(bits):
    rng = np.random.default_rng(3)
    docs = [(i if i else None, rng.integers(0, 49408, rng.integers(0, 300)).astype(np.uint32)) for i in range(60)]
    out = io.BytesIO()
    writer = token_files.ShardWriter(out, bits, 128)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = token_files.ShardReader(out, len(out.getvalue()))
    back = list(reader.documents())
    assert [(d, i.tolist()) for d, _, i in back] == [(d, i.tolist()) for d, i in docs]
    flat = np.concatenate([i for _, i in docs])
    assert reader.block(3).tolist() == flat[3 * 128 : 4 * 128].tolist()
    out.getbuffer()[-40] ^= 1
    with pytest.raises(ValueError):
        token_files.ShardReader(out, len(out.getvalue()))


def test_files_match_the_library(spark, odd_docs, no_docs, library):
    files = token_files.write_token_files(odd_docs, scratch_path(spark, "t"), PATH, block_ids=1000)
    got = sorted(token_files.read_token_files(spark, files).collect(), key=lambda r: r.start)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, zlib.crc32(g.ids)) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    none = token_files.write_token_files(no_docs, scratch_path(spark, "t"), PATH)
    assert none.shards == () and token_files.read_token_files(spark, none).count() == 0


def test_pieces_are_learned_and_looked_up_together(library, monkeypatch):
    """Calls count where time does: fifteen for a new piece when each was split and stored alone, and its ids put together by text."""
    import sys

    from tidemark.llm import words

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefgh'1é.", k=7)) for _ in range(20)) for _ in range(500)]
    worker = token_files.PieceIds(library, token_files.library_words(library))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got, _ = worker.encode(texts)
    finally:
        sys.setprofile(None)
    new = len(worker.rows)
    assert new > 9000 and calls < 9 * new, calls / new
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # plain and odd pieces in one go, and again from memory, some texts at a time
    mixed = [t for pair in zip(HARD * 30, random_texts(len(HARD) * 30), strict=True) for t in pair]
    want = [library.encode(t, add_special_tokens=False).ids for t in mixed]
    for size in (1 << 16, 5):
        monkeypatch.setattr(words, "TAKE_PIECES", size)
        worker.reset()
        assert all([g.tolist() for g in worker.encode(mixed)[0]] == want for _ in range(2))
    assert worker.encode([])[0] == []
