"""Ids equal those of the public library; decoding gives the bytes back."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lumenstep.llm import byte_bpe, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_pieces_of_any_length():
    rng = random.Random(4)
    encoder = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for n, times in ((0, 1), (1, 50), (2, 50), (3, 50), (9, 200), (400, 30), (30_000, 2)):
        for letters in ("ab", "abcdeé", "日本語 x1'", "aAé😀 \n\t's09.,  ", "\x00\x1c\x85 "):
            for _ in range(times):
                text = "".join(rng.choice(letters) for _ in range(n))
                assert encoder.encode(text) == byte_bpe.pack(LIBRARY.encode_ordinary(text)), text


def test_merges_follow_rank_then_place():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 300, b"ab": 299, b"aaa": 301, b"bb": 302}
    want = tiktoken.Encoding("small", pat_str=r"[\s\S]+", mergeable_ranks={b: r for b, r in ranks.items()}, special_tokens={})
    rng = random.Random(1)
    for n in range(1, 60):
        piece = "".join(rng.choice("aab") for _ in range(n))
        assert byte_bpe.encode_piece(piece.encode(), ranks) == want.encode_ordinary(piece)
    assert byte_bpe.encode_piece(b"aaaaa", ranks) == [300, 301]


def test_long_texts_and_small_caches_change_nothing(monkeypatch):
    text = "Spelling, spelt 1234  again\n\n" * 3000
    want = byte_bpe.pack(LIBRARY.encode_ordinary(text))
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(byte_bpe, "PIECES_AT_ONCE", 7)
    monkeypatch.setattr(byte_bpe, "KEEP_PIECES", 3)
    assert byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(text) == want


def test_pair_tree_takes_the_leftmost_lowest():
    tree = byte_bpe.PairTree([5, 3, 9, 3, 7])
    assert tree.leftmost_lowest() == 1
    tree.put(1, byte_bpe.NO_PAIR)
    assert tree.leftmost_lowest() == 3
    for i in (0, 2, 3, 4):
        tree.put(i, byte_bpe.NO_PAIR)
    assert tree.leftmost_lowest() is None


def test_frames_round_trip(spark):
    rows = [(1, "a text", "x"), (1, "a text", "x"), (None, "no id", "y"), (2, None, None), (3, "", "z"), (4, "é\u0000日😀" * 5000, "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.decode(byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got) == sorted((i or 0, (t or "").encode()) for i, t, _ in rows)
    both = byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN, back=True).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    assert byte_bpe.encode(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, b"\xff\xff\xff\x7f")], "doc_id long, ids binary"), RANKS).collect()


def test_query_equals_library(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_rank_file(tmp_path):
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    assert byte_bpe.read_ranks(str(tmp_path / "r"))[b"a"] == 97
