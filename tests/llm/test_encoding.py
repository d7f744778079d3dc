import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from helpers import frame, rows

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "▁x", "a\tb\n\nc", "<s>hi</s>", "\x00a", "日本😀é", "ﬁ①", " " * 50, "a" * 9000, "ab" * 5000, "\n" * 9, "x.,y!.é.", "don't  <|endoftext|> It's ÀÉ 12,5"]


def texts():
    r = random.Random(3)
    signs = "ab  the▁\néßñ日,.!0123\tΩ_-=ing"
    return ODD + ["".join(r.choice(signs) for _ in range(r.randint(1, 90))) for _ in range(1500)]


def test_pieces_match_the_library():
    from sentencepiece import SentencePieceProcessor

    from kvstrata.llm.sentencepiece_bpe import PieceModel

    sp, m = SentencePieceProcessor(model_file=PIECES), PieceModel(PIECES)
    for t in texts():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert m.encode(t, True, True) == ids
        assert m.decode(ids) == sp.decode(ids)
    r = random.Random(4)
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(260) for _ in range(r.randint(0, 9))]
        assert m.decode(ids) == sp.decode(ids)


def test_blocks_and_small_memo_change_nothing():
    from kvstrata.llm.sentencepiece_bpe import PieceModel

    a, b = PieceModel(PIECES), PieceModel(PIECES)
    b.BLOCK, b.MEMO, b.cut = 16, 2, None
    for t in texts()[:400]:
        assert a.encode(t) == b.encode(t)


def test_op1_rows(spark):
    from sentencepiece import SentencePieceProcessor

    from kvstrata.llm.sentencepiece_bpe import encode_documents

    sp = SentencePieceProcessor(model_file=PIECES)
    cases = [(1, None), (2, ""), (2, ""), (None, "null id"), *((10 + i, t) for i, t in enumerate(ODD))]
    out = encode_documents(frame(spark, cases), PIECES)
    want = []
    for i, t in cases:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert encode_documents(frame(spark, []), PIECES).count() == 0


def test_op8_round_trip(spark):
    from tokenizers import Tokenizer

    from kvstrata.llm.token_files import round_trip

    tok = Tokenizer.from_file(WORDS)
    cases = [(5, None), (4, ""), (-3, "minus"), *((10 + 7 * i, t) for i, t in enumerate(ODD))]
    got = rows(round_trip(frame(spark, cases), WORDS, end_id=2), "doc_id", "start", "n_tokens", "ids_crc32")
    want, start = [], 0
    for i, t in sorted(cases):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert round_trip(frame(spark, []), WORDS, end_id=2).count() == 0
    assert round_trip(frame(spark, [(1, "a"), (1, "a"), (None, "b")]), WORDS, end_id=2).count() == 3


def test_by_word_memo_matches_whole_texts():
    from kvstrata.llm.token_files import Encoder

    e = Encoder(WORDS)
    assert e.by_word
    for t in texts():
        assert np.frombuffer(e.packed(t.encode()), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_frames_are_read_alone(tmp_path):
    import io

    from kvstrata.llm import token_files as tf

    docs = [(i, list(range(i, i + 40 * (i % 5)))) for i in range(200)]
    raw = tf.file_of(docs, width=2, frame_bytes=500)
    path = tmp_path / "tokens"
    path.write_bytes(raw)
    got = tf.read_documents(str(path), [7, 123])
    assert {k: v.tolist() for k, v in got.items()} == {k: dict(docs)[k] for k in (7, 123)}
    reader = tf.FrameReader(io.BytesIO(raw))
    assert len(reader.table) > 20
    seen = []
    frame_of = reader.frame
    reader.frame = lambda k: seen.append(k) or frame_of(k)
    reader.read(123)
    assert seen == [int(reader.docs[123][1])]
    bad = bytearray(raw)
    bad[reader.starts[3] + 12] ^= 1
    import zstandard

    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.FrameReader(io.BytesIO(bytes(bad))).frame(3)
    with pytest.raises(ValueError):
        tf.FrameReader(io.BytesIO(raw[:-1]))
