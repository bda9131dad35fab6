"""Piece encoding against the library, byte for byte."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from phasegrid.llm import sentencepiece_op
from phasegrid.llm.pieces import PieceEncoder

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def mixed_texts() -> list[str]:
    rng = random.Random(1)
    parts = ["a", "e", "th", "  ", " ", "\n", "\t", "é", "漢", "🙂", "▁", "<s>", "the", "ing", "0x", "   ", "́", "ß", "Д", "1", ".", " "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for unit in ("a", " ", "=", "abab", "the", "\t", "▁"):
        out += [unit * n for n in range(40)]
    return out + ["x" * 5000, "word " * 3000]


def test_ids_match_the_library(library):
    texts = mixed_texts()
    encoder = PieceEncoder(PATH, cache_words=500)
    for at in range(0, len(texts), 400):          # several calls: the cache is filled and cut
        part = texts[at:at + 400]
        flat, sizes = encoder.encode(pa.array(part, pa.string()))
        want = library.encode(part, num_threads=1)
        start = 0
        for size, ids, raw in zip(sizes.tolist(), want, encoder.decode_bytes(flat, sizes), strict=True):
            assert flat[start:start + size].tolist() == ids
            assert raw.decode(errors="replace") == library.decode(ids)
            start += size


def test_operator(spark, library):
    rows = [(1, "Hello  world\n", 5), (2, "", 6), (3, None, 7), (None, "Hello  world\n", 8), (2, "again", 9), (4, "a▁b", 1)]
    got = sentencepiece_op.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["ids"]) for r in got) == sorted(
        (d or 0, len((t or "").encode()), library.encode(t) if t else []) for d, t, _ in rows)
    assert all(r["n_pieces"] == len(r["ids"]) for r in got)
    assert [r["round_trip"] for r in got if r["doc_id"] == 4] == [False] and sum(r["round_trip"] for r in got) == 5
    back = sentencepiece_op.decode(spark.createDataFrame([(1, library.encode("a b")), (2, None), (3, [0, None])],
                                                         "doc_id long, ids array<int>"), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back}[1] == "a b" and {r["doc_id"]: r["text"] for r in back}[2] == ""
    assert sentencepiece_op.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
