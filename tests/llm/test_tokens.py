"""Packed and flat token files against the library and against counting."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from phasegrid.llm import bitpack, token_scan
from phasegrid.llm.common import scratch_path
from phasegrid.llm.word_encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, World! don't we'll", "", None, "ÉCOLE Straße ΣΑΣ naïve", "a  b\n\tc d e", "x" * 3000, "12345 6 ½ Ⅷ", "<|endoftext|> in <|startoftext|>text",
         "漢字 かな 🙂🙂 !!!...", "Hello, World! don't we'll", "é ́ combining", "(word). [x]; y: z? ...", "\0 \x01\x1c\x85", "A.B,C;D"]


@pytest.mark.parametrize("width", [1, 3, 7, 16, 17, 31, 32])
@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(width, count):
    ids = np.random.default_rng(count).integers(0, 1 << width, count, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, width), width, count) == ids).all()


def test_random_access():
    ids = np.random.default_rng(1).integers(0, 49408, 10_000).astype(np.uint32)
    shard = bitpack.Shard(bitpack.pack_shard(ids, np.array([4000, 10_000]), np.array([3, 9]), np.zeros(2, bool), 16, 128))
    for a, b in [(0, 0), (0, 1), (127, 129), (5000, 5001), (9990, 10_000), (0, 10_000), (128, 256)]:
        assert (shard.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        bitpack.pack_shard(ids, np.array([10_000]), np.array([1]), np.zeros(1, bool), 8)


@pytest.mark.parametrize("special", [False, True])
def test_words_encode_like_texts(special):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = special
    encoder = WordEncoder(PATH, special, cache_words=6)
    for texts in (TEXTS, TEXTS[:4], TEXTS[::-1]):
        flat, counts = encoder.encode(pa.array(texts, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert flat.tolist() == [i for w in want for i in w]


def rows():
    return [(i * 7 % 31, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]


def test_packed_files(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("doc_id", "text", "1 as start").repartition(3)
    out = scratch_path(spark, "test-packed")
    got = bitpack.read_packed(spark, out, bitpack.write_packed(df, out, PATH, end_id=2)).collect()
    library, at = Tokenizer.from_file(PATH), 0
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got}
    for doc, text in sorted(rows(), key=lambda r: -1 if r[0] is None else r[0]):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert found[doc] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = scratch_path(spark, "test-packed")
    assert bitpack.read_packed(spark, empty, bitpack.write_packed(df.limit(0), empty, PATH, end_id=2)).collect() == []


@pytest.mark.parametrize("block", [3, 16, 1 << 18])
def test_separator_scan(spark, block):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(2)
    out = scratch_path(spark, "test-flat")
    places = token_scan.write_flat(df, out, PATH, 49407)
    got = token_scan.scan_counts(spark, out, 49407, block_ids=block)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    found = {r["doc_id"]: r["n_tokens"] for r in got.join(places, ["file", "ordinal"]).collect()}
    assert found == {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows()}
    assert got.where("not complete").count() == 0


def test_separator_scan_without_documents(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").limit(0)
    out = scratch_path(spark, "test-flat")
    places = token_scan.write_flat(df, out, PATH, 49407)
    assert places.collect() == [] and token_scan.scan_counts(spark, out, 49407).join(places, ["file", "ordinal"]).collect() == []


def test_scan_of_foreign_files(spark, tmp_path):
    files = {"a": [5, 9, 9, 7, 7, 7], "b": [9], "c": [1, 2, 3], "d": []}
    for name, ids in files.items():
        (tmp_path / f"{name}.ids").write_bytes(np.array(ids, "<u4").tobytes())
    got = sorted(tuple(r) for r in token_scan.scan_counts(spark, str(tmp_path), 9, id_bytes=4, block_ids=2).collect())
    assert got == [("a.ids", 0, 0, 2, True), ("a.ids", 1, 2, 1, True), ("a.ids", 2, 3, 3, False), ("b.ids", 0, 0, 1, True), ("c.ids", 0, 0, 3, False)]
