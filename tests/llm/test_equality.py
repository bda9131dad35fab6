"""What is taken for equal is equal: sequences that collide under 64-bit polynomials, and rows of one id."""

import unicodedata

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from phasegrid.llm import group_join as gj
from phasegrid.llm import recompression as rc
from phasegrid.llm import suffix_dedup as sd
from phasegrid.llm.word_encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def doubling_words(steps=11):
    """The Thue-Morse word and its complement: no polynomial modulo 2^64 tells them apart."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_recompression_tells_long_words_apart(spark):
    x, y = doubling_words()
    same = " ".join(f"w{i}" for i in range(49))
    docs = [(1, f"{same} {x}"), (2, f"{same} {y}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in rc.digest_columns(rc.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got == rc.brute_force(docs, 50)


def test_join_tells_long_words_apart(spark):
    x, y = doubling_words()
    docs = [(1, x), (2, y), (3, f"x {x} y z k"), (4, f"x {y} y z k")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in gj.link_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == gj.brute_force(docs, 5, 80)


def test_suffixes_tell_long_windows_apart(spark):
    x, y = doubling_words()
    docs = [(1, x), (2, y)]
    got = {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 2048).collect()}
    assert got == {1: 0, 2: 0}


def equal_hashes(spark):
    """Two texts of 61 words with one 32-bit hash, found by trying."""
    rows = spark.range(300_000).selectExpr("concat(array_join(transform(sequence(1, 60), i -> concat('w', i)), ' '), ' ', md5(string(id))) as t")
    pair = rows.selectExpr("t", "hash(t) as h").groupBy("h").agg({"t": "collect_list"}).toDF("h", "t").where("size(t) > 1").first()
    return pair["t"][:2]


def test_twins_with_one_short_hash(spark):
    """Rows of one id whose texts have one 32-bit hash keep their own results."""
    first, second = equal_hashes(spark)
    docs = [(1, first), (5, first), (5, second)]
    got = sorted((r["doc_id"], r["n_removed"]) for r in rc.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 61).collect())
    assert got == [(1, 0), (5, 0), (5, 61)]


def test_long_text_in_pieces(spark, monkeypatch):
    import random
    monkeypatch.setattr(rc, "PIECE_WORDS", 70)
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 40)}" for _ in range(900)]
    docs = [(1, " ".join(words)), (2, " ".join(words[100:500] + ["x"] + words[505:700])), (3, " ".join(["a"] * 300)), (4, " ".join(["a"] * 90))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in rc.digest_columns(rc.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 20)).collect()}
    assert got == rc.brute_force(docs, 20)


def test_every_letter_before_closing_punctuation():
    library = Tokenizer.from_file(PATH)
    encoder = WordEncoder(PATH)
    letters = [c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "L"]
    for tail in ".,;:!?":
        texts = [f"{c}{tail} ab{c}{tail}" for c in letters]
        for a in range(0, len(texts), 20_000):
            part = texts[a:a + 20_000]
            flat, counts = encoder.encode(pa.array(part, pa.string()))
            want = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
            assert counts.tolist() == [len(w) for w in want]
            assert flat.tolist() == [i for w in want for i in w]
