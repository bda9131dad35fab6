"""Marginal probabilities against all segmentations, and held-out accuracy."""

import itertools
import math

import numpy as np
import public_tokenizers
import pyarrow as pa

from phasegrid.llm import langid
from phasegrid.llm.queries import op7_language_id
from phasegrid.llm.trie import PieceTable

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, prob):
    """Sum over all segmentations into pieces; characters that are no piece stand alone."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[start:i])
                start = i
        parts.append(word[start:])
        p = 1.0
        for part in parts:
            p *= prob.get(part, langid.UNKNOWN if len(part) == 1 and part not in prob else 0.0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    table, n = langid.vocabulary(PIECES)
    rng = np.random.default_rng(0)
    probability = np.append(rng.dirichlet(np.ones(n), 2), np.full((2, 1), langid.UNKNOWN), 1)
    scorer = langid.Scorer(langid.Model(["aa", "bb"], probability, PIECES))
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    names = sorted({p.piece for p in model.pieces if p.type == 1})
    words = ["the", "there", "then", "ß", "꧁x", "thethe", "naïve"]
    logs, counts = scorer.score(pa.array([w for w in words] + ["the there", None, "12 !"]))
    assert counts.tolist() == [1] * 3 + [1, 1, 1, 1, 2, 0, 0]
    for k in range(2):
        prob = dict(zip(names, probability[k]))
        for i, w in enumerate(words):
            letters = "".join(c for c in w if c.isalpha())
            assert math.isclose(logs[i, k], math.log(segmentations("▁" + letters, prob)), rel_tol=1e-9)
    assert np.allclose(logs[7], logs[0] + logs[1])


def test_expected_counts():
    prob = {"a": 0.3, "b": 0.2, "ab": 0.4, "▁": 0.1}
    table = PieceTable({"a": 0, "b": 1, "ab": 2, "▁": 3})
    piece, value = langid.expected_counts(["▁ab"], np.array([2.0]), np.array([0.3, 0.2, 0.4, 0.1]), table)
    joint = {"apart": 0.1 * 0.3 * 0.2, "whole": 0.1 * 0.4}
    share = joint["apart"] / sum(joint.values())
    want = {0: 2 * share, 1: 2 * share, 2: 2 * (1 - share), 3: 2.0}
    assert prob and {int(p): round(v, 9) for p, v in zip(piece, value)} == {k: round(v, 9) for k, v in want.items()}


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    got = op7_language_id(spark, root).join(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    out = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(r["held_out"] == langid.held_out_of(r["doc_id"]) for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_long_runs_are_summed_whole():
    table, n = langid.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    probability = np.append(rng.dirichlet(np.ones(n), 2), np.full((2, 1), langid.UNKNOWN), 1)
    scorer = langid.Scorer(langid.Model(["aa", "bb"], probability, PIECES))
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    names = sorted({p.piece for p in model.pieces if p.type == 1})
    words = ["there" * 60, "ꙮ" * 200]        # over any cut; no piece at all
    logs, _ = scorer.score(pa.array(words))
    for k in range(2):
        prob = dict(zip(names, probability[k]))
        for i, w in enumerate(words):
            marked = "▁" + w
            alpha = [0.0]
            for end in range(1, len(marked) + 1):
                terms = [alpha[end - m] + math.log(prob[marked[end - m:end]]) for m in range(1, min(end, table.longest) + 1) if marked[end - m:end] in prob]
                if marked[end - 1] not in prob:
                    terms.append(alpha[-1] + math.log(langid.UNKNOWN))
                top = max(terms)
                alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            assert math.isclose(logs[i, k], alpha[-1], rel_tol=1e-9)


def test_expected_counts_of_a_long_word():
    table = PieceTable({"a": 0, "aa": 1, "▁": 2})
    piece, value = langid.expected_counts(["▁" + "a" * 2001, "▁a", "▁" + "b" * 300], np.ones(3), np.array([1e-3, 1e-9, 0.5]), table)
    got = dict(zip(piece.tolist(), value.tolist()))
    assert math.isclose(got[0] + 2 * got[1], 2002, rel_tol=1e-9) and math.isclose(got[2], 3, rel_tol=1e-9)


def test_copied_texts_are_drawn_once(spark):
    docs = [("the cat and the dog", "en")] * 700 + [(f"der hund {i} und die katze", "de") for i in range(5)]
    docs += [("xyz " * 50, "fr")] * 40 + [("le chat et le chien", "fr")]
    df = spark.createDataFrame(docs, "text string, lang string")
    model = langid.fit(df, PIECES, sample_rows=20)
    once = langid.fit(df.distinct(), PIECES, sample_rows=20)
    assert model.languages == once.languages and np.allclose(model.probability, once.probability)
    assert all(np.ptp(p[:-1]) > 0 for p in model.probability)      # every language learned something


def test_edges(spark):
    docs = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "ignored", None), (4, None, "en"), (None, "x", "de")]
    df = spark.createDataFrame(docs * 3, "doc_id long, text string, lang string").withColumnRenamed("doc_id", "a.b")
    model = langid.fit(df, PIECES)
    assert model.languages == ["de", "en"]
    texts = [(1, "the dog", "en", 0.5), (2, "und die katze", None, 0.1), (3, "", "en", 0.2), (4, None, "de", 0.3), (5, "12 ½ !", "en", 0.4),
             (6, "q" * 500, "en", 0.5), (7, "漢字", None, 0.6)]
    frame = spark.createDataFrame(texts, "id long, text string, lang_pred string, score double").withColumnRenamed("id", "x.y")
    got = {r["x.y"]: r for r in langid.predict(frame, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[7]["lang_pred"] in ("de", "en") and got[6]["score"] > 0 and got[5]["score"] == 0
    none = langid.fit(df.limit(0), PIECES)
    assert {r["lang_pred"] for r in langid.predict(frame, none).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).collect() == []


def test_more_labels_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(f"{w} {i} {w}{w}", lang) for lang, w, n in (("aa", "haus", 5), ("bb", "river", 3), ("cc", "maison", 3)) for i in range(n)]
    rows = [(i, t.replace(str(i % 10), "abcdefghij"[i % 10]), lang) for i, (t, lang) in enumerate(rows)]
    df = spark.createDataFrame([(i, t + " " + "xyzuvwkpqr"[i % 10] * 3, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.fit(df, PIECES)
    assert model.languages == ["aa", "bb"]
    assert {r["lang_pred"] for r in langid.predict(df, model).collect()} <= {"aa", "bb"}
