"""The pipeline against its stages' brute-force versions on a small fixture."""

import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from phasegrid.llm import group_join, langid, mixing, recompression
from phasegrid.llm.queries import MIX_SEED, WEIGHTS, mix_levels


def fixture(spark, root):
    """Clean documents of four languages with planted copies, a shared passage and junk."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()
    rng = random.Random(1)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs]
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(70))
    long = next(r for r in rows if len(r[1].split()) > 200)
    edited = long[1].split()
    edited[100] = "EDITED"
    rows += [(1000, long[1], None, "src1", 1), (1001, " ".join(edited), "en", None, 1), (1002, None, "en", "src1", 0), (1003, "12 34 !!", "en", "src2", 8)]
    for i, k in enumerate((3, 4, 5)):
        rows.append((2000 + i, rows[k][1] + " " + passage + " " + rows[k + 10][1], rows[k][2], "src0", 1))
    rows.append((2003, passage, "en", "src0", len(passage)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return rows


def test_run_matches_brute_force(spark, tmp_path):
    root = str(tmp_path / "data")
    rows = {r[0]: r for r in fixture(spark, root)}
    # 1: language scores come from the model; they are tested on their own.
    df = spark.read.parquet(f"{root}/documents.parquet")
    model = langid.fit(df.where(~langid.held_out()), pipeline.PIECES)
    scored = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    kept = {d: list(rows[d]) for d, r in scored.items() if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_SCORE}
    assert 1002 not in kept and 1003 not in kept and len(kept) >= len(rows) - 3
    for d in kept:
        kept[d][2] = kept[d][2] or scored[d]["lang_pred"]
    # 2
    classes = group_join.brute_force([(d, r[1]) for d, r in kept.items()], 5, 80)
    kept = {d: r for d, r in kept.items() if classes[d][1] == d}
    assert 1000 not in kept and 1001 not in kept
    # 3
    cut = recompression.brute_force([(d, r[1]) for d, r in kept.items()], 50)
    final = recompression_texts(kept)
    for d in list(kept):
        assert hashlib.sha256(" ".join(final[d].split()).encode()).hexdigest() == cut[d][2]
        if cut[d][1] == cut[d][0]:
            del kept[d]
        elif cut[d][1]:
            kept[d][1] = final[d]
    assert 2003 not in kept
    # 4: budgets and prefixes are tested on their own; here the stage must pick what the operator picks.
    mixed = spark.createDataFrame([tuple(r) for r in kept.values()], df.schema)
    chosen = {r["key"] for r in mixing.mix(mixed, mix_levels(), WEIGHTS, pipeline.MIX_SHARE, 1, MIX_SEED).collect()}
    # 5
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: library.encode(kept[d][1]) for d in chosen}
    got = pipeline.run(spark, root)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    assert len(want) > 20


def recompression_texts(kept):
    """Texts after the third stage, by a table of all windows."""
    words = {d: r[1].split() for d, r in kept.items()}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i:i + 50]), d)
    out = {}
    for d, w in words.items():
        off = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                off.update(range(i, i + 50))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in off) if off else kept[d][1]
    return out


def test_empty_table(spark, tmp_path):
    root = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    assert pipeline.run(spark, root).collect() == []


def test_stage_columns(spark):
    assert [f.__name__ for _, f in pipeline.STAGES] == ["language_id", "near_copies", "repeated_passages", "mixture", "piece_ids"]


def test_nulls_repeats_and_clashing_columns(spark):
    """Every stage takes rows without ids or texts, rows that repeat, and columns named like its own."""
    import random
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["the", "of", "and", "house", "river", "green", "walk", "under"]) + rng.choice("abcdefg") for _ in range(120))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en", "src0", 9, 0), (2, a, None, None, None, 1), (None, b, "en", "src1", 5, 2), (None, c, "en", "src1", 5, 3), (3, c, "en", "src2", 5, 4),
            (4, None, "en", "src0", 0, 5), (5, "", "en", "src0", 0, 6), (6, b + " " + c, "en", "src0", 7, 7), (6, b + " " + c, "en", "src0", 7, 8)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, names + ", twin int").selectExpr("*", *[f"twin as {n}" for n in (
        "doc", "component_id", "score", "kept_text", "stays", "key", "tie", "node", "name", "ctx", "place")])
    for name, stage in pipeline.STAGES:
        if name == "language_id":
            continue        # its model needs more than nine texts; its columns are tested with the operator
        got = stage(spark, docs, "")
        kept = sorted(((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.select("doc_id").collect()))
        if name == "near_copies":       # 2 is a copy of 1, 3 of a row without id, which comes first; 6 repeats itself only
            assert kept == [(False, 0), (False, 0), (True, 1), (True, 4), (True, 5), (True, 6), (True, 6)]
        elif name == "repeated_passages":       # what 2, 3 and 6 hold is in rows before them; without words they go
            texts = {(r["doc_id"], r["text"]) for r in got.collect()}
            assert {d for d, t in texts} >= {None, 1} and {d for d, t in texts} & {2, 3} == set()
        else:
            assert got.count() <= len(rows)
        if name != "piece_ids":
            assert got.columns == names.replace(" long", "").replace(" string", "").split(", ")


def test_run_reads_its_own_columns_only(spark, tmp_path):
    root = str(tmp_path / "wide")
    spark.createDataFrame([], "score double, doc_id long, text string, lang string, source string, n_chars long, twin int, key long").write.parquet(f"{root}/documents.parquet")
    assert pipeline.run(spark, root).collect() == []
