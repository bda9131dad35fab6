"""Phrases against counting all of them."""

import random
import re
from collections import Counter

import pytest

from phasegrid.llm import collocations as co


def brute_force(docs, least, longest=5, top=2000):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    kept = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    out = {}
    for (lang, words), a in kept.items():
        if any(m == lang and len(v) > len(words) and c >= a and any(v[i:i + len(words)] == words for i in range(len(v)))
               for (m, v), c in kept.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                             for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]


def prose(seed, docs=120):
    rng = random.Random(seed)
    words = ["Of", "the", "a", "é", "zu", "x|y", "ß", "\0", "in"] + [f"w{i}" for i in range(60)]
    passage = "New York Stock Exchange the"
    out = []
    for _ in range(docs):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += passage if rng.random() < .05 else rng.choice(words[:9]) if rng.random() < .6 else rng.choice(words)
            text += rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"])
        out.append((text, rng.choice(["en", "de", None])))
    return out + [(None, "en"), ("", None), (passage, "fr"), ("the the the the the the the the", "en")] + [("one and the same text of six", "de")] * 70


@pytest.mark.parametrize("mode", ["filters", "no pair filter", "no filter", "hot heads"])
def test_matches_brute_force(spark, monkeypatch, mode):
    docs = prose(5)
    if mode == "no filter":
        monkeypatch.setattr(co, "FILTER_BYTES", 0)
    if mode == "no pair filter":
        monkeypatch.setattr(co, "_pair_filter", lambda *a: None)
    if mode == "hot heads":
        monkeypatch.setattr(co, "HOT_ROWS", 3)
        monkeypatch.setattr(co, "BLOCK_ROWS", 5)
        monkeypatch.setattr(co, "SLICE_BYTES", 50)
    df = spark.createDataFrame([(i, *d, "x") for i, d in enumerate(docs)], "doc_id long, text string, lang string, phrase string").repartition(3)
    for least in (4, 25):
        got = [tuple(r) for r in co.collocations(df, least=least).collect()]
        assert sorted(got) == sorted(brute_force(docs, least))
    assert any(len(r[2].split()) == 5 for r in got)


def test_top_and_nothing(spark):
    docs = prose(6)
    df = spark.createDataFrame(docs, "text string, lang string")
    got = [tuple(r) for r in co.collocations(df, least=5, top=3).collect()]
    assert sorted(got) == sorted(brute_force(docs, 5, top=3))
    assert co.collocations(df.where("lang = 'none'")).collect() == []


def test_one_long_text(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefg") for _ in range(30000))
    got = [tuple(r) for r in co.collocations(spark.createDataFrame([(text, None)], "text string, lang string"), least=30).collect()]
    assert sorted(got) == sorted(brute_force([(text, None)], 30))
