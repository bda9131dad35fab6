"""Budgets and prefixes against plain Python and the registered SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import mixing
from phasegrid.llm.queries import mix_levels, op5_mix_sources
from phasegrid.llm.registry import SQL

LEVELS = ["domain", "lang"]
WEIGHTS = {"domain": {"x": 3, "y": 1, "off": 0}, "lang": {"en": 2}}


def share(children, total):
    """{name: (weight, capacity)} to {name: budget}: fill the children that overflow until none does."""
    out = dict.fromkeys(children, 0)
    open_ = {n for n, (w, _) in children.items() if w > 0}
    while open_:
        weight = sum(children[n][0] for n in open_)
        full = {n for n in open_ if children[n][1] * weight <= total * children[n][0]}
        if not full:
            for n in open_:
                out[n] = total * children[n][0] // weight
            for n in sorted(open_)[:total - sum(out[n] for n in open_)]:
                out[n] += 1
            break
        for n in full:
            out[n] = children[n][1]
            total -= children[n][1]
        open_ -= full
    return out


def plan(leaves, epochs, total):
    tree = defaultdict(dict)
    for (a, b), t in leaves.items():
        tree[a][b] = t * epochs
    top = share({a: (WEIGHTS["domain"].get(a, 1), sum(c.values())) for a, c in tree.items()}, total)
    out = {}
    for a, c in tree.items():
        for b, budget in share({b: (WEIGHTS["lang"].get(b, 1), t) for b, t in c.items()}, top[a]).items():
            out[a, b] = budget
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_and_prefixes(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(400):
        a, b = rng.choice("xxxxyz") if i % 40 else "off", rng.choice(["en", "en", "de", "fr"])
        docs.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 50]))) if i % 11 else None, a, b if i % 17 else None))
    df = spark.createDataFrame(docs, "doc_id long, text string, domain string, lang string").repartition(3)
    got = {r["key"]: r["copies"] for r in mixing.mix(df, {n: F.col(n) for n in LEVELS}, WEIGHTS, (1 + seed, 4), 3, 11).collect()}
    tokens = {d: len((t or "").split()) for d, t, _, _ in docs}
    leaf = {d: (a, b or "(none)") for d, _, a, b in docs}
    leaves = defaultdict(int)
    for d, n in tokens.items():
        leaves[leaf[d]] += n
    budget = plan(leaves, 3, sum(leaves.values()) * 3 * (1 + seed) // 4)
    want = {}
    for name, total in leaves.items():
        mine = [d for d in tokens if leaf[d] == name]
        whole, rest = divmod(budget[name], total) if total else (0, 0)
        run = 0
        for d in sorted(mine, key=lambda d: (hashlib.sha256(f"11:{whole}:{d}".encode()).hexdigest(), d)):
            run += tokens[d]
            want[d] = whole + (rest > 0 and run <= rest)
    assert got == {d: c for d, c in want.items() if c}


def test_query_matches_sql(spark):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    cur = con.execute(SQL["op5_mix_sources"])
    names = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in op5_mix_sources(spark, root).select(*names).collect())


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, copies int, key int"
    empty = spark.createDataFrame([], schema)
    assert mixing.mix(empty, mix_levels(), {}, (1, 2), 1, 3).collect() == []
    same = spark.createDataFrame([(1, "a b", "en", None, 5, 6)] * 4 + [(None, "a b", "en", None, 5, 6)] * 4, schema)
    got = mixing.mix(same, mix_levels(), {}, (1, 2), 1, 3).collect()
    assert sum(r["tokens"] * r["copies"] for r in got) == 8
    nothing = spark.createDataFrame([(1, None, None, None, 1, 1), (2, " \n", "en", "s", 1, 1)], schema)
    assert mixing.mix(nothing, mix_levels(), {}, (1, 1), 1, 3).collect() == []
