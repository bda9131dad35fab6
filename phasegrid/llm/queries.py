"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from phasegrid.llm import (bitpack, collocations, cover_tree, group_join, hidden_markov, iblt, langid, mixing, recompression,
                           sentencepiece_op, suffix_dedup, token_scan, whitening)
from phasegrid.llm.common import F, scratch_path, table
from phasegrid.llm.registry import query

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op4_token_bitpack")
def op4_token_bitpack(spark: SparkSession, root: str) -> DataFrame:
    out = scratch_path(spark, "packed")
    manifest = bitpack.write_packed(table(spark, root, "documents"), out, WORD_BPE, end_id=2)
    return bitpack.read_packed(spark, out, manifest)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts from the files alone; document ids are attached by place afterwards."""
    out = scratch_path(spark, "flat")
    separator = 49407   # <|endoftext|> of this vocabulary
    places = token_scan.write_flat(table(spark, root, "documents"), out, WORD_BPE, separator)
    counts = token_scan.scan_counts(spark, out, separator)
    return counts.join(places, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return sentencepiece_op.encode(table(spark, root, "documents"), PIECES)


@query("op7_language_id")
def op7_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()), PIECES)
    rows = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_iblt_fingerprint")
def op8_iblt_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    return iblt.fingerprints(table(spark, root, "documents"))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op1_cover_tree_topk", OP1_SQL)
def op1_cover_tree_topk(spark: SparkSession, root: str) -> DataFrame:
    return cover_tree.top_k(table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


#: The mixture of the query: domains by source, weights in whole numbers, 6 tenths of one epoch, two epochs at most.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4"], "books": ["src5", "src6", "src7", "src8", "src9"]}
WEIGHTS = {"domain": {"web": 5, "books": 3, "other": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 3}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 10), 2, 7


def mix_levels() -> dict[str, Column]:
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def _mix_sql() -> str:
    """The same mixture in plain SQL: one running sum over each leaf."""
    levels = ["domain", "lang", "source"]
    case = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in DOMAINS.items())
    parts = [f"""docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
        CASE {case} ELSE 'other' END AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source FROM documents)""",
             f"""leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {MIX_EPOCHS} AS BIGINT) AS capacity
        FROM docs GROUP BY ALL)""",
             f"n0 AS (SELECT CAST(sum(capacity) * {MIX_SHARE[0]} // {MIX_SHARE[1]} AS BIGINT) AS budget FROM leaf)"]
    for k, level in enumerate(levels):
        path, named = levels[:k], WEIGHTS.get(level, {})
        weight = "CASE " + " ".join(f"WHEN c.{level} = '{a}' THEN {b}" for a, b in named.items()) + " ELSE 1 END"
        on = " AND ".join(f"c.{p} = n.{p}" for p in path) or "true"
        by = "PARTITION BY " + ", ".join(path) if path else ""
        cols = ", ".join(levels[:k + 1])
        parts.append(f"""w{k} AS (SELECT c.*, n.budget AS total, {weight} AS weight FROM
            (SELECT {cols}, CAST(sum(capacity) AS BIGINT) AS capacity FROM leaf GROUP BY ALL) c JOIN n{k} n ON {on})""")
        parts.append(f"""f{k} AS (SELECT *, CAST(capacity AS HUGEINT) * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER o, 0))
            <= greatest(total - coalesce(sum(capacity) OVER o, 0), 0) * weight AS is_full FROM w{k}
            WINDOW o AS ({by} ORDER BY CAST(capacity AS DOUBLE) / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
        parts.append(f"""r{k} AS (SELECT *, total - coalesce(sum(capacity) FILTER (is_full) OVER ({by}), 0) AS rest,
            sum(weight) FILTER (NOT is_full) OVER ({by}) AS rest_weight FROM f{k})""")
        parts.append(f"""b{k} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE CAST(rest * weight // rest_weight AS BIGINT) END AS base FROM r{k})""")
        also = f"{by}, is_full" if by else "PARTITION BY is_full"
        parts.append(f"""n{k + 1} AS (SELECT {cols}, CAST(base + CASE WHEN NOT is_full AND row_number() OVER ({also} ORDER BY {level})
            <= rest - sum(base) FILTER (NOT is_full) OVER ({by}) THEN 1 ELSE 0 END AS BIGINT) AS budget FROM b{k})""")
    parts.append("""plan AS (SELECT leaf.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
        CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN n3 USING (domain, lang, source))""")
    parts.append(f"""runs AS (SELECT d.*, whole, rest, sum(d.tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY sha256('{MIX_SEED}:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS cum
        FROM docs d JOIN plan USING (domain, lang, source))""")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, domain, lang, source, tokens, CAST(whole + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM runs WHERE whole + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END > 0"""


@query("op5_mix_sources", _mix_sql())
def op5_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(table(spark, root, "documents"), mix_levels(), WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select(F.col("key").alias("doc_id"), "domain", "lang", "source", "tokens", F.col("copies").cast("long").alias("copies"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.digest_columns(suffix_dedup.remove_repeats(table(spark, root, "documents"), length=200))


@query("op3_recompression_dedup")
def op3_recompression_dedup(spark: SparkSession, root: str) -> DataFrame:
    return recompression.digest_columns(recompression.remove_repeats(table(spark, root, "documents"), length=50))


@query("op6_group_jaccard_join")
def op6_group_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return group_join.link_groups(table(spark, root, "documents"), words=5, percent=80)


@query("op11_exact_whitening")
def op11_exact_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"), components=4, scale=256)


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS size FROM
      (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
cuts AS (SELECT c.*, k, a.f AS l, b.f AS r, n.n, (1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(a.f AS HUGEINT) * b.f) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN n USING (lang)
      JOIN f a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1:k], ' ')
      JOIN f b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM
      (SELECT *, unnest(range(1, size)) AS i FROM c), (SELECT unnest(range(2, 5)) AS m) WHERE m < size AND i + m - 1 <= size GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * f)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n,
      CAST(score AS BIGINT) AS score FROM kept) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13_phrase_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.collocations(table(spark, root, "documents"), least=100, longest=5, top=2000)


@query("op12_hidden_markov_score")
def op12_hidden_markov_score(spark: SparkSession, root: str) -> DataFrame:
    return hidden_markov.scores(table(spark, root, "documents"), hidden_markov.held_out_of())
