"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, computed by
a forward pass; prefixes shared by distinct words are computed once.  Piece
probabilities come from expectation maximisation over a bounded sample of labelled
rows; everything else covers all rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from phasegrid.llm.common import F, bounded_slices, column, materialize, release, text_sizes
from phasegrid.llm.trie import PieceTable, Trie, codes_of
from phasegrid.llm.word_encoder import WordTable

SAMPLE_ROWS = 600       # distinct labelled texts taken for each language, about; they count whole
MAX_LANGUAGES = 256     # labels that are learned, as each takes memory in every task
ROUNDS = 2
PRIOR = 0.01
UNKNOWN = 1e-8          # probability of a character that is no piece
CACHE_WORDS = 150_000
CHUNK_BYTES = 2 << 20
FIT_CHARS = 1 << 19     # characters whose segmentations are held at once in the fit


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of letters in lower case of all texts, flat, and their numbers by text."""
    runs = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+")
    flat = runs.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    cuts = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())])
    return flat.filter(real), np.diff(ends[cuts])


@functools.lru_cache(1)
def vocabulary(path: str) -> tuple[PieceTable, int]:
    """Pieces of a public vocabulary, numbered densely."""
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = sorted({p.piece for p in model.pieces if p.type == 1})
    return PieceTable({s: i for i, s in enumerate(pieces)}), len(pieces)


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities by language and piece."""

    languages: list[str]
    probability: np.ndarray
    pieces: str


def expected_counts(words: list[str], weight: np.ndarray, prob: np.ndarray | None, table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of each piece over all segmentations of marked words of one language.

    Without ``prob`` every occurrence of a piece counts once.  Sums are kept as logarithms,
    so words of any length are summed whole.
    """
    codes, size = codes_of(words)
    at = np.cumsum(size) - size
    n, longest = len(words), int(size.max(initial=0))
    node = at + np.arange(n)        # words lie one after the other, each with a place before its first character
    hashes = np.zeros((table.longest, n), np.uint64)
    edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    base = np.uint64(0x9E3779B97F4A7C15)
    rows = np.arange(n)
    for end in range(1, longest + 1):
        rows = rows[size[rows] >= end]
        c = codes[at[rows] + end - 1].astype(np.uint64) + np.uint64(1)
        hashes[1:, rows] = hashes[:-1, rows] * base + c
        hashes[0, rows] = c
        for length in range(1, min(end, table.longest) + 1):
            hit, piece = table.find(hashes[length - 1, rows], length)
            if len(hit):
                edges.append((end, length, rows[hit], piece))
            if length == 1:
                miss = np.setdiff1d(rows, rows[hit], assume_unique=True)
                if len(miss):
                    edges.append((end, 1, miss, np.full(len(miss), -1)))
    pieces, values = [], []
    if prob is None:
        for _, _, rows, piece in edges:
            known = piece >= 0
            pieces.append(piece[known])
            values.append(weight[rows[known]])
    else:
        logp = np.log(np.append(prob, UNKNOWN))
        alpha, beta = np.full(len(codes) + n, -np.inf), np.full(len(codes) + n, -np.inf)
        alpha[node] = 0.0
        for end, length, rows, piece in edges:
            to = node[rows] + end
            alpha[to] = np.logaddexp(alpha[to], alpha[to - length] + logp[piece])
        beta[node + size] = 0.0
        for end, length, rows, piece in reversed(edges):
            to = node[rows] + end
            beta[to - length] = np.logaddexp(beta[to - length], beta[to] + logp[piece])
        total = alpha[node + size]
        for end, length, rows, piece in edges:
            known = piece >= 0
            r, q = rows[known], piece[known]
            to = node[r] + end
            pieces.append(q)
            values.append(np.exp(alpha[to - length] + logp[q] + beta[to] - total[r]) * weight[r])
    out = np.bincount(np.concatenate(pieces), np.concatenate(values)) if pieces else np.zeros(0)
    used = np.flatnonzero(out)
    return used, out[used]


def fit(rows: DataFrame, pieces: str, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
        rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from about ``sample_rows`` of its distinct texts.

    Texts are drawn by their hash, so the draw is the same on every run; copies of a text
    count once, in the draw and in the fit.  The number drawn is binomial: all texts of a
    language that has no more than ``sample_rows``, else ``sample_rows`` with a standard
    deviation below its square root.  Rows without language or letters teach nothing.
    Beyond MAX_LANGUAGES labels, those of most distinct texts are learned (of equals the
    first in order); the others are never predicted.  What reaches the driver is bounded by
    languages times vocabulary.
    """
    base = (rows.select(column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
            .where("text is not null and lang is not null"))
    draw = F.xxhash64("text")
    distinct = base.select("lang", draw.alias("draw")).distinct()
    counts = distinct.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    languages = sorted(sizes)
    table, n_pieces = vocabulary(pieces)
    if not languages:
        return Model([], np.zeros((0, n_pieces + 1)), pieces)
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(million, -(-sample_rows * million // sizes[k])))])
    sample = (base.where(F.pmod(draw, F.lit(million)) < share[F.col("lang")])
              .select("lang", "text").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = words_of(batch.column("text"))
            langs = batch.column("lang").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            seen = pa.table([langs, words], ["lang", "word"]).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from seen.rename_columns(["lang", "word", "n"]).to_batches()

    counted = materialize(sample.mapInArrow(count, "lang string, word string, n long")
                          .groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    spark = rows.sparkSession
    prob: np.ndarray | None = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lookup = vocabulary(pieces)[0]
            now = shared.value
            for batch in batches:
                for lang, part in batch.groupby("lang"):
                    k = languages.index(lang)
                    words, weight = ["▁" + w for w in part["word"]], part["n"].to_numpy(float)
                    for a, b in bounded_slices(np.fromiter(map(len, words), np.int64, len(words)), FIT_CHARS):
                        piece, value = expected_counts(words[a:b], weight[a:b], None if now is None else now[k], lookup)
                        yield pd.DataFrame({"k": k, "piece": piece, "value": value})

        totals = (counted.mapInPandas(expect, "k int, piece int, value double")
                  .groupBy("k", "piece").agg(F.sum("value").alias("value")).toPandas())
        counts = np.full((len(languages), n_pieces), PRIOR)
        np.add.at(counts, (totals["k"].to_numpy(), totals["piece"].to_numpy()), totals["value"].to_numpy())
        prob = counts / counts.sum(1, keepdims=True)
        shared.unpersist()
    return Model(languages, np.concatenate([prob, np.full((len(languages), 1), UNKNOWN)], 1), pieces)


class Scorer:
    """Log probability of words under every language, cached by word up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.table = model, vocabulary(model.pieces)[0]
        self.by_piece = np.ascontiguousarray(np.log(model.probability.T))
        self.words, self.logs = WordTable(), np.zeros((0, len(self.model.languages)))

    def _forward(self, words: list[str]) -> np.ndarray:
        trie = Trie(words, self.table)
        alpha = np.zeros((len(trie.parent), len(self.model.languages)))     # logarithms
        for level in trie.levels():
            here = np.full((len(level), alpha.shape[1]), -np.inf)
            known = np.zeros(len(level), bool)
            for length in range(1, min(level.depth, self.table.longest) + 1):
                at, piece = level.matches(length)
                if not len(at):
                    continue
                before = trie.up(at + level.first, length)
                here[at] = np.logaddexp(here[at], alpha[before] + self.by_piece[piece])
                if length == 1:
                    known[at] = True
            lost = np.flatnonzero(~known)
            here[lost] = np.logaddexp(here[lost], alpha[level.parent[lost]] + np.log(UNKNOWN))
            alpha[level.first:level.first + len(level)] = here
        return alpha[trie.ends]

    def score(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities by text and language, and the number of words."""
        stay = self.words.shrink(CACHE_WORDS)
        if stay is not None:
            self.logs = self.logs[stay]
        words, counts = words_of(texts)
        numbers, fresh = self.words.numbers(words)
        fresh = fresh.to_pylist()
        if fresh:
            order = sorted(range(len(fresh)), key=fresh.__getitem__)
            logs = np.zeros((len(fresh), len(self.model.languages)))
            logs[order] = self._forward(["▁" + fresh[i] for i in order])
            self.logs = np.concatenate([self.logs, logs])
        total = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            total[some] = np.add.reduceat(self.logs[numbers], (np.cumsum(counts) - counts)[some], axis=0)
        return total, counts


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score``; columns of those names are replaced.

    ``score`` is the language's share of the summed probabilities.  A text that is null
    or has no letter, or a model without languages, gives ``und`` and 0.  Ties go to
    the first language in order.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[column(c) for c in kept])
    plain = docs.toDF(*[f"c{i}" for i in range(len(kept))])     # any name is safe inside
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text = f"c{[c.lower() for c in kept].index(text_col.lower())}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Scorer(shared.value)     # its words go with the partition, as the worker lives on for other stages
        names = here.model.languages
        for batch in batches:
            texts = batch.column(text)
            texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
            pred, score = [], []
            for a, b in bounded_slices(text_sizes(texts), CHUNK_BYTES):
                logs, counts = here.score(texts.slice(a, b - a))
                if not names:
                    pred += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                best = logs.argmax(1)
                share = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                pred += [names[k] if n else "und" for k, n in zip(best.tolist(), counts.tolist(), strict=True)]
                score += np.where(counts > 0, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*batch.schema.names, "lang_pred", "score"])
            release()

    return plain.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """Rows kept away from learning: crc32 of the id as text leaves 0 by 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def held_out_of(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
