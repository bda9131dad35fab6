"""Frequent phrases and how strongly their parts belong together.

A suffix is a place in the text with the words after it, up to the longest phrase.
Suffixes meet by their leading words and are sorted by multikey three-way quicksort:
rows are parted by one word into less, equal and greater; the equal part goes on with
the next word, and its size is the count of the phrase so far.  Parts below the least
count are abandoned.  Words and pairs of words that are too rare everywhere are known
before suffixes move, so that suffixes end before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from phasegrid.llm.byte_words import byte_kinds, counted, words_of
from phasegrid.llm.common import bounded_slices, column, materialize, release, text_sizes
from phasegrid.scale import broadcast_if_small

KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
SLICE_BYTES = 4 << 20       # text whose equal words, pairs and suffixes are counted before they move
FILTER_BYTES = 16 << 20     # frequent words or pairs sent to every task; more of them are not, and suffixes end later
HOT_ROWS = 100_000          # suffixes of the same leading words that are sorted together; more are parted by the next word
BLOCK_ROWS = 150_000        # suffixes sorted at once
HOT_LISTED = 100_000        # leading words parted further that are broadcast; more join by shuffle


def _leading(phrase: str | Column, k: int | Column) -> Column:
    """The first ``k`` words, or the last -``k``."""
    return F.call_function("substring_index", F.col(phrase) if isinstance(phrase, str) else phrase, F.lit(" "), F.lit(k) if isinstance(k, int) else k)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(column(text_col).cast("string").alias("text"), F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"))


class Slice:
    """Words of a stretch of texts: distinct words, and by place the word's number, language and piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        words, row, self.piece = words_of(texts, KINDS)
        coded = words.dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def frequent(self, keys: pa.Array) -> np.ndarray:
        """By place, the position of word and language among ``keys``, or -1."""
        own, back = np.unique(self.lang * max(len(self.words), 1) + self.code, return_inverse=True)
        lang, word = np.divmod(own, max(len(self.words), 1))
        found = pc.index_in(_key(self.words.take(pa.array(word)), self.langs.take(pa.array(lang))), keys)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[back]


def _key(words: pa.Array, langs: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words, langs, " ")      # no word has a space


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for a, b in bounded_slices(text_sizes(texts), SLICE_BYTES):
            yield Slice(texts.slice(a, b - a), langs.slice(a, b - a))
        release()


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (one word), f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            key, n = counted(s.lang * max(len(s.words), 1) + s.code)
            lang, word = np.divmod(key, max(len(s.words), 1))
            yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(lang)), s.words.take(pa.array(word)), pa.array(n)], ["lang", "phrase", "f"])

    counts = texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counts, "word-counts")


def _word_filter(words: DataFrame) -> pa.Array | None:
    """Frequent words with their language in order, if they are few enough for every task."""
    size = words.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 9), F.lit(0)).alias("n")).first()["n"]
    if size > FILTER_BYTES:
        return None
    t = words.select("lang", "phrase").toArrow()
    return _key(t["phrase"].combine_chunks(), t["lang"].combine_chunks()).cast(pa.string())


def _pair_filter(texts: DataFrame, keys: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Frequent pairs of frequent words as numbers in order, and their counts, if few enough for every task."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            pair, n = counted(_pairs(s.frequent(shared.value), s.piece)[1])
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    pairs = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = materialize(pairs, "frequent-pairs")
    if 16 * pairs.count() > FILTER_BYTES:
        return None
    found = pairs.toArrow().sort_by("pair")
    return found["pair"].to_numpy(), found["n"].to_numpy()


def _pair_rows(spark: SparkSession, keys: pa.Array, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """lang, phrase, words, f of the pairs, which are as few as go to every task."""
    number, n = pairs
    first, second = (keys.take(pa.array(x)) for x in np.divmod(number, 1 << 32))
    lang = pc.struct_field(pc.extract_regex(second, "(?s) (?P<lang>.*)$"), "lang")
    words = [pc.struct_field(pc.extract_regex(k, "(?s)^(?P<word>[^ ]*) "), "word") for k in (first, second)]
    rows = pa.table([lang, pc.binary_join_element_wise(*words, " "), pa.array(np.full(len(n), 2), pa.int32()), pa.array(n, pa.int64())],
                    ["lang", "phrase", "words", "f"])
    return spark.createDataFrame(rows, "lang string, phrase string, words int, f long")


def _pairs(number: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose word and next word are frequent and in one piece, and the pairs' numbers."""
    at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (piece[:-1] == piece[1:]))
    return at, number[at] << 32 | number[at + 1]


def suffixes(texts: DataFrame, keys: pa.Array | None, pairs: np.ndarray | None, longest: int) -> DataFrame:
    """lang, phrase (2 to ``longest`` words from a place on), n: suffixes, equal ones of a slice as one row.

    Where frequent pairs are known, suffixes end before a pair that is not, and those of two words are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast((keys, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pairs = shared.value
        for s in _slices(batches):
            goes_on = np.zeros(len(s.code) + longest, bool)     # the pair that starts here may be part of a phrase
            if keys is None:
                at = np.flatnonzero(s.piece[:-1] == s.piece[1:])
            else:
                at, pair = _pairs(s.frequent(keys), s.piece)
                if pairs is not None:
                    near = np.searchsorted(pairs, pair)
                    at = at[pairs[np.minimum(near, len(pairs) - 1)] == pair] if len(pairs) else at[:0]
            goes_on[at] = True
            if pairs is not None:
                at = at[goes_on[at + 1]]
            columns, on = [pa.array(s.lang[at]), pa.array(s.code[at])], np.ones(len(at), bool)
            for k in range(1, longest):
                on = on & goes_on[at + k - 1]
                columns.append(pa.array(s.code[np.minimum(at + k, len(s.code) - 1)], mask=~on))
            names = ["lang", *(f"w{k}" for k in range(longest))]
            same = pa.table(columns, names).group_by(names).aggregate([([], "count_all")])
            spelled = [s.words.take(same[n].combine_chunks()) for n in names[1:]]
            for a in range(0, same.num_rows, BLOCK_ROWS):
                part = [w.slice(a, BLOCK_ROWS) for w in spelled]
                yield pa.RecordBatch.from_arrays([s.langs.take(same["lang"].combine_chunks().slice(a, BLOCK_ROWS)),
                                                  pc.binary_join_element_wise(*part, " ", null_handling="skip"),
                                                  same["count_all"].combine_chunks().slice(a, BLOCK_ROWS)], ["lang", "phrase", "n"])

    return materialize(texts.mapInArrow(run, "lang string, phrase string, n long"), "suffixes")


def routed(rows: DataFrame, longest: int) -> DataFrame:
    """Adds ``head``, the leading words by which suffixes meet, and ``k``, how many they are.

    Two words, or as many more as it takes to have at most HOT_ROWS suffixes together.
    """
    rows = rows.withColumn("k", F.lit(2))
    for k in range(2, longest):
        head = _leading("phrase", k)
        hot = (rows.where(F.col("k") == k).groupBy("lang", head.alias("head")).count().where(F.col("count") > HOT_ROWS)
               .select(F.col("lang").alias("hot_lang"), F.col("head").alias("hot_head")))
        hot = materialize(hot, "hot-heads")
        if hot.isEmpty():
            break
        hot = broadcast_if_small(hot, HOT_LISTED)
        on = (rows["k"] == k) & (rows["lang"] == hot["hot_lang"]) & (_leading(rows["phrase"], k) == hot["hot_head"])
        rows = rows.join(hot, on, "left").withColumn("k", F.when(F.col("hot_head").isNotNull(), k + 1).otherwise(F.col("k"))).drop("hot_lang", "hot_head")
    return rows.withColumn("head", _leading("phrase", F.col("k")))


def equal_partitions(keys: np.ndarray, weight: np.ndarray, start: np.ndarray, whole: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of rows of word numbers (-1: no word), all partitions of a round at once.

    ``start``: first rows of the groups whose first two words are equal.  A partition of
    less than ``least`` is abandoned from depth ``whole`` of its group on, as it then has
    all suffixes of its phrase.  Gives depth, a row and the summed weight of equal parts.
    """
    n, longest = keys.shape
    order = np.arange(n)
    low, high = start, np.append(start[1:], n)
    depth = np.full(len(low), 2)

    def heavy(low, high, least_of):
        total = np.concatenate([[0], np.cumsum(weight[order])])
        size = total[high] - total[low]
        return size, size >= least_of

    size, _ = heavy(low, high, 0)
    stay = (size >= least) | (whole > 2)
    low, high, depth, whole, size = low[stay], high[stay], depth[stay], whole[stay], size[stay]
    yield 2, order[low], size
    while True:
        go = depth < longest
        low, high, depth, whole = low[go], high[go], depth[go], whole[go]
        if not len(low):
            return
        width = high - low
        segment = np.repeat(np.arange(len(low)), width)
        place = np.arange(len(segment)) + np.repeat(low - (np.cumsum(width) - width), width)
        word = keys[order[place], depth[segment]]
        offset = np.cumsum(width) - width
        three = np.sort([word[offset], word[offset + width // 2], word[offset + width - 1]], 0)
        pivot = three[1]
        side = (word > pivot[segment]).astype(np.int64) * 2 + (word == pivot[segment])     # 0 less, 1 equal, 2 greater
        slot = segment * 3 + side
        order[place] = order[place][np.argsort(slot, kind="stable")]
        cut = np.bincount(slot, minlength=3 * len(low)).reshape(-1, 3)
        edges = low[:, None] + np.concatenate([np.zeros((len(low), 1), np.int64), np.cumsum(cut, 1)], 1)
        new_low, new_high = edges[:, :3].ravel(), edges[:, 1:].ravel()
        equal = np.tile([False, True, False], len(low))
        new_depth = np.repeat(depth, 3) + equal
        new_whole = np.repeat(whole, 3)
        ends = equal & (np.repeat(pivot, 3) < 0)        # equal in having no further word
        size, _ = heavy(new_low, new_high, 0)
        # what is at this depth still shares depth words; its parts are one word deeper
        kept = (new_high > new_low) & ~ends & ((size >= least) | (np.repeat(depth, 3) + 1 < new_whole))
        low, high, depth, whole, size, equal = (x[kept] for x in (new_low, new_high, new_depth, new_whole, size, equal))
        for d in np.unique(depth[equal]).tolist():
            here = equal & (depth == d)
            yield d, order[low[here]], size[here]


def phrase_counts(rows: DataFrame, least: int, longest: int, pairs: DataFrame | None) -> DataFrame:
    """lang, phrase, words, f of all phrases of 2 to ``longest`` words with a count of ``least`` or more.

    ``pairs``: those of two words, if they are known; the suffixes are then of three or more.
    """
    fewest = 2 if pairs is None else 3

    def flush(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(parts)
        head = _key(t["head"].combine_chunks(), t["lang"].combine_chunks()).dictionary_encode().indices.to_numpy()
        split = pc.split_pattern(t["phrase"].combine_chunks(), " ")
        coded = split.flatten().dictionary_encode()
        size = split.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        keys = np.full((len(size), longest), -1)
        keys[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = coded.indices.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        for d, at, n in equal_partitions(keys, t["n"].to_numpy(), start, t["k"].to_numpy()[start], least):
            if len(at) and d >= fewest:
                spelled = [coded.dictionary.take(pa.array(keys[at, j])) for j in range(d)]
                yield pa.RecordBatch.from_arrays([t["lang"].combine_chunks().take(pa.array(at)), pc.binary_join_element_wise(*spelled, " "),
                                                  pa.array(np.full(len(at), d), pa.int32()), pa.array(n)], ["lang", "phrase", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        held = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held >= BLOCK_ROWS and len(t):
                # cut where the leading words change, so that no group is parted
                last = parts[-1].slice(len(parts[-1]) - 1)
                same = pc.and_(pc.equal(t["head"], last["head"][0]), pc.equal(t["lang"], last["lang"][0])).to_numpy()
                here = len(same) if same.all() else int(np.argmin(same))
                parts.append(t.slice(0, here))
                held += here
                if here == len(t):
                    continue
                yield from flush([p for p in parts if len(p)])
                t, parts, held = t.slice(here), [], 0
            if len(t):
                parts.append(t)
                held += len(t)
        if held:
            yield from flush([p for p in parts if len(p)])
        release()

    met = routed(rows, longest).repartition("lang", "head").sortWithinPartitions("lang", "head")
    found = met.mapInArrow(run, "lang string, phrase string, words int, f long")
    found = found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialize(found if pairs is None else found.unionByName(pairs), "phrase-counts")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, share: int = 100,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: phrases by language, the most tightly bound first.

    Words are what is between spaces and tabs inside pieces of text that punctuation and
    line ends part; A-Z count as lower case.  A phrase of 2 to ``longest`` words with
    ``a`` >= ``least`` occurrences is a candidate; of its cuts into two parts, with ``l``
    and ``r`` occurrences, the one of least floor(1000 * a * n / (l * r)) counts, of
    equals the leftmost; ``n`` is the number of words of the language.  Candidates inside
    a longer one with 100 * f >= ``share`` * ``a`` go.  The first ``top`` of a language
    by score, ``a`` and phrase stay (all, if None).

    Null texts have no words, a null language counts as ``und``, repeated rows count as
    often as they are there, other columns and document ids play no part, and a table
    without frequent phrases gives no rows.
    """
    texts = _texts(docs, text_col, lang_col)
    words = word_counts(texts)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    keys = _word_filter(frequent)
    pairs = None if keys is None else _pair_filter(texts, keys, least)
    known = None if pairs is None else _pair_rows(docs.sparkSession, keys, pairs)
    phrases = phrase_counts(suffixes(texts, keys, None if pairs is None else pairs[0], longest), least, longest, known)
    parts = frequent.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))

    size = F.col("words")
    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
            .withColumn("left", _leading("phrase", F.col("k")))
            .withColumn("right", _leading("phrase", F.col("k") - size)))
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
            .join(totals, "lang"))
    # 64 bits do not hold the products; decimals of 38 digits do
    wide = "cast(1000 as decimal(4,0)) * (cast(f as decimal(18,0)) * cast(n as decimal(18,0)))"
    cuts = cuts.withColumn("score", F.expr(f"({wide}) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("lang", "phrase", "words", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    word = F.split("phrase", " ")
    inside = (phrases.where(size > 2).withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
              .withColumn("i", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
              .groupBy("lang", F.concat_ws(" ", F.slice(word, F.col("i"), F.col("m"))).alias("phrase")).agg(F.max("f").alias("longer")))
    rest = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    rest = rest.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rest = rest.withColumn("rank", F.row_number().over(first))
    if top is not None:
        rest = rest.where(F.col("rank") <= top)
    return rest.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
