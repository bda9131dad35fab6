"""Scores of texts by a hidden Markov language model that is trained by Baum-Welch on all training texts.

The model's symbols are words with a share of the training tokens that is the same at
every size of corpus, each for itself, and classes of rarer words by their last letters; inside a class a word has its share of
the class's training counts, and what was never met counts as one more word.

Texts are turned into symbol numbers once, in slices that have numberings of their
own.  Each round brings a slice together with its symbols' probabilities by a join on
the symbol, sums expected counts inside the slice, and adds them up by symbol.  The
tables of words and symbols grow with the text; neither is sent to all tasks nor to
the driver, which sees counts of states only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from phasegrid.llm import hmm
from phasegrid.llm.byte_words import byte_kinds, words_of
from phasegrid.llm.common import binary_buffer, bounded_slices, column, materialize, release, text_sizes
from phasegrid.scale import broadcast_if_small

KINDS = byte_kinds(b" \t\n\x0b\x0c\r")
STATES = 8
ROUNDS = 3
OWN_PART = 200_000      # a word is a symbol of its own if it is one in so many training tokens or more
ENDING = 2              # last code points that rarer words share a symbol by
STAY = 0.9              # first guess of the probability to stay in a state
SHARE = 0.02            # part of each state's probabilities that follows the counts of all states
SLICE_BYTES = 32 << 20  # text with a numbering of its own
PART_BYTES = 4 << 20    # text whose words are found at once
SMALL_CLASSES = 200_000
_WIDE = 0xFFFF


def pack(codes: np.ndarray, size: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Numbers of each row in two bytes each, with those that need more in a second column."""
    wide = codes >= _WIDE
    ends = np.concatenate([[0], np.cumsum(size)])
    wide_ends = np.concatenate([[0], np.cumsum(wide)])[ends]
    def rows(data, cuts, width):
        return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(data)])
    return rows(np.minimum(codes, _WIDE).astype("<u2"), ends, 2), rows(codes[wide].astype("<u4"), wide_ends, 4)


def unpack(narrow: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, flat, and how many each row has."""
    raw, offsets = binary_buffer(narrow)
    codes = raw.view("<u2").astype(np.int32)
    more, _ = binary_buffer(wide)
    codes[codes == _WIDE] = more.view("<u4").astype(np.int32)
    return codes, np.diff(offsets) // 2


def by_use(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Renumbering by falling use, so that few numbers are large: old by new, new by old."""
    old = np.argsort(-np.bincount(codes, minlength=n), kind="stable")
    new = np.empty(n, np.int32)
    new[old] = np.arange(n)
    return old, new


def _numbered(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words of the texts and the empty word, numbers of all words and ends, and how many each text has."""
    parts, sizes, at = [], [], []
    for a, b in bounded_slices(text_sizes(texts), PART_BYTES):
        words, row, _ = words_of(texts.slice(a, b - a), KINDS)
        parts.append(words.dictionary_encode())
        sizes.append(np.bincount(row, minlength=b - a).astype(np.int32) + 1)
        at.append((np.arange(len(row)) + row).astype(np.int32))
    whole = pa.chunked_array(parts).unify_dictionaries()
    size, names = np.concatenate(sizes), whole.chunk(0).dictionary
    codes = np.full(int(size.sum()), len(names), np.int32)      # ends, where no word goes
    base = 0
    for chunk, places, some in zip(whole.chunks, at, sizes, strict=True):
        codes[base + places] = chunk.indices.to_numpy()
        base += int(some.sum())
    return pa.concat_arrays([names, pa.array([""])]), codes, size


def encoded(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """Rows of texts (doc_id, held_out, narrow, wide) and of their slice's words (word, code, n in training).

    The end of a text is the empty word.
    """
    plain = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for a, b in bounded_slices(text_sizes(batch.column("text")), SLICE_BYTES):
                part = batch.slice(a, b - a)
                names, codes, size = _numbered(part.column("text"))
                old, new = by_use(codes, len(names))
                codes = new[codes]
                learns = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), size)
                n = np.bincount(codes[learns], minlength=len(names))
                narrow, wide = pack(codes, size)
                yield _rows(b - a, slice=number, doc_id=part.column("doc_id"), held_out=part.column("held_out"), narrow=narrow, wide=wide)
                yield _rows(len(names), slice=number, doc_id=pa.nulls(len(names), batch.schema.field("doc_id").type),
                            word=names.take(pa.array(old)), code=pa.array(np.arange(len(names)), pa.int32()), n=pa.array(n))
                number += 1
            release()

    def _rows(count: int, slice: int, **given: pa.Array) -> pa.RecordBatch:
        types = {"held_out": pa.bool_(), "narrow": pa.binary(), "wide": pa.binary(), "word": pa.string(), "code": pa.int32(), "n": pa.int64()}
        cols = {"slice": pa.array(np.full(count, slice)), "doc_id": given["doc_id"]}
        cols |= {k: given.get(k, pa.nulls(count, t)) for k, t in types.items()}
        return pa.RecordBatch.from_pydict(cols)

    schema = f"slice long, doc_id {kind}, held_out boolean, narrow binary, wide binary, word string, code int, n long"
    return materialize(plain.mapInArrow(run, schema), "encoded-texts")


def counted_words(words: DataFrame, tokens: int) -> DataFrame:
    """Words of slices with ``c``, their count in training, and ``symbol``; ``first`` marks one row a word."""
    same = Window.partitionBy("word")
    rows = words.select("slice", "code", "word", F.sum("n").over(same).alias("c"),
                        (F.row_number().over(same.orderBy("slice")) == 1).alias("first"))
    symbol = (F.when(F.col("word") == "", "e").when(F.col("c") * OWN_PART >= max(tokens, 1), F.concat(F.lit("w"), "word"))
              .otherwise(F.concat(F.lit("r"), F.expr(f"right(word, {ENDING})"))))
    return materialize(rows.select("slice", "code", "c", "first", symbol.alias("symbol")), "counted-words")


@dataclass(frozen=True)
class Training:
    """Training tokens, distinct training words and symbols."""

    tokens: int
    words: int
    symbols: int = 0


def symbols_of(texts: DataFrame, words: DataFrame, corpus: Training) -> DataFrame:
    """Texts in numbers of their slice's symbols, with what does not depend on states; and the symbols (symbol, code, n)."""
    rare = F.col("symbol").startswith("r")
    classes = words.where(rare & F.col("first") & (F.col("c") > 0)).groupBy("symbol").agg((F.sum(F.col("c") + 1) + 1).alias("z"))
    classes = broadcast_if_small(materialize(classes, "rare-classes"), SMALL_CLASSES)
    words = words.join(classes, "symbol", "left").select("slice", "code", "c", "symbol", F.when(rare, F.coalesce("z", F.lit(1))).alias("z"))
    log_all = np.log10(corpus.tokens + corpus.words + 1)
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = (f"slice long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inside double, "
              "narrow binary, wide binary, symbol string, code int, n long")

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("code")
        c, z = words["c"].to_numpy(), words["z"].to_numpy()
        codes, size = unpack(docs["narrow"].combine_chunks(), docs["wide"].combine_chunks())
        start = np.cumsum(size) - size
        base = np.log10(c + 1.0) - log_all
        inside = np.where(np.isnan(z), 0.0, np.log10((c + 1.0) / np.where(np.isnan(z), 1.0, z)))    # share within the class
        named = words["symbol"].combine_chunks().dictionary_encode()
        mine = named.indices.to_numpy()[codes]
        old, new = by_use(mine, len(named.dictionary))
        mine = new[mine]
        learns = np.repeat(~docs["held_out"].to_numpy(), size)
        narrow, wide = pack(mine, size)
        def fill(count, **given):
            return pa.table({f.name: given.get(f.name, pa.nulls(count, f.type)) for f in _arrow(schema, docs)})
        number = docs["slice"][0].as_py()
        one = fill(len(docs), slice=docs["slice"], doc_id=docs["doc_id"], held_out=docs["held_out"], n_tokens=pa.array(size),
                   n_known=pa.array(np.add.reduceat((c > 0)[codes].astype(np.int64), start)), base_score=pa.array(np.add.reduceat(base[codes], start)),
                   inside=pa.array(np.add.reduceat(inside[codes], start)), narrow=narrow, wide=wide)
        release()
        two = fill(len(old), slice=pa.array(np.full(len(old), number)), symbol=named.dictionary.take(pa.array(old)),
                   code=pa.array(np.arange(len(old)), pa.int32()), n=pa.array(np.bincount(mine[learns], minlength=len(old))))
        return pa.concat_tables([one, two])

    both = texts.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(run, schema)
    return materialize(both, "symbol-texts")


def _arrow(schema: str, docs: pa.Table) -> list[pa.Field]:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = (f.strip().rsplit(" ", 1) for f in schema.split(","))
    return [pa.field(name, docs.schema.field("doc_id").type if name == "doc_id" else types[kind]) for name, kind in fields]


@dataclass(frozen=True)
class States:
    """Probabilities of first states and moves, and expected symbols in each state."""

    first: np.ndarray
    moves: np.ndarray
    total: np.ndarray


def names(states: int) -> list[str]:
    return [f"s{i}" for i in range(states)]


def emissions(counts: np.ndarray, now: States, corpus: Training) -> np.ndarray:
    """Probability of symbols (rows) in each state: its own counts, and a small share of all states' counts plus one."""
    share = (counts.sum(1, keepdims=True) + 1) / (corpus.tokens + corpus.symbols + 1)
    own = np.divide(counts, now.total, out=np.broadcast_to(share, counts.shape).copy(), where=now.total > 0)
    return (1 - SHARE) * own + SHARE * share


def _gathered(codes_of: pa.Table, symbols: pa.Table, now: States, corpus: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    symbols = symbols.sort_by("code")
    counts = np.column_stack([symbols[s].to_numpy() for s in names(len(now.first))])
    codes, size = unpack(codes_of["narrow"].combine_chunks(), codes_of["wide"].combine_chunks())
    return codes, size, emissions(counts, now, corpus), symbols


def expected(texts: DataFrame, symbols: DataFrame, now: States, corpus: Training) -> DataFrame:
    """Expected counts of one round: a row a symbol, ``i`` for first states, ``n`` for all, ``t<state>`` for moves."""
    cols = names(len(now.first))

    def run(docs: pa.Table, symbols: pa.Table) -> pa.Table:
        if not len(docs):       # all texts of the slice are held out
            return pa.table({"symbol": pa.array([], pa.string()), **{s: pa.array([], pa.float64()) for s in cols}})
        codes, size, emit, symbols = _gathered(docs, symbols, now, corpus)
        _, got = hmm.sequences(codes, size, emit, now.first, now.moves, count=True)
        release()
        used = np.flatnonzero(got.symbols.any(1))
        values = np.concatenate([got.symbols[used], got.first[None], got.symbols.sum(0)[None], got.moves])
        labels = pa.concat_arrays([symbols["symbol"].combine_chunks().take(pa.array(used)),
                                   pa.array(["i", "n", *(f"t{i}" for i in range(len(cols)))])])
        return pa.table({"symbol": labels, **{s: pa.array(values[:, i].copy()) for i, s in enumerate(cols)}})

    rows = texts.groupBy("slice").cogroup(symbols.groupBy("slice")).applyInArrow(run, "symbol string, " + ", ".join(f"{s} double" for s in cols))
    return materialize(rows.groupBy("symbol").agg(*[F.sum(s).alias(s) for s in cols]), "expected-counts")


def train(texts: DataFrame, symbols: DataFrame, corpus: Training, states: int, rounds: int) -> tuple[DataFrame, States]:
    """Expected counts by symbol and the states after ``rounds`` of Baum-Welch over all training texts.

    A symbol starts with its count dealt to the states by hash; as states are kept for
    long, texts alike gather in the same states from the first round on.
    """
    cols = names(states)
    guess = [F.pmod(F.xxhash64("symbol", F.lit(i)), F.lit(1000)) + 500 for i in range(states)]
    whole = sum(guess[1:], guess[0])
    counts = symbols.groupBy("symbol").agg(F.sum("n").alias("n")).where("n > 0")
    counts = materialize(counts.select("symbol", *[(F.col("n") * g / whole).alias(s) for s, g in zip(cols, guess)]), "first-counts")
    r = counts.agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in cols]).first()
    stay = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(stay, STAY if states > 1 else 1.0)
    now = States(np.full(states, 1 / states), stay, np.array([r[s] for s in cols]))
    for _ in range(rounds):
        met = expected(texts.where(~F.col("held_out")), attached(symbols, counts, cols), now, corpus)
        special = F.col("symbol").isin("i", "n", *(f"t{i}" for i in range(states)))
        found = {r["symbol"]: np.array([r[s] for s in cols]) for r in met.where(special).collect()}     # states + 2 rows
        counts = met.where(~special)
        zero = np.zeros(states)
        first = found.get("i", zero) + 1 / states
        moves = np.array([found.get(f"t{i}", zero) for i in range(states)]) + stay
        now = States(first / first.sum(), moves / moves.sum(1, keepdims=True), found.get("n", zero))
    return counts, now


def _own(rows: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that they can meet others of the table they come from."""
    return rows.toDF(*rows.columns)


def attached(symbols: DataFrame, counts: DataFrame, cols: list[str]) -> DataFrame:
    """Symbols of slices with their counts by state; those without any have zeros."""
    return symbols.join(counts, "symbol", "left").select("slice", "code", "symbol", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in cols])


def scores(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts.

    Tokens are what is between white space, A-Z in lower case, and one end a text.
    ``held_out`` says which rows teach nothing; null counts as false.  ``base_score``
    counts each token by itself with one added to every count; ``score`` is the hidden
    Markov model's.  A null or empty text is its end alone.  Repeated and null ids stay
    rows of their own, other columns play no part, and without training texts all
    probabilities come from the added ones.
    """
    encoded_rows = encoded(docs, F.coalesce(held_out, F.lit(False)), id_col, text_col)
    texts = _own(encoded_rows.where("word is null").select("slice", "doc_id", "held_out", "narrow", "wide"))
    words = encoded_rows.where("word is not null").select("slice", "word", "code", "n")
    tokens = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = counted_words(words, tokens)
    r = words.where("first and c > 0").agg(F.count("*").alias("words"), F.count_distinct("symbol").alias("symbols")).first()
    corpus = Training(tokens, r["words"], r["symbols"])
    both = symbols_of(texts, words, corpus)
    symbols = both.where("symbol is not null").select("slice", "symbol", "code", "n")
    texts = _own(both.where("symbol is null").drop("symbol", "code", "n"))
    counts, now = train(texts, symbols, corpus, states, rounds)

    def run(docs: pa.Table, symbols: pa.Table) -> pa.Table:
        codes, size, emit, _ = _gathered(docs, symbols, now, corpus)
        logs, _ = hmm.sequences(codes, size, emit, now.first, now.moves, count=False)
        release()
        score = logs / np.log(10) + docs["inside"].to_numpy()
        return docs.select(["doc_id", "held_out", "n_tokens", "n_known", "base_score"]).append_column("score", pa.array(score))

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    met = texts.groupBy("slice").cogroup(attached(symbols, counts, names(states)).groupBy("slice"))
    return met.applyInArrow(run, schema).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.tokens).cast("long").alias("train_tokens"),
                                                "base_score", "score")


def held_out_of(id_col: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """crc32 of the id as text leaves ``part`` by ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
