"""N-gram Jaccard self-join through a token-group matrix.

Links are between documents whose shingle sets have a Jaccard similarity of the
threshold or more.  Only components of links are wanted, so similar documents are first
gathered in groups, by links found around well-connected documents.  A group keeps the
union of its members' prefix tokens (one row a token and group: the matrix).  A document
and a foreign group can be linked only if enough of the document's tokens are in the
group's union; only those groups are opened and compared with exactly.

Prefix rule.  With shingles in one global order (their hash), take of a set of n the
first floor(n (100 - T + E) / 100) + 1.  Two sets similar by T percent share more than
E n T / 10000 of these, so at least ``need(n)`` of them.  Among the prefix tokens, those in
most groups can then be left out, ``need - 1`` of them for each document (see ``_rarest``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W

from phasegrid.llm import windows as win
from phasegrid.llm.common import F, binary_buffer, bounded_slices, column, materialize, mix64, release, text_sizes
from phasegrid.llm.components import components
from phasegrid.llm.recompression import word_spans, word_symbols
from phasegrid.scale import broadcast_if_small

WORDS = 5
PERCENT = 80
EXTRA = 5
WIDE = 32               # groups that a token may be in before documents are looked at whole
SMALL_ROWS = 1_000_000  # id lists up to this length are broadcast
CHUNK_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_sets(texts: pa.StringArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and their numbers."""
    raw, offsets = binary_buffer(texts)
    raw = _LOWER[raw]
    start, stop, docs = word_spans(raw, offsets)
    symbols = word_symbols(raw, start, stop)
    size = np.diff(docs)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    prefix = win.Prefix(symbols)
    first = np.repeat(docs[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    row = np.repeat(np.arange(len(size)), count)
    length = np.minimum(size[row], words)
    token = mix64(prefix.hash(first, first + length) ^ mix64(length.astype(np.uint64)))
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    return token, np.bincount(row, minlength=len(size))


def need(n: Column | np.ndarray, percent: int, extra: int):
    """Least number of shared prefix tokens of a link, for a set of n."""
    if isinstance(n, Column):
        return F.floor(n * (extra * percent) / 10000) + 1
    return n * (extra * percent) // 10000 + 1


def _map(docs: DataFrame, fn, schema: str, names: list[str]) -> DataFrame:
    """``fn(batch slice, tokens, counts)`` gives the columns of ``schema`` for bounded slices of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in bounded_slices(text_sizes(batch.column("text")), CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays(fn(batch.slice(lo, hi - lo)), names)
            release()

    return docs.mapInArrow(run, schema)


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """doc, n, and a 128-bit key of the whole set."""
    def keys(batch: pa.RecordBatch) -> list[pa.Array]:
        token, count = token_sets(batch.column("text"), words)
        ends = np.concatenate([[0], np.cumsum(count)])
        out = [batch.column("doc"), pa.array(count.astype(np.int64))]
        for salt in (0x51, 0xA7):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(token + np.uint64(salt)), dtype=np.uint64)])
            out.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)))
        return out

    return _map(docs, keys, "doc long, n long, k1 long, k2 long", ["doc", "n", "k1", "k2"])


def prefix_tokens(docs: DataFrame, words: int, percent: int, extra: int) -> DataFrame:
    """token, doc, n: the first tokens of each set in the global order."""
    def prefix(batch: pa.RecordBatch) -> list[pa.Array]:
        token, count = token_sets(batch.column("text"), words)
        take = np.minimum(count, count * (100 - percent + extra) // 100 + 1)
        start = np.cumsum(count) - count
        at = np.repeat(start - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        row = np.repeat(np.arange(len(count)), take)
        return [pa.array(token[at].view(np.int64)), batch.column("doc").take(pa.array(row)), pa.array(count[row].astype(np.int32))]

    return _map(docs, prefix, "token long, doc long, n int", ["token", "doc", "n"])


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc, n, tokens: whole sets."""
    def sets(batch: pa.RecordBatch) -> list[pa.Array]:
        token, count = token_sets(batch.column("text"), words)
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        return [batch.column("doc"), pa.array(count.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(token.view(np.int64)))]

    return _map(docs, sets, "doc long, n int, tokens array<long>", ["doc", "n", "tokens"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("right"))
    same = F.size(F.array_intersect("left", "right"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", same.alias("same"), (F.size("left") + F.size("right")).alias("both"))
            .where(F.col("same") * 100 >= (F.col("both") - F.col("same")) * percent).select("a", "b"))


def _fits(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (F.col(m) * 100 >= F.col(n) * percent) & (F.col(n) * 100 >= F.col(m) * percent)


def _around_centres(postings: DataFrame, percent: int, extra: int) -> DataFrame:
    """One candidate pair a document: with the best-connected document that shares most tokens with it.

    A document's connectedness is the sum of how often its tokens occur; the original of
    many copies has the largest.  (Of equals the least document: a complement reverses the
    order of any long, also of the one that stands for a null id.)
    """
    often = materialize(postings.groupBy("token").agg(F.count("*").alias("df")), "token-counts")
    weight = postings.join(often, "token").groupBy("doc").agg(F.sum("df").alias("w"), F.first("n").alias("n"))
    weight = materialize(weight, "group-weights")
    tagged = postings.select("token", "doc").join(broadcast_if_small(weight, SMALL_ROWS), "doc")
    centre = tagged.groupBy("token").agg(F.max(F.struct("w", F.bitwise_not("doc").alias("d"), F.col("n").alias("m"))).alias("c"))
    centre = materialize(centre, "centres")
    pairs = (tagged.join(centre, "token").select("doc", "n", F.bitwise_not("c.d").alias("centre"), F.col("c.m").alias("m"))
             .where("doc <> centre").where(_fits("n", "m", percent)))
    shared = pairs.groupBy("doc", "n", "centre").agg(F.count("*").alias("k")).where(F.col("k") >= need(F.col("n"), percent, extra))
    best = shared.groupBy("doc").agg(F.max_by("centre", F.struct("k", F.bitwise_not("centre"))).alias("centre"))
    return best.select(F.col("doc").alias("a"), F.col("centre").alias("b"))


def _rarest(matrix: DataFrame, least: Column) -> DataFrame:
    """Rows of a token-group matrix that a link to a foreign group has to touch.

    Tokens are ordered by the number of groups that have them, then by name.  If a link
    shares ``least`` tokens or more, the rarest of these has ``least - 1`` tokens after
    it in both documents, so every document can do without its last ``least - 1`` tokens.
    ``rest`` counts the tokens after this one: no link through it shares more than
    ``rest + 1``.  ``matrix``: token, doc, n, component.
    """
    spread = matrix.groupBy("token", "component").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("groups"))
    spread = materialize(spread.where("groups > 1"), "token-groups")
    last = W.partitionBy("doc").orderBy(F.desc("groups"), F.desc("token"))      # as many rows as a text has tokens at most
    rows = matrix.join(spread, "token").withColumn("rest", F.row_number().over(last) - 1)
    return materialize(rows.where(F.col("rest") + 1 >= least), "rarest-tokens")


def _open_groups(rows: DataFrame, groups: DataFrame, percent: int, enough: Callable[..., Column]) -> DataFrame:
    """Pairs of documents of different groups that the matrix leaves open: a, b, n, m, k shared rows.

    Of two groups the one with fewer members asks.  A document opens a group if a group's
    token union touches its rarest tokens and the sizes of the members allow a link; the
    members are then those that share such a token.  ``enough`` bounds what a pair can
    share by the tokens after the one that joins it (``rest``, ``rest2``, ``n``, ``m``).
    """
    ask = rows.join(broadcast_if_small(groups, SMALL_ROWS), "component")
    union = ask.groupBy("token", F.col("component").alias("g")).agg(F.first("members").alias("g_members"), F.first("least").alias("g_least"),
                                                                    F.first("most").alias("g_most"), F.max("rest").alias("g_rest"))
    union = materialize(union, "group-unions")
    first = F.struct("members", "component") < F.struct(F.col("g_members").alias("members"), F.col("g").alias("component"))
    sized = (F.col("g_most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("g_least") * percent)
    # The most favourable member: most tokens after this one, and the smallest size that fits.
    best = F.greatest(F.col("g_least"), F.ceil(F.col("n") * percent / 100))
    kind = enough(F.col("rest"), F.col("g_rest"), F.col("n"), best)
    opened = materialize(ask.join(union, "token").where(first & sized & kind).select("doc", "g").distinct(), "opened-groups")
    asking = rows.select("token", F.col("doc").alias("a"), "n", "rest").join(opened.withColumnRenamed("doc", "a"), "a")
    member = rows.select("token", F.col("component").alias("g"), F.col("doc").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest2"))
    fits = _fits("n", "m", percent) & enough(F.col("rest"), F.col("rest2"), F.col("n"), F.col("m"))
    return asking.join(member, ["token", "g"]).where(fits).groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"))


def _foreign_links(matrix: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, extra: int) -> DataFrame:
    """Pairs ``a, b`` of different groups that remain to be compared.

    Pairs that share a token of few groups are found with the prefix tokens.  Where
    documents are left with tokens of very many groups (a passage that fills much of
    each), their whole sets take the place of the prefixes: the more of a set is in the
    order, the more of its frequent tokens can be left out.
    """
    sizes = matrix.groupBy("component").agg(F.countDistinct("doc").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = materialize(sizes, "group-sizes")
    own = need(F.col("n"), percent, extra)
    rows = _rarest(matrix, own)
    least = lambda r1, r2, n, m: F.least(r1, r2) + 1 >= F.greatest(need(n, percent, extra), need(m, percent, extra))
    near = _open_groups(rows.where(F.col("groups") <= WIDE), sizes, percent, least)
    # Prefix tokens that a pair of these sizes shares at least, less what was left out of the count.
    hot = rows.groupBy("doc").agg(F.count_if(F.col("groups") > WIDE).alias("hot"))
    near = near.join(hot.withColumnsRenamed({"doc": "a", "hot": "hot_a"}), "a")
    both = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    prefix = lambda c: F.least(F.col(c), F.floor(F.col(c) * (100 - percent + extra) / 100) + 1)
    shared = F.least(prefix("n") - F.col("n") + both, prefix("m") - F.col("m") + both)
    near = near.where(F.col("k") >= shared - (need(F.col("n"), percent, extra) - 1) - (need(F.col("m"), percent, extra) - 1) - F.col("hot_a"))

    crowd = materialize(rows.where(F.col("groups") > WIDE).select("doc").distinct(), "crowded")
    whole = sets.join(broadcast_if_small(crowd, SMALL_ROWS), "doc", "left_semi").select(F.explode("tokens").alias("token"), "doc", "n")
    whole = materialize(whole.join(broadcast_if_small(groups, SMALL_ROWS), F.col("doc") == F.col("node"), "left")
                        .select("token", "doc", "n", F.coalesce("component", "doc").alias("component")), "crowded-sets")
    rows = _rarest(whole, F.ceil(F.col("n") * percent / 100))
    full = lambda r1, r2, n, m: (F.least(r1, r2) + 1) * (100 + percent) >= (n + m) * percent
    far = _open_groups(rows, sizes, percent, full)
    return near.select("a", "b").unionByName(far.select("a", "b")).distinct()


def link_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, extra: int = EXTRA, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Class of each row: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Texts without words have empty sets and are linked with nothing.  A null id counts as
    smaller than all and comes back null.  Rows that share an id are one document that
    links wherever one of its texts does.  Extra columns are left out.
    """
    rows = docs.select(F.coalesce(column(id_col).cast("long"), F.lit(win.NO_ID)).alias("doc"),
                       F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    keys = materialize(set_keys(rows, words), "set-keys")
    # Equal sets are one node, their least document.
    classes = keys.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc").alias("node"))
    member = materialize(keys.join(classes, ["k1", "k2", "n"], "left").select("doc", "n", F.coalesce("node", "doc").alias("node")), "set-classes")
    nodes = member.where("n > 0 and doc = node").select("doc").distinct()

    tokens = prefix_tokens(rows, words, percent, extra)
    # Counts are written before they are joined: both sides are then plain shuffles that Spark can split at a frequent token.
    twice = materialize(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    postings = tokens.join(twice, "token").join(broadcast_if_small(nodes, SMALL_ROWS), "doc", "left_semi").distinct()
    postings = materialize(postings, "postings")
    # Copies of a set no longer count; what is met once or in too few tokens cannot link.
    shared = materialize(postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "tokens")
    postings = postings.join(shared, "token")
    enough = (postings.groupBy("doc").agg(F.count("*").alias("c"), F.min("n").alias("n"))
              .where(F.col("c") >= need(F.col("n"), percent, extra)).select("doc"))
    enough = materialize(enough, "candidates")
    small = broadcast_if_small(enough, SMALL_ROWS)
    postings = materialize(postings.join(small, "doc"), "postings")
    sets = materialize(whole_sets(rows.join(small, "doc", "left_semi"), words), "sets")

    near = materialize(confirm(_around_centres(postings, percent, extra), sets, percent), "near-links")
    groups = components(near)
    matrix = (postings.join(groups, F.col("doc") == F.col("node"), "left")
              .select("token", "doc", "n", F.coalesce("component", "doc").alias("component")))
    far = materialize(confirm(_foreign_links(matrix, sets, groups, percent, extra), sets, percent), "far-links")
    final = components(near.unionByName(far))
    out = member.join(final, "node", "left")
    back = lambda c: F.when(c != win.NO_ID, c)
    return out.select(back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("component", "node")).alias("component_id"))


def brute_force(docs: list[tuple[int, str | None]], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """All pairs; for tests.  Ids are distinct."""
    def lower(b: bytes) -> bytes:
        return bytes(c + 32 if 65 <= c <= 90 else c for c in b)

    sets = {}
    for d, t in docs:
        w = lower((t or "").encode()).split()
        sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}
