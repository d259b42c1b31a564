"""N-gram Jaccard join by filtering under several global token orders.

Two sets with Jaccard similarity t share a token among the first
n - ceil(t n) + 1 of each set, under any order of all tokens. Here the orders
put rare tokens first and break ties by different hashes; candidates must share
a prefix token under each order, and are verified on their whole sets.

Tokens that occur in one document only come first in every order and match
nothing, so a document whose other tokens are fewer than ceil(t n) can't link.
That is found by counting document frequencies over all tokens, and leaves few
documents. Rows with equal sets are one class throughout.

Within one token's posting list no pairs are made of documents that are
connected already: first members meet a few leaders of the list, then members
outside the list's largest component meet more of it, and only those still
outside meet the rest. A group of thousands of near copies costs a few
comparisons a member, and no link between components is lost. Long lists are
split by the prefix tokens of the second order for that last step, since
candidates share one of these too.

A token in a great share of all sets is no hot group of the counts: a slice of
documents says once that it is shared, and the tokens that make up more than a
fixed share of all entries are counted by partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens that one bucket of the frequency count holds on average.
BUCKET_TOKENS = 3_000_000
#: Orders beyond the first, whose prefixes must meet as well.
MORE_ORDERS = 2
#: Leaders of a posting list that its members meet in a round, and rounds.
LEADERS, ROUNDS = 8, 2
#: Members of a list's largest component that outsiders meet before they meet all.
REACH = 64
#: Members from which on a list is split by the second order's tokens.
LONG_LIST = 1000
#: Documents whose prefixes are made at a time.
PREFIX_ROWS = 64
#: Entries at least of a token that is counted apart.
LEAST_HOT = 1000
#: Tokens with one of so many shares of all entries, or more, are counted apart; there are no more such tokens than this.
HOT_TOKENS = 20_000
WORD_CACHE = 300_000
#: Tokens that a task deals at a time, and documents of such a slice in which a token is settled at once.
SLICE_TOKENS, OFTEN = 1_000_000, 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen."""

    def __missing__(self, word):
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int, hashes: _Hashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lowered and words are runs of other than ASCII white space. A text
    of fewer than n words is one shingle, one without words has none.
    """
    with np.errstate(over="ignore"):
        out = []
        for text in texts:
            words = text.encode().lower().split()
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            k = min(n, len(h))
            if k == 0:
                out.append(h)
                continue
            acc = np.full(len(h) - k + 1, k, np.uint64)
            for j in range(k):
                acc = (acc ^ h[j : len(h) - k + 1 + j]) * _MIX[0]
                acc ^= acc >> np.uint64(29)
            out.append(np.unique(mixed(acc)))
        return out


def profiles(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, signature (of the set; null if it is empty)."""

    def make():
        import xxhash

        hashes = _Hashes()
        return lambda texts: [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None) for s in shingle_sets(texts, n, hashes)]

    return common.map_texts(common.id_and_text(docs, id_col, text_col), make, "n_shingles long, signature binary")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def make():
        hashes = _Hashes()
        return lambda texts: [(s.view(np.int64),) for s in shingle_sets(texts, n, hashes)]

    return common.map_texts(docs, make, "tokens array<long>")


def _by_bucket(owner: np.ndarray, tokens: np.ndarray, bits: int):
    """Rows (bucket, documents, how many tokens of each, tokens): the tokens of each bucket with their documents."""
    buckets = (tokens >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(buckets, kind="stable")  # documents stay in order within a bucket
    buckets, owner, tokens = buckets[order], owner[order], tokens[order]
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
        if lo == hi:
            continue
        own = owner[lo:hi]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        yield int(buckets[lo]), own[starts], np.diff(np.concatenate((starts, [hi - lo]))).astype(np.int32), tokens[lo:hi]


#: Stands for the document of a token that a slice found in OFTEN of its documents.
SEVERAL = -(2**63)


def _slices(batches, sets_of, most: int = SLICE_TOKENS):
    """(documents, their tokens, one after the other) of slices of about `most` tokens."""
    ids, sets, held = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids.append(batch.column(0)[i].as_py())
            sets.append(sets_of(batch.column(1)[i]))
            held += len(sets[-1])
            if held > most:
                yield np.repeat(np.array(ids, np.int64), [len(x) for x in sets]), np.concatenate(sets)
                ids, sets, held = [], [], 0
    if held:
        yield np.repeat(np.array(ids, np.int64), [len(x) for x in sets]), np.concatenate(sets)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _shared_counts(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """(doc_id, shared): of docs (doc_id, text), the distinct shingles that other documents have too, in parts.

    What a slice finds in OFTEN or more of its documents it settles by document,
    and says once in the token's bucket that it is shared.
    """
    common.ship(docs.sparkSession)
    kinds = {"bucket": pa.int32(), "docs": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32()), "done_docs": pa.list_(pa.int64()), "done": pa.list_(pa.int32())}

    def run(batches):
        hashes = _Hashes()
        for owner, tokens in _slices(batches, lambda v: shingle_sets([v.as_py()], n, hashes)[0]):
            values = np.sort(tokens)
            starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            several = values[starts[np.diff(np.append(starts, len(values))) >= OFTEN]]
            settled = several[np.minimum(np.searchsorted(several, tokens), len(several) - 1)] == tokens if len(several) else np.zeros(len(tokens), bool)
            keep = ~settled
            own, sent = np.concatenate((owner[keep], np.full(len(several), SEVERAL))), np.concatenate((tokens[keep], several))
            rows = [(b, d, c, (t & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), [], []) for b, d, c, t in _by_bucket(own, sent, bits)]
            ids, shared = np.unique(owner[settled], return_counts=True)
            place = (mixed(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
            for b in np.unique(place).tolist():
                rows.append((b, [], [], [], ids[place == b], shared[place == b].astype(np.int32)))
            yield _batch(rows, kinds)

    def count(table):
        docs, counts, tokens, done_docs, done = _flat(table, ("docs", "counts", "tokens", "done_docs", "done"))
        docs = np.repeat(docs, counts)
        order = np.argsort(tokens, kind="stable")
        docs, tokens = docs[order], tokens[order]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(tokens)))
        known = np.logical_or.reduceat(docs == SEVERAL, starts) if len(starts) else np.zeros(0, bool)
        met = docs[np.repeat((size > 1) | known, size)]
        ids, m = np.unique(met[met != SEVERAL], return_counts=True)
        return pa.table({"doc_id": pa.array(np.concatenate((ids, done_docs)), pa.int64()), "shared": pa.array(np.concatenate((m, done)), pa.int64())})

    dealt = docs.select("doc_id", "text").mapInArrow(run, "bucket int, docs array<long>, counts array<int>, tokens array<int>, done_docs array<long>, done array<int>")
    return dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(count, "doc_id long, shared long")


def _shared_tokens(sets: DataFrame, total: int) -> DataFrame:
    """(doc_id, tokens, df): of sets (doc_id, tokens), the tokens in two or more sets and how many have them, in parts.

    Tokens with a HOT_TOKENS-th of all entries or more are counted by partial
    aggregation and known to every task: at most HOT_TOKENS of them.
    """
    common.ship(sets.sparkSession)
    bits, hot = _bits(total), max(LEAST_HOT, -(-total // HOT_TOKENS))
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= hot).collect()
    known = sorted((r.token & (2**64 - 1), r.df) for r in often)
    hot_tokens, hot_df = np.array([t for t, _ in known], np.uint64), np.array([f for _, f in known], np.int64)
    kinds = {"bucket": pa.int32(), "docs": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "tokens": pa.list_(pa.int64()), "frequencies": pa.list_(pa.int64())}

    def run(batches):
        for owner, tokens in _slices(batches, lambda v: v.values.to_numpy().view(np.uint64)):
            at = np.minimum(np.searchsorted(hot_tokens, tokens), max(len(hot_tokens) - 1, 0))
            is_hot = hot_tokens[at] == tokens if len(hot_tokens) else np.zeros(len(tokens), bool)
            rows = [(b, d, c, t.view(np.int64), []) for b, d, c, t in _by_bucket(owner[~is_hot], tokens[~is_hot], bits)]
            if is_hot.any():
                own, held, df = owner[is_hot], tokens[is_hot], hot_df[at[is_hot]]
                place = (mixed(own.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
                for b in np.unique(place).tolist():
                    mine = place == b
                    ids, counts = np.unique(own[mine], return_counts=True)  # a document's tokens stand together
                    order = np.argsort(own[mine], kind="stable")
                    rows.append((b, ids, counts.astype(np.int32), held[mine][order].view(np.int64), df[mine][order]))
            yield _batch(rows, kinds)

    def count(table):
        parts = []
        cold, warm = table.filter(pa.compute.equal(pa.compute.list_value_length(table.column("frequencies")), 0)), table.filter(pa.compute.greater(pa.compute.list_value_length(table.column("frequencies")), 0))
        for t, sure in ((cold, False), (warm, True)):
            docs, counts, tokens, df = _flat(t, ("docs", "counts", "tokens", "frequencies"))
            docs = np.repeat(docs, counts)
            if not sure:
                order = np.argsort(tokens, kind="stable")
                docs, tokens = docs[order], tokens[order]
                starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
                size = np.diff(np.append(starts, len(tokens)))
                df = np.repeat(size, size)
            parts.append((docs[df > 1], tokens[df > 1], df[df > 1]))
        docs, tokens, df = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(docs, kind="stable")
        docs, tokens, df = docs[order], tokens[order], df[order]
        starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate((starts, [len(docs)])), pa.int32())
        return pa.table({"doc_id": pa.array(docs[starts], pa.int64()), "tokens": pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int64())), "df": pa.ListArray.from_arrays(offsets, pa.array(df, pa.int64()))})

    dealt = sets.select("doc_id", "tokens").mapInArrow(run, "bucket int, docs array<long>, counts array<int>, tokens array<long>, frequencies array<long>")
    return dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(count, "doc_id long, tokens array<long>, df array<long>")


def _flat(table: pa.Table, names) -> list[np.ndarray]:
    """The lists of each column, one after the other."""
    out = []
    for c in names:
        parts = [x.flatten().to_numpy(zero_copy_only=False) for x in table.column(c).chunks]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def _bits(tokens: int) -> int:
    return max(5, (max(1, tokens // BUCKET_TOKENS)).bit_length())


def _prefixes(percent: int):
    """Prefix tokens of each document under each order, from its shared tokens.

    Input (doc_id, n_shingles, tokens, df): lists by bucket. The tokens of one
    document only fill the first places of every prefix. Documents whose
    prefixes they fill wholly give no row.
    """

    def run(batches):
        for batch in (b.slice(i, PREFIX_ROWS) for b in batches for i in range(0, b.num_rows, PREFIX_ROWS)):
            out = []
            for row in batch.to_pylist():
                tokens = np.array([t for part in row["tokens"] for t in part], np.int64).view(np.uint64)
                df = np.array([x for part in row["df"] for x in part], np.int64)
                size = row["n_shingles"]
                left = size - -(-percent * size // 100) + 1 - (size - len(tokens))
                if left <= 0:
                    continue
                with np.errstate(over="ignore"):
                    orders = [np.lexsort((tokens, df))[:left]]
                    level = np.log2(df).astype(np.int64)
                    orders += [np.lexsort((mixed(tokens, k), level))[:left] for k in range(1, MORE_ORDERS + 1)]
                out.append({"doc_id": row["doc_id"], "n": size, "alone": size - len(tokens)} | {f"p{k}": tokens[o].view(np.int64) for k, o in enumerate(orders)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("alone", pa.int64())] + [(f"p{k}", pa.list_(pa.int64())) for k in range(MORE_ORDERS + 1)]))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph of edges (a, b); component is its smallest node.

    Every round maps each node to the smallest of itself and its neighbours,
    twice, and keeps the edges between what they map to, until none is left.
    Rounds are cut by tables in the shared folder.
    """
    edges = common.saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        first = common.saved(first, "up")
        up = common.saved(first.join(first.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "up")
        if labels is None:
            new = up.withColumnRenamed("up", "component")
        else:
            step = up.select(F.col("node").alias("component"), F.col("up"))
            new = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        new = common.saved(new, "labels")
        to = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        left = common.saved(edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).filter("a <> b").distinct(), "edges")
        common.discard(first, up, edges, labels)
        labels, edges = new, left
        if edges.isEmpty():
            common.discard(edges)
            return labels


def _verified(pairs: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the other orders' prefixes and then the whole sets."""
    others = [f"p{k}" for k in range(1, MORE_ORDERS + 1)]
    side = lambda s: info.select(F.col("doc_id").alias(s), *[F.col(p).alias(f"{s}_{p}") for p in others])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    for p in others:
        met = met.filter(F.arrays_overlap(f"a_{p}", f"b_{p}"))
    whole = lambda s: sets.select(F.col("doc_id").alias(s), F.col("tokens").alias(f"{s}_set"))
    met = met.select("a", "b").join(whole("a"), "a").join(whole("b"), "b")
    met = met.withColumn("__i", F.size(F.array_intersect("a_set", "b_set")))
    return met.filter(100 * F.col("__i") >= percent * (F.size("a_set") + F.size("b_set") - F.col("__i"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of
    distinct shingles of `words` words; component_id is the smallest id that is
    reachable by links (null where none has an id). Null and empty texts have no
    shingles and link with nothing. Every row is a document of its own, also
    where ids repeat or are null, and ids may be of any type that sorts. An
    empty table gives an empty table.
    """
    rows, same = common.numbered(common.id_and_text(docs, id_col, text_col))
    out = _components(rows, words, percent)
    if same:
        return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    names = rows.select("key", "doc_id")
    out = out.join(names, "key").join(names.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.select("doc_id", "n_shingles", "component_id")


def _components(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, n_shingles, component) of rows (key, text): component is the smallest key reachable."""
    rows = rows.select(F.col("key").alias("doc_id"), "text")
    base = common.saved(profiles(rows, words), "profiles")
    classes = base.filter("n_shingles > 0").groupBy("signature").agg(F.min("doc_id").alias("rep"))
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    labels = _linked(rows, base, total, words, percent)
    known = classes.join(labels, classes.rep == labels.node, "left").select("signature", F.coalesce("component", "rep").alias("component"))
    out = base.join(known, "signature", "left")
    return out.select(F.col("doc_id").alias("key"), "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def _linked(rows: DataFrame, base: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    """(node, component) of the classes' smallest ids, as far as they have links."""
    # Documents with enough tokens in other documents too; of equal sets, one.
    counts = _shared_counts(rows, words, _bits(total)).groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    able = base.join(counts, "doc_id").filter(100 * F.col("shared") >= percent * F.col("n_shingles"))
    able = common.saved(able.groupBy("signature").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles")).drop("signature"), "able")
    sets = common.saved(_sets(rows.join(able.select("doc_id"), "doc_id", "left_semi"), words), "sets")
    total = able.agg(F.sum("n_shingles")).first()[0] or 0
    shared = _shared_tokens(sets, total).groupBy("doc_id").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("df").alias("df"), F.sum(F.size("tokens")).alias("m"))
    shared = shared.join(able, "doc_id").filter(100 * F.col("m") >= percent * F.col("n_shingles"))
    schema = "doc_id long, n long, alone long, " + ", ".join(f"p{k} array<long>" for k in range(MORE_ORDERS + 1))
    info = common.saved(shared.select("doc_id", "n_shingles", "tokens", "df").mapInArrow(_prefixes(percent), schema), "prefixes")

    # rest: tokens of the set from this one on. What two sets share from their first common token on bounds their overlap.
    post = info.select(F.posexplode("p0").alias("at", "token"), "doc_id", "n", "alone")
    post = post.select("token", "doc_id", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), (F.col("alone") / F.col("n")).alias("far"))
    near = (100 + percent) * F.least("rest", "other_rest") >= percent * (F.col("n") + F.col("m"))
    # Members of a posting list against a few leaders, others in every list and round, across components.
    links, labels = None, None
    for turn in range(ROUNDS):
        if labels is not None:
            now = post.drop("c").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        else:
            now = post.withColumn("c", F.col("doc_id"))
        post = common.saved(now, "postings")
        one = F.struct("doc_id", "n", "rest", "c")
        # At first the lists of one group of copies have the same leaders, so a member meets these once: those
        # with the fewest tokens of their own, to which most copies link. Then others in each list.
        def place(k):
            seed = F.lit(turn * LEADERS + k)
            return F.struct("far", F.xxhash64(seed, "doc_id")) if turn == 0 else F.struct(F.xxhash64(seed, "token", "doc_id"))

        lead = post.groupBy("token").agg(*[F.min_by(one, place(k)).alias(f"l{k}") for k in range(LEADERS)], F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
        lead = lead.select("token", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))).alias("l"))
        lead = lead.select("token", F.col("l.doc_id").alias("other"), F.col("l.n").alias("m"), F.col("l.rest").alias("other_rest"), F.col("l.c").alias("d"))
        met = post.join(lead, "token").filter(F.col("c") != F.col("d")).filter(near)
        pairs = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        found = common.saved(_verified(pairs, info, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    # Members outside the largest component of a list: against its members with the fewest tokens of
    # their own, by which most that link to it at all are joined; those still outside against all others.
    for reach in (REACH, None):
        post = post.drop("c").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        post = common.saved(post, "postings")
        by = post.groupBy("token", "c").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("c", F.struct("size", "c")).alias("most"), F.count("*").alias("parts"), (F.sum("size") >= LONG_LIST).alias("long"))
        lists = post.join(by.filter("parts > 1"), "token")
        left = lists.filter("c <> most").drop("far").withColumn("second", F.lit(0).cast("long"))
        right = lists.withColumn("second", F.lit(0).cast("long"))
        if reach:
            w = Window.partitionBy("token").orderBy("far", F.xxhash64("doc_id"), "doc_id")
            right = right.filter("c = most").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= reach)
        else:
            # Members of a long list meet only where they share a prefix token of the second order too, as candidates do.
            second = info.select("doc_id", F.explode("p1").alias("__second"))
            split = lambda x: x.filter("NOT long").unionByName(x.filter("long").join(second, "doc_id").withColumn("second", F.col("__second")).drop("__second"))
            left, right = split(left), split(right)
        right = right.select("token", "second", F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("rest").alias("other_rest"), F.col("c").alias("d"))
        met = left.join(right, ["token", "second"]).filter((F.col("c") != F.col("d")) & ((F.col("d") == F.col("most")) | (F.col("doc_id") < F.col("other")))).filter(near)
        pairs = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
        more = common.saved(_verified(pairs, info, sets, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    common.discard(sets, info, post)
    return labels


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of near duplicates one row, with all its columns: that of the smallest id.

    Rows are documents as in near_duplicates: rows of one id and different texts
    are judged apart, and rows without words all stay. An empty table gives an
    empty table.
    """
    rows, same = common.numbered(common.id_and_text(docs, id_col, text_col))
    out = _components(rows, words, percent)
    if same:
        kept = common.saved(out.filter("key = component").select("key"), "kept")
        return docs.join(kept.withColumnRenamed("key", "__keep"), F.col(id_col).cast("long") == F.col("__keep"), "left_semi")
    both = rows.select("key", "doc_id", F.xxhash64("text").alias("of")).join(out, "key")
    kept = both.groupBy(F.col("doc_id").alias("id"), "of").agg(F.count_if(F.col("key") == F.col("component")).alias("n"), F.count("*").alias("rows"))
    return common.picked(docs, id_col, F.xxhash64(common.text_or_empty(text_col)), common.saved(kept.filter("n > 0"), "kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return near_duplicates(common.documents(spark, sf_dir), words=4, percent=85)


#: DuckDB SQL of op8: links by counting shared shingles of pairs, components by reachability.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a WHERE r.c < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY a) m USING (doc_id)
"""
