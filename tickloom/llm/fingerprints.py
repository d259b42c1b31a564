"""Document fingerprints: randomised edit embedding, bit samples, banding and verification.

All texts take one shared random walk over their characters: at each step the
walk writes the character it stands on and moves to the next one or stays, as a
random function of step and character says. Texts that differ by few edits soon
walk in step again, so their edit distance becomes a Hamming distance of the
walks. Of a walk as long as it is, each of SLOTS slots samples one step (the one
of least random priority, so that texts of like length sample like steps) and
keeps four bits of a hash of what stands there. Fingerprints that agree in a band
of sampled bits are candidates; verification counts all slots.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 256
#: Slots of a band, and bands; each band samples its slots at random.
BAND, BANDS = 3, 64
#: Characters hashed at a sampled step: the one that the walk stands on and those after it.
GRAM = 4
#: Steps after which the shared random functions repeat, and classes of characters they tell apart.
PERIOD, CLASSES = 1024, 4
#: Characters that one table look-up walks over, and texts that walk side by side at least.
FOUR, TOGETHER = 4, 16
#: Bytes of text that walk at a time, or one longer text.
SLICE = 2_000_000
SEED = 29


@functools.cache
def _moves():
    """moves[c, j]: steps that the shared walk spends on a character of class c from step j (of PERIOD) on."""
    import numpy as np

    go = np.random.default_rng(SEED).random((CLASSES, PERIOD)) < 0.5
    go[:, -1] = True
    out = np.empty((CLASSES, PERIOD), np.int64)
    at = np.zeros(CLASSES, np.int64)
    for j in range(PERIOD - 1, -1, -1):
        at = np.where(go[:, j], j + 1, at)
        out[:, j] = at - j
    return out


@functools.cache
def _fours():
    """fours[code, j]: steps spent on FOUR characters, whose classes are the code's digits, from step j on."""
    import numpy as np

    moves, out = _moves(), np.zeros((CLASSES**FOUR, PERIOD), np.int64)
    for code in range(CLASSES**FOUR):
        for n in range(FOUR - 1, -1, -1):
            out[code] += moves[code // CLASSES**n % CLASSES][(np.arange(PERIOD) + out[code]) % PERIOD]
    assert out.max() < PERIOD
    return out


@functools.cache
def _states():
    """The same as linked states, states[j][code] being the state reached, so that one walk is one C loop; last comes j."""
    import numpy as np

    states: list = [[None] * CLASSES**FOUR + [n] for n in range(PERIOD)]
    for n, to in enumerate(((np.arange(PERIOD) + _fours()) % PERIOD).T.tolist()):
        states[n][:-1] = map(states.__getitem__, to)
    return states


@functools.cache
def _classes():
    """Class of every code point."""
    import numpy as np

    return (_mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(CLASSES)).astype(np.uint8)


@functools.cache
def _records():
    """Per slot, ascending: steps whose random priority is lower than any before, up to 2^40; padded with a large number."""
    import numpy as np

    rng, rows = np.random.default_rng(SEED + 1), []
    for _ in range(SLOTS):
        step, least, row = 0, rng.random(), [0]
        while True:
            step += int(min(rng.geometric(max(least, 1e-13)), 1 << 41))
            if step >= 1 << 40:
                break
            row.append(step)
            least *= rng.random()
        rows.append(row)
    out = np.full((SLOTS, max(map(len, rows))), 1 << 62, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _walked(codes, starts, counts):
    """Steps spent on each four characters: codes holds those at every place, starts and counts say where texts lie.

    Texts walk side by side while enough of them are under way; the long ones
    that are left walk alone.
    """
    import itertools
    import operator

    import numpy as np

    base = np.cumsum(counts) - counts
    spent = np.empty(int(counts.sum()), np.int64)
    order = np.argsort(-counts, kind="stable")
    at, sizes, to = starts[order], counts[order], base[order]
    state, n, k = np.zeros(len(order), np.int64), int((counts > 0).sum()), 0
    fours = _fours().ravel()
    while n >= TOGETHER:
        until = int(sizes[n - 1])
        at_, to_, here = at[:n], to[:n], state[:n]
        for k in range(k, until):
            took = fours[codes[at_ + FOUR * k].astype(np.int64) * PERIOD + here]
            spent[to_ + k] = took
            here += took
            here %= PERIOD
        k = until
        n = int((sizes[:n] > k).sum())
    for i in range(n):
        rest = codes[at[i] + FOUR * k : at[i] + FOUR * int(sizes[i]) : FOUR].tobytes()
        walk = itertools.accumulate(rest, operator.getitem, initial=_states()[int(state[i])])
        reached = np.fromiter(map(operator.itemgetter(-1), walk), np.int64, len(rest) + 1)
        spent[to[i] + k : to[i] + int(sizes[i])] = np.diff(reached) % PERIOD
    return spent


def prints(texts: list):
    """SLOTS digits (0 to 15) of each text as a matrix; the empty text's are all 0."""
    import numpy as np

    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(points):
        return np.zeros((len(texts), SLOTS), np.uint8)
    ends = np.cumsum(sizes)
    starts, counts = ends - sizes, sizes // FOUR
    classes = np.concatenate([_classes()[points], np.zeros(FOUR, np.uint8)])
    codes = np.zeros(len(points), np.uint8)
    for i in range(FOUR):
        codes = codes * CLASSES + classes[i : i + len(points)]
    spent = _walked(codes, starts, counts)
    # steps at which the walk reaches every fourth character and the text's end, all texts one after the other
    begins = np.zeros(len(spent) + 1, np.int64)
    begins[1:] = np.cumsum(spent)
    base = np.cumsum(counts) - counts
    length = begins[base + counts] - begins[base]
    for i in range(FOUR - 1):
        at = starts + FOUR * counts + i
        more = at < ends
        length[more] += _moves()[classes[at[more]], length[more] % PERIOD]
    records = _records()
    rank = np.zeros((len(texts), SLOTS), np.int64)
    for column in records.T:
        rank += column[None, :] < length[:, None]
    sampled = records[np.arange(SLOTS)[None, :], np.maximum(rank - 1, 0)]
    # a gap of a step after each text keeps its sampled steps out of the next one's
    marks = np.append(begins[:-1] + np.repeat(np.arange(len(texts)), counts), np.iinfo(np.int64).max)
    four = np.searchsorted(marks, sampled + (begins[base] + np.arange(len(texts)))[:, None], side="right") - 1
    four = np.clip(four, base[:, None], (base + np.maximum(counts, 1) - 1)[:, None])
    step = begins[np.minimum(four, len(begins) - 1)] - begins[base][:, None]
    stands = starts[:, None] + FOUR * (four - base[:, None])
    last = np.maximum(ends - 1, starts)[:, None]
    for _ in range(2 * FOUR - 1):
        after = step + _moves()[classes[stands], step % PERIOD]
        go = (sampled >= after) & (stands < last)
        stands, step = stands + go, np.where(go, after, step)
    gram = np.zeros(sampled.shape, np.uint64)
    for i in range(GRAM):
        at = stands + i
        char = np.where(at < ends[:, None], points[np.minimum(at, len(points) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        gram = _mix(gram * np.uint64(0x9E3779B97F4A7C15) + char)
    out = (_mix(gram + sampled.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(60)).astype(np.uint8)
    out[sizes == 0] = 0
    return out


def _written(digits) -> str:
    return bytes((digits[0::2] << 4) | digits[1::2]).hex()


def fingerprint(text: str) -> str:
    """SLOTS hexadecimal digits."""
    return _written(prints([text])[0])


def digits(fingerprint: str):
    """A fingerprint's digits as numbers."""
    import numpy as np

    both = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).ravel()


def likeness(a, b) -> float:
    """Share of slots (digits of two fingerprints) that agree, above what chance gives (one in 16): 0 to 1."""
    same = int((a == b).sum()) / SLOTS
    return max(0.0, (same - 1 / 16) / (15 / 16))


@functools.cache
def _banded():
    import numpy as np

    rng = np.random.default_rng(SEED + 2)
    return np.stack([np.sort(rng.permutation(SLOTS)[:BAND]) for _ in range(BANDS)])


def _common_bands(a, b) -> int:
    return int((a == b)[_banded()].all(axis=1).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null texts count as empty, and equal texts have equal fingerprints.

    Rows are on their own: repeated or null ids and other columns don't matter.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    return common.map_texts(rows, lambda: lambda texts: [(_written(d),) for d in prints(texts)], "fingerprint string")


def _verified(a: Column, b: Column) -> Column:
    """likeness() of two columns of fingerprints."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(SLOTS)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.greatest(F.lit(0.0), (same / F.lit(SLOTS) - F.lit(1 / 16)) / F.lit(15 / 16))


def search(docs: DataFrame, queries: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, doc_id, likeness: documents whose verified likeness to a query is `least` or more, other ids only.

    Candidates agree in a band; with likeness s one of BANDS bands does with
    probability 1 - (1 - s^BAND)^BANDS, above 1 - 10^-15 at 0.8. Equal
    fingerprints meet once and are expanded only in the result. Null ids are in
    no result, as they can't be told apart.
    """
    prints = [common.saved(fingerprints(d, id_col, text_col).filter("doc_id IS NOT NULL"), "prints") for d in (queries, docs)]
    band = F.array(*[F.concat_ws("", F.lit(f"{n}:"), *[F.substring("fingerprint", i + 1, 1) for i in b]) for n, b in enumerate(_banded().tolist())])
    sides = [p.select("fingerprint").distinct().select(F.col("fingerprint").alias(f"f{i}"), F.explode(band).alias("band")) for i, p in enumerate(prints)]
    pairs = sides[0].join(sides[1], "band").select("f0", "f1").distinct()
    pairs = pairs.withColumn("likeness", _verified(F.col("f0"), F.col("f1"))).filter(F.col("likeness") >= least)
    own = prints[0].select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("f0"))
    other = prints[1].select("doc_id", F.col("fingerprint").alias("f1"))
    return own.join(pairs, "f0").join(other, "f1").filter("query_id <> doc_id").select("query_id", "doc_id", "likeness")


def _edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_PAIR = "edited_sha256 string, edited_fingerprint string, near_edited double, near_next double, edited_bands int, next_bands int"


def _compared(texts: list, digits, after: list, after_digits) -> list:
    """The columns of _PAIR of each text, given the text that follows it and both fingerprints' digits."""
    import hashlib

    edited = [_edited(a, b) for a, b in zip(texts, after)]
    new = prints(edited)
    sha = (hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited)
    return [(h, _written(n), likeness(d, n), likeness(d, x), _common_bands(d, n), _common_bands(d, x)) for h, d, n, x in zip(sha, digits, new, after_digits)]


def with_edits(docs: DataFrame) -> DataFrame:
    """Every row of docs with its fingerprint, its edited text's, and how alike they and the next row's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_bands, next_bands (bands in common). Rows follow each other
    by doc_id, nulls last; rows of one id go by their text's hash; after the last
    comes the first, and a row alone follows itself. Texts are dealt by ranges of
    ids once; a range's first and last row, two per task, meet across ranges in a
    second pass over those rows alone.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    common.ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    made = StructType.fromDDL(f"part int, place string, doc_id {kind}, n_chars long, fingerprint string, text string, {_PAIR}")
    schema = to_arrow_schema(made)

    def batch(rows, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    def walk(batches):
        import numpy as np
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, True
        for ids, texts in common.slices(batches, SLICE):
            digits = prints(texts)
            if last:  # the row before this slice is compared with its first
                ids, texts, digits = [last[0], *ids], [last[1], *texts], np.concatenate([last[2][None], digits])
            out = [(part, "first", ids[0], len(texts[0]), _written(digits[0]), texts[0], *[None] * 6)] if first else []
            pairs = _compared(texts[:-1], digits[:-1], texts[1:], digits[1:])
            out += [(part, "whole", i, len(t), _written(d), None, *p) for i, t, d, p in zip(ids, texts, digits, pairs)]
            if out:
                yield batch(out, schema)
            last, first = (ids[-1], texts[-1], digits[-1]), False
        if last:
            yield batch([(part, "last", last[0], len(last[1]), _written(last[2]), last[1], *[None] * 6)], schema)

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = common.id_and_text(docs)
    rows = common.saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, made), "walks")
    whole = rows.filter("place = 'whole'")
    edge = rows.filter("place <> 'whole'")
    # one row a task: the first row of the next task that has rows, or of the first
    parts = [r.part for r in edge.filter("place = 'first'").select("part").orderBy("part").collect()]
    if not parts:
        return whole.drop("part", "place", "text")
    follows = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, after int")
    first = edge.filter("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("after_text"), F.col("fingerprint").alias("after_print"))
    seams = edge.filter("place = 'last'").join(follows, "part").join(first, "after").select("doc_id", "n_chars", "fingerprint", "text", "after_text", "after_print")

    out = StructType.fromDDL(f"doc_id {kind}, n_chars long, fingerprint string, {_PAIR}")
    seam_schema = to_arrow_schema(out)

    def settle(batches):
        for rows in batches:
            for r in rows.to_pylist():
                (pair,) = _compared([r["text"]], [digits(r["fingerprint"])], [r["after_text"]], [digits(r["after_print"])])
                yield batch([(r["doc_id"], r["n_chars"], r["fingerprint"], *pair)], seam_schema)

    return whole.drop("part", "place", "text").unionByName(seams.mapInArrow(settle, out))


def op12(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, and bands in common; nulls, ties and empty tables: see with_edits()."""
    out = with_edits(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_bands", "next_bands")
