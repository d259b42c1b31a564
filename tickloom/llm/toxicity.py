"""Toxicity: maximal scoring segments of token log-odds, calibrated by extreme values.

Words get the log-odds of toxic against other documents under an informative
Dirichlet prior; words whose log-odds aren't significant share one slightly
negative score. A linear scan finds all maximal scoring segments of a text. A
segment's score becomes an E-value, the number of such segments expected by
chance in a text of that length, from the extreme-value law of segment scores;
what the segments exceed chance by is summed and mapped to a probability.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows, at most, that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Least z-score of a word's log-odds, and least number of documents with it.
LEAST_Z, LEAST_DOCS = 3.4, 3
#: Weight of the prior: documents' words in proportion to the corpus, and of each word.
PRIOR, LEAST_PRIOR = 500.0, 0.5
#: Letters of a stem; words with no score of their own take that of their stem.
STEM = 6
#: E-value below which a passage counts as significant.
LEAST_E = 0.05
_WORD = re.compile(r"[^\W\d_]+")
PASSAGES = "array<struct<start:int,end:int,score:double,e_value:double>>"


def is_held_out(doc_id):
    """crc32 of the id as text, mod 3, is 1: such rows' labels are never learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def segments(scores: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of n tokens, in linear time.

    scores: (index, score) of the tokens with scores of their own, ascending;
    every other token scores `other` < 0. Gives (first, last, score), the
    segments that no neighbour can extend to a higher sum.
    """
    held: list[list] = []  # [left sum, right sum, first, last, index of the nearest with a smaller left sum]
    total, at = 0.0, 0
    for i, s in scores:
        total += other * (i - at)
        at = i + 1
        if s <= 0:
            total += s
            continue
        new = [total, total + s, i, i]
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j = held[j][4]
            if j < 0 or held[j][1] >= new[1]:
                held.append([*new, j])
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(x[2], x[3], x[1] - x[0]) for x in held]


class Model:
    """Word scores, the score of other words, and the calibration."""

    def __init__(self, words: dict[str, float], other: float, lam: float = 1.0, k: float = 1.0, a: float = 0.0, b: float = -3.0):
        self.words, self.other, self.lam, self.k, self.a, self.b = words, other, lam, k, a, b
        self.known: dict = {}

    def passages(self, text: str) -> tuple[list[tuple], int]:
        """(start, end, score) of maximal segments, and the number of tokens."""
        tokens = _WORD.findall(text.lower())
        found = self.segments_of(tokens)
        if not found:
            return [], len(tokens)
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lowered; offsets stay those of the text
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        ends = {i for a, b, _ in found for i in (a, b)}
        at = {i: m for i, m in enumerate(_WORD.finditer(low)) if i in ends}
        return [(at[a].start(), at[b].end(), s) for a, b, s in found if a in at and b in at], len(tokens)

    def segments_of(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        known = self.known
        found = []
        for i, w in enumerate(tokens):
            s = known.get(w, 0)
            if s == 0:
                if len(known) > 500_000:
                    known.clear()
                s = known[w] = self.words.get(w, self.words.get("^" + w[:STEM]) if len(w) > STEM else None)
            if s is not None:
                found.append((i, s))
        return segments(found, len(tokens), self.other)

    def excess(self, scores: list[float], n: int) -> float:
        """What segments score above chance in n tokens, summed: -log of each E-value below 1."""
        base = math.log(max(self.k, 1e-12) * max(n, 1))
        return sum(max(0.0, self.lam * s - base) for s in scores)

    def probability(self, excess: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.a * math.log1p(excess) + self.b))))


def _decay(words: dict[str, tuple[float, float]], other: float, rest: float) -> float:
    """Root above 0 of sum p exp(lam s) = 1 over the background, by bisection."""
    f = lambda x: rest * math.exp(x * other) + sum(p * math.exp(min(700.0, x * s)) for s, p in words.values()) - 1
    lo, hi = 1e-6, 1.0
    if f(lo) >= 0:
        return 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _logistic(xs: list[float], ys: list[int]) -> tuple[float, float]:
    """Slope (0 at least) and intercept of P(y | x), with a weak prior, by Newton steps."""
    a, b = 0.0, math.log((sum(ys) + 0.5) / (len(ys) - sum(ys) + 0.5))
    for _ in range(50):
        g = [-0.01 * a, -0.01 * b]
        h = [[0.01, 0.0], [0.0, 0.01]]
        for x, y in zip(xs, ys):
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + b))))
            g[0] += (y - p) * x
            g[1] += y - p
            w = p * (1 - p)
            h[0][0] += w * x * x
            h[0][1] += w * x
            h[1][1] += w
        det = h[0][0] * h[1][1] - h[0][1] ** 2
        if det <= 1e-12:
            break
        da, db = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
    return max(0.0, a), b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labels (doc_id, toxic) on the texts; held-out rows aren't used.

    At most SAMPLE_ROWS labelled rows, those with the smallest hashed ids, are
    used; of an id labelled more than once, the largest label. Ids may be of any
    type, the same in both tables; null ids and labels aren't used. Without
    labels of both kinds, every text gets the same low score.
    """
    spark = docs.sparkSession
    own = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~is_held_out(F.col("doc_id")))
    picked = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).collect()
    if len({r.toxic for r in picked}) < 2:
        return Model({}, -1.0)
    sample = spark.createDataFrame([(r.doc_id, int(r.toxic)) for r in picked], f"i {dict(labels.dtypes)['doc_id']}, toxic int")
    rows = common.id_and_text(docs, id_col, text_col)
    rows = common.saved(rows.join(F.broadcast(sample), F.col("doc_id") == F.col("i")).select("doc_id", "text", "toxic"), "toxic-sample")
    # Each document counts once for a word, so a text that repeats a word can't carry it.
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    stems = F.transform(F.filter(split, lambda w: F.length(w) > STEM), lambda w: F.concat(F.lit("^"), F.left(w, F.lit(STEM))))
    words = rows.select("toxic", F.explode(F.array_distinct(F.concat(split, stems))).alias("word")).filter("word <> ''")
    totals = words.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = float(totals[0] or 0), float(totals[1] or 0)
    counts = words.groupBy("word").agg(F.sum("toxic").alias("y1"), F.count("*").alias("y")).filter(F.col("y1") >= LEAST_DOCS).collect()  # bounded by the sample
    n0 = n - n1
    chosen = {}
    for r in counts:
        y1, y0, prior = float(r.y1), float(r.y - r.y1), LEAST_PRIOR + PRIOR * r.y / n
        odds = math.log((y1 + prior) / (n1 + PRIOR - y1)) - math.log((y0 + prior) / (n0 + PRIOR - y0))
        if odds / math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)) >= LEAST_Z:
            chosen[r.word] = (odds, y1, y0)
    if not chosen:
        return Model({}, -1.0)
    in1, in0 = sum(x[1] for x in chosen.values()) / n1, sum(x[2] for x in chosen.values()) / n0
    other = min(-1e-3, math.log((1 - in1) / (1 - in0)))
    lam = _decay({w: (x[0], x[2] / n0) for w, x in chosen.items()}, other, 1 - in0)
    model = Model({w: x[0] for w, x in chosen.items()}, other, lam)
    scored = [(r.toxic, r.scores, r.n) for r in _segments(rows, model).join(F.broadcast(sample), F.col("doc_id") == F.col("i")).select("toxic", "scores", "n").collect()]
    best = [(max(s, default=0.0), m) for y, s, m in scored if not y and m]
    # Location of the extreme-value law: the mean of lam S - log n over other documents.
    model.k = math.exp(sum(lam * s - math.log(m) for s, m in best) / len(best) - 0.5772) if best else 1.0
    model.a, model.b = _logistic([math.log1p(model.excess(s, m)) for _, s, m in scored], [y for y, _, _ in scored])
    return model


def _segments(rows: DataFrame, model: Model) -> DataFrame:
    parts = (model.words, model.other)

    def make():
        own = Model(*parts)

        def work(text):
            tokens = _WORD.findall(text.lower())
            return ([s for _, _, s in own.segments_of(tokens)], len(tokens))

        return lambda texts: [work(t) for t in texts]

    return common.map_texts(rows, make, "scores array<double>, n long")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score in [0, 1], passages.

    passages: significant segments (E-value at most LEAST_E) with offsets in code
    points. The score depends on the text alone; null and empty texts get the
    score of a text without toxic words. Repeated rows are scored alike.
    """
    parts = (model.words, model.other, model.lam, model.k, model.a, model.b)

    def make():
        own = Model(*parts)

        def work(text):
            found, n = own.passages(text)
            expected = [own.k * max(n, 1) * math.exp(-min(700.0, own.lam * s)) for _, _, s in found]
            out = [{"start": a, "end": b, "score": s, "e_value": e} for (a, b, s), e in zip(found, expected) if e <= LEAST_E]
            return own.probability(own.excess([s for _, _, s in found], n)), out

        return lambda texts: [work(t) for t in texts]

    return common.map_texts(common.id_and_text(docs, id_col, text_col), make, f"score double, passages {PASSAGES}")


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
