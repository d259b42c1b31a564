"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of words with smallest period q, at least LEAST words and
TIMES periods long, that no neighbouring word extends. A run of period q overlaps
its own shift by q in max(LEAST - q, (TIMES - 1) * q) words or more, whose least
value over all q is k. So each word of a run lies in a k-gram that occurs again in
its document, and words outside such k-grams cannot join runs. The words that are
left form segments, which are far apart in most texts and short.

Main and Lorentz halve a segment again and again; a run that crosses a middle is
found from how far the words before and after it agree with those q further on.
Here all middles of one level, of all segments of a slice of texts, are settled
at once by numpy: agreement is measured by doubling hashes of 2^j words, and
every run found is compared word by word before it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 24
TIMES = 3

#: 2^j for the longest hashed stretch; longer agreement is measured in steps of it, so memory stays linear.
_TOP = 12


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """k: words that any run shares with its own shift by a period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _mixed(a, b):
    """A 64-bit hash of pairs."""
    import numpy as np

    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _grams(ids, top: int) -> list:
    """Hashes of the 1, 2, 4, ..., 2^top words that start at each place."""
    import numpy as np

    out = [_mixed(ids.astype(np.uint64), np.zeros(1, np.uint64))]
    for j in range(top):
        step = 1 << j
        if len(out[-1]) <= step:
            break
        out.append(_mixed(out[-1][:-step], out[-1][step:]))
    return out


def _gram(levels: list, k: int):
    """Hashes of the k words at each place, from two overlapping stretches of a power of two."""
    j = k.bit_length() - 1
    n = max(0, len(levels[0]) - k + 1)
    return _mixed(levels[j][:n], levels[j][k - (1 << j) :][:n])


def surviving(ids, k: int):
    """Starts and ends of the segments of words that lie in k-grams found twice or more in ids (one document)."""
    import numpy as np

    none = np.empty(0, np.int64)
    if len(ids) <= k:
        return none, none
    grams = _gram(_grams(ids, k.bit_length() - 1), k)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return none, none
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    marks = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + k, -1)
    inside = np.diff(np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)


def _agree(levels: list, a, b, back: bool):
    """Words that agree from places a and b (b > a) onwards, or before them if back."""
    import numpy as np

    n, total = len(levels[0]), np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for j in range(len(levels) - 1, -1, -1):
        step = 1 << j
        todo = live
        while len(todo):
            x, y = (a[todo] - total[todo] - step, b[todo] - total[todo] - step) if back else (a[todo] + total[todo], b[todo] + total[todo])
            fits = (x >= 0) if back else (y + step <= n)
            todo, x, y = todo[fits], x[fits], y[fits]
            todo = todo[levels[j][x] == levels[j][y]]
            total[todo] += step
            if j < len(levels) - 1:
                break
    return total


def main_lorentz(words, starts, ends, least: int, times: int) -> list:
    """Runs (start, end, period), sorted, inside segments [start, end) of words.

    words: whole numbers, other than at a segment's end, where a number of its own
    stands that ends any agreement.
    """
    import numpy as np

    levels = _grams(words, _TOP)
    probe = max(0, (overlap(least, times) // 2).bit_length() - 1)
    found, length, half = [], ends - starts, 1 << max(1, (least - 1).bit_length() - 2)
    while half < length.max(initial=0):
        nodes = (length + half - 1) // (2 * half)  # middles at odd multiples of half
        seg = np.repeat(np.arange(len(starts)), nodes)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        middle = starts[seg] + (2 * nth + 1) * half
        widest = max(1, 2 * half // times)
        for block in range(0, len(middle), max(1, 2_000_000 // widest)):
            m = middle[block : block + max(1, 2_000_000 // widest)]
            lo, hi = (x[seg[block : block + len(m)]] for x in (starts, ends))
            q = np.tile(np.arange(1, widest + 1), len(m))
            m, lo, hi = (np.repeat(x, widest) for x in (m, lo, hi))
            for shift in (0, 1):  # the period's first copy behind the middle, or ahead of it
                x, y = m - shift * q, m + q - shift * q
                ok = (x >= lo) & (y < hi)
                size, n = 1 << probe, len(levels[probe])
                ahead = ok & (y < n) & (levels[probe][np.minimum(x, n - 1).clip(0)] == levels[probe][np.minimum(y, n - 1)])
                behind = ok & (x >= size) & (levels[probe][(x - size).clip(0, n - 1)] == levels[probe][(y - size).clip(0, n - 1)])
                at = np.flatnonzero(ahead | behind)
                a = x[at] - _agree(levels, x[at], y[at], True)
                b = y[at] + _agree(levels, x[at], y[at], False)
                long = (b - a >= least) & (b - a >= times * q[at])
                found.append(np.stack([a[long], b[long], q[at][long]], axis=1))
        half *= 2
    if not found:
        return []
    rows = np.unique(np.concatenate(found), axis=0)
    out, last = [], None
    for a, b, q in rows.tolist():  # of one stretch the smallest period counts; multiples of it come after it
        if (a, b) != last and np.array_equal(words[a : b - q], words[a + q : b]):
            out.append((a, b, q))
            last = (a, b)
    return out


def _work(least: int, times: int):
    """Function from texts to (runs as tuples start, length, period; words that stay, joined by a space)."""
    import itertools

    import numpy as np

    k = overlap(least, times)

    def work(texts: list) -> list:
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # splits at the contract's white space, bytes only
        parts, place, sizes = [], [], []
        for doc, w in enumerate(words):
            first: dict = {}
            ids = np.fromiter(map(first.setdefault, w, itertools.count()), np.int64, len(w))
            for a, b in zip(*surviving(ids, k)):
                if b - a >= least:
                    parts.append(ids[a:b])
                    place.append((doc, int(a)))
                    sizes.append(int(b - a))
        runs: list = [[] for _ in texts]
        if parts:
            ends = np.cumsum(np.array(sizes) + 1) - 1
            starts = ends - np.array(sizes)
            flat = np.empty(int(ends[-1]) + 1, np.int64)
            for i, p in enumerate(parts):
                flat[starts[i] : ends[i]] = p
                flat[ends[i]] = -1 - i
            for a, b, q in main_lorentz(flat, starts, ends, least, times):
                i = int(np.searchsorted(starts, a, side="right")) - 1
                doc, at = place[i]
                runs[doc].append((a - int(starts[i]) + at, b - a, q))
        out = []
        for w, found in zip(words, runs):
            found.sort(key=lambda r: (r[0], r[2]))
            if found:
                cover = np.zeros(len(w) + 1, np.int64)
                for start, length, period in found:
                    cover[start + period] += 1
                    cover[start + length] -= 1
                w = list(itertools.compress(w, (np.cumsum(cover[:-1]) == 0).tolist()))
            out.append((found, b" ".join(w).decode("utf-8", "surrogatepass")))
        return out

    return work


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, runs (array of start, length, period; by start, then period), collapsed.

    collapsed: the words outside runs and those of each run's first period, joined
    by one space. Null and empty texts have no words, no runs and an empty
    collapsed text. Rows are on their own: null or repeated ids, equal rows and
    other columns don't matter; an empty table gives an empty one. Memory follows
    the longest text.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    # half a slice: a text's words are held as objects, several times the size of their bytes
    out = common.map_texts(rows, lambda: _lists(_work(least, times)), "starts array<long>, lengths array<long>, periods array<long>, collapsed string", common.SLICE_BYTES // 2)
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r.starts.alias("start"), r.lengths.alias("length"), r.periods.alias("period")))
    return out.select("doc_id", runs.alias("runs"), "collapsed")


def _lists(work):
    """work with the runs of a text as three lists, which Arrow takes as columns."""

    def columns(texts: list) -> list:
        return [([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], kept) for runs, kept in work(texts)]

    return columns


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, with the contract's periods planted in every tenth document, by the hash of its id.

    A null id counts as the hash of an empty string; a null text stays without words.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(common.text_or_empty(), common.WHITE + "+"), lambda w: w != "")
    rows = docs.select("doc_id", common.text_or_empty().alias("text"), h.alias("h"))
    hit = rows.filter("h % 10 = 0").withColumn("w", words).withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    hit = hit.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")).otherwise(0))
    hit = hit.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.concat_ws(" ", F.expr("transform(w, (x, i) -> if(i < a, x, get(w, CAST(a + (i - a) % p AS INT))))"))
    return rows.filter("h % 10 <> 0").select("doc_id", "text").unionByName(hit.select("doc_id", text.alias("text")))


def _best(runs: str) -> Column:
    """The first run of greatest length / period, compared as fractions; null where there is none."""
    none = F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def op11(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents, with periods planted as it says; nulls, ties and empty tables: see periodic_runs()."""
    out = periodic_runs(planted(common.documents(spark, sf_dir))).withColumn("best", _best("runs"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
