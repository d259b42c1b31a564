"""Removal of repeated substrings by prefix-free parsing.

A rolling hash over GRAM bytes sets triggers: of every WINDOW-byte string, the
gram with the smallest hash is its trigger, whatever stands around the string.
The windows with one trigger form a phrase (their bytes overlap the next
phrase's), so every window lies in one phrase wholly and equal windows lie in
phrases of the same trigger, at the same place. The corpus is the sequence of
phrases (the parse), and the dictionary holds each distinct phrase once.

Of a phrase that occurs again, all occurrences but the first of the parse repeat
wholly. Of the dictionary, only phrases that share a trigger can share windows.
Their suffixes that begin at triggers, and their reversed prefixes that end
there, are sorted by bytes into suffix arrays with common-prefix lengths: two
windows are equal when both sides agree for as long as the window reaches. The
suffix arrays put equal windows side by side, the parse gives them corpus order,
and all but the first are repeats. Windows don't leave phrases, so of the parse
its order is needed and not what follows a phrase. Phrases that are alone with
their trigger, nearly all of a corpus, are never looked at.

Whole phrases are told apart by 64 bits of their trigger and 128 of their
content (at 10^13 phrases a wrong match has a chance below 10^-12), windows by
their bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string, and of the grams whose hashes set triggers.
WINDOW, GRAM = 100, 40
#: Bytes at most of a window ahead of its trigger.
AHEAD = WINDOW - GRAM
#: Phrases that one bucket of triggers holds on average, and bits of a bucket at least.
BUCKET_PHRASES, LEAST_BITS = 150_000, 6
#: Dictionary phrases that one bucket of the suffix arrays holds on average.
BUCKET_SORTED = 50_000
#: Distinct phrases from which on a trigger's windows are dealt one by one, by their bytes.
HOT_PHRASES = 50_000
#: Bytes of text whose phrases a task holds at a time, and that are hashed at a time.
SLICE_PARSED, BLOCK = 8_000_000, 500_000
#: Bytes of phrases that a task deals at a time, and of texts that it cuts at a time.
SLICE_DEALT, SLICE_CUT = 8_000_000, 4_000_000
REPEAT, CHECK, HOT = 0, 1, 2

_powers: dict[int, tuple] = {}


def _tables(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of the k-th hash's base, and powers of its inverse."""
    if k not in _powers:
        base = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[k]
        with np.errstate(over="ignore"):
            up = np.full(BLOCK + 2 * WINDOW + 1, base, np.uint64)
            down = np.full(len(up), pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            value = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * k))
            _powers[k] = value, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[k]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(data: np.ndarray, k: int) -> np.ndarray:
    value, up, _ = _tables(k)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * _tables(k)[2][start])


def _smallest(h: np.ndarray, n: int) -> np.ndarray:
    """Index of the leftmost smallest of h[i : i + n], for every i."""
    value, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width * 2 <= n:
        right = value[width:] < value[:-width]
        at = np.where(right, at[width:], at[:-width])
        value = np.minimum(value[width:], value[:-width])
        width *= 2
    if width < n:
        gap = n - width
        at = np.where(value[gap:] < value[:-gap], at[gap:], at[:-gap])
    return at


def phrases(pieces: list[tuple[int, int, bytes]]):
    """Phrases of a block in corpus order: arrays trigger, content (two), doc, lo, gram, last.

    pieces: (document, offset, bytes), of BLOCK bytes together. lo is the first
    window start in the document; from there gram is the distance to the trigger
    and last that to the last window start.
    """
    pieces = [p for p in pieces if len(p[2]) >= WINDOW]
    if not pieces:
        return None
    with np.errstate(over="ignore"):
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        sums = _sums(data, 0)
        hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * _tables(0)[2][: len(sums) - GRAM])
        at = _smallest(hashes, AHEAD + 1)  # one for each window start
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(at)]
        inside = np.arange(len(at)) + WINDOW <= ends[piece]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])))
        starts = np.flatnonzero(inside & new)
        stops = np.flatnonzero(inside & np.concatenate((new[1:] | ~inside[1:], [True])))
        q = at[starts]
        place = mixed((q - starts).astype(np.uint64) * np.uint64(1009) + (stops - starts).astype(np.uint64) + np.uint64(7))
        content = _hash(sums, starts, stops + WINDOW, 0) ^ place
        other = _hash(_sums(data, 1), starts, stops + WINDOW, 1) ^ place
        piece = piece[starts]
        shift = np.array([p[1] for p in pieces]) - (ends - sizes)
        docs = np.array([p[0] for p in pieces], np.int64)
        return hashes[q], content, other, docs[piece], (starts + shift[piece]).astype(np.int32), (q - starts).astype(np.int8), (stops - starts).astype(np.int8)


def _pieces(rows: list[tuple[int, bytes]]):
    """Blocks of pieces; a long text is cut into pieces that overlap by a window less a byte."""
    block, held = [], 0
    for doc, data in rows:
        for a in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
            part = data[a : a + BLOCK + WINDOW - 1]
            if held + len(part) > BLOCK and block:
                yield block
                block, held = [], 0
            block.append((doc, a, part))
            held += len(part)
    if block:
        yield block


_PHRASE = {"triggers": pa.int64(), "contents": pa.int64(), "others": pa.int64(), "docs": pa.int64(), "los": pa.int32(), "grams": pa.int8(), "lasts": pa.int8()}
_DONE = {"done_docs": pa.int64(), "done_los": pa.int32(), "done_his": pa.int32()}
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.int8(): "byte"}
COLUMNS = "bucket int, " + ", ".join(f"{c} array<{_DDL[k]}>" for c, k in (_PHRASE | _DONE).items())


def _lists(buckets: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of COLUMNS: one per run of equal buckets, each column a list, the others empty."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    starts = np.concatenate(([0], edges))
    full, none = pa.array(np.concatenate((starts, [len(buckets)])), pa.int32()), pa.array(np.zeros(len(starts) + 1, np.int32))
    out = [pa.array(buckets[starts].astype(np.int32))]
    for name, kind in (_PHRASE | _DONE).items():
        x = columns.get(name)
        if x is None:
            out.append(pa.ListArray.from_arrays(none, pa.array([], kind)))
        else:
            out.append(pa.ListArray.from_arrays(full, pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, kind)))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *_PHRASE, *_DONE])


def _flat(table: pa.Table, names) -> list[np.ndarray]:
    """The lists of each column, one after the other."""
    out = []
    for c in names:
        parts = [x.flatten() for x in table.column(c).chunks]
        out.append(np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0, np.int64))
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row of sorted columns differs from the one ahead; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _later(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows that start later than the first of their class: not the same place, as of repeated rows of one id."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return ~new & ((doc != doc[first]) | (place != place[first]))


def _local(rows: list[tuple[int, bytes]], bits: int):
    """Rows of COLUMNS for a slice of documents.

    The slice's first occurrence of a phrase goes to its trigger's bucket; later
    ones repeat whatever other slices hold, and are dealt by document, as runs.
    """
    rows.sort(key=lambda r: r[0])
    found = [f for block in _pieces(rows) if (f := phrases(block)) is not None]
    if not found:
        return
    columns = [np.concatenate(x) for x in zip(*found)]
    del found
    order = np.argsort(columns[0], kind="stable")  # corpus order within a trigger
    columns = [x[order] for x in columns]
    trigger, content, other, doc, lo, gram, last = columns
    start = _changes(trigger)
    often = np.flatnonzero(np.repeat(np.diff(np.append(np.flatnonzero(start), len(start))), np.diff(np.append(np.flatnonzero(start), len(start)))) > 1)
    first = np.ones(len(trigger), bool)
    if len(often):
        often = often[np.lexsort((other[often], content[often], trigger[often]))]
        new = _changes(trigger[often], content[often], other[often])
        first[often[~new]] = False
        again = often[_later(new, doc[often], lo[often])]
        if len(again):
            yield _lists(*_runs(doc[again], lo[again], lo[again] + last[again], bits))
    yield _lists((trigger[first] >> np.uint64(64 - bits)).astype(np.int32), dict(zip(_PHRASE, (x[first] for x in columns))))


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, dict]:
    """Buckets by document, and runs of window starts with neighbouring ones joined."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)))
    at = np.flatnonzero(new)
    doc, lo, hi = doc[at], lo[at], hi[np.append(at[1:], len(hi)) - 1]
    with np.errstate(over="ignore"):
        bucket = (mixed(doc.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], {"done_docs": doc[order], "done_los": lo[order], "done_his": hi[order].astype(np.int32)}


MARKS = "doc_id long, lo int, hi int, gram byte, key int, kind byte"


def _resolver(hot: int):
    """A function of one bucket's phrases to its marks: REPEAT runs, and dictionary phrases to sort."""

    def resolve(table: pa.Table) -> pa.Table:
        trigger, content, other, doc, lo, gram, last = _flat(table, _PHRASE)
        done_doc, done_lo, done_hi = _flat(table, _DONE)
        order = np.argsort(trigger, kind="stable")
        start = np.flatnonzero(_changes(trigger[order]))
        size = np.diff(np.append(start, len(order)))
        pick = order[np.repeat(size > 1, size)]
        trigger, content, other, doc, lo, gram, last = (x[pick] for x in (trigger, content, other, doc, lo, gram, last))
        order = np.lexsort((lo, doc, other, content, trigger))
        trigger, content, other, doc, lo, gram, last = (x[order] for x in (trigger, content, other, doc, lo, gram, last))
        new = _changes(trigger, content, other)
        of = np.cumsum(_changes(trigger)) - 1
        distinct = np.bincount(of, new)[of] if len(of) else np.zeros(0)
        key = (trigger.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        again, check = _later(new, doc, lo), new & (distinct > 1)
        kind = np.where(distinct > hot, HOT, CHECK).astype(np.int8)
        cat = lambda a, b, c: np.concatenate((a, b[again], c[check]))
        none = np.zeros(len(done_doc), np.int8)
        zero, hi = np.zeros(len(new), np.int8), (lo + last).astype(np.int32)
        columns = [cat(done_doc, doc, doc), cat(done_lo, lo, lo), cat(done_hi, hi, hi), cat(none, gram, gram), cat(none.astype(np.int32), key, key), cat(none, zero, kind)]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.int8()))], names=["doc_id", "lo", "hi", "gram", "key", "kind"])

    return resolve


def marks(rows: DataFrame, total_bytes: int, hot: int = HOT_PHRASES) -> DataFrame:
    """MARKS of (doc_id, text): runs of window starts that repeat, and dictionary phrases that share their trigger."""
    common.ship(rows.sparkSession)
    bits = max(LEAST_BITS, (total_bytes // 30 // BUCKET_PHRASES).bit_length())

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()))
                size += len(held[-1][1])
                if size > SLICE_PARSED:
                    yield from _local(held, bits)
                    held, size = [], 0
        yield from _local(held, bits)

    dealt = rows.select("doc_id", "text").mapInArrow(run, COLUMNS)
    return dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_resolver(hot), MARKS)  # tasks grow in number, not in size


DICTIONARY = "bucket int, docs array<long>, los array<int>, grams array<byte>, lasts array<byte>, content binary"


def _dealt(entries: list[tuple], bits: int):
    """A batch of DICTIONARY of (key, document, lo, gram, last, bytes): one row per bucket."""
    if not entries:
        return
    bucket = (np.array([e[0] for e in entries], np.int64) & 0xFFFFFFFF) >> (32 - bits)
    order = np.argsort(bucket, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
    out = {c: [] for c in ("bucket", "docs", "los", "grams", "lasts", "content")}
    for a, b in zip(edges, edges[1:]):
        mine = [entries[i] for i in order[a:b].tolist()]
        out["bucket"].append(int(bucket[order[a]]))
        for c, k in (("docs", 1), ("los", 2), ("grams", 3), ("lasts", 4)):
            out[c].append([e[k] for e in mine])
        out["content"].append(b"".join(e[5] for e in mine))
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.int8()), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _common(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many bytes each has in common with the one ahead of it there."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]).astype(np.int16)


def repeated(doc: np.ndarray, lo: np.ndarray, gram: np.ndarray, last: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, lo, hi): runs of window starts of dictionary phrases that also start earlier.

    content: the bytes of the phrases, one after the other; last + WINDOW of each.
    """
    gram, last = gram.astype(np.int64), last.astype(np.int64)
    size = last + WINDOW
    at = np.cumsum(size) - size
    order = np.lexsort((lo + gram, doc))  # the parse: corpus order
    doc, lo, gram, last, size, at = (x[order] for x in (doc, lo, gram, last, size, at))
    n, place = len(doc), lo + gram
    ahead, behind = -(-AHEAD // 8) * 8, -(-WINDOW // 8) * 8
    padded = np.concatenate((np.zeros(ahead, np.uint8), content, np.zeros(behind, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view
    right = view(padded, behind)[at + gram + ahead]
    right[np.arange(behind) >= (size - gram)[:, None]] = 0
    left = np.ascontiguousarray(view(padded, ahead)[at + gram][:, ::-1])
    left[np.arange(ahead) >= gram[:, None]] = 0
    (by_right, same_right), (by_left, same_left) = _common(right), _common(left)
    del right, left, padded
    hit = np.zeros((n, AHEAD + 3), np.int8)  # a column per window start from place - AHEAD on, between two empty ones
    side = np.empty((2, n), np.int64)
    for d in range(AHEAD + 1):  # windows that begin d bytes ahead of their trigger
        pick = np.flatnonzero((gram - last <= d) & (d <= gram))
        if len(pick) < 2:
            continue
        side[0, by_left] = np.concatenate(([0], np.cumsum(same_left < d)))
        side[1, by_right] = np.concatenate(([0], np.cumsum(same_right < WINDOW - d)))
        key = side[0, pick] * n + side[1, pick]
        o = np.argsort(key, kind="stable")
        again = pick[o[_later(_changes(key[o]), doc[pick[o]], place[pick[o]])]]
        hit[again, 1 + AHEAD - d] = 1
    edge = np.diff(hit, axis=1)
    row, first = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    return doc[row], place[row] - AHEAD + first, place[row] - AHEAD + stop - 1


def _sorted(table: pa.Table) -> pa.Table:
    columns = _flat(table, ("docs", "los", "grams", "lasts"))
    content = np.frombuffer(b"".join(x.as_py() for x in table.column("content")), np.uint8)
    out = repeated(*columns, content)
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "lo", "hi"])


def repeated_windows(held: DataFrame, n_phrases: int) -> DataFrame:
    """(doc_id, lo, hi): runs of window starts of held (doc_id, text, marks) that the suffix arrays find to repeat."""
    bits = max(LEAST_BITS, (n_phrases // BUCKET_SORTED).bit_length())

    def run(batches):
        entries, size = [], 0
        for batch in batches:
            own = batch.column(2)
            ends = own.offsets.to_numpy()
            ends = ends - ends[0]
            lo, hi, gram, key, kind = (own.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "gram", "key", "kind"))
            for i in range(batch.num_rows):
                pick = ends[i] + np.flatnonzero(kind[ends[i] : ends[i + 1]] != REPEAT)
                if not len(pick):
                    continue
                doc, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                for a, b, g, k, hot in zip(lo[pick].tolist(), hi[pick].tolist(), gram[pick].tolist(), key[pick].tolist(), (kind[pick] == HOT).tolist()):
                    if hot:
                        own_windows = [(data[s : s + WINDOW], s) for s in range(a, b + 1)]
                        entries += [(zlib.crc32(w), doc, s, a + g - s, 0, w) for w, s in own_windows]
                    else:
                        entries.append((k, doc, a, g, b - a, data[a : b + WINDOW]))
                    size += (b - a + 1) * WINDOW if hot else b - a + WINDOW
                if size > SLICE_DEALT:
                    yield from _dealt(entries, bits)
                    entries, size = [], 0
        yield from _dealt(entries, bits)

    dealt = held.select("doc_id", "text", "marks").mapInArrow(run, DICTIONARY)
    return dealt.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_sorted, "doc_id long, lo int, hi int")


def removed_runs(starts: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows cover, of their runs of starts (lo, hi)."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts):
        b = min(size, hi + WINDOW)
        if lo >= size:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([lo, b])
    return [(a, b) for a, b in out]


_CUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])


def _cut(batches):
    """(doc_id, spans, kept) of (doc_id, text, repeats, places)."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, text, *runs = (batch.column(c)[i].as_py() for c in range(4))
            data, at, parts = text.encode(), 0, []
            spans = removed_runs([(r["lo"], r["hi"]) for part in runs for r in part or []], len(data))
            for a, b in spans:
                parts.append(data[at:a])
                at = b
            rows.append({"doc_id": doc, "spans": [{"start": a, "end": b} for a, b in spans], "kept": b"".join([*parts, data[at:]])})
            held += len(data)
            if held > SLICE_CUT:
                yield pa.RecordBatch.from_pylist(rows, _CUT)
                rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, _CUT)


def _cuts(rows: DataFrame, hot: int = HOT_PHRASES) -> DataFrame:
    """(doc_id, spans, kept) of the documents of (doc_id, text) with repeats; doc_id unique longs in corpus order."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    found = common.saved(marks(rows, total, hot), "marks")
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "gram", "key", "kind")).alias("marks"))
    held = common.saved(rows.join(own, "doc_id"), "held")
    n = found.filter(F.col("kind") != REPEAT).count()
    common.discard(found)
    places = repeated_windows(held, n).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    repeats = F.filter("marks", lambda m: m["kind"] == REPEAT)
    cut = held.join(places, "doc_id", "left").select("doc_id", "text", repeats.alias("repeats"), "places")
    return cut.mapInArrow(_cut, "doc_id long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PHRASES) -> DataFrame:
    """One row per document with repeats: doc_id, spans array<struct<start, end>>, kept binary.

    A byte goes if a WINDOW-byte string covers it that also starts earlier, in a
    document of smaller id or ahead in the same one. Offsets are bytes of the
    UTF-8 text. Null and short texts have no such string. Every row is a
    document: null ids come last, and rows of one id follow in the order of
    their texts' hash, so all copies of a row but one go wholly. An empty table
    gives an empty table.
    """
    rows, same = common.numbered(common.id_and_text(docs, id_col, text_col))
    cut = _cuts(rows.select(F.col("key").alias("doc_id"), "text"), hot)
    return cut if same else cut.withColumnRenamed("doc_id", "key").join(rows.select("key", "doc_id"), "key").select("doc_id", "spans", "kept")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; rows as in remove_repeats."""
    rows, _ = common.numbered(common.id_and_text(docs, id_col, text_col))
    text = F.col("text")
    base = rows.select("key", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("__whole"))
    cut = _cuts(rows.select(F.col("key").alias("doc_id"), "text"))
    cut = cut.select(F.col("doc_id").alias("key"), F.size("spans").cast("long").alias("n_spans"), F.octet_length("kept").cast("long").alias("__kept"), F.sha2("kept", 256).alias("__sha"))
    out = base.join(cut, "key", "left")
    return out.select("doc_id", "n_bytes", F.coalesce(F.col("n_bytes") - F.col("__kept"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("__sha", "__whole").alias("kept_sha256"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return digests(common.documents(spark, sf_dir))


#: DuckDB SQL of op10: every window, those that start later than the first of their kind, and the runs they cover.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS s, unnest(list_transform(range(0, n - 99), lambda i: t[i + 1 : i + 100])) AS g FROM d WHERE n >= 100),
f AS (SELECT g, min(struct_pack(d := doc_id, s := s)) AS first FROM w GROUP BY g HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.s FROM w JOIN f USING (g) WHERE struct_pack(d := w.doc_id, s := w.s) > f.first),
i AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM r),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM i),
c AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM k GROUP BY doc_id, run),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM c),
x AS (SELECT o.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(hex(t[z + 1 : a]), '' ORDER BY a) AS kept, max(b) AS last FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || hex(t[coalesce(last, 0) + 1 : n]))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
