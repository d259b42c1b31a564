"""Conversation structure repair: the cheapest edits that make roles follow a grammar.

The turns of a conversation and the states of a small grammar span a lattice
whose nodes are (turns read, state). Its edges, made only when a node is reached,
keep, re-role or delete the next turn or insert one. Dijkstra's search with
(cost, audit) as its key stops at the first accepting end node that it pops; the
audit (the edits' initials) settles ties.

Conversations of up to LONG turns are searched whole, one after the other, in a
stream of sorted rows. Longer ones are cut into pieces of PIECE turns, which any
tasks search from every state; only the pieces' costs and the order of their
audits meet, and the path through them is chosen there. This gives the same
result: a path with an inserted turn is never cheapest (deleting the neighbour
that it serves, and the system turn where no pair is left, costs at most 4 and
the insertion 5), so cheapest audits of a piece have one letter a turn, and the
least whole audit has the least piece for its states.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Role initials that lead from state to state for `(s?(ua)+)?`, and the accepting states.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPT = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Turns of a conversation that is searched whole, and of a piece of a longer one.
LONG = 1024
PIECE = 256


def _search(turns: list, start: int, ends: tuple, first: bool) -> dict:
    """End state to (cost, audit) over turns (initial, must go, truncated); only the first popped of ends if first."""
    heap, done, out, n = [(0, "", 0, start)], set(), {}, len(turns)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            out[state] = (cost, audit)
            if first or len(out) == len(ends):
                break
        if i < n:
            initial, gone, cut = turns[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                stays = cost + TRUNCATED * cut
                for role, to in STEPS[state].items():
                    if role == initial:
                        heapq.heappush(heap, (stays, audit + "K", i + 1, to))
                    if role in ROLES:
                        heapq.heappush(heap, (stays + REROLE, audit + "R", i + 1, to))
        for role, to in STEPS[state].items():
            if role in ROLES and (i, to) not in done:
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
    return out


def _applied(turns: list, audit: str, state: int) -> list:
    """(role, text) after the audit's edits of (role, text) turns from a state; an edit's new role follows from the state."""
    out, i = [], 0
    for edit in audit:
        role = next((r for r in STEPS[state] if r in ROLES), None)
        if edit == "I":
            out.append((ROLES[role], ""))
            state = STEPS[state][role]
            continue
        if edit == "K":
            out.append(turns[i])
            state = STEPS[state][turns[i][0][:1]]
        elif edit == "R":
            out.append((ROLES[role], turns[i][1]))
            state = STEPS[state][role]
        i += 1
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the contract's damage, null roles and texts as one space.

    One row per turn that is left (two for a repeated one, n 0 and 1), and turns
    that the damage drops as rows with gone true and no text, so that no
    conversation is lost. A null id or turn counts as one space in the hash.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")
    return rows.select("conv_id", "turn", copies, F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"))


def _with_faults(rows: DataFrame) -> DataFrame:
    """rows with blank and cut (truncated), which a turn's own text decides; the first fault that holds counts."""
    blank = ~F.col("text").rlike(common.WORD)
    return rows.withColumns({"blank": blank, "cut": ~blank & ~F.col("text").rlike(rf"[.!?]{common.WHITE}*\z")})


def _sorted_by() -> list:
    return ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "n"]


def _grouped(batches, names: list, most: int | None = None):
    """Lists of rows (as tuples) of one conv_id that follow each other, of at most `most` rows each."""
    held, of = [], None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in names]):
            if held and (row[0] != of or len(held) == most):
                yield held
                held = []
            of = row[0]
            held.append(row)
    if held:
        yield held


def _emit(rows, schema, each: int = 512):
    """Arrow batches of `each` rows from tuples."""
    import pyarrow as pa

    rows, held = iter(rows), []
    while True:
        held = [r for _, r in zip(range(each), rows)]
        if not held:
            return
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow(df: DataFrame, names: list, make, ddl: str, most: int | None = None) -> DataFrame:
    """df mapped by make(rows of one conversation) -> tuples, streamed in the order of its partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    common.ship(df.sparkSession)
    kind = StructType.fromDDL(ddl)
    schema = to_arrow_schema(kind)
    return df.select(*names).mapInArrow(lambda batches: _emit((out for rows in _grouped(batches, names, most) for out in make(rows)), schema), kind)


def _pairs(initials) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


LINES = "lines array<struct<role: string, text: string>>"


def _short(rows: DataFrame, kind: str) -> DataFrame:
    """One row per conversation of at most LONG turns, searched whole."""
    names = ["conv_id", "turn", "role", "text", "gone", "blank", "cut"]

    def make(held):
        live, seen, turns, counts = [r for r in held if not r[4]], set(), [], [0, 0, 0]
        for _, _, role, text, _, blank, cut in live:
            again = not blank and (role, text) in seen
            seen.add((role, text))
            turns.append((role[:1], blank or again, cut and not again))
            for i, fault in enumerate((blank, again, cut and not again)):
                counts[i] += fault
        at = [r[1] for r in live if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        ((cost, audit),) = _search(turns, 0, ACCEPT, True).values()
        fixed = _applied([(r[2], r[3]) for r in live], audit, 0)
        yield (held[0][0], gaps, *counts, _pairs([t[0] for t in turns]), cost, audit, [{"role": a, "text": b} for a, b in fixed])

    dealt = rows.repartition("conv_id").sortWithinPartitions(*_sorted_by())
    return _arrow(dealt, names, make, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {LINES}")


def _pieces(rows: DataFrame, kind: str) -> DataFrame:
    """Saved: pieces of long conversations in order (by piece), each with its faults, its turns and the best way between any two states.

    A turn is a duplicate if its role and text come earlier in its conversation:
    earliest places are found by a partial aggregation over a 128-bit hash of the
    text, and only those that occur again are joined back.
    """
    ordered = common.saved(rows.orderBy(*_sorted_by()).withColumn("place", F.monotonically_increasing_id()).withColumn("h", F.md5("text")), "conv-ordered")
    firsts = ordered.filter("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("x")).agg(F.min("place").alias("first"), F.count("*").alias("often")).filter("often > 1")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("x"))
    flagged = ordered.join(firsts, on, "left").withColumn("again", F.coalesce(F.col("place") > F.col("first"), F.lit(False)))
    names = ["conv_id", "place", "role", "text", "blank", "again", "cut"]

    def make(held):
        turns = [(r[2][:1], r[4] or r[5], r[6] and not r[5]) for r in held]
        ways = [(a, b, *best) for a in STEPS for b, best in _search(turns, a, tuple(STEPS), False).items()]
        order = {x: i for i, x in enumerate(sorted({w[3] for w in ways}))}
        keys = ("src", "dst", "cost", "audit", "rank")
        yield (held[0][0], held[0][1], *(sum(x) for x in zip(*[(r[4], r[5], r[6] and not r[5]) for r in held])), _pairs([t[0] for t in turns]), turns[0][0], turns[-1][0], [dict(zip(keys, (*w, order[w[3]]))) for w in ways], [{"role": r[2], "text": r[3]} for r in held])

    ddl = f"conv_id {kind}, piece long, blank long, duplicate long, truncated long, illegal long, head string, tail string, ways array<struct<src: int, dst: int, cost: long, audit: string, rank: int>>, {LINES}"
    out = common.saved(_arrow(flagged.repartitionByRange("place").sortWithinPartitions("place"), names, make, ddl, PIECE), "conv-pieces")
    common.discard(ordered)
    return out


def _chosen(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv_id, piece, src, dst, cost, seams) of the cheapest, least path through each conversation's pieces.

    Costs to the end are found backwards, then the way forward takes the least
    audit that keeps to them. One task holds a few numbers per piece.
    """
    import pandas as pd

    def choose(pdf):
        pdf = pdf.sort_values("piece")
        ways = [{(w["src"], w["dst"]): (w["cost"], w["rank"]) for w in x} for x in pdf["ways"]]
        far = float("inf")
        left = [{s: 0 if s in ACCEPT else far for s in STEPS}]
        for w in reversed(ways):
            left.append({s: min((c + left[-1][b] for (a, b), (c, _) in w.items() if a == s), default=far) for s in STEPS})
        left.reverse()
        state, path = 0, []
        for i, w in enumerate(ways):
            _, to = min((r, b) for (a, b), (c, r) in w.items() if a == state and c + left[i + 1][b] == left[i][state])
            path.append((state, to))
            state = to
        seams = [0, *[int(a + b not in LEGAL) for a, b in zip(pdf["tail"].iloc[:-1], pdf["head"].iloc[1:])]]
        return pd.DataFrame({"conv_id": pdf["conv_id"], "piece": pdf["piece"], "src": [p[0] for p in path], "dst": [p[1] for p in path], "seams": seams}, dtype=object)

    narrow = pieces.select("conv_id", "piece", "head", "tail", F.transform("ways", lambda w: F.struct(w.src.alias("src"), w.dst.alias("dst"), w.cost.alias("cost"), w.rank.alias("rank"))).alias("ways"))
    return narrow.groupBy("conv_id").applyInPandas(choose, f"conv_id {kind}, piece long, src int, dst int, seams long")


def _long(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Of conversations of over LONG turns: one row each, with the repaired text's hash, and their repaired pieces (saved)."""
    import hashlib

    live = rows.filter("NOT gone")
    pieces = _pieces(live, kind)
    path = _chosen(pieces, kind).withColumnsRenamed({"conv_id": "c", "piece": "p"})
    both = pieces.join(path, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    way = F.filter("ways", lambda w: (w.src == F.col("src")) & (w.dst == F.col("dst")))[0]
    both = both.withColumns({"cost": way.cost, "audit": way.audit, "illegal": F.col("illegal") + F.col("seams")})
    names = ["conv_id", "piece", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "src", "lines"]

    def fix(held):
        for r in held:
            fixed = _applied([(x["role"], x["text"]) for x in r[9]], r[7], r[8])
            yield (*r[:8], [{"role": a, "text": b} for a, b in fixed])

    ddl = f"conv_id {kind}, piece long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {LINES}"
    fixed = common.saved(_arrow(both, names, fix, ddl, 1), "conv-fixed")

    def digest(batches):
        of, hashed, audits = None, None, []
        for batch in batches:
            for conv, audit, lines in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines")]):
                if hashed is None or conv != of[0]:
                    if hashed:
                        yield (of[0], "".join(audits), hashed.hexdigest())
                    of, hashed, audits, empty = (conv,), hashlib.sha256(), [], True
                audits.append(audit)
                for x in lines:
                    hashed.update(f"{'' if empty else chr(10)}{x['role']}:{x['text']}".encode())
                    empty = False
        if hashed:
            yield (of[0], "".join(audits), hashed.hexdigest())

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(f"conv_id {kind}, audit string, repaired_sha256 string")
    schema = to_arrow_schema(out)
    dealt = fixed.select("conv_id", "piece", "audit", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    hashes = dealt.mapInArrow(lambda b: _emit(digest(b), schema, 1), out).withColumnRenamed("conv_id", "h")
    sums = fixed.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    span = live.groupBy(F.col("conv_id").alias("g")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    whole = sums.join(hashes, F.col("conv_id").eqNullSafe(F.col("h"))).join(span, F.col("conv_id").eqNullSafe(F.col("g"))).drop("h", "g")
    ids = rows.select(F.col("conv_id").alias("i")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = ids.join(whole, F.col("conv_id").eqNullSafe(F.col("i")), "left").select(F.col("i").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return whole, fixed


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows of short and of long conversations (None where there are none), with faults."""
    rows = _with_faults(rows)
    many = rows.groupBy(F.col("conv_id").alias("many")).count().filter(F.col("count") > LONG).select("many")
    if many.isEmpty():
        return rows, None
    on = F.col("conv_id").eqNullSafe(F.col("many"))
    return rows.join(many, on, "left_anti"), rows.join(many, on, "left_semi")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, and optionally n and gone, see damaged).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Null roles and texts count as one space; null ids are one
    conversation; null turns come first; turns of one number go by role and text.
    A conversation without rows that stay has zeros, an empty audit and the hash
    of an empty string. Other columns are left alone; an empty table gives an empty one.
    """
    short, long = _split(_whole(rows))
    kind = dict(rows.dtypes)["conv_id"]
    text = F.concat_ws("\n", F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)))
    out = _short(short, kind).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    return out if long is None else out.unionByName(_long(long, kind)[0])


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (ascending in a conversation), role, text."""
    short, long = _split(_whole(rows))
    kind = dict(rows.dtypes)["conv_id"]
    parts = _short(short, kind).select("conv_id", F.lit(0).cast("long").alias("piece"), "lines")
    if long is not None:
        parts = parts.unionByName(_long(long, kind)[1].select("conv_id", "piece", "lines"))
    return parts.select("conv_id", "piece", F.posexplode("lines").alias("at", "line")).select("conv_id", (F.col("piece") + F.col("at")).alias("place"), "line.role", "line.text")


def _whole(rows: DataFrame) -> DataFrame:
    """The columns that the search reads, with n and gone where the caller has none."""
    n = F.col("n") if "n" in rows.columns and "gone" in rows.columns else F.lit(0)
    gone = F.col("gone") if "n" in rows.columns and "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n"), gone.alias("gone"))


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every conv_id of conversations, damaged as it says.

    Nulls, ties, repeated rows and empty tables: see damaged() and repair().
    """
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
