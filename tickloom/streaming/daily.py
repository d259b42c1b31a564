"""A day's check as one report: files against their manifests, doubled keys, and books replayed against the stored ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, tables
from ..sources.shared import cut
from . import book

COUNTS = {"matched": "matched", "mismatched": "mismatched", "only_left": "only_in_replay", "only_right": "only_in_store"}


def stored_books(spark: SparkSession, root: str, symbol: str, day: str, top: int = 20) -> DataFrame | None:
    """(symbol, session, epoch, u, recv, bid_px, bid_qty, ask_px, ask_qty) of a stored day's valid books, levels that are there; None without files.

    Rows keep their session, by which load() doesn't tell them apart.
    """
    spark.conf.set("spark.sql.caseSensitive", "true")  # u and U
    d = tables._stored(spark, root, "book_top20", symbol, day, day, None)
    if d is None:
        return None
    side = lambda name: F.array_compact(F.array(*[F.col(f"{name}_{i}").cast("double") for i in range(top)])).alias(name)
    valid = d.filter("is_valid") if "is_valid" in d.columns else d
    return valid.select("symbol", F.col("session_id").alias("session"), F.col("book_epoch").alias("epoch"), "u", F.col("recv_time_ns").alias("recv"), *map(side, ("bid_px", "bid_qty", "ask_px", "ask_qty")))


def replayed_day(spark: SparkSession, raw: str, store: str, day: str, specs: dict[str, tuple[str, str]], top: int = 20, **options) -> DataFrame:
    """(symbol, session, status, n, deterministic) of a day's books replayed twice from raw and held against the store, over all symbols.

    specs: symbol to (tick, step). status as in COUNTS; a symbol without a session has no row.
    """
    out = []
    for symbol, (tick, step) in specs.items():
        messages = cut(tables.raw_messages(spark, raw, symbol, day))
        once, again = (cut(book.replay(messages, tick, step, top=top, **options)) for _ in range(2))
        own = stored_books(spark, store, symbol, day, top)
        found = book.replay_against(once, own if own is not None else once.limit(0)).groupBy("symbol", "session", "status").agg(F.count("*").alias("n"))
        pair = book.replay_digest(once).select("symbol", "session", F.struct("n", "digest").alias("__x")).join(book.replay_digest(again).select("symbol", "session", F.struct("n", "digest").alias("__y")), ["symbol", "session"], "full")
        same = pair.select("symbol", "session", F.col("__x").eqNullSafe(F.col("__y")).alias("deterministic"))
        # a session whose messages gave no book counts as well, with nothing compared
        sessions = messages.select("symbol", "session").distinct().join(found, ["symbol", "session"], "left").join(same, ["symbol", "session"], "left")
        out.append(sessions.withColumn("deterministic", F.coalesce("deterministic", F.lit(True))))
    empty = spark.createDataFrame([], "symbol string, session string, status string, n long, deterministic boolean")
    for d in out:
        empty = empty.unionByName(d)
    return empty


def day_report(spark: SparkSession, raw: str, store: str, day: str, specs: dict[str, tuple[str, str]], recorded: DataFrame, keyed: dict[str, tuple[DataFrame, list[str]]], glob: str = "*.jsonl*", **options) -> dict:
    """The report of a day: {day, ok, verify: rows of files.verify_day, replay: counts per symbol}.

    A symbol is well if it has a session, and in each of them rows were compared,
    none mismatched, and both replays were equal. The day is well if all parts are.
    Only counts reach the driver: a few rows per table, symbol and session.
    """
    base = f"{raw}/raw" if tables.exists(spark, f"{raw}/raw") else raw
    verify = [r.asDict() for r in files.verify_day(spark, base, recorded, keyed, glob).orderBy("what", "status").collect()]
    replay = {s: {"sessions": {}, **dict.fromkeys(COUNTS.values(), 0)} for s in specs}
    for r in replayed_day(spark, raw, store, day, specs, **options).orderBy("symbol", "session", "status").collect():
        own = replay[r.symbol]["sessions"].setdefault(str(r.session), {"deterministic": r.deterministic, **dict.fromkeys(COUNTS.values(), 0)})
        if r.status is not None:
            own[COUNTS[r.status]] += r.n
            replay[r.symbol][COUNTS[r.status]] += r.n
    for s in replay.values():
        s["ok"] = bool(s["sessions"]) and all(o["deterministic"] and o["matched"] > 0 and o["mismatched"] == 0 for o in s["sessions"].values())
    ok = all(r["ok"] for r in verify) and all(s["ok"] for s in replay.values())
    return {"day": day, "ok": ok, "verify": verify, "replay": replay}


def as_markdown(report: dict) -> str:
    """A day's report as two Markdown tables under a line that says whether all is well."""
    out = [f"# Day {report['day']}: {'ok' if report['ok'] else 'FAILED'}", "", "| what | status | n | ok |", "|---|---|---|---|"]
    out += [f"| {r['what']} | {r['status']} | {r['n']} | {r['ok']} |" for r in report["verify"]]
    names = list(COUNTS.values())
    out += ["", f"| symbol | sessions | {' | '.join(names)} | ok |", "|---" * (len(names) + 3) + "|"]
    out += [f"| {s} | {len(v['sessions'])} | {' | '.join(str(v[n]) for n in names)} | {v['ok']} |" for s, v in sorted(report["replay"].items())]
    return "\n".join(out) + "\n"


def day_job(spark: SparkSession, reports: str, day: str, **parts) -> bool:
    """Write verify_<day>.json and .md in the folder of reports, each put in place whole; whether the day is well."""
    report = day_report(spark, day=day, **parts)
    files.put_text(spark, f"{reports}/verify_{day}.json", json.dumps(report, indent=1))
    files.put_text(spark, f"{reports}/verify_{day}.md", as_markdown(report))
    return report["ok"]
