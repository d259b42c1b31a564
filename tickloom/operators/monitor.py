"""What a feed's records say of its quality: validation, counters, clocks, gaps and health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dedup


def aggressor(buyer_is_maker: Column) -> Column:
    """The side that took: sell where the buyer was the maker; null stays null."""
    return F.when(buyer_is_maker, "sell").when(~buyer_is_maker, "buy")


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with error: the names of the rules that a row breaks, joined by commas; null where it breaks none.

    A rule that is null counts as broken.
    """
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("error", F.nullif(F.concat_ws(",", *broken), F.lit("")))


def depth_rules() -> dict[str, Column]:
    """Rules of depth events (first_id, last_id, prev_id, bids, asks)."""
    rules = {f"missing_{c}": F.col(c).isNotNull() for c in ("first_id", "last_id", "prev_id", "bids", "asks")}
    return rules | {"first_after_last": F.col("first_id") <= F.col("last_id")}


def trade_rules() -> dict[str, Column]:
    """Rules of trades (a, p, q as text, f, l, T_ms, m)."""
    rules = {f"missing_{c}": F.col(c).isNotNull() for c in ("a", "f", "l", "T_ms", "m")}
    number = lambda c: F.col(c).rlike(r"^[0-9]+(\.[0-9]+)?$")
    return rules | {"price": number("p"), "quantity": number("q"), "first_after_last": F.col("f") <= F.col("l")}


def unknown_fields(raw: Column, known: list[str]) -> Column:
    """The members of a JSON object that aren't known, as JSON text; null where there is none."""
    rest = F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def counters(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, of records (recv, exchange, outcome): how many came and what became of them, first and last times.

    outcome: accepted, duplicate, old, parse_error or invalid.
    """
    n = lambda o, name: F.count_if(F.col("outcome") == o).alias(name)
    last = F.max_by(F.when(F.col("exchange").isNotNull(), F.col("exchange")), F.when(F.col("exchange").isNotNull(), F.col("recv")))
    return records.groupBy(*keys).agg(F.count("*").alias("received"), n("accepted", "accepted"), n("duplicate", "duplicates"), n("old", "old_or_out_of_order"), n("parse_error", "parse_errors"), n("invalid", "invalid_values"), F.min("recv").alias("first_recv"), F.max("recv").alias("last_recv"), last.alias("last_exchange"))


def clock_summary(samples: DataFrame, keys: list[str], recent: int = 20) -> DataFrame:
    """Per key, of time samples (sent, received in ns, server in ms): the last one, and of the `recent` last the median offset (the upper one) and the least round trip, in ms.

    The offset is server less local time, taking both ways as equally long.
    """
    rtt = (F.col("received") - F.col("sent")) / 1e6
    offset = F.col("server") - (F.col("sent") + F.col("received")) / 2 / 1e6
    d = samples.select(*keys, "sent", "received", rtt.alias("rtt"), offset.alias("offset"))
    # Only a key's last few rows pass the limit, ahead of the shuffle too.
    last = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("received"), F.desc("sent")))).filter(F.col("__r") <= recent)
    g = last.groupBy(*keys).agg(F.max_by(F.struct("sent", "rtt", "offset"), F.struct("received", "sent")).alias("l"), F.array_sort(F.collect_list("offset")).alias("__o"), F.min("rtt").alias("rtt_min_ms"))
    g = g.join(d.groupBy(*keys).agg(F.count("*").alias("samples")), keys)
    return g.select(*keys, "samples", F.col("l.sent").alias("last_sent"), F.col("l.rtt").alias("last_rtt_ms"), F.col("l.offset").alias("last_offset_ms"), F.get("__o", F.floor(F.size("__o") / 2).cast("int")).alias("offset_median_ms"), "rtt_min_ms")


def gap_states(versions: DataFrame) -> DataFrame:
    """The latest version of each gap (gap_id, update_time_ns, position), null times counting as 0; of ties the first read."""
    return dedup.latest_version(versions, ["gap_id"], "update_time_ns", "position")


def gap_summary(versions: DataFrame) -> DataFrame:
    """(symbol, stream, kind, repair_status, n, longest_s, reason): the latest versions counted, with the longest closed one."""
    g = gap_states(versions).withColumn("__d", (F.col("end_time_ns") - F.col("start_time_ns")) / 1e9)
    return g.groupBy("symbol", "stream", "kind", "repair_status").agg(F.count("*").alias("n"), F.max("__d").alias("longest_s"), F.max_by("reason", F.struct("__d", "gap_id")).alias("reason"))


def faults(body: Column, integers: list[str], texts: list[str], ascending: list[tuple[str, str]] = ()) -> Column:
    """What is wrong with a JSON text, as an array of reasons, by the types of its own values: empty if nothing is.

    integers are whole numbers (true and "1" aren't), texts are strings (prices
    must not be numbers), and of each pair of ascending the first is at most the
    second. A null or damaged text is unparseable, and nothing else.
    """
    v = F.try_parse_json(body)
    kind = lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant")), F.lit("VOID"))
    number = lambda c: F.try_variant_get(v, f"$.{c}", "bigint")
    found = [(kind(c) != "BIGINT", f"{c}_not_integer") for c in integers] + [(kind(c) != "STRING", f"{c}_not_text") for c in texts]
    found += [((kind(a) == "BIGINT") & (kind(b) == "BIGINT") & (number(a) > number(b)), f"{a}_above_{b}") for a, b in ascending]
    return F.when(v.isNull(), F.array(F.lit("unparseable"))).otherwise(F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in found])))


def accepted(rows: DataFrame, body: str, **rules) -> tuple[DataFrame, DataFrame]:
    """rows whose body has no faults, and the others with their faults as reasons: a table of rejects."""
    d = rows.withColumn("reasons", faults(F.col(body), **rules))
    return d.filter(F.size("reasons") == 0).drop("reasons"), d.filter(F.size("reasons") > 0)


def in_gaps(rows: DataFrame, gaps: DataFrame, keys: list[str], a: str, bucket: int = 1 << 18) -> DataFrame:
    """rows whose a lies in a gap (keys, from_a, to_a) of their key, with from_a and to_a.

    Gaps of a key don't overlap, so a row can lie only in the last one that begins
    at or before it: an as-of lookup by id, however far a gap reaches.
    """
    from . import timealign

    hit = timealign.asof_backward(rows.withColumn("__a", F.col(a)), gaps.select(*keys, F.col("from_a").alias("__a"), "from_a", "to_a"), keys, "__a", "to_a", ["from_a", "to_a"], bucket)
    return hit.filter(F.col(a) <= F.col("to_a")).drop("__a", "t_match")


def filled_gaps(gaps: DataFrame, source: DataFrame, keys: list[str], a: str, order: list[str] | None = None, bucket: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Gaps (keys, from_a, to_a) filled from recorded rows: (gaps with n_missing, n_filled and repair_status, the rows).

    repaired: all ids were found; partial: some; unrepairable: none. Of rows with one id the first by `order` (all columns
    unless given) counts.
    """
    one = dedup.keep_first(source, [*keys, a], order or source.columns)
    rows = in_gaps(one, gaps, keys, a, bucket)
    n = rows.groupBy(*keys, "from_a", "to_a").agg(F.count("*").alias("n_filled"))
    out = gaps.select(*keys, "from_a", "to_a").join(n, [*keys, "from_a", "to_a"], "left")
    out = out.withColumns({"n_missing": F.col("to_a") - F.col("from_a") + 1, "n_filled": F.coalesce("n_filled", F.lit(0)).cast("long")})
    status = F.when(F.col("n_filled") == F.col("n_missing"), "repaired").when(F.col("n_filled") > 0, "partial").otherwise("unrepairable")
    return out.withColumn("repair_status", status), rows.drop("from_a", "to_a")


def downtime(rows: DataFrame, keys: list[str], a: str, session: str, t: str) -> DataFrame:
    """Between neighbouring sessions of a key (keys, from_t, to_t, prev_id, next_id, n_missing, status).

    status: no_id_missing, ids_missing, or unknown where the earlier session has no id.
    """
    s = rows.groupBy(*keys, session).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.min_by(a, F.struct(t, a)).alias("__first"), F.max(a).alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__t0", session)  # a row per session
    d = s.withColumns({"from_t": F.lag("__t1").over(w), "prev_id": F.lag("__last").over(w), "__n": F.row_number().over(w)}).filter("__n > 1")
    missing = F.greatest(F.col("__first") - F.col("prev_id") - 1, F.lit(0))
    return d.select(*keys, "from_t", F.col("__t0").alias("to_t"), "prev_id", F.col("__first").alias("next_id"), missing.alias("n_missing"), F.when(F.col("prev_id").isNull(), "unknown").when(missing > 0, "ids_missing").otherwise("no_id_missing").alias("status"))


def freshness(status: DataFrame, keys: list[str], t: str, now: Column, interval: int) -> DataFrame:
    """Per key the age of its latest record and whether it is alive (younger than 4 intervals) or stale (older than 6)."""
    s = status.groupBy(*keys).agg(F.max(t).alias("last"))
    age = now - F.col("last")
    return s.select(*keys, "last", age.alias("age"), (age < 4 * interval).alias("alive"), (age > 6 * interval).alias("stale"))


def health(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, reasons) of checks (keys, reason, failed, fatal): failed if a fatal one fails, degraded if another does, else ok."""
    bad = F.col("failed")
    level = F.when(F.max(bad & F.col("fatal")), "failed").when(F.max(bad), "degraded").otherwise("ok")
    return checks.groupBy(*keys).agg(level.alias("level"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(bad, F.col("reason"))))).alias("reasons"))


def health_line(level: DataFrame, keys: list[str], age: Column, stale_after: float) -> DataFrame:
    """level with line and code: 0 ok, 1 degraded, 2 failed, 3 stale, as a monitoring script wants them."""
    old = age > stale_after
    code = F.when(old, 3).when(F.col("level") == "ok", 0).when(F.col("level") == "degraded", 1).otherwise(2)
    line = F.concat(F.when(old, "STALE ").otherwise(""), F.upper("level"), F.lit(" age="), age.cast("string"), F.lit("s reasons="), F.col("reasons"))
    return level.withColumns({"code": code, "line": line})


def feature_groups(kline: list[str], micro: list[str]) -> dict[str, list[str]]:
    """Columns of a combined dataset by the group whose worth is measured."""
    return {"kline": list(kline), "micro": list(micro), "combined": [*kline, *micro]}


def unioned(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other; a column that one lacks is null there, and integers widen to doubles where another has these."""
    kinds: dict[str, str] = {}
    wide = ["tinyint", "smallint", "int", "bigint", "float", "double"]
    for df in parts:
        for c, k in df.dtypes:
            old = kinds.setdefault(c, k)
            if old != k and old in wide and k in wide:
                kinds[c] = max(old, k, key=wide.index)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns]) for df in parts])
