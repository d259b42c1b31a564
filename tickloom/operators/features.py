"""Features of books, flow and bars, as column expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import carry

BPS = 1e4


def total(levels: str) -> Column:
    """Sum of an array of doubles; null if a level is missing."""
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x)


def book_features(book: DataFrame) -> DataFrame:
    """mid, spread_bps, imb1, depths, imb20 and micro_bps of each book row; x/0 is null."""
    b, a, bq, aq = (F.col(c)[0] for c in ("bid_px", "ask_px", "bid_qty", "ask_qty"))
    df = book.withColumns({"mid": (b + a) / 2, "depth20_bid": total("bid_qty"), "depth20_ask": total("ask_qty")})
    return df.withColumns({
        "spread_bps": F.try_divide(a - b, F.col("mid")) * BPS,
        "imb1": F.try_divide(bq - aq, bq + aq),
        "imb20": F.try_divide(F.col("depth20_bid") - F.col("depth20_ask"), F.col("depth20_bid") + F.col("depth20_ask")),
        "micro_bps": F.try_divide(F.try_divide(b * aq + a * bq, bq + aq) - F.col("mid"), F.col("mid")) * BPS,
    })


def increments(book: DataFrame, keys: list[str], t: str, tie: str, segment: str | None = None) -> DataFrame:
    """book with ofi and r2 (squared log return in bps) against the row before; the first row of a key, and of a segment, has 0."""
    d = carry.previous(_tops(book), keys, t, [tie], [*TOPS, *([segment] if segment else [])], name="__prev")
    first = F.col("__prev.__bp").isNull() | (F.col(f"__prev.{segment}") != F.col(segment) if segment else F.lit(False))
    return d.withColumns(_steps(first)).drop(*TOPS, "__prev")


#: The best prices and quantities of both sides, as inner columns.
TOPS = ["__bp", "__ap", "__bq", "__aq"]


def _tops(book: DataFrame) -> DataFrame:
    return book.withColumns({c: F.col(of)[0] for c, of in zip(TOPS, ("bid_px", "ask_px", "bid_qty", "ask_qty"))})


def _steps(first: Column) -> dict[str, Column]:
    """ofi and r2 of rows with TOPS and those of the row ahead in __prev; 0 for a first row."""
    b, a, bq, aq = (F.col(c) for c in TOPS)
    pb, pa, pbq, paq = (F.col(f"__prev.{c}") for c in TOPS)
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    ofi = when(b >= pb, bq) - when(b <= pb, pbq) - when(a <= pa, aq) + when(a >= pa, paq)
    step = (F.log((b + a) / 2) - F.log((pb + pa) / 2)) * BPS
    return {"ofi": F.when(first, 0.0).otherwise(ofi), "r2": F.when(first, 0.0).otherwise(step * step)}


def segmented(book: DataFrame, keys: list[str], t: str, tie: str, max_gap: int, columns: list[str]) -> DataFrame:
    """book rows (keys, t, tie, segment, columns, ofi, r2), saved: segments and increments from one look at the row ahead.

    A segment begins where t moves on by more than max_gap; its first row has
    increments 0. The narrow rows are written down, so the ladders are read once.
    """
    d = carry.previous(_tops(book_features(book)), keys, t, [tie], [*TOPS, t], name="__prev")
    new = F.col(t) - F.col(f"__prev.{t}") > max_gap
    first = F.col("__prev").isNull() | F.coalesce(new, F.lit(False)) | F.col("__prev.__bp").isNull()
    d = cut(d.withColumns(_steps(first)).select(*keys, t, tie, *columns, "ofi", "r2", F.when(new, 1).otherwise(0).alias("__new")))
    out = carry.running_sum(d, keys, t, [tie], F.col("__new"), "segment")
    return cut(out.withColumn("segment", F.col("segment").cast("int")).drop("__new"))


def bars(trades: DataFrame, width: int, keys=("symbol",)) -> DataFrame:
    """Bars of `width` ms: open, high, low, close, volume, quote volume, count, buy volume."""
    order = F.struct("t_ms", "a")
    return trades.groupBy(*keys, (F.floor(F.col("t_ms") / width) * width).cast("long").alias("open_ms")).agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"),
        F.sum("q").alias("volume"), F.sum(F.col("p") * F.col("q")).alias("quote_volume"), F.count("*").alias("n_trades"),
        F.sum(F.when(F.col("side") == "buy", F.col("q")).otherwise(0.0)).alias("buy_volume"),
    )


def rolling(x: Column, w, n: int, what: str) -> Column:
    """Rolling sum, mean or population std over n rows; null before n rows, missing values as 0."""
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(frame) == n
    x = F.coalesce(x, F.lit(0.0))
    s1 = F.sum(x).over(frame)
    if what == "sum":
        out = s1
    elif what == "mean":
        out = s1 / n
    else:
        out = F.sqrt(F.greatest(F.sum(x * x).over(frame) / n - (s1 / n) * (s1 / n), F.lit(0.0)))
    return F.when(full, out)


#: Features of bars, and the rows that the longest of them looks back on.
KLINE = ["ret_1", "ret_5", "ret_15", "ret_60", "rv_15", "rv_60", "taker_imb_5", "taker_imb_30", "vol_z_15", "trade_z_15", "range_15", "vwap_dev", "rsi_14", "ac_15"]
LOOK_BACK = 64


def kline_features(bars: DataFrame, keys=("symbol",), block: int = 65_536) -> DataFrame:
    """Rolling features of bars by position: returns, volatility, imbalance, z-scores, range, VWAP, RSI, autocorrelation.

    A key's bars are numbered and cut into blocks, each of which also gets the
    LOOK_BACK bars ahead of it, so that no window is over a whole key.
    """
    at = carry.positions(bars, list(keys), "open_ms", [], "__p", 1000 * carry.DAY)
    into = F.when(F.col("__p") % block >= block - LOOK_BACK, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    at = at.withColumn("__ahead", F.explode(into)).withColumn("__block", F.expr(f"__p div {block}") + F.col("__ahead"))
    return _kline_features(at, (*keys, "__block")).filter("__ahead = 0").drop("__p", "__ahead", "__block")


def _kline_features(bars: DataFrame, keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("open_ms")
    lagged = lambda c, n: F.lag(c, n).over(w)
    df = bars.withColumn("r", F.log(F.col("close") / lagged("close", 1)) * BPS)
    df = df.withColumns({f"ret_{n}": F.log(F.col("close") / lagged("close", n)) * BPS for n in (1, 5, 15, 60)})
    df = df.withColumns({"__r1": lagged("r", 1), "__up": F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(0.0)), "__dn": F.greatest(-F.coalesce("r", F.lit(0.0)), F.lit(0.0))})
    s = lambda c, n, what: rolling(F.col(c) if isinstance(c, str) else c, w, n, what)
    share = lambda n: F.when(s("volume", n, "sum") > 0, s("buy_volume", n, "sum") / s("volume", n, "sum") - 0.5).otherwise(0.0)
    z = lambda c: F.when(s(c, 60, "std") > 0, (s(c, 15, "mean") - s(c, 60, "mean")) / s(c, 60, "std")).otherwise(0.0)
    return df.withColumns({
        "rv_15": F.sqrt(s(F.col("r") * F.col("r"), 15, "sum")), "rv_60": F.sqrt(s(F.col("r") * F.col("r"), 60, "sum")),
        "taker_imb_5": share(5), "taker_imb_30": share(30),
        "vol_z_15": z("volume"), "trade_z_15": z("n_trades"),
        "range_15": s(F.col("high") - F.col("low"), 15, "mean") / F.col("close") * BPS,
        "vwap_dev": (F.col("close") / (s("quote_volume", 15, "sum") / F.greatest(s("volume", 15, "sum"), F.lit(1e-12))) - 1) * BPS,
        "rsi_14": 100 - 100 / (1 + s("__up", 14, "mean") / F.greatest(s("__dn", 14, "mean"), F.lit(1e-12))) - 50,
        "ac_15": F.when(s(F.col("r") * F.col("r"), 15, "mean") > 0, s(F.col("r") * F.col("__r1"), 15, "mean") / s(F.col("r") * F.col("r"), 15, "mean")).otherwise(0.0),
    }).drop("__r1", "__up", "__dn")


def three_way(y: Column, flat: float = 0.5) -> Column:
    """Label 1 above flat, -1 below -flat, else 0."""
    return F.when(y > flat, 1).when(y < -flat, -1).otherwise(0).cast("tinyint")


def finite(columns: list[str]) -> Column:
    """True where every column is a number, neither NaN nor infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out
