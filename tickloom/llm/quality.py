"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over the row, so the plan is a scan and
projections: no shuffle, no user function. Repeated word windows are found inside
the row by sorting them, in n log n, so a very long text costs no more per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for on with was as by this at from are be it or an "
    "der die das und ist ein eine den dem des von zu mit auf für im nicht auch sich "
    "le la les un une et est que qui dans pour des du en à au par sur ne pas "
    "el los las y del se por con para es su como lo más"
).split()

#: (rule, statistic, least, most); a row is kept while every statistic lies within.
RULES = (
    ("length", "n_words", 50, None),
    ("word_length", "mean_word", 2.5, 12.0),
    ("symbols", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.02, None),
    ("lines", "dup_line_ratio", None, 0.5),
    ("repeats", "repeat_ratio", None, 0.5),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ratios.

    A null text has no words, so all counts are 0. The texts of the columns that
    docs has already win no clash: columns of the same names are replaced.
    """
    text, words, grams, marked = (F.col(f"__{x}") for x in ("text", "words", "grams", "marked"))
    # Each step is a projection of its own: lambdas read finished arrays and don't compute them anew.
    df = docs.withColumn("__text", common.text_or_empty(text_col))
    df = df.withColumn("__words", F.array_remove(F.split(common.squeezed(text), " "), ""))
    df = df.withColumn("n_words", F.size(words).cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    gram = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2))
    df = df.withColumn("__grams", F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), gram)).otherwise(F.array().cast("array<string>")))
    # Windows that occur once only are the rule; only other texts are sorted.
    some = F.size(F.array_distinct(grams)) < F.size(grams)
    df = df.withColumn("__sorted", F.when(some, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("__sorted")
    same = lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))
    df = df.withColumn("__marked", F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])))
    step = lambda x, j: F.coalesce(F.least(F.get(marked, j + 1) - x, F.lit(3)), F.lit(3))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform(marked, step), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    n = F.col("n_words")
    white = F.regexp_count(text, F.lit(common.WHITE))
    df = df.withColumns({
        "word_chars": (F.length(text) - white).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "__stop": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
    })
    df = df.withColumns({
        "mean_word": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "stop_ratio": _ratio(F.col("__stop"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.size("__lines")),
        "repeat_ratio": _ratio(F.col("n_repeat_words"), n),
    })
    return df.drop("__text", "__words", "__lines", "__grams", "__sorted", "__marked", "__stop")


def verdict(rules=RULES) -> Column:
    """One Boolean expression that is true where every rule holds."""
    out = F.lit(True)
    for _, name, least, most in rules:
        if least is not None:
            out = out & (F.col(name) >= least)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out


def quality(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with statistics, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated
    windows of three. kept: not base_failed, and all rules hold. Null and empty
    texts fail; repeated rows are judged alike; an empty table stays empty.

    The optimizer would push a filter on the result below the projections and so
    write their arrays out again inside each lambda, at a quadratic cost. A row
    number that both columns read keeps filters above the statistics.
    """
    df = statistics(docs, text_col).withColumn("__row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    here = F.col("__row") >= 0
    return df.withColumn("base_failed", failed & here).withColumn("kept", ~F.col("base_failed") & verdict(rules) & here).drop("__row")


def kept_rows(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that every rule keeps, with their own columns only; repeated rows all stay."""
    own = [F.col(c).alias(f"own_{i}") for i, c in enumerate(docs.columns)]
    df = quality(docs.select(*own, F.col(text_col).alias("__of")), "__of", rules).filter("kept")
    return df.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return quality(common.documents(spark, sf_dir).select("doc_id", "text")).select(*COLUMNS)


def sql(columns: str = ", ".join(COLUMNS)) -> str:
    """DuckDB SQL of op3 over the view documents."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bound = {"n_words": "n_words", "mean_word": "coalesce(word_chars / nullif(n_words, 0), 0)", "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)", "stop_ratio": "coalesce(n_stop / nullif(n_words, 0), 0)", "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)", "repeat_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0)"}
    rules = " AND ".join(f"{bound[c]} >= {a}" if a is not None else "true" for _, c, a, b in RULES) + " AND " + " AND ".join(f"{bound[c]} <= {b}" if b is not None else "true" for _, c, a, b in RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, * FROM documents),
w AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM p),
m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM m WHERE c > 1) GROUP BY rid),
s AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
k AS (SELECT *, NOT base_failed AND {rules} AS kept FROM b)
SELECT {columns} FROM k
"""
