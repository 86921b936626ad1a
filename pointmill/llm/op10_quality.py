"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured (words, symbols, repeated lines and word windows). Rule failures are then counted by host, the
hosts' failure rates shrunk by a beta prior whose two parameters come from the hosts themselves (method of moments), and
the verdicts on hosts joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import BLANKS, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A document fails a soft rule with more symbols than this share of its words; a host is refused above this rate.
SYMBOL_SHARE, HOST_RATE = 0.5, 0.5


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(a: Column, shift: int) -> Column:
    """Hashes of each element with the one `shift` further on; the last ones pair with nothing."""
    return F.zip_with(a, F.slice(a, F.lit(shift + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    located = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = bind(located, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
    return bind(
        F.sort_array(repeated),
        lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda t, x: t + x),
    ).cast("long")


def repeat_words(words: Column) -> Column:
    def count(w: Column) -> Column:
        hashes = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: bind(_pairs(h, 1), lambda a: bind(_pairs(a, 2), lambda b: _pairs(b, 4))))
        whole = F.slice(hashes, F.lit(1), F.size(w) - (WINDOW - 1))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(whole, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h))))

    return bind(words, count)


def measures(text: Column) -> Column:
    """The five base measures of a text as a struct of longs; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)
    return F.struct(
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, host, the five measures, base_failed and soft_failed."""
    m = docs.select(*(F.col(c) for c in keep), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), measures(F.col("text")).alias("_m"))
    out = m.select(*keep, "host", F.col("_m.w.n").alias("n_words"), "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", F.col("_m.w.r").alias("n_repeat_words"))
    n = F.col("n_words")
    base = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return out.withColumn("base_failed", base).withColumn("soft_failed", base | (F.col("n_symbols") > SYMBOL_SHARE * n))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) and host_kept, from rows with host and soft_failed.

    The prior's mean is the mean of the host rates, its weight follows from their variance between 1 and 1000 documents;
    equal rates give the largest weight. One row of totals meets each host: the only broadcast, of that one row.
    """
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("soft_failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("_mean"), F.var_pop(raw).alias("_var"))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.when(F.col("_var") > 0, F.col("_mean") * (1 - F.col("_mean")) / F.col("_var") - 1).otherwise(F.lit(1000.0))))
    rate = (F.col("n_failed") + F.col("_mean") * F.col("_weight")) / (F.col("n_docs") + F.col("_weight"))
    return hosts.join(F.broadcast(prior.withColumn("_weight", weight))).select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= HOST_RATE).alias("host_kept"))


def assess(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with the measures, base_failed and kept.

    A null text is empty and fails; a null source is the host ''. Repeated rows count as often as they occur. Columns
    other than text, source and `keep` are not read, so clashing names do no harm. An empty table gives an empty result.
    The measured rows are written once in the shared folder, since hosts and documents both need them. Spark joins by
    broadcast only if the hosts' table turns out to be under its threshold; otherwise rows are shuffled by host, and
    Spark splits a host that holds many of them.
    """
    rows = written(measured(docs, keep), "measured")
    hosts = written(host_verdicts(rows).select("host", "host_kept"), "hosts")
    joined = rows.join(hosts, "host", "left")
    return joined.select(*keep, *MEASURES, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).alias("kept"))


#: The same in SQL for small tables.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
k AS (SELECT *, CASE WHEN len(ws) < 8 THEN [] ELSE list_transform(range(1, len(ws) - 6), lambda i: array_to_string(list_slice(ws, i, i + 7), ' ')) END AS ks FROM w),
g AS (SELECT row_number() OVER () AS r, * FROM k),
p AS (SELECT r, unnest(ks) AS s, unnest(range(1, len(ks) + 1)) AS i FROM g),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM q WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
      FROM g LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
s AS (SELECT *, base_failed OR n_symbols > 0.5 * n_words AS soft_failed FROM f),
h AS (SELECT host, count(*) AS n_docs, sum(CAST(soft_failed AS INT)) AS n_failed FROM s GROUP BY host),
b AS (SELECT avg(n_failed / n_docs) AS mean, var_pop(n_failed / n_docs) AS var FROM h),
x AS (SELECT mean, greatest(1.0, least(1000.0, CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 ELSE 1000.0 END)) AS weight FROM b),
v AS (SELECT host, (n_failed + mean * weight) / (n_docs + weight) <= 0.5 AS host_kept FROM h, x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM s JOIN v USING (host)
"""
