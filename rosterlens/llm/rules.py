"""Quality rules judged for whole hosts: failures by rule and host, shrunk with an empirical beta prior.

Everything is a column expression or an aggregate.  Texts are read once; what is measured on them is a few
numbers a document, which are written before hosts are summed up.

A host's rate of failures of a rule is (k + a) / (n + a + b), where a and b are a beta prior fitted to the
rates of all hosts by moments: a host with few documents stays near the mean of all, a large one is judged
by itself.  A host where some rule's rate exceeds the limit is rejected with all its documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.small_tables import attach

from .common import fresh
from .storage import written

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host and the numbers that the rules read; a null text has no words."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.select("doc_id", F.col(host).cast("string").alias("host"), whole.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    split = docs.select(
        "doc_id",
        "host",
        F.array_remove(F.split("t", BLANK), "").alias("words"),
        (F.length("t") - without(F.col("t"), BLANK_CHARS)).cast("long").alias("word_chars"),
        without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    word = lambda i: F.get(F.col("words"), i)
    windows = F.when(
        F.size("words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), i.alias("p"))),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    counted = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    seen = F.size(F.array_distinct(F.col("windows.h"))) == F.size("windows")
    rest = [c for c in counted.columns if c != "windows"]
    # equal windows stand side by side when sorted; texts that repeat none need no sorting
    ordered = counted.select(*rest, F.when(~seen, F.sort_array("windows")).alias("s"))
    # as arrays of their own: a field of an array of structs would be taken out anew for every element
    apart = ordered.select(*rest, F.transform("s", lambda x: x["h"]).alias("h"), F.transform("s", lambda x: x["p"]).alias("p"))
    h = lambda i: F.get(F.col("h"), i)
    again = F.filter("p", lambda _, i: h(i).eqNullSafe(h(i - 1)) | h(i).eqNullSafe(h(i + 1)))
    places = apart.select(*rest, F.sort_array(again).alias("at"))
    # windows at p cover words p to p + 2: each adds three words, or as many as it lies behind the one before
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    return places.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """What fails a document, by rule; the first two are the base rules."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repetition": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "same_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


BASE = ("few_words", "repetition")


def host_rates(failed: DataFrame, names: list[str]) -> DataFrame:
    """host, n and the shrunk rate of each rule, from rows of host and 0/1 columns ``names``."""
    sums = [F.sum(F.col(c)).alias(c) for c in names]
    hosts = written(failed.groupBy("host").agg(F.count("*").alias("n"), *sums))
    total = F.sum("n")
    stats = [x for c in names for x in ((F.sum(c) / total).alias(f"{c}_m"), (F.sum(F.col(c) * F.col(c) / F.col("n")) / total).alias(f"{c}_q"))]
    prior = hosts.agg(*stats).first()
    rates = []
    for c in names:
        m, q = prior[f"{c}_m"] or 0.0, prior[f"{c}_q"] or 0.0
        spread = max(q - m * m, 0.0)
        weight = min(max(m * (1 - m) / spread - 1, LEAST_WEIGHT), MOST_WEIGHT) if spread > 0 else MOST_WEIGHT
        rates.append(((F.col(c) + m * weight) / (F.col("n") + weight)).alias(c))
    return hosts.select("host", "n", *rates)


def judge(docs: DataFrame, host: str = "source", limit: float = 0.5, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per document row: its measures, base_failed, host_rejected and kept.

    ``extra``: further rules over the measured columns.  A null host is a host of its own; repeated rows
    count each; an empty table gives an empty one.  Other columns of the input are ignored.
    """
    checks = rules() | dict(extra or {})
    measured = measures(docs, host)
    failed = written(measured.select("*", *[c.cast("int").alias(fresh(measured.columns, k)) for k, c in checks.items()]))
    rates = host_rates(failed, list(checks))
    worst = F.greatest(*[F.col(c) for c in checks])
    verdicts = rates.select(F.coalesce("host", F.lit("")).alias("name"), F.col("host").isNull().alias("none"), (worst > limit).alias("host_rejected"))
    keyed = failed.withColumns({"name": F.coalesce("host", F.lit("")), "none": F.col("host").isNull()})
    base = F.greatest(*[F.col(c) for c in BASE]) == 1
    joined = attach(keyed, verdicts, ["name", "none"], "left").withColumn("base_failed", base)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).drop("name", "none")


def verdicts(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same in SQL.
SQL = r"""
with d as (select row_number() over () r, doc_id, source host, coalesce(text, '') t from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from d),
g as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] gram
      from (select r, words, unnest(range(1, greatest(len(words) - 1, 1))) i from w)),
twice as (select r, gram from g group by r, gram having count(*) > 1),
places as (select distinct g.r, unnest([i, i + 1, i + 2]) p from g join twice using (r, gram)),
repeats as (select r, count(*) n from places group by r),
m as (select d.r, doc_id, host, len(words) n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols,
             len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(repeats.n, 0) n_repeat_words
      from d join w using (r) left join repeats using (r)),
f as (select *, (n_words < 50)::int f1, (100 * n_repeat_words > 50 * n_words)::int f2, (10 * n_symbols > n_words)::int f3,
             (100 * n_dup_lines > 30 * n_lines)::int f4, (word_chars < 3 * n_words or word_chars > 10 * n_words)::int f5 from m),
h as (select host, rule, count(*) n, sum(fails) k from (unpivot f on f1, f2, f3, f4, f5 into name rule value fails) group by host, rule),
p as (select rule, sum(k) / sum(n) m, greatest(sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)), 0) v from h group by rule),
s as (select rule, m, case when v > 0 then least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) else 1e6 end weight from p),
bad as (select host, max((k + m * weight) / (n + weight)) > 0.5 rejected from h join s using (rule) group by host)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
       n_repeat_words::bigint n_repeat_words, (f1 + f2 > 0) base_failed, (f1 + f2 = 0 and not rejected) kept
from f join bad on f.host is not distinct from bad.host
"""
