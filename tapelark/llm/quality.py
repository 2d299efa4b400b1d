"""Quality rules with host-level verdicts, from DataFrame functions only.

Base figures come from each whole text. Rules fail documents; failures are counted by host (the
``source`` of a document; null is a host of its own), each host's failure rate is shrunk through a beta
prior fitted to all hosts, and a host whose rate is above ``HOST_RATE`` by the lower posterior bound of
any rule is rejected with all its documents.

Defined cases: null and blank texts have zero words and fail ``few_words``; an empty table gives no
rows; rows are judged one by one, repeated rows included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelark.llm import priors
from tapelark.llm.common import SPACES, materialize, once, sized, words

WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: Host-level only: percent of symbols among word characters, percent of repeated lines.
SYMBOL_PERCENT, DUP_LINE_PERCENT = 10, 30
HOST_RATE, BOUND = 0.5, 2.0


#: Words in windows that occur twice or more, from the array ``_h`` of window hashes. Window starts
#: sorted by hash have equal ones side by side; the starts of repeated ones, sorted again, each cover up
#: to the next start. Both sorts are within the row: n log n in its length.
REPEAT_WORDS = f"""
CASE WHEN size(array_distinct(_h)) = size(_h) THEN 0L ELSE
  aggregate(array(array_sort(transform(_h, (x, i) -> struct(x AS x, i AS i)))), 0L, (z, s) -> z +
    aggregate(array(array_sort(transform(filter(
        transform(s, (e, k) -> struct(coalesce(e.x = get(s, k - 1).x, false) OR coalesce(e.x = get(s, k + 1).x, false) AS twice, e.i AS i)),
        e -> e.twice), e -> e.i))), 0L, (y, d) -> y +
      aggregate(transform(d, (p, k) -> least({WINDOW}, coalesce(get(d, k + 1) - p, {WINDOW}))), 0L, (a, b) -> a + b)))
END"""


def figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    out = once(once(docs, "_w", words(F.col(text_col))), "_l", lines)
    hashes = F.expr(
        f"CASE WHEN size(_w) > {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) ELSE array() END"
    )
    out = once(out, "_h", hashes)
    out = once(out, "n_repeat_words", F.expr(REPEAT_WORDS)).withColumn("n_words", F.size("_w").cast("long"))
    return (
        out.withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("_n_lines", F.size("_l").cast("long"))
        .drop("_w", "_l", "_h")
    )


def rules() -> dict[str, Column]:
    """Rule name to its failure condition; the first two fail a document by themselves."""
    c = F.col
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > DUP_LINE_PERCENT * c("_n_lines"),
    }


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``figures`` with one boolean ``fail_<rule>`` per rule and base_failed."""
    out = figures(docs, text_col)
    for name, fails in rules().items():
        out = out.withColumn(f"fail_{name}", fails)
    return out.withColumn("base_failed", F.col("fail_few_words") | F.col("fail_repeats"))


def host_verdicts(fails: DataFrame, host_col: str = "source") -> DataFrame:
    """(host, n, rate_<rule>, low_<rule>, host_low, host_ok): shrunk failure rates by host, with their lower bounds and the highest of these.

    ``fails`` has ``fail_<rule>`` columns. The mean of all hosts is smoothed by half a failure, so that it
    stays between 0 and 1.
    """
    names = list(rules())
    hosts = fails.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fail_{x}").cast("long")).alias(f"x_{x}") for x in names]
    )
    whole = hosts.agg(F.sum("n").alias("_t"), *[((F.sum(f"x_{x}") + 0.5) / (F.sum("n") + 1.0)).alias(f"m_{x}") for x in names])
    placed = hosts.crossJoin(F.broadcast(whole))  # one row
    fits = placed.agg(*[priors.correlation(F.col(f"x_{x}"), F.col("n"), F.col(f"m_{x}")).alias(f"r_{x}") for x in names])
    out = placed.crossJoin(F.broadcast(fits))  # one row
    for x in names:
        at = (F.col(f"x_{x}"), F.col("n"), F.col(f"m_{x}"), priors.strength(F.col(f"r_{x}")))
        out = out.withColumn(f"rate_{x}", priors.mean(*at)).withColumn(f"low_{x}", priors.mean(*at) - BOUND * priors.spread(*at))
    worst = F.greatest(*[F.col(f"low_{x}") for x in names])
    return out.select("host", "n", *[f"rate_{x}" for x in names], *[f"low_{x}" for x in names], worst.alias("host_low"), (worst <= HOST_RATE).alias("host_ok"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, figures, base_failed, host, host_low, kept."""
    cols = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    narrow = judged(docs.select(id_col, text_col, host_col), text_col)
    rows = materialize(narrow.select(*cols, host_col, *[f"fail_{x}" for x in rules()]), "quality")
    hosts = materialize(host_verdicts(rows, host_col).select(F.col("host").alias("_host"), "host_low", "host_ok"), "hosts")
    back = rows.join(sized(hosts), F.col(host_col).eqNullSafe(F.col("_host")), "left")
    return back.select(*cols, F.col(host_col).alias("host"), "host_low", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with their columns as they came.

    The figures are worked out once: rows are written with what they fail (without the texts of those that
    fail by themselves), hosts are counted from the narrow columns of that table, and rejected hosts leave it.
    """
    own = docs.columns
    held = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)])
    text, host = f"c{own.index(text_col)}", f"c{own.index(host_col)}"
    fails = [f"fail_{x}" for x in rules()]
    told = judged(held, text).withColumn(text, F.when(~F.col("base_failed"), F.col(text))).select(*held.columns, "base_failed", *fails)
    rows = materialize(told, "judged")
    hosts = host_verdicts(rows, host).filter(~F.col("host_ok")).select(F.col("host").alias("_host"))
    passed = rows.filter(~F.col("base_failed")).join(sized(materialize(hosts, "rejected")), F.col(host).eqNullSafe(F.col("_host")), "left_anti")
    return passed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(own)])
