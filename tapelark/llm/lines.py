"""Line dedup by winnowing over line hashes, from DataFrame functions only.

Lines without a word are skipped. Every window of ``RUN`` lines selects its smallest line hash (the last
of equal ones) as a fingerprint, so two equal runs of ``RUN`` lines or more select the same fingerprint
at the same place. Fewer lines that hold ``LONG_WORDS`` words are a window as well, posted whole: a single
long line is its own minimum.

Positions of fingerprints found more than once are joined, by what their windows hold, to the earliest
position of the same (by document id, then hash of the text, then line). A joined position is extended both
ways as long as the neighbouring lines of both documents agree: windows that overlap or touch on the same
diagonal are one maximal run. The later run of each such pair is deleted.

Defined cases: null and blank texts have no lines; rows equal in id and text are one document, which
does not repeat itself; documents without a window keep all; a null id comes first in order; columns of
any name come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelark.llm.common import SPACES, WORD, apart, later_occurrences, materialize, once

RUN, LONG_WORDS = 3, 50


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, at, h, n, c) per row: numbers, hashes and words of the lines that have a word, and a second hash of long ones."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    placed = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.translate(p["x"], SPACES, "") != "")
    rows = once(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col)), "p", placed)
    rows = once(rows, "n", F.transform("p", lambda p: F.regexp_count(p["x"], F.lit(WORD))))
    check = F.transform("p", lambda p, i: F.when(F.get("n", i) >= LONG_WORDS, F.hash(p["x"])).otherwise(0))
    return rows.select("doc_id", "mark", F.transform("p", lambda p: p["i"]).alias("at"), F.transform("p", lambda p: F.xxhash64(p["x"])).alias("h"), "n", check.alias("c"))


def fingerprints(lines: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, mark, key, pos, low, around): each window minimum once, with the hashes within a window of it.

    ``around`` holds the hashes from line ``low`` on; a window that selected ``pos`` lies in it.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda s: F.struct(s.alias("s"), F.slice("h", s + 1, run).alias("w")))
    places = F.array_distinct(F.transform(windows, lambda v: _minimum(v["s"], v["w"], run)))
    found = lines.filter(F.size("h") >= run).select("doc_id", "mark", "h", F.explode(places).alias("pos"))
    low, high = F.greatest(F.lit(0), F.col("pos") - (run - 1)), F.least(F.size("h"), F.col("pos") + run)
    found = found.select("doc_id", "mark", "h", "pos", low.alias("low"), (high - low).alias("n"))
    return found.select("doc_id", "mark", F.element_at("h", F.col("pos") + 1).alias("key"), "pos", "low", F.slice("h", F.col("low") + 1, F.col("n")).alias("around"))


def _minimum(start: Column, window: Column, run: int) -> Column:
    """Line of a window's smallest hash, the last of equal ones."""
    return (start + run - F.array_position(F.reverse(window), F.array_min(window))).cast("int")


def long_windows(lines: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, mark, s, n, w): windows of fewer than ``run`` lines with LONG_WORDS words or more; a single line's has its second hash."""

    def of(k: int) -> Column:
        starts = F.when(F.size("h") >= k, F.sequence(F.lit(0), F.size("h") - k)).otherwise(F.array().cast("array<int>"))
        size = lambda s: sum(F.get("n", s + i) for i in range(k))
        held = lambda s: F.slice("h", s + 1, k)
        whole = (lambda s: F.array_append(held(s), F.get("c", s).cast("long"))) if k == 1 else held
        return F.transform(F.filter(starts, lambda s: size(s) >= LONG_WORDS), lambda s: F.struct(s.alias("s"), F.lit(k).alias("n"), whole(s).alias("w")))

    return lines.select("doc_id", "mark", F.explode(F.concat(*[of(k) for k in range(1, run)])).alias("v")).select("doc_id", "mark", "v.s", "v.n", "v.w")


def matches(lines: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, mark, s, n, first): windows whose content occurs earlier, joined to the earliest place (doc_id, mark, s) of it."""
    found = materialize(fingerprints(lines, run), "fingerprints")
    shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    starts = F.sequence(F.col("low"), F.col("low") + F.size("around") - run)
    windows = F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("around", s - F.col("low") + 1, run).alias("w")))
    own = F.filter(windows, lambda v: _minimum(v["s"], v["w"], run) == F.col("pos"))
    near = found.join(apart(shared, "shared"), "key", "left_semi").select("doc_id", "mark", F.explode(own).alias("v"))
    near = near.select("doc_id", "mark", "v.s", F.lit(run).alias("n"), "v.w").unionByName(long_windows(lines, run))
    return later_occurrences(near, ["n", "w"], ["doc_id", "mark", "s"]).drop("w")


def runs(found: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end, first_doc, first_mark, first_start): ``matches`` extended both ways to maximal runs [start, end)."""
    line = found.select("doc_id", "mark", "s", (F.col("s") + F.col("n")).alias("e"), F.col("first.doc_id").alias("first_doc"), F.col("first.mark").alias("first_mark"), (F.col("s") - F.col("first.s")).alias("diagonal"))
    pair = ["doc_id", "mark", "first_doc", "first_mark", "diagonal"]
    along = Window.partitionBy(*pair).orderBy("s", "e")
    reached = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cut = line.withColumn("fresh", F.coalesce((F.col("s") > reached).cast("int"), F.lit(1)))
    cut = cut.withColumn("part", F.sum("fresh").over(along))
    whole = cut.groupBy(*pair, "part").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    return whole.select("doc_id", "mark", "start", "end", "first_doc", "first_mark", (F.col("start") - F.col("diagonal")).alias("first_start"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc_id, mark, n_lines, lines): per distinct row, the number of lines with a word and the line numbers to delete."""
    lines = materialize(hashed(docs, id_col, text_col).dropDuplicates(["doc_id", "mark"]), "lines")
    gone = runs(matches(lines, run)).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("r"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "r")
    out = lines.select("doc_id", "mark", "at").join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["start"], r["end"] - 1)))))
    numbers = F.transform(covered, lambda k: F.element_at("at", k + 1))
    return out.select("doc_id", "mark", F.size("at").alias("n_lines"), F.coalesce(numbers, F.array().cast("array<int>")).alias("lines"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` with repeated lines deleted from their texts; rows without repeats come back as they are."""
    gone = removed(docs, id_col, text_col, run).filter(F.size("lines") > 0)
    left, right = docs.alias("l"), gone.alias("r")
    old = F.col(f"l.{text_col}")
    joined = left.join(right, F.col(f"l.{id_col}").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(old) == F.col("r.mark")), "left")
    kept = F.filter(F.transform(F.split(old, "\n", -1), lambda x, i: F.when(~F.array_contains("r.lines", i), x)), lambda x: x.isNotNull())
    new = F.when(F.col("r.lines").isNull(), old).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return joined.select(*[new if c == text_col else F.col(f"l.{c}") for c in docs.columns])
