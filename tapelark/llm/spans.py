"""Substring dedup by sliding sentence spans.

A sentence ends at a line end, or after ``.``, ``!`` or ``?`` before white space. Two sentences are equal
if their words are, with A-Z lowered. From every sentence a span goes on, and up to every sentence a span
goes back, until it has ``SPAN`` sentences and ``MIN_WORDS`` words; a single sentence of ``LONG_WORDS``
words is a span by itself. All spans are hashed and joined globally, and sentences covered by a span that
occurs at an earlier place (by document id, then hash of the text, then sentence) are removed.

So of a repeated passage of whole sentences, which has a span, every sentence is covered: by the span that
starts at it, or by the one that ends with the passage. Where fewer than ``MIN_WORDS`` words or ``SPAN``
sentences are left on a side, no span starts (or ends) there; that rest is covered from the other side. A
text that is shorter as a whole, or whose repeats are, is too short to tell a copy from chance and stays.

Defined cases: null and blank texts have no sentences; documents without a span are left as they are; rows
equal in id and text are one document; a null id comes first in order; columns of any name come back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import later_occurrences, materialize

SPAN, MIN_WORDS, LONG_WORDS = 2, 30, 50
_LONG = (1 << 64) - 1
_end = re.compile(r"[.!?]+(?=[ \t\r\x0b\x0c\n])|\n")
_SPACE = " \t\r\x0b\x0c"
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Bounds [start, end) of the sentences that have a word."""
    text, out, start = text or "", [], 0
    for m in _end.finditer(text):
        end = m.start() if m[0] == "\n" else m.end()
        if text[start:end].strip(_SPACE):
            out.append((start, end))
        start = m.end()
    if text[start:].strip(_SPACE):
        out.append((start, len(text)))
    return out


def runs(counts: list[int]) -> list[tuple[int, int]]:
    """Bounds [start, end) of the spans, in order; ``counts`` has the words before each sentence, and all."""
    n = len(counts) - 1
    out = {(s, s + 1) for s in range(n) if counts[s + 1] - counts[s] >= LONG_WORDS}
    for s in range(n - SPAN + 1):
        end = max(s + SPAN, bisect_left(counts, counts[s] + MIN_WORDS))
        if end <= n:
            out.add((s, end))
    for end in range(SPAN, n + 1):
        start = min(end - SPAN, bisect_right(counts, counts[end] - MIN_WORDS) - 1)
        if start >= 0:
            out.add((start, end))
    return sorted(out)


def span_hashes(text: str | None) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Number of sentences; starts and lengths of the spans, and 64 and 32 bits of their hashes."""
    found = [(text or "")[a:b].encode("utf-8", "surrogatepass").translate(_FOLD).split() for a, b in sentences(text)]
    flat, counts = [b" ".join(x) for x in found], [0, *accumulate(map(len, found))]
    held = runs(counts)
    whole = [xxhash.xxh3_128_intdigest(b"\n".join(flat[s:e])) for s, e in held]
    return len(found), [s for s, _ in held], [e - s for s, e in held], [(x & _LONG) - (1 << 63) for x in whole], [(x >> 96) - (1 << 31) for x in whole]


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_sentences, starts, sizes, hashes, checks) per row: 96 bits name a span, so that a corpus of any size has no chance ones."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("mark", T.LongType()), T.StructField("n_sentences", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("checks", T.ArrayType(T.IntegerType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [span_hashes(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()),
                pa.array([g[1] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.list_(pa.int32())),
                pa.array([g[3] for g in got], pa.list_(pa.int64())), pa.array([g[4] for g in got], pa.list_(pa.int32())),
            ], names=schema.names)

    return docs.select(id_col, F.xxhash64(text_col).alias("mark"), text_col).mapInArrow(run, schema)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_sentences, sentences): per distinct row, the numbers of the sentences to remove."""
    rows = materialize(hashed(docs, id_col, text_col).dropDuplicates(["doc_id", "mark"]), "spans")
    placed = rows.select("doc_id", "mark", F.posexplode(F.arrays_zip("hashes", "checks")).alias("k", "p")).select(
        "doc_id", "mark", "k", F.col("p.hashes").alias("h"), F.col("p.checks").alias("c")
    )
    later = later_occurrences(placed, ["h", "c"], ["doc_id", "mark", "k"]).groupBy("doc_id", "mark").agg(F.collect_list("k").alias("ks"))
    later = later.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "ks")
    out = rows.drop("hashes", "checks").join(later, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left")
    spanned = F.transform("ks", lambda k: F.sequence(F.get("starts", k), F.get("starts", k) + F.get("sizes", k) - 1))
    covered = F.array_sort(F.array_distinct(F.flatten(spanned)))
    return out.select("doc_id", "mark", "n_sentences", F.coalesce(covered, F.array().cast("array<int>")).alias("sentences"))


def without(text: str, numbers: list[int]) -> str:
    """The text without the sentences of these numbers."""
    bounds, out, done = sentences(text), [], 0
    for k in numbers:
        out.append(text[done : bounds[k][0]])
        done = bounds[k][1]
    return "".join([*out, text[done:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated spans removed from their texts; rows without repeats come back as they are."""
    gone = removed(docs, id_col, text_col).filter(F.size("sentences") > 0)
    on = F.col(f"l.{id_col}").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64(F.col(f"l.{text_col}")) == F.col("r.mark"))
    names = docs.columns
    # Columns by number: a user's may have any name.
    own = [F.col(f"l.{c}").alias(f"c{k}") for k, c in enumerate(names)]
    joined = docs.alias("l").join(gone.alias("r"), on, "left").select(*own, F.col("r.sentences").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(names.index(text_col)), batch.column(len(names))
            done = [without(t, g) if g else t for t, g in zip(texts.to_pylist(), lost.to_pylist(), strict=True)]
            columns = [pa.array(done, texts.type) if c == text_col else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
