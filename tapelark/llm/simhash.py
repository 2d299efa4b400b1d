"""SimHash near-duplicates through an inverted index on the byte positions of fingerprints.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most two bits
differ in at most two of them, so they share at least six: that is the guaranteed number of matches.
Lists of single positional bytes would hold 1/256 of all documents, and tallying their pairs grows with
the square of the corpus. Postings are therefore keyed by four positional bytes at a time, the 14 sets of
the Steiner system S(3, 4, 8): every three of the eight positions are in one of the sets, and so of any six
positions three sets, of seven seven, and of five or fewer one set at most. Tallying the lists that a pair
shares thus tells whether it shares the guaranteed six bytes: pairs with ``MIN_LISTS`` or more are
retained, and verified bit by bit.

Lists longer than ``SHORT_LIST`` (groups of near copies) never have their pairs written out. Their
fingerprints are posted once more under each one-bit variant of themselves: two fingerprints at most
two bits apart share a variant, and such a list has 65 entries at most, all of them in reach of each
other through it. Linking each entry to the list's smallest keeps every component whole. A pair none of
whose shared lists is long is tallied in full.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal rows share a
fingerprint; a null doc_id never names a component unless the component has no other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import apart, connected_components, materialize, sized

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: The sets of four positions by which fingerprints are posted: those whose numbers cancel out under exclusive or.
PLACES = tuple(c for c in itertools.combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: Lists that two fingerprints at most MAX_BITS apart share at least: sets that avoid MAX_BITS positions.
MIN_LISTS = min(sum(not {x, y} & set(c) for c in PLACES) for x, y in itertools.combinations(range(8), MAX_BITS))
#: Longest posting list whose pairs are written out.
SHORT_LIST = 24
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_BLOCK = 1 << 15


def folded_words(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def digests(found: list[bytes], shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of the shingles of a text's words, repeats included, in blocks; fewer words are one shingle."""
    spans = max(1, len(found) - shingle + 1) if found else 0
    digest = xxhash.xxh64_digest
    for at in range(0, spans, _BLOCK):
        part = [found[at + k : min(at + _BLOCK, spans) + k] for k in range(min(shingle, len(found)))]
        yield np.frombuffer(b"".join([digest(b" ".join(x), seed) for x in zip(*part)]), ">u8")


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    ones, spans = np.zeros(64, np.int64), 0
    for part in digests(folded_words(text), shingle, seed):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        spans += len(part)
    return int.from_bytes(np.packbits(2 * ones > spans).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def links(marks: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all pairs in reach.

    ``marks`` has one row per distinct ``fp``.
    """
    masks = [sum(0xFF << 8 * p for p in places) for places in PLACES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = marks.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("places", "bytes"))
    lists = materialize(posted.groupBy("places", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    held = posted.join(sized(lists), ["places", "bytes"])
    listed = held.filter(F.col("n") <= short_list).groupBy("places", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    every = "flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as a, y as b))))"
    pairs = listed.select(F.explode(F.expr(every)).alias("p")).select("p.a", "p.b")
    tallied = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists")).filter(F.col("lists") >= MIN_LISTS).select("a", "b")
    crowded = held.filter(F.col("n") > short_list).select("fp").distinct()
    variants = crowded.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")).alias("variant"))
    stars = (
        variants.groupBy("variant").agg(F.collect_list("fp").alias("l")).filter(F.size("l") > 1)
        .select(F.array_min("l").alias("a"), F.explode("l").alias("b")).filter("a != b")
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return tallied.unionByName(stars).filter(near).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    marks = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("low")), "marks")
    parts = connected_components(links(marks.select("fp")))
    rooted = marks.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    lows = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialize(rooted.join(apart(lows, "lows"), "component").select("fp", "component_id"), "named")
    return marked.join(sized(named), "fp").select(id_col, "fp", "component_id")


def hex_mark(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
