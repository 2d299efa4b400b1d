"""Benchmark decontamination: an FM-index per training shard, searched backward with test phrases.

Phrases are the windows of ``WINDOW`` consecutive words of a benchmark item; a shorter item is one
phrase. A shard is a run of documents of one Arrow batch with ``SHARD_WORDS`` words at most; longer
documents are cut into pieces that overlap by a phrase less one word. Words that no phrase has cannot
match, nor can neighbours that no phrase has side by side: they end segments, and the index holds the
segments that are as long as the shortest phrase. Everything about a document happens in one task, so no
text is shuffled.

Phrases are a distributed table of distinct (phrase, item) pairs, dealt by their hash to blocks of about
``BLOCK_PAIRS`` pairs, a bound on memory whatever the benchmark. One block at a time passes through the
driver and is broadcast; a worker holds one block at a time, and searches its shard's index for each. No
more than ``BLOCKS_A_PASS`` blocks are out at once: a larger benchmark takes more passes, whose findings
are written between passes, and blocks are withdrawn after theirs.

Defined cases: null and blank texts have no words and hold nothing; an item without words is no phrase;
an empty benchmark hits nothing; rows of equal item_id are one item; an item without id counts for hits
and removals and is in no list of items. Documents are judged row by row; columns of any name come back.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelark.llm.common import by_pieces, drop, materialize
from tapelark.llm.fm_index import FMIndex

WINDOW, SHARD_WORDS = 13, 1_500_000
BLOCK_PAIRS, BLOCKS_A_PASS = 250_000, 16
#: A document is contaminated if one word in so many is hit.
SHARE = 20
#: Words are runs of letters and digits of ASCII and of anything beyond ASCII; A-Z is lowered.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_CHUNK, _SIDE_BY_SIDE, _STEP = 8 << 20, 22, np.uint64(0x9E3779B97F4A7C15)


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def windows(text: str | None, window: int = WINDOW) -> Iterator[bytes]:
    """The phrases of an item, words apart by a space."""
    found = folded(text).split()
    for at in range(max(1, len(found) - window + 1) if found else 0):
        yield b" ".join(found[at : at + window])


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of two neighbouring words in the table of those that phrases have."""
    return ((left.astype(np.uint64) * _STEP + right.astype(np.uint64)) * _STEP) >> np.uint64(64 - _SIDE_BY_SIDE)


@dataclass
class Phrases:
    """Word numbers (from 1), phrases by length as rows of numbers, and which items have them: item ``k`` of row ``r`` of a length."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[int, list[tuple[str, ...]]] = field(default_factory=dict)
    beside: np.ndarray = field(default_factory=lambda: np.zeros(1 << _SIDE_BY_SIDE, bool))

    @classmethod
    def of(cls, pairs: Iterable[tuple[bytes, str | None]]) -> Phrases:
        """From (phrase, item) pairs; a null item leaves the phrase without one."""
        out, held = cls(), {}
        for phrase, item in pairs:
            held.setdefault(phrase, set()).update(() if item is None else (item,))
        by: dict[int, list] = {}
        for phrase, items in held.items():
            found = phrase.split(b" ")
            by.setdefault(len(found), []).append((np.array([out.numbers.setdefault(w, len(out.numbers) + 1) for w in found], np.int32), tuple(items)))
        for width, found in by.items():
            out.rows[width], out.items[width] = np.array([r for r, _ in found], np.int32), [i for _, i in found]
            out.beside[_pair(out.rows[width][:, :-1], out.rows[width][:, 1:]).ravel()] = True
        return out

    @property
    def longest(self) -> int:
        return max(self.rows, default=1)

    def within_reach(self, numbers: np.ndarray) -> np.ndarray:
        """``numbers`` with 0 for words that are in no segment as long as the shortest phrase."""
        if not len(numbers) or not self.rows:
            return np.zeros_like(numbers)
        goes_on = (numbers[:-1] != 0) & (numbers[1:] != 0) & self.beside[_pair(numbers[:-1], numbers[1:])]
        segment = np.concatenate([[0], np.cumsum(~goes_on)])
        return np.where(np.bincount(segment)[segment] >= min(self.rows), numbers, 0)


def phrase_table(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(phrase, item) pairs, each once."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("phrase", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                every = windows(text)
                while part := list(itertools.islice(every, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], names=schema.names)

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, schema).distinct()


def passes(benchmark: DataFrame, id_col: str, text_col: str, block_pairs: int = BLOCK_PAIRS, at_once: int = BLOCKS_A_PASS) -> Iterator[list]:
    """The benchmark's phrases as lists of broadcast blocks, a list for each pass over the documents; one at least."""
    sc, pairs = benchmark.sparkSession.sparkContext, materialize(phrase_table(benchmark, id_col, text_col), "phrases")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)))

    def sent(k: int):
        got = dealt.filter(F.col("block") == k).select("phrase", "item").toArrow()
        return sc.broadcast(Phrases.of(zip(*[c.to_pylist() for c in got.columns], strict=True)))

    for first in range(0, blocks, at_once):
        yield [sent(k) for k in range(first, min(blocks, first + at_once))]
    drop(pairs)


def _numbered(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """Word numbers of a folded text, 0 for words without; long texts go chunk by chunk."""
    parts, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _CHUNK else raw.find(b" ", at + _CHUNK)
        end = len(raw) if end < 0 else end
        found = raw[at:end].split()
        parts.append(np.fromiter((numbers.get(w, 0) for w in found), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


@dataclass
class Found:
    """What one document holds: its words, hit spans of words [start, end) and items."""

    n_words: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    items: set[str] = field(default_factory=set)

    def merged(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for start, end in sorted(self.spans):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out


def _search(shard: list[tuple[int, int, np.ndarray]], phrases: Phrases, found: list[Found]) -> None:
    """Index a shard of (document, first word, word numbers) and add what its documents hold."""
    length = sum(len(x) + 1 for _, _, x in shard)
    numbers, owner = np.zeros(length, np.int32), np.empty(len(shard) + 1, np.int64)
    at = 0
    for k, (_, _, part) in enumerate(shard):
        numbers[at : at + len(part)], owner[k] = part, at
        at += len(part) + 1
    owner[-1] = at
    # A run of numberless words is one end of a segment.
    kept = (numbers != 0) | np.concatenate([[True], numbers[:-1] != 0])
    text, origin = numbers[kept], np.flatnonzero(kept)
    if not text.any():
        return
    index = FMIndex(text)
    for width, rows in phrases.rows.items():
        low, high = index.search(rows)
        hits = np.flatnonzero(high > low)
        counts = (high - low)[hits]
        which = np.repeat(hits, counts)
        first = np.repeat(low[hits] - (np.cumsum(counts) - counts), counts)
        places = origin[index.locate(first + np.arange(len(which)))]
        parts = np.searchsorted(owner, places, "right") - 1
        for phrase, place, part in zip(which.tolist(), places.tolist(), parts.tolist(), strict=True):
            doc, skipped, _ = shard[part]
            start = place - int(owner[part]) + skipped
            found[doc].spans.append((start, start + width))
            found[doc].items.update(phrases.items[width][phrase])


def scan_texts(texts: list[str | None], phrases: Phrases, shard_words: int = SHARD_WORDS, found: list[Found] | None = None) -> list[Found]:
    """What each text holds of the phrases, added to ``found`` where given."""
    out = found or [Found() for _ in texts]
    shard, size = [], 0
    for doc, text in enumerate(texts):
        numbers = _numbered(folded(text), phrases.numbers)
        out[doc].n_words = len(numbers)
        for at in range(0, max(1, len(numbers)), shard_words):
            piece = phrases.within_reach(numbers[at : at + shard_words + phrases.longest - 1])
            if size + len(piece) > shard_words and shard:
                _search(shard, phrases, out)
                shard, size = [], 0
            if piece.any():
                shard.append((doc, at, piece))
                size += len(piece)
    if shard:
        _search(shard, phrases, out)
    return out


def _scan(texts: list[str | None], blocks: list, found: list[Found]) -> list[Found]:
    """What the texts hold of the phrases of all blocks, added to ``found``; one block is held at a time."""
    for block in blocks:
        scan_texts(texts, block.value, found=found)
        if len(blocks) > 1:
            vars(block).pop("_value", None)  # the worker's copy; it is read from its file again
    return found


def _contaminated(hit: int, total: int) -> bool:
    return hit > 0 and SHARE * hit >= total


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
Finish = Callable[[pa.RecordBatch, list[str | None], list[Found]], pa.RecordBatch]


def _over(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, finish: Finish, schema: T.StructType) -> DataFrame:
    """``finish`` of each batch of ``docs`` with what its texts hold of the benchmark.

    Between passes, rows are written with what was found so far, in a last column of their own.
    """
    at, every, now, done = docs.columns.index(text_col), passes(benchmark, item_col, "text"), docs, None
    numbered = [f"c{k}" for k in range(len(docs.columns))]
    halfway = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(numbered, docs.schema, strict=True)], T.StructField("found", _FOUND)])

    def so_far(batch: pa.RecordBatch, texts: list[str | None]) -> list[Found]:
        if batch.num_columns == len(numbered):
            return [Found() for _ in texts]
        held = batch.column(len(numbered)).to_pylist()
        return [Found(h["n_words"], [(x["start"], x["end"]) for x in h["spans"]], set(h["items"])) for h in held]

    def search(blocks: list, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                found = _scan(texts, blocks, so_far(batch, texts))
                columns = batch.columns[: len(numbered)]
                if last:
                    yield finish(pa.RecordBatch.from_arrays(columns, names=numbered), texts, found)
                else:
                    held = [{"n_words": f.n_words, "items": sorted(f.items), "spans": [{"start": x, "end": y} for x, y in f.merged()]} for f in found]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(held, _FOUND_ARROW)], names=halfway.names)

        return by_pieces(run)

    blocks = next(every)
    while (more := next(every, None)) is not None:
        later = materialize(now.mapInArrow(search(blocks, False), halfway), "halfway")
        for block in blocks:
            block.unpersist()
        if done is not None:
            drop(done)
        now = done = later
        blocks = more
    return now.mapInArrow(search(blocks, True), schema)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (sorted as strings), spans of hit words, contaminated."""
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("contaminated", T.BooleanType()),
    ])

    def finish(batch: pa.RecordBatch, texts: list[str | None], found: list[Found]) -> pa.RecordBatch:
        spans = [f.merged() for f in found]
        hit = [sum(e - s for s, e in x) for x in spans]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([f.n_words for f in found], pa.int64()), pa.array(hit, pa.int64()),
            pa.array([sorted(f.items) for f in found], pa.list_(pa.string())),
            pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _FOUND_ARROW.field("spans").type),
            pa.array([_contaminated(h, f.n_words) for h, f in zip(hit, found, strict=True)], pa.bool_()),
        ], names=schema.names)

    return _over(docs.select(id_col, text_col), benchmark, item_col, text_col, finish, schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without its words [start, end), each with what stands between them."""
    raw, folds = text.encode("utf-8", "surrogatepass"), folded(text)
    bounds, at = [], 0
    for word in folds.split():
        at = folds.find(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for start, end in spans:
        out.append(raw[done : bounds[start][0]])
        done = bounds[end - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", chars_col: str = "n_chars") -> DataFrame:
    """The documents that are not contaminated, with their columns; hit spans are cut from those with fewer hits.

    ``chars_col``, if there, is renewed where a text is cut. Clean documents come back as they are.
    """
    names = docs.columns

    def finish(batch: pa.RecordBatch, texts: list[str | None], found: list[Found]) -> pa.RecordBatch:
        spans = [(f.n_words, f.merged()) for f in found]
        stays = [not _contaminated(sum(e - s for s, e in x), n) for n, x in spans]
        columns = list(batch.columns)
        if any(x and k for (_, x), k in zip(spans, stays, strict=True)):
            done = [cut(t, x) if x and k else t for t, (_, x), k in zip(texts, spans, stays, strict=True)]
            columns[names.index(text_col)] = pa.array(done, columns[names.index(text_col)].type)
            if chars_col in names:
                at = names.index(chars_col)
                chars = [len(d) if x and k else c for d, (_, x), k, c in zip(done, spans, stays, columns[at].to_pylist(), strict=True)]
                columns[at] = pa.array(chars, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    return _over(docs, benchmark, item_col, text_col, finish, docs.schema)
