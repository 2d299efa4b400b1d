"""Token ids in binary packs: documents compressed one by one with a shared zstandard dictionary.

Format, a Parquet table with one row per pack, in ascending order of (part, pack): ``payload`` is the
packed documents' zstandard frames end to end; ``doc_id``, ``frame_end`` and ``n_tokens`` are the offset
index, an entry per document in ascending doc_id order, so that one document is read by two offsets;
``dict_sha256`` names the dictionary, whose bytes are the one row of the ``dictionary`` table beside it.
A frame holds a document's ids as little-endian unsigned 16-bit integers, or 32-bit where the
vocabulary needs them (``width``). Packs end at ``PACK_BYTES`` of payload.

The dictionary is trained on the ids of ``SAMPLE_DOCS`` documents, those of the lowest hash of their id
(of equal ids, those of the lowest hash of text), cut at ``SAMPLE_BYTES`` each: a documented, bounded sample that only sets how small frames get.

Defined cases: a null text counts as empty and has the end id alone; documents of equal id follow each
other by a hash of their text; a null id comes first; an empty table gives no packs.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tapelark.llm.common import by_pieces, materialize, scratch, short_batches, sized

END_ID, PACK_BYTES = 0, 4 << 20
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1024, 8 << 10, 64 << 10, 3
#: Units whose ids a worker remembers before it keeps the half that it met most often and forgets the others.
REMEMBERED = 1_300_000
#: Units that are looked up in the library at a time; its answers are large while they last.
LEARNED = 10_000
#: The white space of Unicode besides space and line end.
_OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where a cut would go through white space that the pre-tokenizer keeps together.
_UNEVEN = ("  ", " \n", "\n ", "\n\n\n", "\0")


class _Codes(dict):
    """Number of each unit, in the order of first sight."""

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        return code


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these starts and sizes, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, or a longer copy with zeros after it, so that it has n places at least."""
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """Whole-text ids by a byte-level BPE of the tokenizers library, with remembered units.

    The byte-level pre-tokenizer never joins a character that is not white space with white space after
    it; a space goes with the character after it, a line end stands alone. So the ids of a text are those
    of its units, each a word with the space or line end before it. Texts for which that does not hold
    (other or repeated white space, strings of added tokens) go to the library whole, and so do all texts
    if the tokenizer is of another kind.
    """

    def __init__(self, path: str, remembered: int | None = None) -> None:
        self.remembered = REMEMBERED if remembered is None else remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.by_unit = (
            kind["normalizer"] is None and kind["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True and before.get("add_prefix_space") is False
        )
        # Unit k has the ids flat[ends[k] : ends[k + 1]] and was met in met[k] calls; the arrays have room to grow.
        self.codes, self.known, self.flat, self.ends, self.met = _Codes(), 0, np.zeros(0, f"<u{self.width}"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep half of ``remembered`` units at most, those met most often, under new numbers; their counts are halved."""
        kept = np.sort(np.argpartition(-self.met[: self.known], self.remembered // 2)[: self.remembered // 2])
        kept = kept[self.met[kept] > 1]
        units, sizes = list(self.codes), self.ends[kept + 1] - self.ends[kept]
        self.codes = _Codes(zip(map(units.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.flat = self.flat[_places(self.ends[kept], sizes)]
        self.known, self.ends, self.met = len(kept), np.concatenate([[0], np.cumsum(sizes)]), self.met[kept] // 2

    def _learn(self) -> None:
        """Ids of units seen since the last time, from the library."""
        new = list(islice(self.codes, self.known, None))
        self.ends, self.met = _room(self.ends, len(self.codes) + 1), _room(self.met, len(self.codes))
        for at in range(0, len(new), LEARNED):
            part, total = new[at : at + LEARNED], self.ends[self.known]
            texts = [u[1:] if u[:1] == "\0" else u if u[:1] == "\n" else " " + u for u in part]
            got = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, self.flat.dtype)
            self.flat = _room(self.flat, total + len(ids))
            self.flat[total : total + len(ids)] = ids
            self.ends[self.known + 1 : self.known + 1 + len(part)] = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(1, len(part) + 1)) + total
            self.known += len(part)

    def _units(self, text: str) -> list[str] | None:
        """The units of a text, the first marked as such; null if it has to go to the library whole."""
        if not self.by_unit or any(x in text for x in _UNEVEN) or text[:1] == " " or text[-1:] == " " or text[-2:] == "\n\n":
            return None
        if any(x in text for x in _OTHER_SPACE) or any(x in text for x in self.added):
            return None
        units = text.replace("\n", " \n").split(" ")
        units[0] = "\0" + units[0]
        return units

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``width``."""
        if len(self.codes) > self.remembered:
            self._forget()
        cut = [self._units(t or "") for t in texts]
        counts = np.array([len(u) if u else 0 for u in cut], np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(u for u in cut if u)), np.int64, counts.sum())
        self._learn()
        self.met[codes] += 1
        starts, sizes = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[_places(starts, sizes)]
        bounds = before[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [
            ids[bounds[k] : bounds[k + 1]].tobytes() if u else np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, ids.dtype).tobytes()
            for k, (u, t) in enumerate(zip(cut, texts, strict=True))
        ]


@lru_cache(1)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    return Encoder(path, remembered)


def _in_parts(sizes: list[int], most: int = 1000, total: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of a bounded number and size."""
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start >= most or held + n > total):
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def train_dictionary(docs: DataFrame, path: str, id_col: str, text_col: str, remembered: int | None = None) -> bytes:
    """A dictionary for id arrays from a bounded sample; empty where the sample is too small to train on."""
    place = F.xxhash64(id_col).alias("h")
    edge = docs.select(place).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if edge is None:
        return b""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, remembered)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x[:SAMPLE_BYTES] for a, b in _in_parts([len(t) for t in texts]) for x in encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["h", "ids"])

    cut = docs.select(place, F.xxhash64(text_col).alias("mark"), F.substring(text_col, 1, SAMPLE_BYTES).alias("text")).filter(F.col("h") <= edge)
    picked = cut.orderBy("h", "mark").limit(SAMPLE_DOCS).select("h", "text").mapInArrow(by_pieces(run), schema)
    samples = [bytes(r.ids) for r in sorted(picked.collect(), key=lambda r: (r.h, bytes(r.ids))) if r.ids]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


PACK = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("pack", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("dict_sha256", T.StringType()),
    T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("frame_end", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType()),
])


def _dict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, target: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, pack_bytes: int = PACK_BYTES, remembered: int | None = None) -> None:
    """Encode every text, append ``end_id``, and write packs and dictionary under the folder ``target``; ``remembered`` units by a worker."""
    spark = docs.sparkSession
    trained = train_dictionary(docs, path, id_col, text_col, remembered)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, trained)], "dict_sha256 string, bytes binary").coalesce(1).write.parquet(f"{target}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, remembered)
        end = np.array([end_id], f"<u{encode.width}").tobytes()
        pack_to = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(trained), write_checksum=False)
        part, pack = TaskContext.get().partitionId(), 0
        ids: list = []
        ends: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = [[part], [pack], [encode.width], [digest], [ids], [ends], [counts], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=PACK.names)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in _in_parts(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                for doc, raw in zip(names[a:b], encode(texts[a:b].to_pylist()), strict=True):
                    frame = pack_to.compress(raw + end)
                    frames.append(frame)
                    size += len(frame)
                    ids.append(doc)
                    ends.append(size)
                    counts.append(len(raw) // encode.width + 1)
                    if size >= pack_bytes:
                        yield flush()
                        pack += 1
                        ids, ends, counts, frames, size = [], [], [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    with short_batches(spark):
        ordered.mapInArrow(by_pieces(run), PACK).write.option("compression", "none").parquet(f"{target}/packs")


def packs(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(PACK).parquet(f"{target}/packs")


def dictionary(spark: SparkSession, target: str) -> bytes:
    row = spark.read.parquet(f"{target}/dictionary").first()
    raw = bytes(row.bytes)
    if hashlib.sha256(raw).hexdigest() != row.dict_sha256:
        raise ValueError("the dictionary does not have the hash that it is kept under")
    return raw


def unpack(payload: bytes, ends: list[int], width: int, shared, which: Iterator[int] | None = None) -> Iterator[np.ndarray]:
    """Ids of a pack's documents, all or those at the places ``which``; only their frames are read."""
    reader = zstandard.ZstdDecompressor(dict_data=shared)
    view = memoryview(payload)
    for k in range(len(ends)) if which is None else which:
        yield np.frombuffer(reader.decompress(view[ends[k - 1] if k else 0 : ends[k]]), f"<u{width}")


def read_ids(spark: SparkSession, target: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of some documents by the offset index: packs without them are skipped, other frames stay packed."""
    shared, wanted, out = _dict(dictionary(spark, target)), set(doc_ids), {}
    held = packs(spark, target).filter(F.arrays_overlap("doc_id", F.array(*[F.lit(x).cast("long") for x in doc_ids])))
    for row in held.toLocalIterator():
        at = [k for k, x in enumerate(row.doc_id) if x in wanted]
        for k, ids in zip(at, unpack(bytes(row.payload), row.frame_end, row.width, shared, iter(at)), strict=True):
            out.setdefault(row.doc_id[k], []).extend(ids.tolist())
    return out


def digests(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files; start counts the ids of all documents before it."""
    shared_raw, names = dictionary(spark, target), ["part", "pack", "at", "doc_id", "before", "n_tokens", "ids_crc32"]
    digest = hashlib.sha256(shared_raw).hexdigest()
    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("part", "pack", "at") else T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dict(shared_raw)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("a pack names another dictionary")
                ids = list(unpack(row["payload"], row["frame_end"], row["width"], shared))
                counts = np.array([len(x) for x in ids], np.int64)
                if counts.tolist() != row["n_tokens"]:
                    raise ValueError("a pack's index does not agree with its frames")
                n = len(ids)
                crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                columns = [[row["part"]] * n, [row["pack"]] * n, range(n), row["doc_id"], (np.cumsum(counts) - counts), counts, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 3 else pa.int64()) for k, c in enumerate(columns)], names=names)

    held = packs(spark, target)
    sums = held.select("part", "pack", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    whole = sums.groupBy("part").agg(F.sum("n").alias("n"))
    whole = whole.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.join(whole, "part").select("part", "pack", (F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("base"))
    starts = materialize(starts, "starts")
    rows = held.mapInArrow(run, schema).join(sized(starts), ["part", "pack"])
    return rows.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """Write the documents in the file format into the shared folder and digest what the files hold."""
    import uuid

    target = f"{scratch(docs.sparkSession)}/tapelark/tokens-{uuid.uuid4().hex[:12]}"
    write(docs, target, path, id_col, text_col, remembered=remembered)
    return digests(docs.sparkSession, target)
