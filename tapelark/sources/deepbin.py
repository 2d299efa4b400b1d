"""Dense matrices in binary files: decoding to series, encoding from them, and a data source for one file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tapelark.errors import BadInput
from tapelark.functions.formats import BYTES, decode_matrix, encode_matrix


def read_series(raw: DataFrame, decode: Callable[..., np.ndarray], tokens: tuple[int, int] | None, wanted: list[str] | None) -> DataFrame:
    """(run_id, address, series) of rows (run_id, content, dtype, watched, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                names = list(r.watched)
                matrix = decode(r.content, r.dtype, len(names), r.source or "")
                low, high = tokens or (0, len(matrix) - 1)
                keep = [k for k, n in enumerate(names) if wanted is None or n in wanted]
                part = matrix[low : high + 1][:, keep].T
                yield pd.DataFrame({"run_id": r.run_id, "address": [names[k] for k in keep], "series": list(part)})

    return raw.select("run_id", "content", "dtype", "watched", "source").mapInPandas(run, "run_id string, address string, series array<float>")


def cold_slice(path: str, dtype: str, width: int, tokens: tuple[int, int], columns: list[int] | None = None) -> np.ndarray:
    """Token rows low..high of some columns of one local matrix file, read by its map of bytes."""
    size = BYTES[dtype] * width
    try:
        flat = np.memmap(path, np.uint8, "r")
    except (OSError, ValueError) as e:
        raise BadInput(f"cannot read {path}: {e}") from e
    if not 0 <= tokens[0] <= tokens[1] or (tokens[1] + 1) * size > len(flat):
        raise BadInput(f"tokens {tokens[0]}..{tokens[1]} are not in the file")
    if columns is not None and any(not 0 <= c < width for c in columns):
        raise BadInput(f"columns {columns} are not in 0..{width - 1}")
    matrix = decode_matrix(flat[tokens[0] * size : (tokens[1] + 1) * size].tobytes(), dtype, width)
    return matrix if columns is None else matrix[:, columns]


def matrices(series: DataFrame, watched: DataFrame, dtype: str = "fp16") -> DataFrame:
    """(run_id, content): the binary matrix of each run, token-major; ``watched`` is (run_id, watched array).

    A run's matrix is one value by definition of the format, so a run meets in one row.
    """
    columns = watched.select("run_id", F.posexplode("watched").alias("k", "address")).join(series, ["run_id", "address"])
    rows = columns.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("k", "series"))).alias("m")).select("run_id", F.col("m.series").alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"run_id": batch.run_id, "content": [encode_matrix(np.array([list(x) for x in m]).T, dtype) for m in batch.m]})

    return rows.mapInPandas(run, "run_id string, content binary")


def index_document(run_id: str, watched: list[str], tokens: int, dtype: str = "fp16", every_n: int = 1, window: dict | None = None) -> dict:
    """deep_index.json of a run; without tokens that of a run that never armed, which has no matrix."""
    if dtype not in BYTES:
        raise BadInput(f"bad dtype {dtype!r}; of {', '.join(BYTES)}")
    if every_n < 1:
        raise BadInput(f"every_n is at least 1, not {every_n}")
    columns = {a: {"offset": k, "dtype": dtype, "shape": [tokens]} for k, a in enumerate(watched)} if tokens else {}
    meta = {"stored": dtype, "source": "logical_values", "endian": "little", "order": "row_major_token_major"}
    return {
        "run_id": run_id, "triggered": tokens > 0, "dtype": dtype, "tokens": tokens, "every_n": every_n, "window": window, "watched": watched, "columns": columns, "dtype_meta": meta,
    }


def deep_files(series: DataFrame, dtype: str = "fp16") -> DataFrame:
    """(run_id, content, watched, tokens): matrix and columns of each run that has series, addresses in the order of the model."""
    order = F.array_sort(F.collect_list(F.struct("kind", "layer", "idx", "address")))
    watched = series.groupBy("run_id").agg(order.alias("o"), F.max(F.size("series")).alias("tokens")).select("run_id", F.col("o.address").alias("watched"), "tokens")
    return matrices(series.select("run_id", "address", "series"), watched.select("run_id", "watched"), dtype).join(watched, "run_id")


class DeepBinSource(DataSource):
    """``spark.read.format("deepbin").option("path", ...).option("width", W).option("dtype", ...)``: (tok, col, value).

    With the option pushdown "true", ranges of tok and equality or lists of col are pushed down; Spark wants
    spark.sql.python.filterPushdown.enabled for that.
    """

    @classmethod
    def name(cls) -> str:
        return "deepbin"

    def schema(self) -> str:
        return "tok int, col int, value float"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


class _Part(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    ROWS = 65536

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width, self.dtype = options["path"], int(options["width"]), options.get("dtype", "fp16")
        self.low, self.high, self.columns = 0, None, None

    def _tokens(self) -> int:
        import os

        return os.path.getsize(self.path) // (BYTES[self.dtype] * self.width)

    def partitions(self) -> list[_Part]:
        top = min(self._tokens() - 1, self._tokens() if self.high is None else self.high)
        return [_Part(a, min(top, a + self.ROWS - 1)) for a in range(self.low, top + 1, self.ROWS)]

    def read(self, partition: _Part):
        import pyarrow as pa

        columns = [c for c in range(self.width) if self.columns is None or c in self.columns]
        if not columns:
            return
        part = cold_slice(self.path, self.dtype, self.width, (partition.low, partition.high), columns)
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(partition.low, partition.low + n, dtype=np.int32), len(columns))), pa.array(np.tile(np.array(columns, np.int32), n)), pa.array(part.ravel(), pa.float32())],
            names=["tok", "col", "value"],
        )


class _PushingReader(_Reader):
    """Spark refuses readers that take filters while its setting for that is off; hence a class of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            bounds = {GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0), EqualTo: (0, 0)}.get(type(f))
            if bounds and f.attribute == ("tok",):
                if bounds[0] is not None:
                    self.low = max(self.low, f.value + bounds[0])
                if bounds[1] is not None:
                    top = f.value + bounds[1]
                    self.high = top if self.high is None else min(self.high, top)
            elif isinstance(f, EqualTo | In) and f.attribute == ("col",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.columns = some if self.columns is None else self.columns & some
            else:
                yield f
