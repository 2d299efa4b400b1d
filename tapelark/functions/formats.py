"""Number formats of stored matrices, byte tokens, sizes, canonical JSON."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BYTES = {"fp32": 4, "fp16": 2, "bf16": 2}


def half(bits: Column) -> Column:
    """The value of a 16-bit half float given as an integer 0..65535."""
    sign = F.when(F.shiftright(bits, 15) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    power, part = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    normal = F.pow(F.lit(2.0), power - 15) * (F.lit(1.0) + part / F.lit(1024.0))
    return (sign * F.when(power == 31, special).when(power == 0, part * F.lit(2.0**-24)).otherwise(normal)).cast("float")


def bfloat(bits: Column) -> Column:
    """The value of a 16-bit brain float: the upper half of a 32-bit float."""
    sign = F.when(F.shiftright(bits, 15) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    power, part = F.shiftright(bits, 7).bitwiseAND(255), bits.bitwiseAND(127)
    special = F.when(part == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    normal = F.pow(F.lit(2.0), power - 127) * (F.lit(1.0) + part / F.lit(128.0))
    return (sign * F.when(power == 255, special).when(power == 0, part * F.lit(2.0**-133)).otherwise(normal)).cast("float")


def word16(raw: Column, index: Column) -> Column:
    """Little-endian 16-bit integer number ``index`` of a binary."""
    low, high = F.substring(raw, index * 2 + 1, F.lit(1)), F.substring(raw, index * 2 + 2, F.lit(1))
    return (F.conv(F.hex(high), 16, 10).cast("int") * 256 + F.conv(F.hex(low), 16, 10).cast("int")).cast("int")


def byte_tokens(text: Column) -> Column:
    """The UTF-8 bytes of a text as integers."""
    raw = F.encode(text, "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.length(raw) > 0, codes).when(text.isNotNull(), F.array().cast("array<int>"))


def human_bytes(n: Column) -> Column:
    x = n.cast("double")
    out = F.format_string("%.0f B", x)
    for power, unit in ((1e3, "kB"), (1e6, "MB"), (1e9, "GB"), (1e12, "TB")):
        out = F.when(x >= power, F.format_string(f"%.1f {unit}", x / power)).otherwise(out)
    return out


def encode_matrix(rows: np.ndarray, dtype: str) -> bytes:
    """Token-major little-endian bytes of a [tokens, addresses] matrix."""
    if dtype == "fp32":
        return np.ascontiguousarray(rows, "<f4").tobytes()
    if dtype == "fp16":
        return np.ascontiguousarray(rows, "<f2").tobytes()
    bits = np.ascontiguousarray(rows, "<f4").view("<u4").astype(np.uint64)
    return ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2").tobytes()


def decode_matrix(raw: bytes, dtype: str, width: int, source: str = "logical_values") -> np.ndarray:
    """Float32 matrix [tokens, width]; ``source`` tells bytes that are halves under the name bf16."""
    if dtype == "fp32":
        flat = np.frombuffer(raw, "<f4")
    elif dtype == "fp16" or source == "cpu_fallback_fp16_bytes":
        flat = np.frombuffer(raw, "<f2")
    else:
        flat = (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4")
    return flat.astype(np.float32).reshape(-1, width)


def canonical(value) -> str:
    """JSON text with sorted keys and no spare space, as hashes are taken of it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical spelling of JSON text; null if it is not JSON.

    JVM functions respell numbers (0.0 as 0), which breaks hashes; hence Python, in Arrow batches.
    """

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return None

    return text.map(one)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON text, in a column ``j``."""
    return df.select(F.to_json(F.struct("*")).alias("j"))
