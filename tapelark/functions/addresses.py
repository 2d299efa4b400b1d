"""Addresses of recorded cells: N-LL-NNNN, A-LL-HH, L-LL, LOGITS, EMBED, NORM, with ranges in the last number."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelark.errors import BadAddress, BadInput

SPECIAL = ("LOGITS", "EMBED", "NORM")
#: Bounds assumed where no manifest is at hand.
DEFAULT_ARCH = {"layers": 32, "heads": 32, "mlp": 14336}
_one = re.compile(r"(?:([NA])-(\d{2,})-(\d{2,})(?:\.\.(\d{2,}))?|L-(\d{2,})(?:\.\.(\d{2,}))?)\Z")


@dataclass(frozen=True)
class Span:
    """Addresses of one kind: a layer's numbers low..high, layers low..high (kind L), or a special one."""

    kind: str
    layer: int = 0
    low: int = 0
    high: int = 0

    @property
    def text(self) -> str:
        first = name(self.kind, self.layer, self.low)
        return first if self.low == self.high else f"{first}..{name(self.kind, self.layer, self.high).rsplit('-', 1)[-1]}"

    def names(self) -> list[str]:
        return [name(self.kind, self.layer, k) for k in range(self.low, self.high + 1)]

    def holds(self, kind: Column, layer: Column, idx: Column) -> Column:
        """Column: whether a cell's address is in the span. Plain comparisons, so that scans can use them."""
        if self.kind in SPECIAL:
            return kind == self.kind
        if self.kind == "L":
            return (kind == "L") & layer.between(self.low, self.high)
        return (kind == self.kind) & (layer == self.layer) & idx.between(self.low, self.high)


def name(kind: str, layer: int, idx: int) -> str:
    """Canonical spelling; for kind L ``idx`` is the layer."""
    return {"N": f"N-{layer:02d}-{idx:04d}", "A": f"A-{layer:02d}-{idx:02d}", "L": f"L-{idx:02d}"}.get(kind, kind)


def parse(text: str) -> Span:
    if text in SPECIAL:
        return Span(text)
    found = _one.match(text)
    if not found:
        raise BadAddress(f"bad address {text!r}; valid: N-01-0001..0100, A-01-01, L-01, {', '.join(SPECIAL)}")
    kind = found[1] or "L"
    low, high = (found[3], found[4]) if found[1] else (found[5], found[6])
    span = Span(kind, int(found[2] or 0), int(low), int(high or low))
    if span.high < span.low:
        raise BadInput(f"reversed range {text!r}")
    return span


def expand(texts: list[str]) -> list[str]:
    """All addresses of the texts, each once, in the order of first mention."""
    return list(dict.fromkeys(x for t in texts for x in parse(t).names()))


def check(texts: list[str], arch: dict[str, int]) -> None:
    """Raise for the first address outside a model's inventory."""
    for text in texts:
        span = parse(text)
        layers = (span.low, span.high) if span.kind == "L" else (span.layer, span.layer)
        top = {"N": arch["mlp"], "A": arch["heads"]}.get(span.kind)
        if span.kind not in SPECIAL and not (1 <= layers[0] and layers[1] <= arch["layers"]) or top and not (1 <= span.low and span.high <= top):
            raise BadAddress(f"{text} is not in the model; layers 1..{arch['layers']}, heads 1..{arch['heads']}, neurons 1..{arch['mlp']}")


def kind_of(address: Column) -> Column:
    return F.when(address.rlike("^[NAL]-"), F.substring(address, 1, 1)).otherwise(address)


def layer_of(address: Column) -> Column:
    return F.regexp_extract(address, "^[NAL]-([0-9]+)", 1).try_cast("int")


def idx_of(address: Column) -> Column:
    return F.regexp_extract(address, "^[NA]-[0-9]+-([0-9]+)$", 1).try_cast("int")


def parent(address: Column) -> Column:
    """The part of a model that an address belongs to."""
    layer = F.format_string("layer-%02d", layer_of(address))
    kind = kind_of(address)
    return F.when(kind == "N", F.concat(layer, F.lit(".mlp"))).when(kind == "A", F.concat(layer, F.lit(".attn"))).when(kind == "L", layer).otherwise(F.lower(address))


def outside(addresses: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows (model_id, address) whose address its model does not have."""
    a = F.col("address")
    joined = addresses.join(manifests.select("model_id", "layers", "heads", "mlp"), "model_id")
    layer, idx, kind = layer_of(a), idx_of(a), kind_of(a)
    good = kind.isin(*SPECIAL) | (layer.between(1, F.col("layers")) & (
        (kind == "L") | ((kind == "A") & idx.between(1, F.col("heads"))) | ((kind == "N") & idx.between(1, F.col("mlp")))
    ))
    return joined.filter(~F.coalesce(good, F.lit(False))).select(addresses.columns)


# Presets: layers and counts are fixed values.
PRESETS = ("outer_only", "last-4-layers-full", "attention_only", "mid-mlp-wide", "logit-lens", "pilot-sparse-1k", "ioi-circuit-starter")
MID_LAYERS, MID_EVERY_N = range(12, 21), 10
PILOT_LAYERS, PILOT_EACH, PILOT_SEED = (8, 16, 24, 31), 250, 42
IOI_LAYERS, IOI_HEADS, IOI_MLP_LAYERS, IOI_NEURONS = range(17, 25), (4, 7, 12), range(20, 25), 200


def clamped(wanted, layers: int) -> list[int]:
    return list(dict.fromkeys(max(1, min(layers, x)) for x in wanted))


def preset(spark: SparkSession, which: str, arch: dict[str, int] = DEFAULT_ARCH) -> DataFrame:
    """(ord, address) of a preset for a model, made by ranges rather than on the driver."""
    layers, heads, mlp = arch["layers"], arch["heads"], arch["mlp"]
    if which not in PRESETS:
        raise BadInput(f"unknown preset {which!r}; one of {', '.join(PRESETS)}")

    def block(kind: str, of: list[int], numbers) -> Column:
        """Addresses of some layers, each with the numbers."""
        form = "N-%02d-%04d" if kind == "N" else "A-%02d-%02d"
        each = numbers if isinstance(numbers, Column) else F.array(*[F.lit(x) for x in numbers])
        return F.flatten(F.transform(F.array(*[F.lit(x) for x in of]), lambda la: F.transform(each, lambda k: F.format_string(form, la, k))))

    upto = lambda n: F.sequence(F.lit(1), F.lit(n))
    if which == "outer_only":
        names = F.array().cast("array<string>")
    elif which == "last-4-layers-full":
        parts = [b for la in clamped(range(layers - 3, layers + 1), layers) for b in (block("A", [la], upto(heads)), block("N", [la], upto(mlp)))]
        names = F.concat(*parts, F.array(F.lit("LOGITS")))
    elif which == "attention_only":
        names = block("A", list(range(1, layers + 1)), upto(heads))
    elif which == "mid-mlp-wide":
        names = block("N", clamped(MID_LAYERS, layers), upto(mlp))
    elif which == "logit-lens":
        names = F.concat(F.transform(upto(layers), lambda la: F.format_string("L-%02d", la)), F.array(F.lit("NORM"), F.lit("LOGITS")))
    elif which == "pilot-sparse-1k":
        draw = random.Random(PILOT_SEED)
        picked = [name("N", la, k) for la in clamped(PILOT_LAYERS, layers) for k in sorted(draw.sample(range(1, mlp + 1), min(PILOT_EACH, mlp)))]
        names = F.array(*[F.lit(x) for x in picked])
    else:
        names = F.concat(
            block("A", clamped(IOI_LAYERS, layers), [h for h in IOI_HEADS if h <= heads]),
            block("N", clamped(IOI_MLP_LAYERS, layers), upto(min(IOI_NEURONS, mlp))),
        )
    return spark.range(1).select(F.posexplode(names).alias("ord", "address"))


def catalogue(spark: SparkSession, entries: list[dict], arch: dict[str, int] = DEFAULT_ARCH) -> DataFrame:
    """(ord, address): presets and address lists one after another, each address once, at its first place."""
    out = None
    for k, entry in enumerate(entries):
        if "preset" in entry:
            part = preset(spark, entry["preset"], arch)
        else:
            part = spark.createDataFrame(list(enumerate(expand(entry["addresses"]))), "ord int, address string")
        part = part.select((F.col("ord") + F.lit(k * 10_000_000).cast("long")).alias("ord"), "address")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "ord long, address string")
    return out.groupBy("address").agg(F.min("ord").alias("ord")).select("ord", "address")


def totals(arch: dict[str, int], watched: int) -> dict[str, int]:
    """How many cells a model has, and how many of them are not watched."""
    every = arch["layers"] * (arch["mlp"] + arch["heads"])
    return {"total": every, "watched": watched, "unwatched": max(0, every - watched)}
