"""What to record and when: triggers, windows, watch files, size estimates and the gate before a run."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelark.errors import BadInput, NotFound, OtherCheckpoint, TooLarge
from tapelark.functions import addresses
from tapelark.functions.formats import BYTES

#: Bytes of index and metadata on top of the matrix; bounds of the bands in bytes.
OVERHEAD, GREEN_BELOW, YELLOW_TO = 1.15, 50e9, 1000e9
TAG = re.compile(r"[a-z0-9_]+=.+", re.DOTALL)


@dataclass(frozen=True)
class Window:
    """Token rows start <= pos < end, every n-th of them."""

    start: int = 0
    end: int = 512
    every_n: int = 1

    def __post_init__(self) -> None:
        if self.start < 0 or self.end < 1 or self.end < self.start or self.every_n < 1:
            raise BadInput(f"bad window {self.start}..{self.end} every {self.every_n}")

    @property
    def tokens(self) -> int:
        return math.ceil((self.end - self.start) / self.every_n)


@dataclass(frozen=True)
class Trigger:
    """When cells are kept: always, on_flag, time_window (seconds), token_range, address_gate."""

    kind: str = "always"
    flag: str = ""
    address: str = ""
    low: float = 0.0
    high: float = 0.0


_SECONDS = re.compile(r"window:(\d+(?:\.\d+)?)s\.\.(\d+(?:\.\d+)?)s")
_TOKENS = re.compile(r"window:(\d+)\.\.(\d+)")


def parse_trigger(spec: str | dict | None) -> Trigger:
    """A trigger from its text or its mapping; both bounds of a range belong to it.

    Texts: ``always``, ``on_flag:bad_output``, ``window:5s..10s`` (seconds since the start), ``window:10..50`` (tokens).
    Mappings: ``{"on_flag": name}``, ``{"window": {"after_s", "until_s"}}``, ``{"address", "lo", "hi"}`` (a cell's value).
    """
    if spec is None or spec == "always":
        return Trigger()
    if isinstance(spec, str):
        if spec.startswith("on_flag:") and spec != "on_flag:":
            return Trigger("on_flag", flag=spec.removeprefix("on_flag:"))
        for shape, kind in ((_SECONDS, "time_window"), (_TOKENS, "token_range")):
            if found := shape.fullmatch(spec):
                return _ranged(kind, *found.groups())
    elif isinstance(spec, dict):
        keys = set(spec)
        if keys == {"on_flag"} and isinstance(spec["on_flag"], str):
            return Trigger("on_flag", flag=spec["on_flag"])
        if keys == {"window"} and isinstance(spec["window"], dict) and {"after_s", "until_s"} <= set(spec["window"]):
            out = _ranged("time_window", spec["window"]["after_s"], spec["window"]["until_s"])
            if out.low >= 0:
                return out
        if keys == {"address", "lo", "hi"} and isinstance(spec["address"], str):
            return _ranged("address_gate", spec["lo"], spec["hi"], spec["address"])
    raise BadInput(f"bad trigger {spec!r}; of always, on_flag:bad_output, window:5s..10s, window:10..50")


def trigger_text(trigger: Trigger) -> str | dict:
    """The spelling that ``parse_trigger`` reads; an address gate has a mapping only."""
    plain = {"always": "always", "on_flag": f"on_flag:{trigger.flag}", "time_window": f"window:{trigger.low:g}s..{trigger.high:g}s", "token_range": f"window:{trigger.low:g}..{trigger.high:g}"}
    return plain.get(trigger.kind) or {"address": trigger.address, "lo": trigger.low, "hi": trigger.high}


def _ranged(kind: str, low, high, address: str = "") -> Trigger:
    try:
        out = Trigger(kind, address=address, low=float(low), high=float(high))
    except (TypeError, ValueError) as e:
        raise BadInput(f"bad bounds {low}..{high}") from e
    if not out.low <= out.high:
        raise BadInput(f"reversed bounds {low}..{high}")
    if kind == "address_gate":
        addresses.parse(address)
    return out


def estimate(watched: int, tokens: int, runs: int, precision: str = "fp16") -> float:
    """Bytes of a recording."""
    if precision not in BYTES:
        raise BadInput(f"bad precision {precision!r}; one of {', '.join(BYTES)}")
    return watched * tokens * runs * BYTES[precision] * OVERHEAD


def band(size: float) -> str:
    return "GREEN" if size < GREEN_BELOW else "YELLOW" if size <= YELLOW_TO else "RED"


def estimate_column(watched: Column, tokens: Column, runs: Column, precision: Column) -> Column:
    width = F.when(precision == "fp32", 4).when(precision.isin("fp16", "bf16"), 2)
    return watched.cast("double") * tokens * runs * width * F.lit(OVERHEAD)


def band_column(size: Column) -> Column:
    return F.when(size < GREEN_BELOW, "GREEN").when(size <= YELLOW_TO, "YELLOW").otherwise("RED")


def estimate_line(watched: int, tokens: int, runs: int, precision: str) -> str:
    size = estimate(watched, tokens, runs, precision)
    return f"{watched} cells x {tokens} tokens x {runs} runs x {BYTES[precision]} B x {OVERHEAD} = {size / 1e9:.3f} GB {band(size)}"


def check_tags(tags: list[str]) -> list[str]:
    for t in tags:
        if not TAG.fullmatch(t):
            raise BadInput(f"bad tag {t!r}; key=value with a key of a-z, 0-9 and _")
    return sorted(tags)


@dataclass(frozen=True)
class Watchlist:
    model_id: str = ""
    checkpoint_sha256: str = ""
    watchlist_id: str = ""
    trigger: Trigger = field(default_factory=Trigger)
    window: Window = field(default_factory=Window)
    precision: str = "fp16"
    entries: tuple[dict, ...] = ()
    sha256: str = ""
    patch: dict | None = None

    def listed(self, spark, arch: dict[str, int] = addresses.DEFAULT_ARCH):
        return addresses.catalogue(spark, list(self.entries), arch)

    def width(self, spark, arch: dict[str, int] = addresses.DEFAULT_ARCH) -> int:
        """Exactly how many addresses are watched."""
        return self.listed(spark, arch).count()


def read_watchlist(path: str, add: list[str] | None = None, window: Window | None = None, trigger: str | dict | None = None, precision: str | None = None, _seen: tuple[str, ...] = ()) -> Watchlist:
    """A watch file; arguments go before the file, the file before a preset's hint, that before defaults.

    ``patch`` records arguments that overrode the file. ``outer_only`` needs no file. ``extends`` takes
    the entries of another file, in its place.
    """
    import yaml

    where = Path(path)
    if not where.is_file():
        if where.stem.startswith("outer_only"):
            return Watchlist(watchlist_id="outer_only", entries=({"preset": "outer_only"},))
        raise NotFound(f"{path} not found")
    raw = where.read_bytes()
    try:
        doc = yaml.safe_load(raw)
    except yaml.YAMLError as e:
        raise BadInput(f"{path} is not YAML: {e}") from e
    if not isinstance(doc, dict) or doc.get("version") != 1 or not isinstance(doc.get("entries"), list):
        raise BadInput(f"{path}: version 1 and a list of entries are required")
    entries: list[dict] = []
    for entry in doc["entries"]:
        if not isinstance(entry, dict):
            raise BadInput(f"{path}: bad entry {entry!r}")
        if "extends" in entry:
            base = str((where.parent / entry["extends"]).resolve())
            if base in _seen:
                raise BadInput(f"{path}: extends goes in a circle")
            entries += read_watchlist(base, _seen=(*_seen, str(where.resolve()))).entries
            if entry.get("watch"):
                entries.append({"addresses": list(entry["watch"])})
        elif entry.get("preset") in addresses.PRESETS or isinstance(entry.get("addresses"), list):
            entries.append(entry)
        else:
            raise BadInput(f"{path}: bad entry {entry!r}")
    for entry in entries:
        for text in entry.get("addresses", []):
            addresses.parse(text)
    patch: dict = {}
    if add:
        addresses.expand(add)
        entries.append({"addresses": list(add)})
        patch["add"] = list(add)
    spec = doc.get("window") or {}
    used = Window(int(spec.get("start_token", 0)), int(spec.get("end_token", 511)), int(spec.get("every_n", 1)))
    if window is not None:
        used, patch["window"] = window, [window.start, window.end, window.every_n]
    elif used.every_n == 1 and any(e.get("preset") == "mid-mlp-wide" for e in entries):
        used = replace(used, every_n=addresses.MID_EVERY_N)
    if trigger is not None:
        patch["trigger"] = trigger
    if precision is not None:
        patch["precision"] = precision
    chosen = precision or doc.get("precision", "fp16")
    if chosen not in BYTES:
        raise BadInput(f"bad precision {chosen!r}")
    return Watchlist(
        str(doc.get("model_id", "")), str(doc.get("checkpoint_sha256", "")), str(doc.get("watchlist_id", "")),
        parse_trigger(trigger if trigger is not None else doc.get("trigger")), used, chosen, tuple(entries), hashlib.sha256(raw).hexdigest(), patch or None,
    )


def drifted(watchlist: Watchlist, manifest: dict) -> bool:
    """Whether a watch file was written for another model or checkpoint; one that names neither fits all."""
    own = (watchlist.model_id, watchlist.checkpoint_sha256)
    return any(own) and own != (manifest["model_id"], manifest["checkpoint_sha256"])


def gate(spark, watchlist: Watchlist, manifest: dict | None, runs: int = 1, force: bool = False) -> dict:
    """Checks before a run, in order: checkpoint, addresses, size; the red band needs ``force``.

    Without a manifest addresses are checked against the default architecture.
    """
    if runs < 1:
        raise BadInput("runs are at least 1")
    arch = {k: manifest[k] for k in ("layers", "heads", "mlp")} if manifest else addresses.DEFAULT_ARCH
    if manifest and drifted(watchlist, manifest):
        raise OtherCheckpoint("the watch file belongs to another checkpoint")
    for entry in watchlist.entries:
        addresses.check(entry.get("addresses", []), arch)
    width = watchlist.width(spark, arch)
    size = estimate(width, watchlist.window.tokens, runs, watchlist.precision)
    if band(size) == "RED" and not force:
        raise TooLarge(f"{estimate_line(width, watchlist.window.tokens, runs, watchlist.precision)}; force it or watch less, nothing ran")
    return {"watched": width, "tokens": watchlist.window.tokens, "runs": runs, "bytes": size, "band": band(size), "precision": watchlist.precision}
