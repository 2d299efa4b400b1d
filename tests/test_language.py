"""The find language, addresses, triggers, windows, watch files, estimates."""

import pytest

from tapelark import config
from tapelark.config import Trigger, Window
from tapelark.errors import BadAddress, BadInput, NotFound, TooLarge
from tapelark.functions import addresses
from tapelark.plans.query import CellCond, RunCond, group, parse_compare, parse_find, token_range

ARCH = {"layers": 4, "heads": 8, "mlp": 1024}


@pytest.mark.parametrize(
    ("text", "runs", "cells"),
    [
        ("FIND RUNS WHERE N-24-0001 AT token=17 > 0.8", 0, 1),
        ('find runs where prompt contains "this AND that" and tag:cohort=bad', 2, 0),
        ('checkpoint="sha256:ab" AND flag="bad_output" AND A-02-01 AT tokens 15..19 MEAN >= 0.5', 2, 1),
        ("N-24-0001..0100 AT tokens=1..2 P95 < 1e-3 AND LOGITS > 2", 0, 2),
        ('tag="bad" AND L-03 MAX_WINDOW != -1', 1, 1),
    ],
)
def test_reads(text, runs, cells):
    q = parse_find(text)
    assert (len(q.runs), len(q.cells)) == (runs, cells)


def test_meaning():
    [c] = parse_find("N-24-0001 AT token 17 MEAN == 0.5").cells
    assert (c.low, c.high, c.aggregate, c.op) == (17, 17, "VALUE", "=")
    [c] = parse_find("N-24-0001..0003 > 1").cells
    assert c.high is None and c.aggregate == "MAX" and c.span.names() == ["N-24-0001", "N-24-0002", "N-24-0003"]
    assert parse_find('prompt CONTAINS "a \\"AND\\" b"').runs[0].value == 'a "AND" b'
    assert group("tag:k=v w".split()[0]) == RunCond("tag", "k=v") and group('tag="x y"').value == "x y"
    assert group("checkpoint=sha256:ab").value == "ab"


@pytest.mark.parametrize("op", [">", ">=", "<", "<=", "=", "==", "!="])
def test_comparisons(op):
    assert isinstance(parse_find(f"LOGITS AT token=1 {op} 2").cells[0], CellCond)


@pytest.mark.parametrize("text", ["", "N-24-0001 AT token=17", "N-24-0001 AT token=9..3 > 1", "N-24-0001 > x", 'flag="nonsense"', "prompt CONTAINS word", "N-1 > 2", "LOGITS > 1 OR LOGITS > 2", "LOGITS > nan"])
def test_refuses(text):
    with pytest.raises(BadInput if "N-1 " not in text else BadAddress):
        parse_find(text)


def test_compare_text():
    q = parse_compare("COMPARE GROUPS tag:c=good, tag:c=bad ON N-01-0001..0002, LOGITS AT tokens 3..4 WITH STATS mean, p95")
    assert (len(q.groups), len(q.spans), q.low, q.high, q.stats) == (2, 2, 3, 4, ("mean", "p95"))
    assert token_range("5") == (5, 5)


def test_addresses():
    assert addresses.expand(["A-17-04", "N-24-0009..0011", "A-17-04", "LOGITS"]) == ["A-17-04", "N-24-0009", "N-24-0010", "N-24-0011", "LOGITS"]
    assert addresses.parse("N-24-14336").names() == ["N-24-14336"] and addresses.parse("N-24-9999..10001").names()[-1] == "N-24-10001"
    assert addresses.parse("N-24-0001..0004").text == "N-24-0001..0004"
    with pytest.raises(BadInput):
        addresses.parse("N-24-0009..0001")
    addresses.check(["N-04-1024", "A-01-08", "L-04", "NORM"], ARCH)
    for bad in ("N-05-0001", "A-01-09", "N-01-1020..1025", "L-05"):
        with pytest.raises(BadAddress):
            addresses.check([bad], ARCH)


def test_presets(spark):
    sizes = {p: addresses.preset(spark, p).count() for p in addresses.PRESETS}
    assert sizes == {"outer_only": 0, "last-4-layers-full": 57473, "attention_only": 1024, "mid-mlp-wide": 129024, "logit-lens": 34, "pilot-sparse-1k": 1000, "ioi-circuit-starter": 1024}
    held = [r.address for r in addresses.preset(spark, "pilot-sparse-1k").orderBy("ord").collect()]
    assert {a[:4] for a in held} == {"N-08", "N-16", "N-24", "N-31"} and held == sorted(held, key=lambda a: (a[:4], int(a[5:])))
    small = addresses.preset(spark, "ioi-circuit-starter", ARCH).count()
    assert small == 2 + 200  # all layers are clamped to the last, heads 4 and 7 are there
    two = addresses.catalogue(spark, [{"addresses": ["LOGITS", "L-01"]}, {"preset": "logit-lens"}]).orderBy("ord").collect()
    assert [r.address for r in two][:3] == ["LOGITS", "L-01", "L-02"] and len(two) == 34


def test_triggers():
    assert config.parse_trigger(None) == Trigger()
    assert config.parse_trigger("on_flag:bad_output") == config.parse_trigger({"on_flag": "bad_output"})
    assert config.parse_trigger("window:1s..2.5s") == config.parse_trigger({"window": {"after_s": 1, "until_s": 2.5}}) == Trigger("time_window", low=1, high=2.5)
    assert config.parse_trigger("window:10..50") == Trigger("token_range", low=10, high=50)
    assert config.parse_trigger({"address": "A-01-01", "lo": 0.2, "hi": 0.9}) == Trigger("address_gate", address="A-01-01", low=0.2, high=0.9)
    for spec in ("always", "on_flag:x", "window:5s..10s", "window:10..50", {"address": "LOGITS", "lo": 0.5, "hi": 2.0}):
        assert config.trigger_text(config.parse_trigger(spec)) == spec
    for bad in (
        "sometimes", "window:3..1", "window:3s..1s", "window:1..2.5", "window:1s..2", "on_flag:", "tokens:1..2", {"a": 1, "b": 2}, {"on_flag": 1}, {"window": {"after_s": 1}}, {"window": {"after_s": -1, "until_s": 2}},
        {"address": "LOGITS", "lo": 2, "hi": 1}, {"address": "LOGITS", "lo": "x", "hi": 1}, {"address": "X", "lo": 0, "hi": 1}, {"address": "LOGITS", "lo": 1}, 5, ["always"],
    ):
        with pytest.raises((BadInput, BadAddress)):
            config.parse_trigger(bad)


def test_windows_and_estimates():
    assert Window(0, 25, 10).tokens == 3
    with pytest.raises(BadInput):
        Window(5, 3)
    assert [config.band(config.estimate(w, 500, 10_000)) for w in (1000, 10_000, 100_000)] == ["GREEN", "YELLOW", "RED"]
    assert config.estimate(1000, 500, 10_000) == pytest.approx(11.5e9)
    assert "YELLOW" in config.estimate_line(10_000, 500, 10_000, "fp16")
    assert config.check_tags(["b=2", "a=1"]) == ["a=1", "b=2"]
    with pytest.raises(BadInput):
        config.check_tags(["Bad=1"])


def test_watch_files(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("version: 1\nentries:\n  - preset: mid-mlp-wide\n")
    (tmp_path / "own.yaml").write_text(
        "version: 1\nmodel_id: M\ncheckpoint_sha256: ab\nwatchlist_id: w\ntrigger: {on_flag: bad_output}\nentries:\n  - {extends: base.yaml, watch: [LOGITS]}\n  - addresses: [A-02-04, N-02-0001..0010]\n"
    )
    w = config.read_watchlist(str(tmp_path / "own.yaml"))
    assert w.window.every_n == 10 and w.trigger.kind == "on_flag" and w.patch is None
    assert w.width(spark) == 129024 + 12
    w = config.read_watchlist(str(tmp_path / "own.yaml"), add=["EMBED"], window=Window(0, 100), precision="fp32")
    assert w.window == Window(0, 100) and w.patch == {"add": ["EMBED"], "window": [0, 100, 1], "precision": "fp32"}
    assert config.read_watchlist(str(tmp_path / "outer_only.yaml")).entries == ({"preset": "outer_only"},)
    with pytest.raises(NotFound):
        config.read_watchlist(str(tmp_path / "none.yaml"))
    manifest = {"model_id": "M", "checkpoint_sha256": "ab", "layers": 32, "heads": 32, "mlp": 14336}
    assert config.gate(spark, w, manifest, 1)["watched"] == 129037
    with pytest.raises(TooLarge):
        config.gate(spark, w, manifest, 100_000)
    assert config.gate(spark, w, manifest, 100_000, force=True)["band"] == "RED"
    with pytest.raises(BadAddress):
        config.gate(spark, w, manifest | {"checkpoint_sha256": "other"}, 1)
    with pytest.raises(BadAddress):
        config.gate(spark, config.read_watchlist(str(tmp_path / "own.yaml"), add=["N-40-0001"]), manifest, 1)
