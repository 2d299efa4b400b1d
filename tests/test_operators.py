"""Operators over small frames, with the edge cases that the driver's tables lack."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelark import schema
from tapelark.config import Trigger, Window
from tapelark.errors import NotFound
from tapelark.functions import cells, formats
from tapelark.operators import analytics, compare, frame, gate, hot, report, seal, wal
from tapelark.plans.find import find_runs

NAN, INF = float("nan"), float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def series_of(spark, rows):
    a = F.col("address")
    from tapelark.functions import addresses

    frame_ = spark.createDataFrame(rows, "run_id string, address string, series array<float>")
    return frame_.select("run_id", "address", addresses.kind_of(a).alias("kind"), addresses.layer_of(a).alias("layer"), addresses.idx_of(a).alias("idx"), "series")


@pytest.fixture(scope="module")
def cohort(spark):
    draw = random.Random(1)
    runs, rows = [], []
    for k in range(6):
        bad = k >= 3
        run = f"RUN-{k + 1:06d}"
        runs.append((run, "M", "sha256:ab", ("instructions for testing" if bad else "hello world",), ([],), ["cohort=" + ("bad" if bad else "good"), "plain"], {"bad_output": bad}))
        for address in ("N-02-0001", "N-02-0002", "A-02-01", "LOGITS"):
            s = [draw.uniform(-0.2, 0.4) for _ in range(20)]
            if bad and address == "N-02-0001":
                s[15:] = [draw.uniform(0.85, 0.99) for _ in range(5)]
            rows.append((run, address, s))
    kind = "run_id string, model_id string, checkpoint_sha256 string, prompt struct<text:string>, output struct<tokens:array<int>>, tags array<string>, flags map<string,boolean>"
    return spark.createDataFrame(runs, kind), series_of(spark, rows)


def test_search(spark, cohort):
    runs, series = cohort
    index = hot.build(series)
    assert {r.n_win10 for r in index.collect()} == {2}
    find = lambda q, **k: [(r.run, r.address, r.token) for r in find_runs(runs, series, index, q, **k).collect()]
    assert [x[0] for x in find("N-02-0001 AT token=17 > 0.8")] == ["RUN-000004", "RUN-000005", "RUN-000006"]
    assert find('tag="good" AND N-02-0001 AT token=17 > 0.8') == []
    assert len(find('prompt CONTAINS "hello"')) == 3 and len(find('flag="bad_output"')) == 3 and len(find('tag="plain"')) == 6
    assert find('checkpoint="ab"', limit=2) == [("RUN-000001", None, None), ("RUN-000002", None, None)]
    assert {x[1] for x in find("N-02-0001..0009 AT tokens 15..19 MEAN > 0.8")} == {"N-02-0001"}  # most of the range is not watched
    assert find("N-02-0001 AT token=400 > -9") == [] and find("N-02-0001 AT tokens 0..3 > 0.8") == []
    assert len(find("N-02-0001 AT tokens 15..900 MIN > 0.8")) == 3
    assert find("N-02-0001 AT tokens 0..14 > -9", tokens=(15, 19)) == []
    both = "N-02-0001 AT token=17 > 0.8 AND A-02-01 AT token=1 > 5"
    assert find(both) == [] and len(find(both, match="any")) == 3
    ok = runs.select("run_id", (F.col("run_id") != "RUN-000005").alias("ok"))
    rows = find_runs(runs, series, index, "N-02-0001 AT token=17 > 0.8", verified=ok).collect()
    assert [r.hash_seal_verified for r in rows] == [True, False, True]
    assert [r.run for r in find_runs(runs, series, index, 'flag="hash_fail"', verified=ok).collect()] == ["RUN-000005"]


def test_index_never_loses_a_match(spark):
    draw = random.Random(3)
    rows = []
    for k in range(30):
        s = [draw.choice([NAN, INF, -1.0, 0.0, 0.5, 1.0, draw.random()]) for _ in range(draw.choice([0, 1, 9, 10, 11, 45, 1300]))]
        rows.append((f"RUN-{k:06d}", "N-01-0001", s))
    series = series_of(spark, rows)
    runs = series.select("run_id")
    runs = runs.withColumn("tags", F.array().cast("array<string>"))
    for q in ("AT token=3 > 0.4", "AT tokens 5..12 >= 0.99", "AT tokens 1285..1299 > 0.9", "MIN < -0.5", "AT tokens 0..8 = 1", "AT token=0 != 0.5", "P95 > 0.9", "AT tokens 3..30 MEAN <= 0.3"):
        full = find_runs(runs, series, None, f"N-01-0001 {q}", None).collect()
        assert find_runs(runs, series, hot.build(series), f"N-01-0001 {q}", None).collect() == full, q
    got = find_runs(runs, series, None, "N-01-0001 AT tokens 0..44 > 0.4", None).collect()
    by = dict((r[0], r[2]) for r in rows)
    for r in got:
        s = [float(np.float32(x)) for x in by[r.run][:45]]
        best = max(x for x in s if math.isfinite(x))
        assert r.value == best and r.token == s.index(best)


def test_comparison(spark, cohort):
    runs, series = cohort
    out = {(r.address, r.side): r for r in compare.compare(runs, series, "tag:cohort=good", "tag:cohort=bad", ["N-02-0001", "N-02-0007"], (15, 19)).collect()}
    assert out["N-02-0001", "good"].n == out["N-02-0001", "bad"].n == 3 and out["N-02-0001", "bad"].n_values == 15
    assert out["N-02-0001", "bad"].firing_rate > 0.9 and out["N-02-0001", "good"].firing_rate < 0.2
    assert out["N-02-0007", "bad"].empty and out["N-02-0007", "bad"].n == 0
    nobody = compare.compare(runs, series, "tag:cohort=none", "tag:cohort=bad", ["N-02-0001"])
    with pytest.raises(NotFound):
        compare.require_both(nobody)
    limited = compare.compare(runs, series, "tag=plain".replace("=plain", '="plain"'), "tag:cohort=bad", ["LOGITS"], (0, 4), limit=2, stats="mean,max,firing_rate>0.1")
    assert [r.n for r in limited.collect()] == [2, 2]
    assert [one(spark, compare.bar(F.lit(x))) for x in (0.25, 0.35, 2.0)] == ["[##........]", "[####......]", "[##########]"]


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 100, 1300])
def test_statistics_agree_with_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = [NAN if rng.random() < 0.1 else INF if rng.random() < 0.05 else float(np.float32(x)) for x in rng.normal(0.5, 0.5, n)]
    r = hot.build(series_of(spark, [("RUN-000001", "LOGITS", values)])).first()
    f = [x for x in values if math.isfinite(x)]
    assert r.n == len(f) and r.n_win10 == -(-n // 10)
    if f:
        assert (r.min, r.max) == (min(f), max(f)) and r.mean == pytest.approx(np.mean(f)) and r.p95 == pytest.approx(np.percentile(f, 95))
        assert r.firing_rate == pytest.approx(np.mean(np.array(f) > 0.8))
    else:
        assert r.min is None and r.p95 is None and r.firing_rate == 0.0
    chunks = [max((x for x in values[k : k + 10] if math.isfinite(x)), default=None) for k in range(0, n, 10)][:128]
    assert r.win10 == chunks


def test_gates(spark):
    rows = [("a", k, k / 2, {"bad_output": k == 4}, "N-01-0001", [0.1, 0.9, 2.0, NAN, 0.85][k % 5]) for k in range(10)]
    c = spark.createDataFrame(rows, "run_id string, token_pos int, elapsed double, flags map<string,boolean>, address string, value double")
    kept = lambda w, tr: [r.token_pos for r in gate.armed(c, w, tr).orderBy("token_pos").collect()]
    assert kept(Window(0, 10, 2), Trigger()) == [0, 2, 4, 6, 8]
    assert kept(Window(1, 9, 3), Trigger()) == [1, 4, 7]
    assert kept(Window(0, 10), Trigger("on_flag", flag="bad_output")) == [4]
    assert kept(Window(0, 10), Trigger("on_flag", flag="other")) == []
    assert kept(Window(0, 10), Trigger("time_window", low=1, high=2)) == [2, 3, 4]
    assert kept(Window(0, 10), Trigger("token_range", low=3, high=5)) == [3, 4, 5]
    assert kept(Window(0, 10), Trigger("address_gate", address="N-01-0001", low=0.8, high=1.2)) == [1, 4, 6, 9]
    assert kept(Window(0, 10), Trigger("address_gate", address="N-01-0002", low=0, high=9)) == []
    held, flags = gate.bounded(c, 3)
    assert held.count() == 3 and flags.first().ring_overflow
    cut = gate.until_error(c.withColumn("failed", F.col("token_pos") >= 7))
    assert cut.count() == 7 and cut.first().hook_detached
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert {r.run_id: (r.triggered, r.n_tokens) for r in gate.presence(runs, held).collect()} == {"a": (True, 3), "b": (False, 0)}
    assert one(spark, gate.gathered(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(F.lit(2), F.lit(0), F.lit(9)))) == [3.0, 1.0, None]
    assert one(spark, gate.dequantised(F.lit(4).cast("byte"), F.lit(0.5))) == 2.0


def test_log_to_series(spark):
    rows = [("a", 5, [1.0, 2.0], 0), ("a", 3, [3.0, 4.0], 1), ("a", 5, [9.0, 8.0], 2), ("b", 0, [7.0], 0)]
    log = spark.createDataFrame(rows, "run_id string, token int, values array<double>, seq long")
    watched = spark.createDataFrame([("a", ["LOGITS", "A-01-02"])], "run_id string, watched array<string>")
    got = {(r.run_id, r.address): r for r in wal.series(log, watched).collect()}
    s = got["a", "LOGITS"].series
    assert s[0] == 3.0 and math.isnan(s[1]) and s[2] == 9.0
    assert got["a", "A-01-02"].layer == 1 and got["b", "N-01-0001"].series == [7.0]
    assert wal.open_rows(log, spark.createDataFrame([("a",)], "run_id string")).count() == 1


def fold(docs):
    prev, out = seal.GENESIS, []
    for run, outer, deep, replay in docs:
        h = hashlib.sha256((prev + outer + (deep or hashlib.sha256(b"").hexdigest()) + replay).encode()).hexdigest()
        out.append((run, h, prev))
        prev = h
    return out


def test_seals(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = [(f"RUN-{k:06d}", sha(f"o{k}"), sha(f"d{k}") if k % 2 else None, f'{{"seed":{k}}}') for k in range(1, 6)]
    kind = "run_id string, sha_outer string, sha_deep string, replay string"
    now = spark.createDataFrame(docs, kind)
    made = seal.sealed(now)
    assert [(r.run_id, r.hash, r.prev_hash) for r in made.orderBy("pos").collect()] == fold(docs)
    chain = made.select("pos", "run_id", "hash", "prev_hash", F.lit(False).alias("bad"))
    ok = lambda *a: [r.ok for r in seal.verified(*a).orderBy("run_id").collect()]
    assert ok(now, made, chain) == [True] * 5
    assert ok(now.withColumn("sha_outer", F.when(F.col("run_id") == "RUN-000002", "x").otherwise(F.col("sha_outer"))), made, chain) == [True, False, True, True, True]
    assert ok(now, made, chain.withColumn("prev_hash", F.when(F.col("pos") == 2, "x").otherwise(F.col("prev_hash")))) == [True, True, False, False, False]
    assert ok(now, made, chain.withColumn("bad", F.col("pos") == 1)) == [True, False, False, False, False]
    assert ok(now, made, None) == [True, False, False, False, False]
    assert ok(now, made, chain.filter("pos < 4")) == [True, True, True, True, False]
    assert ok(now, made.filter("pos > 0"), chain)[0] is False
    again = chain.union(spark.createDataFrame([(5, "RUN-000005", "other", fold(docs)[-1][1], False)], chain.schema))
    assert ok(now, made, again) == [True] * 5  # the first line of a run counts


def test_frames(spark):
    series = series_of(spark, [("RUN-000001", f"N-02-000{k}", [k + t / 10 for t in range(10)]) for k in range(1, 5)])
    runs = spark.createDataFrame([("RUN-000001", ("hi",), ([3, 4, 5],)), ("RUN-000002", ("outer",), ([],))], "run_id string, prompt struct<text:string>, output struct<tokens:array<int>>")
    rows = frame.to_dataframe(runs, series, "RUN-000001", tokens=(2, 5), addresses=["N-02-0002", "N-02-0001"]).collect()
    assert [r.token_pos for r in rows] == [2, 2, 3, 3, 4, 4, 5, 5] and [r.address for r in rows][:2] == ["N-02-0002", "N-02-0001"]
    assert rows[0].token == "5" and rows[2].token == "hi" and rows[0].value == pytest.approx(2.2) and rows[0].watched
    gone = frame.to_dataframe(runs, series, "RUN-000001", tokens=(2, 2), addresses=["N-02-0009"]).collect()
    assert len(gone) == 1 and not gone[0].watched and math.isnan(gone[0].value)
    outer = frame.to_dataframe(runs, series, "RUN-000002", "outer").first()
    assert (outer.token, outer.token_pos, outer.watched) == ("outer", 0, False)
    assert dict(frame.to_dataframe(runs, series, "RUN-000001").dtypes) == frame.COLUMNS
    for bad in (("RUN-000009", "outer", None), ("RUN-000002", "deep", None), ("RUN-000001", "deep", (3, 99)), ("RUN-000001", "all", None)):
        with pytest.raises(Exception, match="E0"):
            frame.to_dataframe(runs, series, bad[0], bad[1], bad[2])
    broken = spark.createDataFrame([("RUN-000001", False)], "run_id string, ok boolean")
    with pytest.warns(UserWarning):
        assert not frame.to_dataframe(runs, series, "RUN-000001", verified=broken).first().hash_seal_verified


def test_analytics(spark):
    values = [0.1, 0.2, NAN, 0.3, -0.9, 0.3, 0.2, 0.5, 0.5, 0.1, 0.0, 0.4]
    rows = [("r", t, a, sign * v if math.isfinite(v) else v) for t, v in enumerate(values) for a, sign in (("A", 1.0), ("B", -1.0), ("C", 0.0))]
    long = spark.createDataFrame(rows, "run_id string, token_pos int, address string, value double")
    assert analytics.peak_token(long).first().token_pos == 4
    pairs = analytics.cooccurrence(long).collect()
    assert [(p.a, p.b, round(p.r, 6)) for p in pairs] == [("A", "B", -1.0)]  # C does not vary
    lines = {r.token_pos: r for r in analytics.sparkline(long.filter("address = 'A'")).collect()}
    assert lines[0].level == 0 and lines[1].level == 7 and lines[2].level is None and lines[4].glyph == "▁"
    top = {r.token_pos: r.max_window for r in analytics.sliding_max(long.filter("address = 'A'")).collect()}
    assert top[11] == 0.5 and top[3] == 0.3


def test_formats(spark):
    bits = [0, 0x8000, 1, 0x03FF, 0x3C00, 0x7BFF, 0x7C00, 0xFC00, 0x7E00, 0xBE00, *range(0, 65536, 997)]
    frame_ = spark.createDataFrame([(b,) for b in bits], "b int").select("b", formats.half(F.col("b")).alias("h"), formats.bfloat(F.col("b")).alias("f"))
    for r in frame_.collect():
        want = float(np.array([r.b], "<u2").view("<f2")[0])
        wide = float((np.array([r.b], "<u4") << 16).astype("<u4").view("<f4")[0])
        assert (math.isnan(want) and math.isnan(r.h)) or want == r.h
        assert (math.isnan(wide) and math.isnan(r.f)) or wide == r.f
    m = np.random.default_rng(0).normal(size=(10, 100)).astype(np.float32)
    for dtype, size, close in (("fp32", 4, 0), ("fp16", 2, 1e-2), ("bf16", 2, 5e-2)):
        raw = formats.encode_matrix(m, dtype)
        assert len(raw) == 1000 * size and np.allclose(formats.decode_matrix(raw, dtype, 100), m, atol=close, rtol=close)
    assert one(spark, formats.byte_tokens(F.lit("hé"))) == [104, 195, 169] and one(spark, formats.byte_tokens(F.lit(""))) == []
    text = '{"b": 1.0, "a": {"z": 0.0, "é": "x"}}'
    assert one(spark, formats.canonical_json(F.lit(text))) == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    assert one(spark, formats.human_bytes(F.lit(1_500_000))) == "1.5 MB"


def test_firing_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    r = empty.agg(*[c.alias(k) for k, c in cells.pooled(F.col("v")).items()]).first()
    assert r.n_values == 0 and r.mean is None and r.firing_rate == 0.0


def test_reports(spark):
    runs = spark.createDataFrame([("RUN-000001", "M", "sha256:abcdef99", 10, 60_000_000_000), ("RUN-000002", "M", "abcdef99", 5, 0)], "run_id string, model_id string, checkpoint_sha256 string, hot_bytes long, cold_bytes long")
    [m] = report.by_model(runs).collect()
    assert (m.model, m.runs, m.band) == ("M/C-abcdef", 2, "YELLOW")
    assert [r.band for r in report.by_run(runs).orderBy("run_id").collect()] == ["YELLOW", "GREEN"]
    assert {r.model: r.runs for r in report.retention_state(runs).collect()} == {"M/C-abcdef": 2, None: 2}


def test_schemas_are_explicit():
    assert len(schema.RUN.fields) == 15


def test_long_chains(spark):
    """Sealing and checking are linear: 300,000 runs, one changed, one link broken."""
    import hashlib
    import time

    began = time.perf_counter()
    runs = spark.range(300_000).select(F.format_string("RUN-%06d", "id").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("sha_outer"), F.lit(None).cast("string").alias("sha_deep"), F.lit("{}").alias("replay")).repartition(7)
    links = seal.sealed(runs).cache()
    rows = links.orderBy("pos").limit(1000).collect()
    last, none = seal.GENESIS, hashlib.sha256(b"").hexdigest()
    for k, r in enumerate(rows):
        assert (r.pos, r.run_id, r.prev_hash) == (k, f"RUN-{k:06d}", last)
        last = hashlib.sha256(f"{last}{hashlib.sha256(str(k).encode()).hexdigest()}{none}{{}}".encode()).hexdigest()
        assert r.hash == last
    chain = links.select("pos", "run_id", "hash", F.when(F.col("pos") == 250_000, F.lit("f")).otherwise(F.col("prev_hash")).alias("prev_hash"), F.lit(False).alias("bad"))
    now = runs.withColumn("sha_outer", F.when(F.col("run_id") == "RUN-000003", F.lit("x")).otherwise(F.col("sha_outer")))
    assert seal.summary(seal.verified(now, links, chain)).first().asDict() == {"ok": 249_999, "failed": 50_001}
    assert time.perf_counter() - began < 120
    links.unpersist()
