"""Folders of recorded runs, the store, checkpoints, streams, the recorder, the command line."""

import hashlib
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelark import cli, recorder, schema, viewer
from tapelark.errors import AlreadyThere, BadAddress, BadInput, TooLarge
from tapelark.functions import formats
from tapelark.operators import hot, seal
from tapelark.operators.frame import to_dataframe
from tapelark.plans.find import find_runs
from tapelark.sources import checkpoints, deepbin, folder, shared
from tapelark.sources import store as store_mod
from tapelark.sources.store import Store
from tapelark.streaming import capture

NAMES = ["N-02-0001", "N-02-0002", "A-02-01", "LOGITS"]


@pytest.fixture
def recorded(tmp_path):
    """Three runs as a recorder leaves them: two with matrices, all chained."""
    rng, prev = np.random.default_rng(4), seal.GENESIS
    for k in (1, 2, 3):
        where = tmp_path / "rec" / "runs" / f"RUN-{k:06d}"
        where.mkdir(parents=True)
        doc = {
            "run_id": where.name, "model_id": "M", "checkpoint_sha256": "ab", "prompt": {"text": f"hello {k}", "tokens": [1], "tokenizer": "b"},
            "output": {"text": "x", "tokens": [3, 4, 5], "finish_reason": "stop"}, "flags": {"bad_output": k == 2}, "tags": [f"cohort={'bad' if k == 2 else 'good'}"],
            "sampling": {"seed": k, "temp": 0.0}, "replay": {"seed": k, "temp": 0.0, "versions": {"torch": "2"}},
        }
        (where / "outer.json").write_text(json.dumps(doc, sort_keys=True, indent=2) + "\n")
        sha_deep = hashlib.sha256(b"").hexdigest()
        index = {"run_id": where.name, "triggered": k != 3, "dtype": "fp16", "tokens": 20, "every_n": 1, "watched": NAMES if k != 3 else [], "columns": {}, "dtype_meta": {"source": "logical_values"}}
        if k != 3:
            m = rng.uniform(-0.2, 0.4, (20, 4))
            if k == 2:
                m[15:, 0] = 0.9
            raw = formats.encode_matrix(m, "fp16")
            (where / "deep.bin").write_bytes(raw)
            sha_deep = hashlib.sha256(raw).hexdigest()
        (where / "deep_index.json").write_text(json.dumps(index))
        sha_outer = hashlib.sha256((where / "outer.json").read_bytes()).hexdigest()
        h = hashlib.sha256((prev + sha_outer + sha_deep + formats.canonical(doc["replay"])).encode()).hexdigest()
        (where / "seal.json").write_text(json.dumps({"run_id": where.name, "hash": h, "prev_hash": prev, "sha_outer": sha_outer, "sha_deep": sha_deep}))
        with (tmp_path / "rec" / "chain.jsonl").open("a") as f:
            f.write(json.dumps({"run_id": where.name, "hash": h, "prev_hash": prev}) + "\n")
        prev = h
    (tmp_path / "rec" / "runs" / "RUN-x").mkdir()
    (tmp_path / "rec" / "runs" / "RUN-x" / "outer.json").write_text("{}")
    return tmp_path / "rec"


def test_folder(spark, recorded):
    path = str(recorded)
    assert [r.run_id for r in folder.outer(spark, path).orderBy("run_id").collect()] == ["RUN-000001", "RUN-000002", "RUN-000003"]
    assert folder.one_run(spark, path, "RUN-000002").first().output.tokens == [3, 4, 5]
    assert folder.series(spark, path).count() == 8
    part = folder.series(spark, path, (15, 17), ["LOGITS"]).collect()
    assert len(part) == 2 and len(part[0].series) == 3
    assert {r.run_id: r.ok for r in folder.verified(spark, path).collect()} == {"RUN-000001": True, "RUN-000002": True, "RUN-000003": True}
    raw = (recorded / "runs/RUN-000002/deep.bin").read_bytes()
    (recorded / "runs/RUN-000002/deep.bin").write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    assert {r.run_id: r.ok for r in folder.verified(spark, path).collect()} == {"RUN-000001": True, "RUN-000002": False, "RUN-000003": True}
    found = find_runs(folder.outer(spark, path), folder.series(spark, path), folder.hot(spark, path), "N-02-0001 AT token=17 > 0.8", verified=folder.verified(spark, path)).collect()
    assert [(r.run, r.hash_seal_verified) for r in found] == [("RUN-000002", False)]
    with (recorded / "chain.jsonl").open("a") as f:
        f.write("{broken\n")
    assert folder.chain(spark, path).filter("bad").count() == 1
    assert not folder.outer(spark, path).filter("replay IS NULL").count()


def test_shard_log(spark, recorded):
    (recorded / "index").mkdir()
    stats = {"n": 5, "min": 0.0, "max": 1.0, "mean": 0.5, "p95": 0.9, "firing_rate": 0.2, "win10": [1.0], "n_win10": 1}
    lines = [{"run_id": "RUN-000001", "addresses": {"LOGITS": stats | {"max": m}}} for m in (1.0, 2.0)]
    (recorded / "index/shard-000001.jsonl").write_text(json.dumps(lines[0]) + "\nnot json\n" + json.dumps(lines[1]) + "\n")
    held = folder.hot(spark, str(recorded))
    assert held.filter("run_id = 'RUN-000001'").collect()[0].max == 2.0  # the last line counts
    assert held.filter("run_id = 'RUN-000002'").count() == 4  # not in the log: from its matrix


def test_wal(spark, tmp_path):
    (tmp_path / "RUN-000001.wal.jsonl").write_text('{"token": 4, "values": [1.0]}\n{"token": 3, "values": [2.0]}\n{"tok')
    rows = folder.wal(spark, str(tmp_path / "*.jsonl")).orderBy("seq").collect()
    assert [(r.run_id, r.token, r.values) for r in rows] == [("RUN-000001", 4, [1.0]), ("RUN-000001", 3, [2.0])]


def test_matrix_files(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(1000, 10)).astype("<f2")
    path = str(tmp_path / "deep.bin")
    (tmp_path / "deep.bin").write_bytes(m.tobytes())
    assert deepbin.cold_slice(path, "fp16", 10, (2, 5), [0, 3]).shape == (4, 2)
    for bad in ((990, 1000), (-1, 2)):
        with pytest.raises(BadInput):
            deepbin.cold_slice(path, "fp16", 10, bad)
    spark.dataSource.register(deepbin.DeepBinSource)
    rows = spark.read.format("deepbin").option("path", path).option("width", "10").load()
    assert rows.count() == 10_000
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    part = spark.read.format("deepbin").option("path", path).option("width", "10").option("pushdown", "true").load().filter("tok BETWEEN 15 AND 19 AND col IN (0, 3)")
    assert part.count() == 10 and part.agg(F.max("value")).first()[0] == float(m[15:20][:, [0, 3]].max())
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_store(spark, recorded, tmp_path, capsys):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(str(recorded))
    store.ingest(str(recorded))
    assert store.table("runs").count() == 3 and store.table("series").count() == 8
    store.index()
    assert store.table("hot").count() == 8
    assert store.seal() == 3 and store.seal() == 0
    assert store.verified().filter("ok").count() == 3
    with pytest.raises(AlreadyThere):
        store.add_runs(store.table("runs"))
    more = store.next_numbers(store.table("runs").limit(2), "run_id")
    assert sorted(r.run_id for r in more.collect()) == ["RUN-000004", "RUN-000005"]
    store.index(rebuild=True)
    names = store.export("RUN-000001", str(tmp_path / "x.zip"), with_index=True)
    assert names == ["outer.json", "seal.json", "deep.bin", "deep_index.json"] and store.export("RUN-000003", str(tmp_path / "z.zip")) == ["outer.json", "seal.json"]
    assert store.export("RUN-000003", str(tmp_path / "z.zip"), with_index=True)[2:] == ["deep_index.json"]
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        index, raw = json.loads(z.read("deep_index.json")), z.read("deep.bin")
        assert json.loads(z.read("outer.json"))["replay"] == {"seed": 1, "temp": 0.0, "versions": {"torch": "2"}}
    assert index["watched"] == ["A-02-01", "LOGITS", "N-02-0001", "N-02-0002"] and index["columns"]["LOGITS"] == {"offset": 1, "dtype": "fp16", "shape": [20]}
    want = {r.address: list(r.series) for r in store.table("series").filter("run_id = 'RUN-000001'").collect()}
    assert formats.decode_matrix(raw, "fp16", 4).T.tolist() == [want[a] for a in index["watched"]]
    # back to a folder of recorded runs, and in again
    store_mod.write_folder(store.table("runs"), str(tmp_path / "back"), store.table("series"))
    again = folder.series(spark, str(tmp_path / "back"))
    assert again.exceptAll(store.table("series").select(again.columns)).isEmpty() and again.count() == 8
    assert {r.run_id: r.triggered for r in folder.deep_index(spark, str(tmp_path / "back")).collect()} == {"RUN-000001": True, "RUN-000002": True, "RUN-000003": False}
    assert store.verify_run("RUN-000002") and not store.verify_run("RUN-000009")

    def run(*argv):
        return cli.main(["--store", store.path, *argv], spark)

    assert run("find", "N-02-0001 AT token=17 > 0.8", "--json") == 0 and run("find", "N-02-0001 AT") == 2 and run("find", "N-2 > 1") == 4
    assert run("compare", "--good", "tag:cohort=good", "--bad", "tag:cohort=bad", "--neurons", "N-02-0001") == 0
    assert run("compare", "--good", "tag:cohort=none", "--bad", "tag:cohort=bad", "--neurons", "N-02-0001") == 6
    assert run("verify", "--all") == 0 and run("verify", "RUN-000009") == 6 and run("verify", "RUN-000001", "RUN-000009", "--json") == 7
    assert run("view", "RUN-000001", "--json") == 0 and run("view", "RUN-000002", "--export-html", str(tmp_path / "v.html")) == 0
    page = (tmp_path / "v.html").read_text()
    assert "seal verified" in page and "hello 2" in page and "<script src" not in page and len(page) < 200_000
    capsys.readouterr()
    assert run("view", "RUN-000002", "--tokens", "0..9", "--addrs", "N-02-0001,N-02-0009", "--no-color") == 0
    out = capsys.readouterr().out
    assert "model=M" in out and "(W=4)" in out and "RUN-000002 VERIFIED" in out and 'PROMPT (1 tokens): "hello 2"' in out and "#3 " in out and "t9" in out and "--" in out and 'OUTPUT: "x"' in out
    assert run("view", "RUN-000002", "--tokens", "17..17", "--addrs", "N-02-0001,N-02-0009", "--json") == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["hash_seal_verified"] is True and doc["tokens"] == [{"pos": 17, "text": "t17", "values": {"N-02-0001": pytest.approx(0.9, abs=1e-3), "N-02-0009": None, "_note": "not_watched"}}]
    assert run("view", "RUN-000003", "--no-color") == 0 and "Outer-only run" in capsys.readouterr().out
    assert run("view", "RUN-000002", "--tokens", "9..3") == 2 and run("view", "RUN-000002", "--port", "80") == 2
    assert run("size", "--by-model") == 0 and run("size", "--by-run", "--json") == 0 and run("export", "--run", "RUN-000001", "--out", str(tmp_path / "y.zip")) == 0
    assert run("export", "--run", "RUN-000009") == 6
    watch = tmp_path / "w.yaml"
    watch.write_text("version: 1\nentries:\n  - addresses: [LOGITS]\n")
    assert run("run", "--watch", str(watch), "--limit", "10", "--dry-run") == 0 and run("run", "--watch", str(watch), "--limit", "0") == 2
    watch.write_text("version: 1\nentries:\n  - preset: mid-mlp-wide\n")
    assert run("run", "--watch", str(watch), "--limit", "1000000") == 5 and run("run", "--watch", str(watch), "--trigger", "window:1..2.5") == 2
    assert run("run", "--watch", "outer_only.yaml", "--tag", "k=v", "--seed", "7") == 0
    assert store.verify_run("RUN-000004") and json.loads(store.table("runs").filter("run_id = 'RUN-000004'").first().replay)["seed"] == 7
    assert run("run", "--watch", "outer_only.yaml", "--dry-run") == 0 and store.table("runs").count() == 4
    assert set(cli.COMMANDS) == {"scan", "run", "find", "compare", "verify", "view", "size", "export"}


def test_checkpoints(spark, tmp_path):
    where = tmp_path / "model"
    where.mkdir()
    config = {"num_hidden_layers": 4, "n_embd": 512, "num_attention_heads": 8, "n_inner": 1024, "vocab_size": 32000, "model_type": "llama"}
    (where / "config.json").write_text(json.dumps(config))
    head = json.dumps({"w": {"dtype": "F16", "shape": [1], "data_offsets": [0, 2]}}).encode()
    (where / "a.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0\0")
    row = checkpoints.manifest(spark, str(where)).first()
    assert (row.layers, row.hidden, row.heads, row.mlp, row.vocab) == (4, 512, 8, 1024, 32000)
    assert row.checkpoint_sha256 == hashlib.sha256((where / "config.json").read_bytes() + head).hexdigest()
    args = ["--store", str(tmp_path / "s"), "scan", str(where)]
    assert cli.main(args, spark) == 0 and cli.main(args, spark) == 3 and cli.main([*args, "--force"], spark) == 0
    assert cli.main(["--store", str(tmp_path / "s"), "scan", "--api-model", "remote"], spark) == 0
    (where / "config.json").write_text(json.dumps({"n_embd": 5}))
    with pytest.raises(BadInput):
        checkpoints.manifest(spark, str(where))
    assert checkpoints.api_model(spark, "m").first().mode == "outer_only"


def test_recorder(spark, tmp_path):
    with recorder.watch(spark, "outer_only.yaml", tag=["b=2", "a=1"], store=str(tmp_path / "s"), redactor=lambda t: t.replace("secret", "***")) as r:
        assert r.call(lambda p: {"text": p.upper()}, "a secret", seed=1) == {"text": "A SECRET"}
        with pytest.raises(ZeroDivisionError):
            r.call(lambda p: 1 / 0, "boom")
        r.detach()
        r.call(str, "unseen")
    rows = Store(spark, str(tmp_path / "s")).table("runs").orderBy("run_id").collect()
    assert [x.run_id for x in rows] == ["RUN-000001", "RUN-000002"]
    assert rows[0].prompt.text == "a ***" and rows[0].output.text == "A SECRET" and rows[0].tags == ["a=1", "b=2"] and rows[0].versions["redactor"] == "custom"
    assert rows[1].error.code == "ZeroDivisionError" and rows[0].cost.usd == 0.0 and json.loads(rows[0].replay)["seed"] == 1
    assert recorder.redacted(lambda t, ids: (t[:1], [7]), "abc", [1]) == ("a", [7])


def test_streams(spark, tmp_path):
    rows = [("a", k, float(k), f"2026-01-01 00:00:{k:02d}") for k in range(6)] + [("b", 0, 1.0, "2026-01-01 00:00:01")]
    src = str(tmp_path / "src")
    first = spark.createDataFrame(rows, "run_id string, token int, value double, t string").select("run_id", "token", "value", F.to_timestamp("t").alias("ts"))
    first.coalesce(1).write.parquet(src)
    stream = capture.rows(spark, src, first.schema, 1)
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    sealed = spark.createDataFrame([("b",)], "run_id string")
    capture.to_log(stream.withColumn("values", F.array("value")), log, state, sealed).awaitTermination()
    assert {r.run_id: (r.rows, r.last_token) for r in capture.progress(spark, log).collect()} == {"a": (6, 5)}
    later = spark.createDataFrame([("a", 7, 7.0, "2026-01-01 02:00:00"), ("c", 0, 0.0, "2026-01-01 05:00:00")], "run_id string, token int, value double, t string")
    later.select("run_id", "token", "value", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(src)
    capture.to_log(capture.rows(spark, src, first.schema, 1).withColumn("values", F.array("value")), log, state, sealed).awaitTermination()
    assert capture.progress(spark, log).filter("run_id = 'a'").first().rows == 7
    done = capture.drained(capture.finalised(capture.rows(spark, src, first.schema, 1), "1 minute", "10 seconds"), "append", str(tmp_path / "state2"))
    got = {r.run_id: r.tokens for r in done.collect()}
    assert got["b"] == [0] and got["a"][:6] == [0, 1, 2, 3, 4, 5]


def test_recorder_under_a_watch_file(spark, tmp_path):
    """The gate comes first; what was recorded can be saved, and names its versions."""
    where = str(tmp_path / "s")
    (tmp_path / "w.yaml").write_text("version: 1\nmodel_id: M\ncheckpoint_sha256: ab\nentries:\n  - preset: attention_only\n")
    Store(spark, where).table("manifests").limit(0).write.parquet(f"{where}/manifests")
    spark.createDataFrame([("M", "M", "cd", 32, 64, 32, 128, 10, "full")], schema.MANIFEST).write.mode("append").parquet(f"{where}/manifests")
    with pytest.raises(BadAddress):
        recorder.watch(spark, str(tmp_path / "w.yaml"), store=where)
    spark.createDataFrame([("M", "M", "ab", 32, 64, 32, 128, 10, "full")], schema.MANIFEST).write.mode("append").parquet(f"{where}/manifests")
    with pytest.raises(TooLarge):
        recorder.watch(spark, str(tmp_path / "w.yaml"), store=where, runs=100_000_000)
    with recorder.watch(spark, str(tmp_path / "w.yaml"), store=where, runs=100_000_000, force=True) as r:
        r.call(lambda p: p, "hi", seed=3)
    doc = json.loads((tmp_path / "s" / "last.json").read_text()) if r.save_outer(f"{where}/last.json") else {}
    assert r.run_ids == ["RUN-000001"] and doc["run_id"] == "RUN-000001" and doc["replay"]["seed"] == 3 and set(doc["versions"]) == {"torch", "cuda", "redactor"}


def test_adapters(spark, tmp_path):
    doc = {"family": "f", "layout": "row_major_float16", "order": "row_major_token_major", "endian": "little", "dtypes": ["fp16"], "addressing": {"layer": "L-{LL:02d}", "specials": ["NORM"]}, "reference_arch": {"layers": 2, "hidden": 3, "heads": 4, "mlp_per_layer": 5, "vocab": 6}}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    (tmp_path / "g.json").write_text("not json")
    [row] = checkpoints.adapters(spark, str(tmp_path / "*.json")).collect()
    assert (row.family, row.row_order, row.addressing.specials, row.reference_arch.mlp_per_layer) == ("f", "row_major_token_major", ["NORM"], 5)


def test_exact_checks_that_raise(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 0.5)], "run_id string, value double")
    assert [r.run_id for r in hot.exact(rows, lambda r: r["value"] > 0.7).collect()] == ["a"]


def test_frame_addresses_are_checked(spark, recorded):
    runs, series = folder.outer(spark, str(recorded)), folder.series(spark, str(recorded))
    frame = to_dataframe(runs, series, "RUN-000001", tokens=(0, 1))
    assert [r.address for r in frame.collect()] == ["A-02-01", "LOGITS", "N-02-0001", "N-02-0002"] * 2
    with pytest.raises(BadAddress):
        to_dataframe(runs, series, "RUN-000001", addresses=["N-99-0001"], manifest={"layers": 32, "heads": 32, "mlp": 100})


def test_shared_folder_needs_a_name_off_the_local_master(spark, monkeypatch):
    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(BadInput):
        shared.folder(Elsewhere)
    assert shared.folder(spark).endswith("/tapelark")


def test_view_text():
    run = {"run_id": "r", "model_id": "M", "output": {"text": "out", "tokens": [5]}}
    rows = [{"pos": k, "text": f"t{k}", "values": {"A-01-01": float(k), "LOGITS": None, "_note": "not_watched"}} for k in range(3)]
    text = viewer.format_table(run, rows, ["A-01-01", "LOGITS"], False, 1, color=False)
    assert "FAIL" in text and "2.00" in text and "--" in text and "\033" not in text and "\033[31m" in viewer.format_table(run, rows, ["A-01-01"], False, 1)
    assert json.loads(viewer.to_json(run, rows, True))["tokens"][2]["values"]["A-01-01"] == 2.0
    assert schema.SERIES.names[-1] == "series"
