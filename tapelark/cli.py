"""Command line: scan, run, find, compare, verify, view, size, export. Exit status 0, or that of the error."""

from __future__ import annotations

import argparse
import json
import sys
import webbrowser
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tapelark import viewer
from tapelark.config import check_tags, estimate_line, gate, parse_trigger, read_watchlist
from tapelark.errors import BadInput, NotFound, SealBroken, TapeError
from tapelark.functions import addresses
from tapelark.functions.formats import json_lines
from tapelark.operators import compare as cohorts
from tapelark.operators import report, seal
from tapelark.operators.frame import MOST_ADDRESSES, TABLE_ADDRESSES, TABLE_TOKENS, deep_frame
from tapelark.plans.find import find_runs
from tapelark.plans.query import token_range
from tapelark.recorder import watch
from tapelark.sources import checkpoints, shared
from tapelark.sources.store import Store, document


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tapelark")
    top.add_argument("--store")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple, **kinds) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--json", action="store_true")
        for flag in flags:
            p.add_argument(flag, action="store_true")
        for flag, options in kinds.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **options)
        return p

    command("scan", "--force", output={}, api_model={}).add_argument("weights_path", nargs="?")
    command("run", "--force", "--dry-run", watch={"required": True}, tag={"action": "append", "default": []}, seed={"type": int, "default": 42}, limit={"type": int, "default": 1}, trigger={}, precision={})
    command("find", "--table", "--no-verify", "--verify", limit={"type": int, "default": 20}, tokens={}).add_argument("query")
    command("compare", good={"required": True}, bad={"required": True}, neurons={"required": True}, stat={"default": "mean,p95,firing_rate"}, tokens={"default": "15..20"}, limit={"type": int, "default": 10_000})
    command("verify", "--all").add_argument("run_ids", nargs="*")
    command("view", "--open", "--no-color", "--no-gpu", export_html={}, tokens={}, addrs={}, port={"type": int, "default": 8137}).add_argument("run_id")
    command("size", "--by-model", "--by-run")
    command("export", "--zip", "--with-manifest", "--with-index", run={"required": True}, out={})
    return top


def scan(spark, store: Store, a) -> list[str]:
    row = checkpoints.record(store, a.weights_path, a.api_model, a.force)
    if a.output:
        Path(a.output).write_text(json.dumps(row.asDict(), sort_keys=True, indent=2) + "\n")
    found = {"manifest": a.output or store.where("manifests"), "model_id": row.model_id, "checkpoint_sha256": row.checkpoint_sha256}
    return [json.dumps(found, sort_keys=True) if a.json else f"{row.model_id} {row.checkpoint_sha256[:12]} {row.mode}"]


def run(spark, store: Store, a) -> list[str]:
    """Gate and estimate; then, but for a dry run, a document is recorded under the watch file and sealed."""
    if a.limit < 1:
        raise BadInput("limit is at least 1")
    parse_trigger(a.trigger)
    check_tags(a.tag)
    held = read_watchlist(a.watch, trigger=a.trigger, precision=a.precision)
    plan = gate(spark, held, store.manifest(held.model_id, held.checkpoint_sha256), a.limit, a.force)
    line = estimate_line(plan["watched"], plan["tokens"], plan["runs"], plan["precision"])
    if a.dry_run:
        return [json.dumps(plan | {"dry_run": True}, sort_keys=True) if a.json else f"{line} Proceeding."]
    with watch(spark, a.watch, trigger=a.trigger, precision=a.precision, tag=a.tag, store=store.path, force=a.force, runs=a.limit) as recorder:
        recorder.call(lambda _: "", "", seed=a.seed)
    store.seal()
    run_id = recorder.run_ids[-1]
    sealed, size = store.table("seals").filter(F.col("run_id") == run_id).head(), len(recorder.last.encode())
    if a.json:
        return [json.dumps({"run": run_id, "hash": sealed.hash, "outer_kb": round(size / 1e3, 1), "deep_mb": 0.0, "flag": plan["band"]}, sort_keys=True)]
    good = "OK" if store.verify_run(run_id) else "BROKEN"
    return [f"{line} Proceeding.", f"{run_id} sealed | outer {size / 1e3:.1f}KB | hash {sealed.hash[:4]}... | chain {good}"]


def find(spark, store: Store, a) -> list[str]:
    checked = None if a.no_verify else store.verified()
    rows = find_runs(store.table("runs"), store.table("series"), store.table("hot") if store.has("hot") else None, a.query, a.limit, token_range(a.tokens) if a.tokens else None, verified=checked)
    if a.json:
        return [r.j for r in json_lines(rows).collect()]
    return [f"{r.run}  {r.address or '-'}@t{'-' if r.token is None else r.token}  {'-' if r.value is None else f'{r.value:.6g}'}  verified={str(r.hash_seal_verified).lower()}" for r in rows.collect()]


def compare(spark, store: Store, a) -> list[str]:
    low, high = token_range(a.tokens)
    rows = cohorts.require_both(cohorts.compare(store.table("runs"), store.table("series"), a.good, a.bad, a.neurons.split(","), (low, high), a.limit, a.stat).cache())
    stats = list(cohorts.parse_stats(a.stat))
    by: dict[str, dict] = {}
    for r in rows.orderBy("address", F.desc("side")).collect():
        by.setdefault(r.address, {"address": r.address, "tokens": a.tokens})[r.side] = {"n": 0, "empty": True} if r.empty else {"n": r.n, **{s: r[s] for s in stats}}
    if a.json:
        return [json.dumps(list(by.values()))]
    out = [f"{x['address']} | " + " | ".join(f"{s} " + " ".join(f"{k}={v:.4g}" if isinstance(v, float) else f"{k}={v}" for k, v in x[s].items()) for s in ("good", "bad")) for x in by.values()]
    if "firing_rate" in stats:
        bars = rows.groupBy("side").agg(cohorts.bar(F.coalesce(F.avg("firing_rate"), F.lit(0.0))).alias("b")).orderBy(F.desc("side")).collect()
        out.append("histogram " + " ".join(f"{r.side} {r.b}" for r in bars))
    return out


def verify(spark, store: Store, a) -> Iterator[str]:
    checked = store.verified()
    if not a.all:
        if not a.run_ids:
            raise BadInput("run ids or --all are needed")
        asked = spark.createDataFrame([(x,) for x in a.run_ids], "run_id string")
        checked = asked.join(checked, "run_id", "left")
        if len(a.run_ids) == 1 and checked.filter("ok IS NULL").count():
            raise NotFound(f"{a.run_ids[0]} not found")
        checked = checked.select("run_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    with shared.written(checked, "verified") as held:
        rows, total = held.orderBy("run_id"), seal.summary(held).head()
        if a.json:
            yield json.dumps([{"run": r.run_id, "ok": r.ok} for r in rows.collect()])
        else:
            yield from (f"{r.run_id} {'OK' if r.ok else 'FAIL'}" for r in rows.toLocalIterator())
    if total.failed:
        raise SealBroken(f"{total.failed} of {total.ok + total.failed} runs fail")


def view(spark, store: Store, a) -> list[str]:
    if not 1024 <= a.port <= 65535:
        raise BadInput(f"port {a.port} is not in 1024..65535")
    one = store.table("runs").filter(F.col("run_id") == a.run_id)
    if one.isEmpty():
        raise NotFound(f"{a.run_id} not found")
    doc = document(json_lines(one).head().j)
    held = store.table("series").filter(F.col("run_id") == a.run_id)
    if a.addrs:
        names = a.addrs.split(",")
        for n in names:
            addresses.parse(n)
    else:
        most = MOST_ADDRESSES if a.export_html else TABLE_ADDRESSES
        names = [r.address for r in held.select("address").orderBy("kind", "layer", "idx", "address").limit(most).collect()]
    frame = deep_frame(one, held, names, token_range(a.tokens) if a.tokens else None)
    good, watched = store.verify_run(a.run_id), held.count()
    if a.export_html:
        Path(a.export_html).write_text(viewer.page(frame, doc, names, good))
        if a.open:
            webbrowser.open(Path(a.export_html).resolve().as_uri())
        return [a.export_html]
    rows = viewer.token_rows(frame, names, (doc.get("output") or {}).get("tokens") or [], viewer.shown(frame, None if a.tokens else TABLE_TOKENS))
    if a.json:
        return [viewer.to_json(doc, rows, good)]
    seal_row = store.table("seals").filter(F.col("run_id") == a.run_id).head()
    return [viewer.format_table(doc, rows, names, good, watched, seal_row.hash if seal_row else "0" * 64, not a.no_color)]


def size(spark, store: Store, a) -> Iterator[str]:
    rows = report.by_run(store.sizes()).orderBy("run_id") if a.by_run else report.by_model(store.sizes()).orderBy("model")
    if a.json:
        yield from (r.j for r in json_lines(rows).toLocalIterator())
    else:
        yield from ("  ".join(map(str, r)) for r in rows.toLocalIterator())


def export(spark, store: Store, a) -> list[str]:
    out = a.out or f"{a.run}.zip"
    names = store.export(a.run, out, a.with_manifest, a.with_index)
    return [json.dumps({"zip": out, "files": names}) if a.json else f"{out}: {', '.join(names)}"]


COMMANDS = {f.__name__: f for f in (scan, run, find, compare, verify, view, size, export)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("tapelark").getOrCreate()
    try:
        for line in COMMANDS[a.command](spark, Store(spark, a.store), a):
            print(line)
    except TapeError as e:
        print(e, file=sys.stderr)
        return e.status
    return 0


if __name__ == "__main__":
    sys.exit(main())
