"""One run for the eye: text, JSON and a self-contained page, of the tokens and addresses that are asked for."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelark.functions import cells
from tapelark.operators import analytics
from tapelark.operators.frame import MOST_ADDRESSES, TABLE_TOKENS, token_table

#: Values that a page holds at most.
MOST_VALUES = 32_768


def badge(run_id: str, verified: bool) -> str:
    return f"{run_id} VERIFIED" if verified else f"{run_id} FAIL: seal broken"


def shown(frame: DataFrame, n_tokens: int | None = TABLE_TOKENS) -> tuple[int, int]:
    """First and last token to show: all of the frame's, or its first ``n_tokens``."""
    low, high = frame.agg(F.min("token_pos"), F.max("token_pos")).first()
    if low is None:
        return 0, -1
    return low, high if n_tokens is None else min(high, low + n_tokens - 1)


def token_rows(frame: DataFrame, addresses: list[str], ids: list[int], tokens: tuple[int, int]) -> list[dict]:
    """Per token pos, text (its id in the output, or its place) and values by address; a note where one is missing.

    ``tokens`` and ``addresses`` are what a viewer asked for; that many values come to the driver.
    """
    part = frame.filter(F.col("token_pos").between(*tokens) & F.col("address").isin(addresses))
    held = {(r.token_pos, r.address): r.v for r in part.select("token_pos", "address", cells.known(F.col("value")).alias("v")).collect()}
    out = []
    for pos in range(tokens[0], tokens[1] + 1):
        values: dict = {a: held.get((pos, a)) for a in addresses}
        if None in values.values():
            values["_note"] = "not_watched"
        out.append({"pos": pos, "text": f"#{ids[pos]}" if pos < len(ids) else f"t{pos}", "values": values})
    return out


def format_table(run: dict, rows: list[dict], addresses: list[str], verified: bool, n_watched: int, seal: str = "", color: bool = True) -> str:
    """Text view of a run's document and some of its tokens; what was not watched is shown as ``--``."""
    blue, grey, red, green, plain = ("\033[34m", "\033[2m", "\033[31m", "\033[32m", "\033[0m") if color else ("",) * 5
    watch, prompt, output = run.get("watchlist_ref") or {}, run.get("prompt") or {}, run.get("output") or {}
    lines = [
        f"{run['run_id']}  model={run.get('model_id') or '?'}  ckpt=sha256:{(run.get('checkpoint_sha256') or '?').removeprefix('sha256:')[:8]}...  "
        f"watchlist={watch.get('watchlist_id') or '?'} (W={n_watched})  {green if verified else red}{badge(run['run_id'], verified)}{plain}",
        f'PROMPT ({len(prompt.get("tokens") or [])} tokens): "{prompt.get("text") or ""}"',
    ]
    if not n_watched:
        lines.append("Outer-only run: no Deep values, only prompt, output and timing.")
    lines.append(f"{'TOK':<5} {'TEXT':<8}" + "".join(f" {blue}{a:<10}{plain}" for a in addresses))
    for row in rows:
        shown_values = (row["values"][a] for a in addresses)
        lines.append(f"{row['pos']:<5} {row['text']:<8}" + "".join(f" {grey}{'--':>10}{plain}" if v is None else f" {v:>10.2f}" for v in shown_values))
    lines.append(f'OUTPUT: "{output.get("text") or ""}"')
    lines.append(f"seal: hash_i={seal[:8]}... verified={str(verified).lower()} | -- was not watched")
    return "\n".join(lines)


def to_json(run: dict, rows: list[dict], verified: bool) -> str:
    return json.dumps({
        "run_id": run["run_id"], "model_id": run.get("model_id") or "", "checkpoint_sha256": run.get("checkpoint_sha256") or "", "hash_seal_verified": verified,
        "prompt": (run.get("prompt") or {}).get("text") or "", "tokens": rows, "output": (run.get("output") or {}).get("text") or "",
    })


def page(frame: DataFrame, run: dict, addresses: list[str], verified: bool, unwatched: int = 0) -> str:
    """A page without outside resources: a badge for the seal, prompt and output, all token rows that it holds, and co-occurring pairs.

    It says so where it holds fewer tokens or addresses than there are.
    """
    run_id, asked = run["run_id"], len(addresses)
    addresses = addresses[:MOST_ADDRESSES]
    n_tokens = MOST_VALUES // max(1, len(addresses))
    held = frame.filter(F.col("address").isin(addresses))
    rows = token_table(held, addresses, n_tokens).orderBy("token_pos").collect()
    total = frame.agg(F.max("token_pos") + 1).first()[0] or 0
    left = f"<p>{len(rows)} of {total} tokens and {len(addresses)} of {asked} addresses are on this page</p>" if len(rows) < total or len(addresses) < asked else ""
    told = "".join(f"<p class='{k}'>{html.escape((run.get(k) or {}).get('text') or '')}</p>" for k in ("prompt", "output"))
    pairs = analytics.cooccurrence(held).orderBy(F.desc("abs_r")).collect()
    peak = analytics.peak_token(held).head()
    data = {"addresses": addresses, "rows": [[r.token_pos, *[r[a] for a in addresses]] for r in rows]}
    table = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in line) + "</tr>" for line in data["rows"])
    listed = "".join(f"<li>{html.escape(p.a)} with {html.escape(p.b)}: {p.r:+.3f}</li>" for p in pairs)
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(run_id)}</title></head><body><h1>{html.escape(run_id)}</h1>"
        f"<p class='seal'>{'seal verified' if verified else 'SEAL BROKEN'}</p><p>peak token {peak.token_pos if peak else '-'}; {unwatched} cells not watched</p>{told}{left}"
        f"<table><tr><th>token</th>{''.join(f'<th>{html.escape(a)}</th>' for a in addresses)}</tr>{table}</table><ul>{listed}</ul>"
        f"<script type='application/json' id='data'>{json.dumps(data).replace('</', '<' + chr(92) + '/')}</script></body></html>"
    )
