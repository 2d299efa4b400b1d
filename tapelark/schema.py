"""Tables of the store: runs, series, hot, seals, chain, manifests."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXTS, INTS = T.ArrayType(S), T.ArrayType(I)

#: A run's document. ``patch`` and ``replay`` are JSON text: hashes need the spelling.
RUN = struct(
    run_id=S,
    model_id=S,
    checkpoint_sha256=S,
    watchlist_ref=struct(watchlist_id=S, watchlist_sha256=S, patch=S),
    prompt=struct(text=S, tokens=INTS, tokenizer=S),
    output=struct(text=S, tokens=INTS, token_order=INTS, finish_reason=S),
    logits_summary=struct(available=B, top_k=T.ArrayType(INTS)),
    timing=struct(t_start_iso=S, t_end_iso=S, ms_per_token=D, cuda_event_ms=D),
    sampling=struct(seed=L, temp=D, top_p=D, sampler=S),
    versions=T.MapType(S, S),
    cost=struct(input_tokens=I, output_tokens=I, usd=D),
    flags=T.MapType(S, B),
    tags=TEXTS,
    replay=S,
    error=struct(code=S, message=S),
)

DEEP_INDEX = struct(
    run_id=S, triggered=B, dtype=S, tokens=I, every_n=I,
    window=struct(start_token=I, end_token=I, every_n=I), watched=TEXTS,
    columns=T.MapType(S, struct(offset=I, dtype=S, shape=INTS)), dtype_meta=T.MapType(S, S),
)

#: One row per run and address; the series is indexed by token row.
SERIES = struct(run_id=S, address=S, kind=S, layer=I, idx=I, series=T.ArrayType(T.FloatType()))

STATS = struct(n=L, min=D, max=D, mean=D, p95=D, firing_rate=D, win10=T.ArrayType(D), n_win10=L)
HOT_LINE = struct(
    run_id=S, model_id=S, checkpoint_sha256=S, watchlist_id=S, tags=TEXTS, flags=T.MapType(S, B),
    prompt_prefix=S, has_deep=B, dtype=S, tokens=I, addresses=T.MapType(S, STATS),
)

SEAL = struct(run_id=S, hash=S, prev_hash=S, sha_outer=S, sha_deep=S, algorithm=S, sealed_by=S, sealed_at_iso=S)
CHAIN = struct(pos=L, run_id=S, hash=S, prev_hash=S, bad=B)
WAL = struct(run_id=S, token=I, values=T.ArrayType(D), seq=L)
MANIFEST = struct(model_id=S, model_name=S, checkpoint_sha256=S, layers=I, hidden=I, heads=I, mlp=I, vocab=I, mode=S)
