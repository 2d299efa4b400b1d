"""The registered queries of the store's operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelark import recorder
from tapelark import testmap as t
from tapelark.config import Trigger, band_column, estimate_column, parse_trigger
from tapelark.config import Window as TokenWindow
from tapelark.functions import addresses, formats, sql
from tapelark.operators import analytics, compare, frame, gate, hot, report, seal, wal
from tapelark.plans.find import find_runs
from tapelark.sources import shared
from tapelark.streaming import capture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENTS = """e AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS token_pos,
  event_type AS address, value, ts, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS elapsed FROM events)"""
CELLS = """c AS (SELECT label AS run_id, pos AS token_pos, d AS idx, 'N-01-' || lpad(CAST(d AS VARCHAR), 4, '0') AS address, v FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, unnest(range(1, len(embedding) + 1)) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the embeddings as a store has them: a table in order of address, written once."""
    return shared.once(spark, (sf_dir, "series-embeddings"), lambda: t.series_embeddings(spark, sf_dir), ("address", "run_id"))


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# Cohorts -------------------------------------------------------------------------------------------

_POOLED = f"""WITH {EVENTS}, n AS (SELECT run_id, count(*) AS n FROM e GROUP BY 1),
 w AS (SELECT DISTINCT run_id, address FROM e), k AS (SELECT w.*, CASE WHEN run_id % 2 = 0 THEN 'good' ELSE 'bad' END AS side FROM w JOIN n USING (run_id) WHERE n > 15),
 r AS (SELECT *, row_number() OVER (PARTITION BY address, side ORDER BY run_id) AS i FROM k),
 m AS (SELECT * FROM r WHERE i <= LIMIT_RUNS),
 v AS (SELECT m.address, m.side, m.run_id, e.value FROM m LEFT JOIN e ON e.run_id = m.run_id AND e.address = m.address AND e.token_pos BETWEEN 15 AND 20)
SELECT address, side, count(DISTINCT run_id) AS n, count(value) AS n_values, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95,
 round(max(value), 6) AS max, round(coalesce(avg(CASE WHEN value > 100 THEN 1.0::DOUBLE WHEN value IS NOT NULL THEN 0.0::DOUBLE END), 0), 6) AS firing_rate
FROM v GROUP BY 1, 2"""


def _pooled_events(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    runs = t.runs_events(spark, sf_dir)
    side = F.when(F.array_contains("tags", "cohort=good"), "good").otherwise("bad")
    series = shared.once(spark, (sf_dir, "series-events"), lambda: t.series_events(spark, sf_dir), ("address", "run_id"))
    sided = series.join(runs.select("run_id", side.alias("side")), "run_id")
    out = compare.pooled_by_side(sided, ["address", "side"], 15, 20, limit, above=100.0)
    return out.select("address", "side", "n", "n_values", r6("mean"), r6("p95"), r6("max"), r6("firing_rate"))


@query(_POOLED.replace("LIMIT_RUNS", "10000"))
def compare_pooled_events(spark, sf_dir):
    return _pooled_events(spark, sf_dir, 10_000)


@query(_POOLED.replace("LIMIT_RUNS", "7"))
def compare_limit_per_group(spark, sf_dir):
    return _pooled_events(spark, sf_dir, 7)


@query(f"""WITH {CELLS}, p AS (SELECT address, CASE WHEN run_id % 2 = 0 THEN 'good' ELSE 'bad' END AS side, run_id, v FROM c WHERE token_pos BETWEEN 5 AND 9 AND idx BETWEEN 1 AND 8)
SELECT address, side, count(DISTINCT run_id) AS n, count(v) AS n_values, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95,
 round(avg(CASE WHEN v > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS firing_rate, false AS empty FROM p GROUP BY 1, 2""")
def compare_groups(spark, sf_dir):
    out = compare.compare(t.runs_embeddings(spark, sf_dir), _stored(spark, sf_dir), "tag:cohort=good", "tag:cohort=bad", ["N-01-0001..0008"], (5, 9), stats="mean,p95,firing_rate>0.1")
    return out.select("address", "side", "n", "n_values", r6("mean"), r6("p95"), r6("firing_rate"), "empty")


@query(f"""WITH {CELLS}, p AS (SELECT address, CASE WHEN run_id % 2 = 0 THEN 'tag:cohort=good' ELSE 'tag:cohort=bad' END AS side, run_id, v FROM c WHERE token_pos BETWEEN 2 AND 6 AND idx BETWEEN 3 AND 5)
SELECT address, side, count(DISTINCT run_id) AS n, count(v) AS n_values, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM p GROUP BY 1, 2""")
def compare_groups_query(spark, sf_dir):
    text = "COMPARE GROUPS tag:cohort=good, tag:cohort=bad ON N-01-0003..0005 AT tokens 2..6 WITH STATS mean, max"
    out = compare.compare_query(t.runs_embeddings(spark, sf_dir), _stored(spark, sf_dir), text)
    return out.select("address", "side", "n", "n_values", r6("mean"), r6("max"))


@query("""SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n, round(avg(CAST(length(text) AS DOUBLE)), 6) AS mean, round(quantile_cont(CAST(length(text) AS DOUBLE), 0.95), 6) AS p95
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1""")
def compare_quality_documents(spark, sf_dir):
    docs, labels = t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "labels").filter("quality IS NOT NULL")
    long = docs.join(labels, "doc_id").select(F.col("quality").cast("long").alias("quality"), F.length("text").cast("double").alias("x")).filter("x IS NOT NULL")
    return long.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", 0.95), 6).alias("p95"))


@query(f"""WITH {EVENTS}, f AS (SELECT address, avg(CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM e GROUP BY 1),
 k AS (SELECT address, CAST(greatest(0, least(10, round_even(rate * 10, 0))) AS BIGINT) AS k FROM f)
SELECT address, '[' || repeat('#', CAST(k AS INTEGER)) || repeat('.', CAST(10 - k AS INTEGER)) || ']' AS bar FROM k""")
def histogram_bar(spark, sf_dir):
    from tapelark.functions.cells import firing_rate

    rates = t.cells_events(spark, sf_dir).groupBy("address").agg(firing_rate(F.col("value"), 100.0).alias("rate"))
    return rates.select("address", compare.bar(F.col("rate")).alias("bar"))


# Index ---------------------------------------------------------------------------------------------


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, address, count(*) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean,
 round(quantile_cont(v, 0.95), 6) AS p95, round(avg(CASE WHEN v > 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS firing_rate FROM c GROUP BY 1, 2""")
def hot_index_embeddings(spark, sf_dir):
    held = hot.build(_stored(spark, sf_dir))
    return held.select(F.col("run_id").cast("long").alias("run_id"), "address", "n", r6("min"), r6("max"), r6("mean"), r6("p95"), r6("firing_rate"))


@query(f"WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, address, token_pos // 10 AS chunk, round(max(v), 6) AS top FROM c WHERE token_pos < 1280 GROUP BY 1, 2, 3")
def hot_win10_embeddings(spark, sf_dir):
    held = hot.build(_stored(spark, sf_dir))
    each = held.select(F.col("run_id").cast("long").alias("run_id"), "address", F.posexplode("win10").alias("chunk", "top"))
    return each.select("run_id", "address", F.col("chunk").cast("long").alias("chunk"), r6("top"))


# Search --------------------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    series = _stored(spark, sf_dir)
    index = shared.once(spark, (sf_dir, "hot-embeddings"), lambda: hot.build(series), ("address", "run_id"))
    out = find_runs(t.runs_embeddings(spark, sf_dir), series, index, text, None, **options)
    return out.select(F.col("run").cast("long").alias("run"), "address", "token", r6("value"))


def _one(where: str, low: int, high: int, aggregate: str, test: str) -> str:
    """SQL of a range condition on one address: the aggregate, and the first token of the extreme."""
    extreme = "min" if aggregate == "min(v)" else "max"
    sign = "" if extreme == "min" else "-"
    return f"""WITH {CELLS}, s AS (SELECT * FROM c WHERE {where} AND token_pos BETWEEN {low} AND {high}),
 a AS (SELECT run_id, address, {aggregate} AS value, arg_min(token_pos, ({sign}v, token_pos)) AS token FROM s GROUP BY 1, 2)
SELECT CAST(run_id AS BIGINT) AS run, address, token, round(value, 6) AS value FROM a WHERE value {test}"""


@query(_one("idx = 3", 17, 17, "max(v)", "> 0.1"))
def find_point_gt(spark, sf_dir):
    return _found(spark, sf_dir, "FIND RUNS WHERE N-01-0003 AT token=17 > 0.1")


@query(_one("idx = 5", 15, 19, "max(v)", ">= 0.15"))
def find_range_max(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0005 AT tokens 15..19 MAX >= 0.15")


@query(_one("idx = 5", 0, 9, "min(v)", "< -0.1"))
def find_range_min(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0005 AT tokens=0..9 MIN < -0.1")


@query(_one("idx = 7", 0, 2000000000, "avg(v)", "< 0.01"))
def find_range_mean(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0007 MEAN < 0.01")


@query(_one("idx = 7", 3, 30, "quantile_cont(v, 0.95)", "<= 0.25"))
def find_range_p95(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0007 AT tokens 3..30 P95 <= 0.25")


@query(_one("idx = 9", 4, 4, "max(v)", "!= 0.5"))
def find_not_equal(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0009 AT token 4 != 0.5")


@query("""WITH l AS (SELECT l_orderkey AS run, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem)
SELECT run, 'N-01-0001' AS address, CAST(0 AS BIGINT) AS token, CAST(q AS DOUBLE) AS value FROM l WHERE k = 1 AND q = 17""")
def find_equal(spark, sf_dir):
    series = shared.once(spark, (sf_dir, "series-lineitems"), lambda: t.series_lineitems(spark, sf_dir), ("run_id",))
    out = find_runs(t.runs_orders(spark, sf_dir), series, hot.build(series), "FIND RUNS WHERE N-01-0001 AT token=0 = 17", None)
    return out.select(F.col("run").cast("long").alias("run"), "address", F.col("token").cast("long").alias("token"), F.col("value").cast("double").alias("value"))


@query(f"""WITH {CELLS}, a AS (SELECT run_id, address, max(v) AS value, arg_min(token_pos, (-v, token_pos)) AS token FROM c WHERE idx BETWEEN 1 AND 64 AND token_pos BETWEEN 10 AND 20 GROUP BY 1, 2),
 h AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, address) AS k FROM a WHERE value > 0.2)
SELECT CAST(run_id AS BIGINT) AS run, address, token, round(value, 6) AS value FROM h WHERE k = 1""")
def find_addr_range_best(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0001..0064 AT tokens 10..20 > 0.2")


@query(_one("idx = 11", 15, 19, "max(v)", "> 0.05"))
def find_two_phase_equals_full(spark, sf_dir):
    """The answer is that of a full scan, whatever the index leaves out."""
    return _found(spark, sf_dir, "N-01-0011 AT tokens 15..19 > 0.05")


@query(f"""WITH {CELLS}, a AS (SELECT run_id, idx, address, arg_min(token_pos, (-v, token_pos)) AS token, max(v) AS value FROM c WHERE idx IN (1, 2) AND token_pos BETWEEN 0 AND 20 GROUP BY 1, 2, 3),
 h AS (SELECT * FROM a WHERE value > 0.12), b AS (SELECT run_id FROM h GROUP BY 1 HAVING count(*) = 2)
SELECT CAST(run_id AS BIGINT) AS run, address, token, round(value, 6) AS value FROM h JOIN b USING (run_id) WHERE run_id % 2 = 0""")
def find_and_multi(spark, sf_dir):
    return _found(spark, sf_dir, 'FIND RUNS WHERE tag:cohort=good AND N-01-0001 AT tokens 0..20 > 0.12 AND N-01-0002 AT tokens 0..20 > 0.12')


@query(f"""WITH {CELLS}, a AS (SELECT run_id, idx, address, arg_min(token_pos, (-v, token_pos)) AS token, max(v) AS value FROM c WHERE idx IN (1, 2) AND token_pos BETWEEN 4 AND 12 GROUP BY 1, 2, 3)
SELECT CAST(run_id AS BIGINT) AS run, address, token, round(value, 6) AS value FROM a WHERE value > 0.12""")
def find_any_within_tokens(spark, sf_dir):
    return _found(spark, sf_dir, "N-01-0001 AT tokens 0..99 > 0.12 AND N-01-0002 AT tokens 4..99 > 0.12", tokens=(4, 12), match="any")


def _runs_found(runs: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return find_runs(runs, runs.sparkSession.createDataFrame([], "run_id long, address string, kind string, layer int, idx int, series array<float>"), None, text, limit).select("run")


@query("SELECT doc_id AS run FROM documents WHERE contains(text, 'License')")
def find_prompt_contains(spark, sf_dir):
    return _runs_found(t.runs_documents(spark, sf_dir), 'FIND RUNS WHERE prompt CONTAINS "License"')


@query("SELECT doc_id AS run FROM documents WHERE lang = 'fr'")
def find_tag_value(spark, sf_dir):
    return _runs_found(t.runs_documents(spark, sf_dir), 'tag="fr"')


@query("SELECT doc_id AS run FROM documents WHERE lang = 'de' AND source = 'src3'")
def find_tag_pair(spark, sf_dir):
    return _runs_found(t.runs_documents(spark, sf_dir), 'tag:lang=de AND tag:source="src3"')


@query("SELECT d.doc_id AS run FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def find_flag_bad_output(spark, sf_dir):
    return _runs_found(t.runs_documents(spark, sf_dir), 'flag="bad_output"')


@query("SELECT o_orderkey AS run FROM orders WHERE o_orderstatus = 'F'")
def find_checkpoint(spark, sf_dir):
    return _runs_found(t.runs_orders(spark, sf_dir), 'checkpoint="sha256:F"')


@query("SELECT o_orderkey AS run FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 20")
def find_limit_ordered(spark, sf_dir):
    """The row limit is the feature."""
    return _runs_found(t.runs_orders(spark, sf_dir), 'checkpoint="O"', 20)


# Frames --------------------------------------------------------------------------------------------


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, 'label ' || run_id AS token, round(v, 6) AS value, address, CAST(1 AS BIGINT) AS layer, true AS watched
FROM c WHERE idx IN (2, 4) AND token_pos BETWEEN 2 AND 30""")
def frame_deep_long(spark, sf_dir):
    return _framed(spark, sf_dir, ["N-01-0002", "N-01-0004"], (2, 30))


def _framed(spark, sf_dir, wanted: list[str], tokens: tuple[int, int]) -> DataFrame:
    from tapelark.functions.cells import known

    runs, series = t.runs_embeddings(spark, sf_dir), _stored(spark, sf_dir)
    out = frame.deep_frame(runs.withColumn("run_id", F.col("run_id").cast("long")), series.withColumn("run_id", F.col("run_id").cast("long")), wanted, tokens)
    value = F.round(known(F.col("value")), 6).alias("value")
    return out.select(F.col("run_id").cast("long").alias("run_id"), F.col("token_pos").cast("long").alias("token_pos"), "token", value, "address", F.col("layer").cast("long").alias("layer"), "watched")


@query(f"""WITH {CELLS}, k AS (SELECT DISTINCT run_id, token_pos FROM c WHERE token_pos BETWEEN 2 AND 5)
SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, 'label ' || run_id AS token, round(c.v, 6) AS value, q.address, CASE WHEN c.v IS NOT NULL THEN CAST(1 AS BIGINT) END AS layer, c.v IS NOT NULL AS watched
FROM k CROSS JOIN (VALUES ('N-01-0002'), ('N-02-0001')) q(address) LEFT JOIN c USING (run_id, token_pos, address)""")
def frame_unwatched_null(spark, sf_dir):
    return _framed(spark, sf_dir, ["N-01-0002", "N-02-0001"], (2, 5))


@query("SELECT doc_id AS run_id, CAST(0 AS BIGINT) AS token_pos, text AS token, 'LOGITS' AS address, false AS watched FROM documents")
def frame_outer(spark, sf_dir):
    out = frame.outer_frame(t.runs_documents(spark, sf_dir), "LOGITS")
    return out.select("run_id", F.col("token_pos").cast("long").alias("token_pos"), "token", "address", "watched")


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, round(max(CASE WHEN idx = 1 THEN v END), 6) AS "N-01-0001", round(max(CASE WHEN idx = 2 THEN v END), 6) AS "N-01-0002"
FROM c WHERE token_pos < 32 GROUP BY 1, 2""")
def token_table_pivot(spark, sf_dir):
    wanted = ["N-01-0001", "N-01-0002"]
    out = frame.token_table(_framed(spark, sf_dir, wanted, (0, 10_000)), wanted)
    return out


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, count(*) AS n_values, CAST(NULL AS VARCHAR) AS note FROM c WHERE idx IN (1, 2) AND token_pos < 8 GROUP BY 1, 2""")
def view_rows(spark, sf_dir):
    out = frame.view_rows(_framed(spark, sf_dir, ["N-01-0001", "N-01-0002"], (0, 7)))
    return out.select("run_id", "token_pos", F.size("values").cast("long").alias("n_values"), "note")


# Gates ---------------------------------------------------------------------------------------------


def _gated(spark, sf_dir, window: TokenWindow, trigger: Trigger) -> DataFrame:
    out = gate.armed(t.cells_events(spark, sf_dir), window, trigger)
    return out.select("run_id", F.col("token_pos").cast("long").alias("token_pos"), "address", "value")


_ALL = TokenWindow(0, 1 << 30, 1)


@query(f"WITH {EVENTS} SELECT run_id, token_pos, address, value FROM e WHERE token_pos >= 2 AND token_pos < 40 AND (token_pos - 2) % 3 = 0")
def gate_window_every_n(spark, sf_dir):
    return _gated(spark, sf_dir, TokenWindow(2, 40, 3), Trigger())


@query(f"WITH {EVENTS} SELECT run_id, token_pos, address, value FROM e WHERE address = 'error'")
def gate_on_flag(spark, sf_dir):
    return _gated(spark, sf_dir, _ALL, parse_trigger("on_flag:bad_output"))


@query(f"WITH {EVENTS} SELECT run_id, token_pos, address, value FROM e WHERE elapsed BETWEEN 3600 AND 864000")
def gate_time_window(spark, sf_dir):
    return _gated(spark, sf_dir, _ALL, parse_trigger("window:3600s..864000s"))


@query(f"WITH {EVENTS} SELECT run_id, token_pos, address, value FROM e WHERE token_pos BETWEEN 3 AND 9")
def gate_token_range(spark, sf_dir):
    return _gated(spark, sf_dir, _ALL, parse_trigger("window:3..9"))


@query(f"WITH {EVENTS}, k AS (SELECT DISTINCT run_id, token_pos FROM e WHERE address = 'click' AND value BETWEEN 20 AND 90) SELECT run_id, token_pos, address, value FROM e JOIN k USING (run_id, token_pos)")
def gate_address(spark, sf_dir):
    return _gated(spark, sf_dir, _ALL, Trigger("address_gate", address="click", low=20, high=90))


@query(f"WITH {EVENTS}, n AS (SELECT run_id, count(*) AS n FROM e GROUP BY 1) SELECT run_id, least(n, 50) AS kept, n > 50 AS ring_overflow FROM n")
def gate_capacity_overflow(spark, sf_dir):
    kept, flags = gate.bounded(t.cells_events(spark, sf_dir), 50)
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("kept")).join(flags, "run_id")


@query(f"""WITH {EVENTS}, b AS (SELECT run_id, min(token_pos) AS bad FROM e WHERE address = 'error' GROUP BY 1)
SELECT run_id, count(*) AS n, bad IS NOT NULL AS hook_detached FROM e LEFT JOIN b USING (run_id) WHERE bad IS NULL OR token_pos < bad GROUP BY 1, 3""")
def gate_until_error(spark, sf_dir):
    held = gate.until_error(t.cells_events(spark, sf_dir).withColumn("failed", F.col("address") == "error"))
    return held.groupBy("run_id", "hook_detached").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, k AS (SELECT run_id, count(DISTINCT token_pos) AS n FROM e WHERE address = 'error' AND token_pos < 20 GROUP BY 1)
SELECT DISTINCT e.run_id, k.n IS NOT NULL AS triggered, coalesce(k.n, 0) AS n_tokens FROM e LEFT JOIN k USING (run_id)""")
def absent_deep_triggered_flag(spark, sf_dir):
    kept = gate.armed(t.cells_events(spark, sf_dir), TokenWindow(0, 20, 1), Trigger("on_flag", flag="bad_output"))
    return gate.presence(t.runs_events(spark, sf_dir), kept)


@query(f"""WITH {EVENTS}, w AS (SELECT run_id, CAST(floor(elapsed / 3600) AS BIGINT) AS token, value, event_id FROM e), s AS (SELECT run_id, token, arg_max(value, event_id) AS value FROM w GROUP BY 1, 2)
SELECT run_id, min(token) AS low, max(token) AS high, count(*) AS n_rows, max(token) - min(token) + 1 - count(*) AS n_gaps, round(sum(value), 6) AS total FROM s GROUP BY 1""")
def wal_last_wins_dense(spark, sf_dir):
    held = wal.dense(t.log_events(spark, sf_dir))
    present = F.filter("cells", lambda v: v.isNotNull())
    return held.select(
        "run_id", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.col("n_rows").cast("long").alias("n_rows"),
        (F.size("cells") - F.size(present)).cast("long").alias("n_gaps"), F.round(F.aggregate(present, F.lit(0.0), lambda a, v: a + v[0]), 6).alias("total"),
    )


# Seals ---------------------------------------------------------------------------------------------

_DOCS = """d AS (SELECT conv_id AS run_id, sha256(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS sha_outer, sha256(coalesce(arg_max(text, turn), '')) AS sha_deep,
  '{"n":' || count(*) || '}' AS replay, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM conversations GROUP BY 1),
 s AS (SELECT pos, run_id, sha256(repeat('0', 64) || sha_outer || sha_deep || replay) AS hash, repeat('0', 64) AS prev_hash FROM d WHERE pos = 0
  UNION ALL SELECT d.pos, d.run_id, sha256(s.hash || d.sha_outer || d.sha_deep || d.replay), s.hash FROM s JOIN d ON d.pos = s.pos + 1)"""


@query(f"WITH RECURSIVE {_DOCS} SELECT pos, run_id, hash, prev_hash FROM s")
def seal_chain_fold(spark, sf_dir):
    return seal.sealed(t.documents_of_conversations(spark, sf_dir)).select("pos", "run_id", "hash", "prev_hash")


def _verified(spark, sf_dir) -> DataFrame:
    """Document 3 was changed after sealing, and the chain is broken at line 60."""
    docs = t.documents_of_conversations(spark, sf_dir)
    sealed = seal.sealed(docs)
    chain = sealed.select("pos", "run_id", "hash", F.when(F.col("pos") == 60, F.lit("f")).otherwise(F.col("prev_hash")).alias("prev_hash"), F.lit(False).alias("bad"))
    now = docs.withColumn("sha_outer", F.when(F.col("run_id") == 3, F.sha2(F.lit("changed"), 256)).otherwise(F.col("sha_outer")))
    return seal.verified(now, sealed, chain)


@query(f"WITH RECURSIVE {_DOCS} SELECT run_id, run_id <> 3 AND pos < 60 AS ok FROM d")
def seal_verify_tamper(spark, sf_dir):
    return _verified(spark, sf_dir)


@query(f"WITH RECURSIVE {_DOCS} SELECT count(*) FILTER (run_id <> 3 AND pos < 60) AS ok, count(*) FILTER (NOT (run_id <> 3 AND pos < 60)) AS failed FROM d")
def verify_summary(spark, sf_dir):
    return seal.summary(_verified(spark, sf_dir))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' OR o_totalprice > 400000 THEN 'warn' WHEN o_orderpriority = '1-URGENT' THEN 'deterministic' ELSE 'reproducible' END AS mode FROM orders""")
def replay_mode(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")

    def world(checkpoint, versions, seed):
        return F.struct(
            checkpoint.alias("checkpoint_sha256"), versions.alias("versions"), F.lit("gpu").alias("gpu"), F.lit(True).alias("deterministic"),
            F.lit(0.7).alias("temp"), seed.alias("seed"),
        )

    kept = F.when(F.col("o_totalprice") <= 400_000, F.lit(1))
    recorded = world(F.col("o_orderstatus"), F.col("o_orderpriority"), kept)
    now = world(F.when(F.col("o_orderstatus") == "P", "other").otherwise(F.col("o_orderstatus")), F.lit("1-URGENT"), F.lit(1))
    return orders.select(F.col("o_orderkey").alias("run_id"), seal.replay_mode(recorded, now).alias("mode"))


@query(f"WITH RECURSIVE {_DOCS} SELECT run_id AS run FROM d WHERE NOT (run_id <> 3 AND pos < 60)")
def find_hash_fail(spark, sf_dir):
    """Runs whose seal does not hold; document 3 was changed and the chain is broken at line 60."""
    runs = t.run_rows(t.documents_of_conversations(spark, sf_dir), "run_id")
    none = spark.createDataFrame([], "run_id long, address string, kind string, layer int, idx int, series array<float>")
    return find_runs(runs, none, None, 'flag="hash_fail"', None, verified=_verified(spark, sf_dir)).select("run")


# Analytics -----------------------------------------------------------------------------------------


def _long(spark, sf_dir) -> DataFrame:
    return t.long_embeddings(spark, sf_dir).withColumn("run_id", F.col("run_id").cast("long")).withColumn("token_pos", F.col("token_pos").cast("long"))


@query(f"""WITH {CELLS}, m AS (SELECT run_id, token_pos, max(abs(v)) AS s FROM c GROUP BY 1, 2)
SELECT CAST(run_id AS BIGINT) AS run_id, arg_min(token_pos, (-s, token_pos)) AS token_pos, round(max(s), 6) AS peak FROM m GROUP BY 1""")
def peak_token(spark, sf_dir):
    return analytics.peak_token(_long(spark, sf_dir)).select("run_id", "token_pos", F.round(F.col("peak").cast("double"), 6).alias("peak"))


@query(f"""WITH {CELLS}, m AS (SELECT run_id, token_pos, max(abs(v)) AS s FROM c GROUP BY 1, 2), p AS (SELECT run_id, arg_min(token_pos, (-s, token_pos)) AS centre FROM m GROUP BY 1),
 w AS (SELECT c.run_id, token_pos, address, v FROM c JOIN p USING (run_id) WHERE abs(token_pos - centre) <= 5),
 g AS (SELECT x.run_id, x.address AS a, y.address AS b, x.v AS x, y.v AS y FROM w x JOIN w y ON x.run_id = y.run_id AND x.token_pos = y.token_pos AND x.address < y.address),
 n AS (SELECT run_id, a, b, avg(x) AS mx, avg(y) AS my FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3),
 r AS (SELECT run_id, a, b, sum((x - mx) * (y - my)) / sqrt(sum((x - mx) * (x - mx)) * sum((y - my) * (y - my))) AS r FROM g JOIN n USING (run_id, a, b) GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(abs(r), 6) DESC, a DESC, b DESC) AS k FROM r WHERE abs(r) > 0.5)
SELECT CAST(run_id AS BIGINT) AS run_id, a, b, round(r, 6) AS r FROM k WHERE k <= 5""")
def cooccurrence_pairs(spark, sf_dir):
    """The five strongest of all pairs of each run are the feature."""
    long = _long(spark, sf_dir)
    out = analytics.cooccurrence(long)
    return out.select("run_id", "a", "b", r6("r"))


@query(f"""WITH {CELLS}, w AS (SELECT *, min(v) OVER q AS lo, max(v) OVER q AS hi FROM c WINDOW q AS (PARTITION BY run_id, address ORDER BY token_pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, address, CAST(least(7, floor((v - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) * 8)) AS BIGINT) AS level FROM w""")
def sparkline_glyphs(spark, sf_dir):
    return analytics.sparkline(_long(spark, sf_dir)).select("run_id", "token_pos", "address", F.col("level").cast("long").alias("level"))


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, token_pos, address, round(max(v) OVER (PARTITION BY run_id, address ORDER BY token_pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS max_window FROM c""")
def sliding_max10(spark, sf_dir):
    return analytics.sliding_max(_long(spark, sf_dir)).select("run_id", "token_pos", "address", r6("max_window"))


# Sizes and catalogue -------------------------------------------------------------------------------

_SIZED = """z AS (SELECT o_orderkey AS run_id, o_orderpriority || '/C-' || substr(o_orderstatus, 1, 6) AS model, length(o_orderpriority) AS hot_bytes,
  coalesce(n, 0) AS cold_bytes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) * 16 AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_BAND = "CASE WHEN {x} < 50e9 THEN 'GREEN' WHEN {x} <= 1000e9 THEN 'YELLOW' ELSE 'RED' END"


@query(f"WITH {_SIZED}, g AS (SELECT model, count(*) AS runs, CAST(sum(hot_bytes) AS BIGINT) AS hot_bytes, CAST(sum(cold_bytes) AS BIGINT) AS cold_bytes FROM z GROUP BY 1) SELECT *, {_BAND.format(x='(hot_bytes + cold_bytes) * 1.15')} AS band FROM g")
def size_by_model(spark, sf_dir):
    return report.by_model(t.sized_orders(spark, sf_dir))


@query(f"WITH {_SIZED} SELECT run_id, model, hot_bytes, cold_bytes, {_BAND.format(x='(hot_bytes + cold_bytes) * 1.15')} AS band FROM z")
def size_by_run(spark, sf_dir):
    return report.by_run(t.sized_orders(spark, sf_dir)).drop("size")


@query(f"WITH {_SIZED}, g AS (SELECT model, count(*) AS runs, round(sum(hot_bytes + cold_bytes) / 1e9, 9) AS gb FROM z GROUP BY ROLLUP (model)) SELECT model, runs, gb, lower({_BAND.format(x='gb * 1e9')}) AS level FROM g")
def retention_state(spark, sf_dir):
    return report.retention_state(t.sized_orders(spark, sf_dir)).select("model", "runs", F.round("gb", 9).alias("gb"), "level")


@query("""WITH r AS (SELECT doc_id, CASE WHEN l.toxic = 1 THEN 0 WHEN d.lang = 'en' THEN 1 END AS rule FROM documents d LEFT JOIN labels l USING (doc_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY doc_id DESC) AS k FROM r)
SELECT doc_id AS run_id, CASE WHEN rule = 0 THEN 'keep' WHEN rule = 1 AND k <= 100 THEN 'keep' WHEN rule = 1 THEN 'over_limit' ELSE 'unmatched' END AS keep FROM k""")
def retention_plan(spark, sf_dir):
    return report.retention_plan(t.runs_documents(spark, sf_dir), [{"match": {"flag": "bad_output"}, "keep": "forever"}, {"match": {"tag": "lang=en"}, "keep_runs": 100}])


@query(f"""WITH w AS (SELECT range AS i FROM range(0, 6)), x AS (SELECT CAST(10 ** i AS BIGINT) AS watched, p AS dtype, CAST(10 ** i AS DOUBLE) * 500 * 10000 * b * CAST(1.15 AS DOUBLE) AS bytes FROM w CROSS JOIN (VALUES ('fp32', 4), ('fp16', 2), ('bf16', 2)) v(p, b))
SELECT watched, dtype, round(bytes, 3) AS bytes, {_BAND.format(x='bytes')} AS band FROM x""")
def estimate_banding(spark, sf_dir):
    grid = spark.range(6).select(F.pow(F.lit(10.0), F.col("id")).cast("long").alias("watched"), F.explode(F.array(*map(F.lit, formats.BYTES))).alias("dtype"))
    size = estimate_column(F.col("watched"), F.lit(500), F.lit(10_000), F.col("dtype"))
    return grid.withColumn("bytes", size).select("watched", "dtype", F.round("bytes", 3).alias("bytes"), band_column(F.col("bytes")).alias("band"))


@query("""WITH a AS (SELECT 'A-' || lpad(CAST(l AS VARCHAR), 2, '0') || '-' || lpad(CAST(h AS VARCHAR), 2, '0') AS address FROM range(1, 33) x(l), range(1, 33) y(h)),
 n AS (SELECT 'N-' || CAST(l AS VARCHAR) || '-' || printf('%04d', k) AS address FROM range(12, 21) x(l), range(1, 14337) y(k)),
 f AS (SELECT 'A-' || l || '-' || lpad(CAST(h AS VARCHAR), 2, '0') AS address FROM range(29, 33) x(l), range(1, 33) y(h)
  UNION ALL SELECT 'N-' || l || '-' || printf('%04d', k) FROM range(29, 33) x(l), range(1, 14337) y(k) UNION ALL SELECT 'LOGITS'),
 g AS (SELECT 'L-' || lpad(CAST(l AS VARCHAR), 2, '0') AS address FROM range(1, 33) x(l) UNION ALL VALUES ('NORM'), ('LOGITS')),
 i AS (SELECT 'A-' || l || '-' || lpad(CAST(h AS VARCHAR), 2, '0') AS address FROM range(17, 25) x(l), (VALUES (4), (7), (12)) y(h)
  UNION ALL SELECT 'N-' || l || '-' || printf('%04d', k) FROM range(20, 25) x(l), range(1, 201) y(k))
SELECT 'attention_only' AS preset, address FROM a UNION ALL SELECT 'mid-mlp-wide', address FROM n UNION ALL SELECT 'last-4-layers-full', address FROM f
UNION ALL SELECT 'logit-lens', address FROM g UNION ALL SELECT 'ioi-circuit-starter', address FROM i""")
def preset_expand(spark, sf_dir):
    out = None
    for name in ("attention_only", "mid-mlp-wide", "last-4-layers-full", "logit-lens", "ioi-circuit-starter", "outer_only"):
        part = addresses.preset(spark, name).select(F.lit(name).alias("preset"), "address")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT parent, count(*) AS n FROM (SELECT 'layer-' || lpad(CAST(l AS VARCHAR), 2, '0') || '.attn' AS parent FROM range(17, 25) x(l), range(3) UNION ALL
 SELECT 'layer-' || l || '.mlp' FROM range(20, 25) x(l), range(200) UNION ALL VALUES ('logits'), ('norm') UNION ALL SELECT 'layer-' || lpad(CAST(l AS VARCHAR), 2, '0') FROM range(1, 33) x(l)) GROUP BY 1""")
def parent_groups(spark, sf_dir):
    every = addresses.catalogue(spark, [{"preset": "ioi-circuit-starter"}, {"preset": "logit-lens"}])
    return every.groupBy(addresses.parent(F.col("address")).alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'M-' || CAST(i % 3 AS VARCHAR) AS model_id, 'N-' || lpad(CAST(i // 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(i % 100 AS VARCHAR), 4, '0') AS address
FROM range(0, 1000) r(i) WHERE NOT (i // 100 BETWEEN 1 AND 4 * (i % 3 + 1) AND i % 100 BETWEEN 1 AND 30 * (i % 3 + 1))""")
def address_validate_antijoin(spark, sf_dir):
    models = spark.createDataFrame([(f"M-{k}", 4 * (k + 1), 8, 30 * (k + 1)) for k in range(3)], "model_id string, layers int, heads int, mlp int")
    i = F.col("id")
    asked = spark.range(1000).select(F.concat(F.lit("M-"), (i % 3).cast("string")).alias("model_id"), F.format_string("N-%02d-%04d", F.floor(i / 100), i % 100).alias("address"))
    return addresses.outside(asked, models)


# Functions -----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM conversations")
def byte_tokenize(spark, sf_dir):
    """Byte ids, checked by length and by the text that they spell."""
    ids = formats.byte_tokens(F.col("text"))
    back = F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return t.table(spark, sf_dir, "conversations").withColumn("ids", ids).select("conv_id", "turn", F.size("ids").cast("long").alias("n_bytes"), F.md5(back).alias("md5"))


@query()
def fp16_roundtrip(spark, sf_dir):
    """Embeddings as half-float matrices and back, decoded by columns and by arrays."""
    from tapelark.sources.deepbin import matrices, read_series

    series = t.series_embeddings(spark, sf_dir)
    watched = series.groupBy("run_id").agg(F.sort_array(F.collect_list("address")).alias("watched"))
    packed = matrices(series.withColumn("run_id", F.col("run_id").cast("string")), watched.withColumn("run_id", F.col("run_id").cast("string")))
    named = packed.join(watched.select(F.col("run_id").cast("string").alias("run_id"), "watched"), "run_id").withColumn("dtype", F.lit("fp16")).withColumn("source", F.lit(""))
    arrays = read_series(named, formats.decode_matrix, None, None)
    first = named.select("run_id", F.element_at("watched", 1).alias("address"), formats.half(formats.word16(F.col("content"), F.lit(0))).alias("first"))
    return arrays.join(first, ["run_id", "address"], "left").select("run_id", "address", F.size("series").alias("n"), F.get("series", F.lit(0)).alias("value"), "first")


@query("SELECT doc_id AS run_id, regexp_replace(text, '[0-9]', '#', 'g') AS text, 'custom' AS redactor FROM documents")
def redactor_udf(spark, sf_dir):
    """Prompts without digits."""
    import re

    runs = t.runs_documents(spark, sf_dir).withColumn("versions", F.create_map(F.lit("redactor"), F.lit("none")))
    out = recorder.redact(runs, lambda text: re.sub("[0-9]", "#", text))
    return out.select("run_id", F.col("prompt.text").alias("text"), F.col("versions")["redactor"].alias("redactor"))


# Formats and SQL functions ---------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31744 // 1024 = 0 THEN o_orderkey % 31744 % 1024 * pow(2.0::DOUBLE, -24)
 ELSE pow(2.0::DOUBLE, o_orderkey % 31744 // 1024 - 15) * (1 + (o_orderkey % 31744 % 1024) / 1024.0::DOUBLE) END AS fp16,
 CASE WHEN o_orderkey % 32640 // 128 = 0 THEN o_orderkey % 32640 % 128 * pow(2.0::DOUBLE, -133) ELSE pow(2.0::DOUBLE, o_orderkey % 32640 // 128 - 127) * (1 + (o_orderkey % 32640 % 128) / 128.0::DOUBLE) END AS bf16 FROM orders""")
def half_decode(spark, sf_dir):
    """Sixteen bits as halves and as brain floats, all finite positive ones."""
    bits = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 31744).cast("int").alias("h"), (F.col("o_orderkey") % 32640).cast("int").alias("b"))
    return bits.select("id", formats.half(F.col("h")).cast("double").alias("fp16"), formats.bfloat(F.col("b")).cast("double").alias("bf16"))


@query(f"""WITH {CELLS} SELECT CAST(run_id AS BIGINT) AS run_id, address, round(avg(CASE WHEN v > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate, round(avg(v), 6) AS mean FROM c WHERE token_pos BETWEEN 2 AND 11 GROUP BY 1, 2""")
def sql_functions(spark, sf_dir):
    """The registered SQL functions, in SQL."""
    sql.register(spark)
    cut = _stored(spark, sf_dir).selectExpr("CAST(run_id AS BIGINT) AS run_id", "address", "tokens_of(CAST(series AS ARRAY<DOUBLE>), 2, 11) AS s")
    return cut.filter("size(s) > 0").selectExpr("run_id", "address", "round(firing_rate(s, 0.1D), 6) AS rate", "round(series_mean(s), 6) AS mean")


@query("SELECT 'N-24-' || lpad(CAST(k AS VARCHAR), 4, '0') AS address FROM range(7, 121) x(k) UNION ALL SELECT 'A-01-02' UNION ALL SELECT 'LOGITS' UNION ALL SELECT 'L-' || lpad(CAST(k AS VARCHAR), 2, '0') FROM range(1, 33) x(k)")
def sql_expand_address(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT explode(l) AS address FROM (SELECT expand_address(span) AS l FROM VALUES ('N-24-0007..0120'), ('A-01-02'), ('LOGITS'), ('L-01..32') AS s(span))")


# Streams -------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: its folder is watched, its file is what has arrived."""
    kind = t.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "run_id")


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared.folder(spark)}/stream-{uuid.uuid4().hex[:12]}"


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_rollup(spark, sf_dir):
    """Complete mode: what a stream holds once its source is drained."""
    out = capture.drained(capture.daily(_stream(spark, sf_dir)), "complete", _checkpoint(spark))
    return out.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER q < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW q AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT run_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY run_id, k""")
def stream_session_runs(spark, sf_dir):
    out = capture.drained(capture.sessions(_stream(spark, sf_dir), gap="6 hours"), "complete", _checkpoint(spark))
    return out.select("run_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@query(f"WITH {EVENTS} SELECT run_id, count(*) AS n, round(sum(value), 6) AS total FROM e WHERE address = 'error' GROUP BY 1")
def stream_log_gated(spark, sf_dir):
    """A gated stream, appended to a log by micro-batches, read back."""
    where = _checkpoint(spark)
    rows = _stream(spark, sf_dir).select("run_id", F.lit(0).alias("token_pos"), F.create_map(F.lit("bad_output"), F.col("event_type") == "error").alias("flags"), "value")
    capture.to_log(capture.gated(rows, TokenWindow(0, 1, 1), Trigger("on_flag", flag="bad_output")), f"{where}/log", f"{where}/state").awaitTermination()
    return capture.log_rows(spark, f"{where}/log").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_pooled_events(spark, sf_dir)
