"""The library's functions for SQL text: temporary functions of a session, from SQL expressions only."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FINITE = "filter(series, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
#: Name with parameters, what it returns, and its body.
FUNCTIONS = (
    ("firing_rate(series ARRAY<DOUBLE>, above DOUBLE)", "DOUBLE", f"aggregate({_FINITE}, named_struct('n', 0D, 'k', 0D), (a, x) -> named_struct('n', a.n + 1, 'k', a.k + if(x > above, 1, 0)), a -> if(a.n = 0, 0D, a.k / a.n))"),
    ("series_mean(series ARRAY<DOUBLE>)", "DOUBLE", f"aggregate({_FINITE}, named_struct('n', 0D, 's', 0D), (a, x) -> named_struct('n', a.n + 1, 's', a.s + x), a -> a.s / nullif(a.n, 0))"),
    ("tokens_of(series ARRAY<DOUBLE>, low INT, high INT)", "ARRAY<DOUBLE>", "slice(series, greatest(low, 0) + 1, greatest(high - greatest(low, 0) + 1, 0))"),
    (
        "expand_address(span STRING)", "ARRAY<STRING>",
        "if(span RLIKE '^.+-[0-9]+([.][.][0-9]+)?$', transform(sequence(CAST(regexp_extract(span, '-([0-9]+)([.][.][0-9]+)?$', 1) AS INT), CAST(regexp_extract(span, '([0-9]+)$', 1) AS INT)),"
        " k -> concat(regexp_extract(span, '^(.+-)[0-9]+([.][.][0-9]+)?$', 1), lpad(CAST(k AS STRING), length(regexp_extract(span, '-([0-9]+)([.][.][0-9]+)?$', 1)), '0'))), array(span))",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    return [name.partition("(")[0] for name, _, _ in FUNCTIONS]
