"""The functions as SQL functions of a session: expressions that Catalyst inlines, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


_MS = "CAST(floor(greatest(seconds, 0.0D) * 1000 + 0.5D) AS BIGINT)"
_S = "CAST(floor(greatest(seconds, 0.0D) + 0.5D) AS BIGINT)"
FUNCTIONS = {
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN size(a) > 0 AND size(a) = size(b) AND {_dot('a', 'a')} > 1e-12D AND {_dot('b', 'b')} > 1e-12D THEN {_dot('a', 'b')} / (sqrt({_dot('a', 'a')}) * sqrt({_dot('b', 'b')})) ELSE 0.0D END",
    "l2_normalise(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": f"CASE WHEN {_dot('v', 'v')} > 1e-24D THEN transform(v, x -> x / sqrt({_dot('v', 'v')})) ELSE v END",
    "overlap_seconds(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE) RETURNS DOUBLE": "greatest(0.0D, least(a1, b1) - greatest(a0, b0))",
    "display_name(name STRING, id BIGINT) RETURNS STRING": "CASE WHEN coalesce(name, '') <> '' THEN name ELSE format_string('SPEAKER_%04d', id) END",
    "fmt_timestamp(seconds DOUBLE, mark STRING) RETURNS STRING": f"format_string('%02d:%02d:%02d%s%03d', {_MS} div 3600000, {_MS} div 60000 % 60, {_MS} div 1000 % 60, mark, {_MS} % 1000)",
    "fmt_duration(seconds DOUBLE) RETURNS STRING": f"CASE WHEN {_S} >= 3600 THEN format_string('%dh %02dm', {_S} div 3600, {_S} div 60 % 60) WHEN {_S} >= 60 THEN format_string('%dm %02ds', {_S} div 60, {_S} % 60) ELSE format_string('%ds', {_S}) END",
    "split_windows(n BIGINT, width BIGINT, hop BIGINT) RETURNS TABLE (start BIGINT)": "SELECT explode(CASE WHEN n <= width THEN array(0L) ELSE sequence(0L, greatest(n - width, 0L), hop) END)",
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session and returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
