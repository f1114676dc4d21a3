"""SQL names for the scalar functions: plain SQL functions, and for edit distances the batch kernels.

Spark's ``levenshtein`` takes some fifteen times as long as the kernels on utterances.
"""

from pyspark.sql import SparkSession

from ..operators.distance import batch_char_error_rate, batch_word_error_rate

# Each body is SQL that Spark inlines into the query plan.
_FUNCTIONS = {
    "norm_text": (
        "t STRING",
        "STRING",
        """trim(regexp_replace(lower(t), r"[^\\p{L}\\p{N}_'\\-]+", ' '))""",
    ),
    "norm_entropy": (
        "p ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN size(p) > 1 THEN -aggregate(filter(p, x -> x > 0), 0D,"
        " (a, x) -> a + x * ln(x)) / ln(size(p)) ELSE 0D END",
    ),
    "margin": (
        "p ARRAY<DOUBLE>",
        "DOUBLE",
        "get(transform(array(sort_array(p, false)), s -> get(s, 0) - coalesce(get(s, 1), 0D)), 0)",
    ),
    "zscore": (
        "f ARRAY<FLOAT>, m ARRAY<DOUBLE>, s ARRAY<DOUBLE>",
        "ARRAY<FLOAT>",
        "CASE WHEN size(f) = size(m) AND size(f) = size(s) THEN"
        " zip_with(f, zip_with(m, s, (a, b) -> named_struct('m', a, 's',"
        " CASE WHEN abs(b) < 1e-8D THEN 1D ELSE b END)),"
        " (x, q) -> CAST((CAST(x AS DOUBLE) - q.m) / q.s AS FLOAT))"
        " WHEN f IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL"
        " THEN CAST(raise_error('statistics of another width') AS ARRAY<FLOAT>) END",
    ),
    "resample": (
        "f ARRAY<ARRAY<FLOAT>>, n INT",
        "ARRAY<ARRAY<FLOAT>>",
        "CASE WHEN size(f) > 0 THEN transform(sequence(0, n - 1), k -> zip_with("
        "get(f, CAST(k * (size(f) - 1) DIV (n - 1) AS INT)),"
        "get(f, CAST(least(k * (size(f) - 1) DIV (n - 1) + 1, size(f) - 1) AS INT)),"
        "(a, b) -> CAST(CAST(a AS DOUBLE) + (CAST(b AS DOUBLE) - CAST(a AS DOUBLE))"
        " * ((k * (size(f) - 1)) % (n - 1)) / CAST(n - 1 AS DOUBLE) AS FLOAT))) END",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions in this session; returns their names."""
    for name, (arguments, returns, body) in _FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}"
        )
    kernels = {"cer": batch_char_error_rate, "wer": batch_word_error_rate}
    for name, kernel in kernels.items():
        spark.udf.register(name, kernel)
    return [*_FUNCTIONS, *kernels]
