"""Speech evaluation: error rates, summaries, error decomposition."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import realtime_factor, safe_rate
from ..functions.text import normalise_text
from .distance import batch_char_error_rate, error_rates
from .tables import grid, listed, pivot_models, top_per_group

_ERRORS = {
    "substitutions": "substitutions_count",
    "deletions": "deletions_count",
    "insertions": "insertions_count",
}


def _mean(column, digits=6):
    return F.round(F.avg(column), digits)


def normalise_utterances(df: DataFrame) -> DataFrame:
    """Adds normalised ``reference`` and ``hypothesis`` from the raw texts."""
    return df.withColumn("reference", normalise_text(F.col("reference_raw"))).withColumn(
        "hypothesis", normalise_text(F.col("hypothesis_raw"))
    )


def score_utterances(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Adds ``wer`` and ``cer`` of normalised texts; null on an empty reference."""
    rates = df.withColumn("_rates", error_rates(F.col("reference"), F.col("hypothesis")))
    for name in ("wer", "cer"):
        rate = F.col("_rates")[name]
        rates = rates.withColumn(name, rate if digits is None else F.round(rate, digits))
    return rates.drop("_rates")


def score_aligned(aligned: DataFrame) -> DataFrame:
    """Adds ``wer`` and ``cer`` to aligned utterances.

    The word rate is read off the alignment, so only characters are compared anew.
    """
    edits = sum((F.col("alignment")[c] for c in _ERRORS.values()), F.lit(0))
    words = F.col("alignment")["reference_word_count"]
    chars = batch_char_error_rate(F.col("reference"), F.col("hypothesis"))
    return aligned.withColumn("wer", F.when(words > 0, edits / words)).withColumn("cer", chars)


def _rtf_of_means():
    return F.round(
        realtime_factor(F.avg("inference_time_ms") / 1000.0, F.avg("duration_seconds")), 6
    )


def asr_by_category(scored: DataFrame, by=("category",)) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count("*").alias("count"),
        _mean("wer").alias("mean_wer"),
        _mean("cer").alias("mean_cer"),
        _mean("inference_time_ms", 3).alias("mean_latency_ms"),
        _mean("duration_seconds", 3).alias("mean_duration_seconds"),
        _rtf_of_means().alias("realtime_factor"),
    )


def asr_global(scored: DataFrame, by=()) -> DataFrame:
    """Means over rows rounded to 6 places; the real-time factor is a ratio of sums."""
    seconds = F.sum("inference_time_ms") / 1000.0
    return scored.groupBy(*by).agg(
        F.count("*").alias("count"),
        _mean(F.round("wer", 6)).alias("mean_wer"),
        _mean(F.round("cer", 6)).alias("mean_cer"),
        F.round(F.sum("duration_seconds"), 3).alias("total_audio_seconds"),
        F.round(seconds, 6).alias("total_inference_seconds"),
        F.round(realtime_factor(seconds, F.sum("duration_seconds")), 6).alias("realtime_factor"),
    )


def asr_by_model(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(
        _mean("wer").alias("mean_wer"),
        _mean("cer").alias("mean_cer"),
        _mean("inference_time_ms", 4).alias("mean_latency_ms"),
        _rtf_of_means().alias("realtime_factor"),
    )


def asr_by_category_model(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category", "model").agg(
        _mean("wer").alias("mean_wer"), _mean("cer").alias("mean_cer")
    )


def _with_gains(wide: DataFrame, base: str, adapted: str) -> DataFrame:
    for rate in ("wer", "cer"):
        gain = F.col(f"{rate}_{base}") - F.col(f"{rate}_{adapted}")
        wide = wide.withColumn(f"{rate}_improvement", F.round(gain, 6))
    return wide


def adaptation_gain(scored: DataFrame, keys: list[str], base: str, adapted: str) -> DataFrame:
    """Rounded base rate minus rounded adapted rate, rounded again, per utterance."""
    rounded = scored.withColumn("wer", F.round("wer", 6)).withColumn("cer", F.round("cer", 6))
    return _with_gains(pivot_models(rounded, keys, ["wer", "cer"], [base, adapted]), base, adapted)


def _transcript(model: str, names: list[str]) -> Column:
    """A model's hypothesis in the array ``models``; unlisted and repeated models fail."""
    own = F.filter("models", lambda m: listed(m["model"], names) == model)
    repeated = F.raise_error(F.lit(f"several transcripts of {model}")).cast("string")
    return F.when(F.size(own) > 1, repeated).otherwise(F.get(own, F.lit(0))["hypothesis"])


def record_gain(records: DataFrame, keys: list[str], base: str, adapted: str) -> DataFrame:
    """``adaptation_gain`` from one row per utterance: both models lie in it, so nothing
    is exchanged.

    ``models`` is an array of structs with ``model`` and ``hypothesis``.  The rates of a
    model without an entry are null, as are those of an empty reference.
    """
    names = [base, adapted]
    rates = [error_rates(F.col("reference"), F.col(f"_{i}")).alias(f"_rates_{i}") for i in range(2)]
    rated = records.select(*keys, "reference", *[_transcript(m, names).alias(f"_{i}") for i, m in enumerate(names)])
    rounded = [
        F.round(F.col(f"_rates_{i}")[rate], 6).alias(f"{rate}_{m}") for i, m in enumerate(names) for rate in ("wer", "cer")
    ]
    return _with_gains(rated.select(*keys, *rates).select(*keys, *rounded), base, adapted)


def rank_improvements(gains: DataFrame, order=("input_pos",)) -> DataFrame:
    """All utterances by word error improvement, largest first (range sort)."""
    return gains.orderBy(F.desc("wer_improvement"), *order)


def _error_sums(condition=None):
    def total(field):
        value = F.col("alignment")[field]
        return F.coalesce(
            F.sum(value if condition is None else F.when(condition, value)), F.lit(0)
        ).cast("long")

    sums = {name: total(field) for name, field in _ERRORS.items()}
    sums["reference_words"] = total("reference_word_count")
    return sums


def _corpus_wer(cell=None):
    def get(name):
        return F.col(name) if cell is None else cell[name]

    errors = get("substitutions") + get("deletions") + get("insertions")
    return F.round(safe_rate(errors, get("reference_words")), 6)


def error_totals(aligned: DataFrame) -> DataFrame:
    """Per model: counts, corpus error rate, mean utterance rates, S/D/I rates."""
    totals = aligned.groupBy("model").agg(
        *[v.alias(k) for k, v in _error_sums().items()],
        _mean("wer").alias("mean_utterance_wer"),
        _mean("cer").alias("mean_utterance_cer"),
    )
    totals = totals.withColumn("corpus_wer", _corpus_wer())
    for name in _ERRORS:
        rate = safe_rate(F.col(name), F.col("reference_words"))
        totals = totals.withColumn(f"{name[:-1]}_rate", F.round(rate, 6))
    return totals


def error_by_category(aligned: DataFrame, models: list[str]) -> DataFrame:
    """Category x model counts and corpus rate; every listed model appears, others fail.

    One aggregation with a column set per model, then unfolded: no second pass
    over the alignments and no join for the empty cells.
    """
    wide = aligned.groupBy("category").agg(
        *[
            F.struct(*[v.alias(k) for k, v in _error_sums(listed(F.col("model"), models) == m).items()]).alias(m)
            for m in models
        ]
    )
    long = grid(wide, ["category"], "model", {m: F.col(f"`{m}`") for m in models})
    return long.withColumn("corpus_wer", _corpus_wer())


def _place(position: list[str], at: str = "at") -> Column:
    """Position columns as one number in the same order.

    A struct cannot be updated in place, so its minimum would sort all rows before and
    after the shuffle; a decimal keeps the aggregate a hash aggregate.  The first column
    may be any long, the others have to stay below 10**9, or the packing overflows and fails.
    """
    first, *rest = [*position, at]
    packed = F.col(first).cast("decimal(20,0)")
    for name in rest:
        fits = F.when(F.col(name).between(0, 10**9 - 1), F.col(name)).otherwise(
            F.raise_error(F.lit(f"position beyond 10**9: {name}")).cast("long")
        )
        packed = (packed * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(38,0)") + fits.cast("decimal(10,0)")
    return packed.cast("decimal(38,0)")


def _most_common(items: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k most frequent keys per model; ties by first occurrence."""
    counted = items.groupBy("model", *keys).agg(
        F.count("*").alias("count"), F.min("seen").alias("seen")
    )
    return top_per_group(counted, ["model"], [F.desc("count"), F.asc("seen")], k).drop("seen")


def top_substitutions(aligned: DataFrame, position: list[str], k: int = 10) -> DataFrame:
    """Most frequent (reference run, hypothesis run); runs may be several words.

    ``position`` are the columns that order utterances.
    """
    runs = aligned.select(
        "model", *position, F.posexplode_outer("alignment.substitutions").alias("at", "s")
    ).filter("at is not null")
    items = runs.select("model", "s.*", _place(position).alias("seen"))
    return _most_common(items, ["reference", "hypothesis"], k)


def _words(aligned: DataFrame, field: str, text: str, position: list[str]) -> DataFrame:
    words = F.flatten(F.transform(f"alignment.{field}", lambda r: F.split(r[text], " ")))
    exploded = aligned.select("model", *position, F.posexplode_outer(words).alias("at", "word"))
    return exploded.filter("word is not null").select("model", "word", _place(position).alias("seen"))


def top_deletions(aligned: DataFrame, position: list[str], k: int = 10) -> DataFrame:
    """Most frequent deleted single words."""
    return _most_common(_words(aligned, "deletions", "reference", position), ["word"], k)


def top_insertions(aligned: DataFrame, position: list[str], k: int = 10) -> DataFrame:
    """Most frequent inserted single words."""
    return _most_common(_words(aligned, "insertions", "hypothesis", position), ["word"], k)


def utterance_errors(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """One flat row per utterance and model, as written to the error CSV."""
    counts = [F.col("alignment")[field].alias(name) for name, field in _ERRORS.items()]
    words = F.col("alignment")["reference_word_count"].alias("reference_words")
    return aligned.select(*keys, "model", *counts, words, "wer", "cer")
