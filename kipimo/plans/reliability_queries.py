"""Registered queries: scoring of clips and reliability of the scores."""

from pyspark.sql import functions as F

from ..functions import clips as C
from ..functions import vectors as V
from ..functions.conditions import PROBES
from ..operators import clipsets as L
from ..operators import reliability as Q
from ..operators.prepare import prepare_source
from . import views
from .clip_queries import ABLATION_SQL, PROBE_SQL, _picked, frame_sums
from .oracle import resampled, with_ctes
from .registry import query
from .stage import staged

LAYOUT = views.LAYOUT
KEYS = ["split", "label", "file"]

# ---- oracle text ---------------------------------------------------------------------


def _stack(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS condition, * FROM ({sql})" for n, sql in parts.items())


# Resampled hand features (condition, clip_id, k, d, v) to metrics per prediction.
_SCORING = {
    "zs": """SELECT condition, clip_id, k, d,
        ((v - mean) / CASE WHEN abs(std) < 1e-8 THEN 1.0 ELSE std END)::FLOAT::DOUBLE AS v
      FROM ready JOIN stats USING (d) WHERE d IN (0, 5, 10, 15, 21, 26, 31, 36)""",
    "logits": """SELECT condition, clip_id, (d % 21) // 5 AS d, 8 * sum((k + 1) * v) / 2080 AS z FROM zs
      GROUP BY condition, clip_id, (d % 21) // 5""",
    "exps": """SELECT condition, clip_id, d, exp(z - max(z) OVER (PARTITION BY condition, clip_id)) AS e FROM logits""",
    "probs": """SELECT condition, clip_id, d, (e / sum(e) OVER (PARTITION BY condition, clip_id))::FLOAT::DOUBLE AS p FROM exps""",
    "lists": """SELECT condition, clip_id, 'c' || clip_id % 4 AS label,
        'clip_' || lpad(clip_id::VARCHAR, 12, '0') || '.npy' AS file, list(p ORDER BY d) AS p FROM probs GROUP BY condition, clip_id""",
    "scored": """SELECT *, 'c' || (list_position(p, list_max(p)) - 1) AS predicted, list_max(p) AS max_probability,
        list_reverse_sort(p)[1] - list_reverse_sort(p)[2] AS margin,
        -list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: x * ln(x))) / ln(4) AS normalized_entropy,
        p[clip_id % 4 + 1] AS true_probability, 'c' || (list_position(p, list_max(p)) - 1) = label AS correct FROM lists""",
}

_PROBED = {"clean_id": "SELECT clip_id, i AS k, d, v FROM source"} | {
    name: PROBE_SQL[short]
    for name, short in (
        ("temporal_reverse", "reverse"),
        ("temporal_shuffle", "shuffle"),
        ("static_freeze", "freeze"),
        ("coordinate_noise", "noise"),
    )
}
_PROBE_CTES = {
    "probed": _stack({n: f"SELECT clip_id, k AS i, d, v FROM ({sql})" for n, sql in _PROBED.items()}),
    "ready": """SELECT p.condition, s.clip_id, s.k, p.d, (p.v + (q.v - p.v) * s.w)::FLOAT::DOUBLE AS v
      FROM steps s JOIN probed p ON p.clip_id = s.clip_id AND p.i = s.lo AND p.d <= 36
      JOIN probed q ON q.condition = p.condition AND q.clip_id = s.clip_id AND q.i = s.hi AND q.d = p.d""",
} | _SCORING

_ABLATED = {
    "clean": "clean",
    "block_1_removed": "block1",
    "block_2_removed": "block2",
    "block_1_only": "block2",
    "block_2_only": "block1",
    "temporal_mean_freeze": "mean_freeze",
    "first_half_only": "first_half",
    "second_half_only": "second_half",
}
_ABLATION_CTES = {
    "short": resampled("source"),
    "ready": _stack({n: ABLATION_SQL[short] for n, short in _ABLATED.items()}),
} | _SCORING
_COMPARED = {
    "compared": """SELECT a.*, c.predicted AS clean_predicted, c.true_probability AS clean_true_probability,
        a.predicted = c.predicted AS prediction_retained, c.true_probability - a.true_probability AS true_probability_drop
      FROM scored a JOIN scored c ON c.clip_id = a.clip_id AND c.condition = 'clean'"""
}

_METHOD_CTES = {
    "ready": _stack(
        {
            "linear_interpolation": resampled("source"),
            "nearest_resample": _picked("round_even(s.k * (s.t - 1) / 63.0::DOUBLE, 0)"),
            "floor_resample": _picked("floor(s.k * (s.t - 1) / 63.0::DOUBLE)"),
            "repeat_last_padding": _picked("least(s.k, s.t - 1)"),
            "zero_padding": """SELECT s.clip_id, s.k, x.d, coalesce(p.v, 0.0) AS v FROM steps s CROSS JOIN
              (SELECT unnest(range(0, 42)) AS d) x LEFT JOIN source p ON p.clip_id = s.clip_id AND p.i = s.k AND p.d = x.d""",
        }
    )
} | _SCORING

_BASE = ("steps", "stats", "source", "lengths")


def _probes(final, **extra):
    return with_ctes(final, *_BASE, **_PROBE_CTES, **extra)


def _ablations(final, **extra):
    return with_ctes(final, *_BASE, **_ABLATION_CTES, **_COMPARED, **extra)


def _methods(final, **extra):
    return with_ctes(final, *_BASE, **_METHOD_CTES, **extra)


# ---- scored tables -----------------------------------------------------------------------


def clips_and_stats(spark, sf_dir):
    clips = views.source_clips(spark, sf_dir).select("clip_id", "label", "file", "split", "frames")
    return clips, views.feature_stats(spark, sf_dir)


def clean_scores(spark, sf_dir):
    clips, stats = clips_and_stats(spark, sf_dir)
    prepared = prepare_source(F.col("frames"), F.col("mean"), F.col("std"), LAYOUT)
    ready = L.join_feature_stats(clips, stats).withColumn("prepared", prepared)
    return views.scored(ready.drop("frames", "mean", "std"))


def probe_scores(spark, sf_dir):
    clips, stats = clips_and_stats(spark, sf_dir)
    return views.scored(Q.probe_clips(clips, stats, "clip_id", LAYOUT))


def ablation_scores(spark, sf_dir):
    clips, stats = clips_and_stats(spark, sf_dir)
    return views.scored(Q.ablate_clips(clips, stats, LAYOUT))


def ablation_compared(spark, sf_dir):
    """All conditions of a clip from one row, beside the clean one."""
    clips, stats = clips_and_stats(spark, sf_dir)
    return Q.compared_variants(views.scored_variants(Q.ablation_variants(clips, stats, LAYOUT)))


def method_scores(spark, sf_dir):
    """Every clip under every temporal method, scored."""
    clips, stats = clips_and_stats(spark, sf_dir)
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("method"), m(F.col("frames")).alias("frames"))
            for n, m in C.METHODS.items()
        ]
    )
    counted = clips.withColumn("raw_frames", F.size("frames"))
    many = counted.withColumn("_c", F.explode(cells)).drop("frames").select("*", "_c.*").drop("_c")
    prepared = prepare_source(F.col("frames"), F.col("mean"), F.col("std"), LAYOUT)
    ready = L.join_feature_stats(many, stats).withColumn("prepared", prepared)
    return views.scored(ready.drop("frames", "mean", "std"))


def _r(*columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


# ---- scoring and metrics --------------------------------------------------------------------


@query(
    "score_clips",
    _probes("""SELECT clip_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3
      FROM scored WHERE condition = 'clean_id'"""),
)
def score_clips(spark, sf_dir):
    p = [F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(4)]
    return clean_scores(spark, sf_dir).select("clip_id", *p)


@query(
    "rank_classes",
    _probes("""SELECT clip_id, rank, 'c' || c AS label, c AS index, round(p[c + 1], 6) AS probability FROM (
      SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY p[c + 1] DESC, c DESC) AS rank FROM (
        SELECT *, unnest(range(0, 4)) AS c FROM scored WHERE condition = 'clean_id'))"""),
)
def rank_classes(spark, sf_dir):
    ranked = clean_scores(spark, sf_dir).select(
        "clip_id", F.posexplode_outer("predictions").alias("at", "s")
    )
    return ranked.select(
        "clip_id",
        (F.col("at") + 1).cast("long").alias("rank"),
        F.col("s.label").alias("label"),
        F.col("s.index").cast("long").alias("index"),
        F.round("s.probability", 6).alias("probability"),
    )


def _metric(name, column, expression):
    @query(
        name,
        _probes(
            f"SELECT clip_id, condition, round({column}, 6) AS value FROM scored"
        ),
    )
    def run(spark, sf_dir):
        value = F.round(expression(), 6).alias("value")
        return probe_scores(spark, sf_dir).select("clip_id", "condition", value)

    return run


_metric("max_probability", "max_probability", lambda: V.max_probability(F.col("p")))
_metric("prediction_margin", "margin", lambda: V.prediction_margin(F.col("p")))
_metric("entropy", "normalized_entropy * ln(4)", lambda: V.entropy(F.col("p")))
_metric("normalized_entropy", "normalized_entropy", lambda: V.normalized_entropy(F.col("p")))
_metric(
    "probability_of", "true_probability", lambda: V.probability_of(F.col("predictions"), F.col("label"))
)


# ---- conditions -------------------------------------------------------------------------------


@query(
    "cross_conditions",
    with_ctes(
        """SELECT condition, clip_id, k, round(sum(v), 5) AS total, round(sum(v * (d + 1)), 4) AS weighted
        FROM probed GROUP BY condition, clip_id, k""",
        "source",
        "lengths",
        probed=_stack({n: f"SELECT clip_id, k, d, v FROM ({sql})" for n, sql in _PROBED.items()}),
    ),
)
def cross_conditions(spark, sf_dir):
    clips = views.source_clips(spark, sf_dir).select("clip_id", "frames")
    crossed = Q.cross_conditions(clips, PROBES, lambda c, f: c.apply(f, F.col("clip_id")))
    return frame_sums(crossed, keys=("condition", "clip_id"))


_ROW = """condition, clip_id, predicted, correct, round(max_probability, 6) AS max_probability, round(margin, 6) AS margin,
  round(normalized_entropy, 6) AS normalized_entropy"""
_ROW_COLUMNS = ["condition", "clip_id", "predicted", "correct"]
_ROW_METRICS = ["max_probability", "margin", "normalized_entropy"]


@query("run_probes", _probes(f"SELECT {_ROW} FROM scored"))
def run_probes(spark, sf_dir):
    return probe_scores(spark, sf_dir).select(*_ROW_COLUMNS, *_r(*_ROW_METRICS))


@query(
    "union_conditions",
    _probes(f"SELECT {_ROW} FROM scored WHERE condition IN ('clean_id', 'static_freeze')"),
)
def union_conditions(spark, sf_dir):
    """Separately scored tables stacked; one explode is the cheaper plan (run_probes)."""
    clips, stats = clips_and_stats(spark, sf_dir)
    frozen = {n: PROBES[n] for n in ("static_freeze",)}
    parts = {
        "clean_id": clean_scores(spark, sf_dir),
        "static_freeze": views.scored(
            Q.probe_clips(clips, stats, "clip_id", LAYOUT, frozen)
        ).drop("condition"),
    }
    return Q.union_conditions(parts).select(*_ROW_COLUMNS, *_r(*_ROW_METRICS))


_COMPARISON = """SELECT condition, clip_id, predicted, clean_predicted, correct, prediction_retained,
  round(true_probability, 6) AS true_probability, round(true_probability_drop, 6) AS true_probability_drop FROM compared"""
_COMPARISON_COLUMNS = [
    "condition",
    "clip_id",
    "predicted",
    "clean_predicted",
    "correct",
    "prediction_retained",
]


def _comparison(df):
    return df.select(*_COMPARISON_COLUMNS, *_r("true_probability", "true_probability_drop"))


@query("run_ablations", _ablations(_COMPARISON))
def run_ablations(spark, sf_dir):
    return _comparison(ablation_compared(spark, sf_dir))


@query("join_clean_baseline", _ablations(_COMPARISON))
def join_clean_baseline(spark, sf_dir):
    """The join form, for a clean table that was scored on its own."""
    scores = staged(ablation_scores(spark, sf_dir))
    clean = scores.filter("condition = 'clean'")
    return _comparison(Q.join_clean_baseline(scores, clean, KEYS))


# ---- summaries -----------------------------------------------------------------------------------


@query(
    "uncertainty_summary",
    _probes("""SELECT condition, count(*) AS count, round(avg(max_probability), 6) AS mean_max_probability,
      round(avg(margin), 6) AS mean_margin, round(avg(normalized_entropy), 6) AS mean_normalized_entropy,
      round(quantile_cont(max_probability, 0.5), 6) AS median_max_probability,
      round(quantile_cont(max_probability, 0.05), 6) AS p05_max_probability,
      round(quantile_cont(margin, 0.05), 6) AS p05_margin,
      round(quantile_cont(normalized_entropy, 0.95), 6) AS p95_normalized_entropy FROM scored GROUP BY condition"""),
)
def uncertainty_summary(spark, sf_dir):
    return Q.uncertainty_summary(staged(metrics(spark, sf_dir)))


def metrics(spark, sf_dir):
    """The few columns that summaries need; vectors are not staged."""
    columns = ["condition", "clip_id", "label", "correct", *_ROW_METRICS]
    return probe_scores(spark, sf_dir).select(*columns)


_THRESHOLDS = """SELECT quantile_cont(max_probability, 0.05) AS max_probability_lower, quantile_cont(margin, 0.05) AS margin_lower,
  quantile_cont(normalized_entropy, 0.95) AS entropy_upper FROM scored WHERE condition = 'clean_id'"""
_LIMITS = ["max_probability_lower", "margin_lower", "entropy_upper"]


@query(
    "id_thresholds",
    _probes(
        "SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _LIMITS) + " FROM t", t=_THRESHOLDS
    ),
)
def id_thresholds(spark, sf_dir):
    return Q.id_thresholds(staged(metrics(spark, sf_dir))).select(*_r(*_LIMITS))


_REJECTED = """SELECT *, max_probability < max_probability_lower OR margin < margin_lower
  OR normalized_entropy > entropy_upper AS rejected FROM scored, t"""


@query(
    "join_thresholds",
    _probes("SELECT condition, clip_id, rejected FROM r", t=_THRESHOLDS, r=_REJECTED),
)
def join_thresholds(spark, sf_dir):
    scores = staged(metrics(spark, sf_dir))
    joined = Q.join_thresholds(scores, Q.id_thresholds(scores))
    return joined.select("condition", "clip_id", "rejected")


@query(
    "rejection_rate",
    _probes(
        "SELECT condition, round(avg(rejected::INT), 6) AS rejection_rate FROM r GROUP BY condition",
        t=_THRESHOLDS,
        r=_REJECTED,
    ),
)
def rejection_rate(spark, sf_dir):
    scores = staged(metrics(spark, sf_dir))
    return Q.rejection_rate(scores, Q.id_thresholds(scores))


_ACCURACY = """count(*) FILTER (WHERE correct) AS correct, count(*) AS total, round(avg(correct::INT), 6) AS accuracy"""


@query(
    "ablation_summary",
    _ablations(f"""SELECT condition, {_ACCURACY}, round(avg(prediction_retained::INT), 6) AS prediction_retention,
      round(avg(true_probability), 6) AS mean_true_class_probability, round(avg(max_probability), 6) AS mean_max_probability,
      round(avg(true_probability_drop), 6) AS mean_true_probability_drop,
      round(quantile_cont(true_probability_drop, 0.5), 6) AS median_true_probability_drop FROM compared GROUP BY condition"""),
)
def ablation_summary(spark, sf_dir):
    columns = ["condition", "correct", "prediction_retained", "max_probability"]
    probabilities = ["true_probability", "true_probability_drop"]
    compared = ablation_compared(spark, sf_dir).select(*columns, *probabilities)
    return Q.ablation_summary(staged(compared))


_METHOD_SUMMARY = f"""SELECT condition AS method, {_ACCURACY}, round(avg(max_probability), 6) AS mean_max_probability,
  count(*) FILTER (WHERE NOT correct) AS errors FROM scored GROUP BY condition"""


@query("clip_accuracy", _methods(_METHOD_SUMMARY))
def clip_accuracy(spark, sf_dir):
    return Q.clip_accuracy(method_scores(spark, sf_dir))


@query(
    "rank_methods",
    _methods(
        """SELECT method, accuracy, mean_max_probability, rank, rank = 1 AS best FROM (SELECT *, row_number() OVER (
          ORDER BY accuracy DESC, mean_max_probability DESC, method) AS rank FROM m)""",
        m=_METHOD_SUMMARY,
    ),
)
def rank_methods(spark, sf_dir):
    ranked = Q.rank_methods(clip_accuracy(spark, sf_dir))
    rank = F.col("rank").cast("long").alias("rank")
    return ranked.select("method", "accuracy", "mean_max_probability", rank, "best")


@query(
    "error_rows",
    _methods("""SELECT condition AS method, clip_id, label AS expected, predicted, round(max_probability, 6) AS probability
        , file, t AS raw_frames, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3
      FROM scored JOIN lengths USING (clip_id) WHERE NOT correct"""),
)
def error_rows(spark, sf_dir):
    columns = ["method", "clip_id", "label", "file", "raw_frames", "predicted", "max_probability", "p"]
    wrong = Q.error_rows(method_scores(spark, sf_dir), columns)
    return wrong.select(
        "method",
        "clip_id",
        F.col("label").alias("expected"),
        "file",
        F.col("raw_frames").cast("long").alias("raw_frames"),
        "predicted",
        F.round("max_probability", 6).alias("probability"),
        *[F.round(F.get("p", F.lit(k)), 6).alias(f"p{k}") for k in range(4)],
    )


@query(
    "per_class_accuracy",
    _ablations(f"SELECT condition, label, {_ACCURACY} FROM scored GROUP BY condition, label"),
)
def per_class_accuracy(spark, sf_dir):
    return Q.per_class_accuracy(ablation_scores(spark, sf_dir), views.CLIP_LABELS)


def _mean_sql(condition, column):
    return f"avg({column}) FILTER (WHERE condition = '{condition}')"


_KNOWN, _CONTROL = "clean_id", "coordinate_noise"


@query(
    "id_vs_control",
    _probes(
        f"SELECT count(*) FILTER (WHERE condition = '{_KNOWN}') AS id_count, "
        f"round({_mean_sql(_KNOWN, 'correct::INT')}, 6) AS id_accuracy, "
        + ", ".join(
            f"round({_mean_sql(_KNOWN, m)}, 6) AS mean_id_{m}, round({_mean_sql(_CONTROL, m)}, 6) AS control_{m}"
            for m in _ROW_METRICS
        )
        + ", "
        + ", ".join(
            f"round({_mean_sql(a, m)} - {_mean_sql(b, m)}, 6) AS {n}"
            for n, m, a, b in (
                ("confidence_gap", "max_probability", _KNOWN, _CONTROL),
                ("margin_gap", "margin", _KNOWN, _CONTROL),
                ("entropy_gap", "normalized_entropy", _CONTROL, _KNOWN),
            )
        )
        + " FROM scored"
    ),
)
def id_vs_control(spark, sf_dir):
    """Clean clips as the known side, noisy ones as the control."""
    chosen = {n: PROBES[n] for n in (_KNOWN, _CONTROL)}
    clips, stats = clips_and_stats(spark, sf_dir)
    scores = views.scored(Q.probe_clips(clips, stats, "clip_id", LAYOUT, chosen))
    return Q.id_vs_control(scores, F.col("condition") == _CONTROL)
