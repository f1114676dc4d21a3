"""Registered queries: sentence-pair evaluation."""

from pyspark.sql import functions as F

from ..functions.columns import round_report as round_columns
from ..operators import charts
from ..operators import pairs as P
from ..operators import tables as R
from . import views
from .oracle import with_ctes
from .registry import query
from .stage import staged

A, B = views.ENCODER_A, views.ENCODER_B

# Means of scores that have six places: compared beyond them, where no value can
# be a tie that the two engines round differently.
DIGITS = {"digits": 9, "ms_digits": 6}


def gaps(spark, sf_dir):
    return P.model_gap(views.scored_pairs(spark, sf_dir), A, B)


@query(
    "melt_models",
    with_ctes(
        """SELECT id, category, input_pos, model, similarity, ms AS inference_time_ms,
          width AS embedding_dimension, 'cpu' AS device FROM long_pairs""",
        "long_pairs",
    ),
)
def melt_models(spark, sf_dir):
    pairs = views.scored_pairs(spark, sf_dir).drop("text_a", "text_b")
    return R.melt_models(pairs)


@query(
    "pivot_models",
    with_ctes(
        """SELECT id, category, sim_a AS similarity_encoder_a, ms_a AS inference_time_ms_encoder_a,
          sim_b AS similarity_encoder_b, ms_b AS inference_time_ms_encoder_b FROM pairs""",
        "pairs",
    ),
)
def pivot_models(spark, sf_dir):
    long = R.melt_models(views.scored_pairs(spark, sf_dir))
    values = ["similarity", "inference_time_ms"]
    return R.pivot_models(long, ["id", "category"], values, views.ENCODERS)


@query(
    "model_gap",
    with_ctes(
        """SELECT id, sim_a AS similarity_a, sim_b AS similarity_b, ms_a AS latency_a, ms_b AS latency_b,
          round(sim_a - sim_b, 9) AS gap, round(abs(sim_a - sim_b), 9) AS abs_gap FROM pairs""",
        "pairs",
    ),
)
def model_gap(spark, sf_dir):
    columns = ["similarity_a", "similarity_b", "latency_a", "latency_b"]
    rounded = [F.round(c, 9).alias(c) for c in ("gap", "abs_gap")]
    return gaps(spark, sf_dir).select("id", *columns, *rounded)


@query(
    "rep_shift",
    with_ctes("SELECT id, model, similarity, shift FROM long_pairs", "long_pairs"),
)
def rep_shift(spark, sf_dir):
    long = R.melt_models(views.scored_pairs(spark, sf_dir))
    return long.select("id", "model", "similarity", P.rep_shift(F.col("similarity")).alias("shift"))


_RELATION = """CASE WHEN category IN ('paraphrase', 'informal', 'code_switching') THEN 'similar'
  WHEN category = 'topical_similarity' THEN 'related' WHEN category = 'contrast' THEN 'contrast'
  WHEN category = 'unrelated' THEN 'unrelated' END"""
_EFFECT = """CASE WHEN semantic_effect IN ('meaning_change', 'temporal_change', 'participant_change') THEN 'meaning_changing'
  WHEN semantic_effect IN ('meaning_preserving', 'approximately_meaning_preserving') THEN 'meaning_preserving' END"""


@query(
    "relation_group",
    with_ctes(f"SELECT id, category, {_RELATION} AS relation FROM pairs", "pairs"),
)
def relation_group(spark, sf_dir):
    pairs = views.scored_pairs(spark, sf_dir)
    return pairs.select("id", "category", P.relation_group(F.col("category")).alias("relation"))


@query(
    "effect_group",
    with_ctes(f"SELECT id, semantic_effect, {_EFFECT} AS effect FROM pairs", "pairs"),
)
def effect_group(spark, sf_dir):
    pairs = views.scored_stress(spark, sf_dir)
    effect = P.effect_group(F.col("semantic_effect"))
    return pairs.select("id", "semantic_effect", effect.alias("effect"))


_BY_CATEGORY = """SELECT category, count(*) AS count, round(avg(sim_a), 9) AS mean_similarity_a,
  round(avg(sim_b), 9) AS mean_similarity_b, round(avg(sim_a - sim_b), 9) AS mean_gap,
  round(avg(abs(sim_a - sim_b)), 9) AS mean_abs_gap, round(avg(ms_a), 6) AS mean_latency_a,
  round(avg(ms_b), 6) AS mean_latency_b FROM pairs GROUP BY category"""


@query("similarity_by_category", with_ctes(_BY_CATEGORY, "pairs"))
def similarity_by_category(spark, sf_dir):
    return P.similarity_by_category(gaps(spark, sf_dir), **DIGITS)


@query(
    "similarity_global",
    with_ctes(
        "SELECT count(*) AS count, "
        + ", ".join(
            f"round(avg({x}), {d}) AS mean_{n}, round(quantile_cont({x}, 0.5), {d}) AS median_{n}"
            for n, x, d in (
                ("similarity_a", "sim_a", 9),
                ("similarity_b", "sim_b", 9),
                ("latency_a", "ms_a", 6),
                ("latency_b", "ms_b", 6),
                ("gap", "sim_a - sim_b", 9),
            )
        )
        + ", round(avg(abs(sim_a - sim_b)), 9) AS mean_abs_gap FROM pairs",
        "pairs",
    ),
)
def similarity_global(spark, sf_dir):
    columns = ["similarity_a", "similarity_b", "latency_a", "latency_b", "gap", "abs_gap"]
    return P.similarity_global(staged(gaps(spark, sf_dir).select(*columns)), **DIGITS)


@query(
    "category_stats",
    with_ctes(
        """SELECT model, category, count(*) AS count, round(avg(similarity), 9) AS mean,
          round(quantile_cont(similarity, 0.5), 9) AS median, min(similarity) AS min, max(similarity) AS max
        FROM long_pairs GROUP BY model, category""",
        "long_pairs",
    ),
)
def category_stats(spark, sf_dir):
    return P.category_stats(staged(views.scored_pairs(spark, sf_dir).select("category", "models")), 9)


_GROUPS = ("similar", "related", "contrast", "unrelated")
_SEPARATION = (
    "SELECT model, "
    + ", ".join(f"count(*) FILTER (WHERE g = '{g}') AS {g}_count" for g in _GROUPS)
    + ", "
    + ", ".join(f"round(avg(similarity) FILTER (WHERE g = '{g}'), 9) AS {g}_mean" for g in _GROUPS)
    + """, round(avg(similarity) FILTER (WHERE g = 'similar') - avg(similarity) FILTER (WHERE g = 'unrelated'), 9) AS semantic_separation,
    round(avg(similarity) FILTER (WHERE g = 'similar') - avg(similarity) FILTER (WHERE g = 'contrast'), 9) AS contrast_separation
    FROM (SELECT *, """
    + _RELATION
    + " AS g FROM long_pairs) GROUP BY model"
)


@query("semantic_separation", with_ctes(_SEPARATION, "long_pairs"))
def semantic_separation(spark, sf_dir):
    return P.semantic_separation(views.scored_pairs(spark, sf_dir), 9)


def _gap_sql(*scores):
    return ", ".join(
        f"round(max({s}) FILTER (WHERE model = 'encoder_a') - max({s}) FILTER (WHERE model = 'encoder_b'), 9) AS {s}_gap"
        for s in scores
    )


@query(
    "separation_gap",
    with_ctes(
        f"SELECT {_gap_sql('semantic_separation', 'contrast_separation')} FROM m",
        "long_pairs",
        m=_SEPARATION,
    ),
)
def separation_gap(spark, sf_dir):
    scores = ["semantic_separation", "contrast_separation"]
    return P.score_gap(semantic_separation(spark, sf_dir), scores, A, B, 9)


@query(
    "combine_categories",
    with_ctes(
        """SELECT model, category, similarity FROM long_pairs
        WHERE category IN ('paraphrase', 'informal', 'code_switching')""",
        "long_pairs",
    ),
)
def combine_categories(spark, sf_dir):
    long = R.melt_models(views.scored_pairs(spark, sf_dir))
    chosen = long.filter(F.col("category").isin(*P.SIMILAR))
    return chosen.select("model", "category", "similarity")


# ---- stress pairs ---------------------------------------------------------------------


@query(
    "phenomenon_shift",
    with_ctes(
        """SELECT phenomenon, model, count(*) AS count, round(avg(shift), 9) AS mean_shift,
          min(shift) AS min_shift, max(shift) AS max_shift FROM long_pairs GROUP BY phenomenon, model""",
        "long_pairs",
    ),
)
def phenomenon_shift(spark, sf_dir):
    return P.phenomenon_shift(views.scored_stress(spark, sf_dir), 9)


_EFFECTS = f"SELECT *, {_EFFECT} AS effect_group FROM long_pairs"
_SENSITIVITY = """SELECT model, count(*) FILTER (WHERE effect_group = 'meaning_changing') AS changing_count,
  count(*) FILTER (WHERE effect_group = 'meaning_preserving') AS preserving_count,
  round(avg(shift) FILTER (WHERE effect_group = 'meaning_changing'), 9) AS changing_mean_shift,
  round(avg(shift) FILTER (WHERE effect_group = 'meaning_preserving'), 9) AS preserving_mean_shift,
  round(avg(shift) FILTER (WHERE effect_group = 'meaning_changing')
    - avg(shift) FILTER (WHERE effect_group = 'meaning_preserving'), 9) AS sensitivity_score
FROM effects GROUP BY model"""


@query("sensitivity_score", with_ctes(_SENSITIVITY, "long_pairs", effects=_EFFECTS))
def sensitivity_score(spark, sf_dir):
    return P.sensitivity_score(views.scored_stress(spark, sf_dir), 9)


@query(
    "sensitivity_gap",
    with_ctes(
        f"SELECT {_gap_sql('sensitivity_score')} FROM m",
        "long_pairs",
        effects=_EFFECTS,
        m=_SENSITIVITY,
    ),
)
def sensitivity_gap(spark, sf_dir):
    return P.score_gap(sensitivity_score(spark, sf_dir), ["sensitivity_score"], A, B, 9)


def _failures_sql(group, direction):
    return f"""SELECT model, id, phenomenon, semantic_effect, shift, rank FROM (SELECT *, row_number() OVER (
      PARTITION BY model ORDER BY shift {direction}, input_pos) AS rank FROM effects WHERE effect_group = '{group}')
      WHERE rank <= 5"""


def _failures(df):
    return df.select(
        "model",
        "id",
        "phenomenon",
        "semantic_effect",
        F.col("representational_shift").alias("shift"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "sensitivity_failures",
    with_ctes(_failures_sql("meaning_changing", "ASC"), "long_pairs", effects=_EFFECTS),
)
def sensitivity_failures(spark, sf_dir):
    return _failures(P.sensitivity_failures(views.scored_stress(spark, sf_dir)))


@query(
    "invariance_failures",
    with_ctes(_failures_sql("meaning_preserving", "DESC"), "long_pairs", effects=_EFFECTS),
)
def invariance_failures(spark, sf_dir):
    return _failures(P.invariance_failures(views.scored_stress(spark, sf_dir)))


# ---- rankings and chart feeds -----------------------------------------------------------


@query(
    "top_disagreements",
    with_ctes(
        """SELECT id, category, round(sim_a - sim_b, 9) AS gap, round(abs(sim_a - sim_b), 9) AS abs_gap FROM pairs
        ORDER BY abs(sim_a - sim_b) DESC, input_pos LIMIT 10""",
        "pairs",
    ),
)
def top_disagreements(spark, sf_dir):
    rounded = [F.round(c, 9).alias(c) for c in ("gap", "abs_gap")]
    return P.top_disagreements(gaps(spark, sf_dir)).select("id", "category", *rounded)


@query(
    "fastest_model",
    with_ctes(
        """SELECT id, CASE WHEN ms_a <= ms_b THEN 'encoder_a' ELSE 'encoder_b' END AS fastest_model,
          CASE WHEN sim_a >= sim_b THEN 'encoder_a' ELSE 'encoder_b' END AS highest_similarity_model FROM pairs""",
        "pairs",
    ),
)
def fastest_model(spark, sf_dir):
    best = P.fastest_model(views.scored_pairs(spark, sf_dir), views.ENCODERS)
    return best.select("id", "fastest_model", "highest_similarity_model")


@query(
    "feed_shift_difference",
    with_ctes(
        """SELECT id, phenomenon, round(round(1 - sim_a, 6) - round(1 - sim_b, 6), 6) AS difference FROM pairs
        ORDER BY abs(difference), input_pos""",
        "pairs",
    ),
)
def feed_shift_difference(spark, sf_dir):
    records = views.scored_stress(spark, sf_dir)
    feed = charts.feed_shift_difference(records, A, B, ["input_pos"])
    return feed.select("id", "phenomenon", "difference")


@query(
    "feed_similarity_space",
    with_ctes(
        """SELECT id, category, sim_b AS similarity_b, sim_a AS similarity_a, round(lo - pad, 6) AS axis_low,
          round(hi + pad, 6) AS axis_high FROM pairs, (SELECT *, greatest(0.02, (hi - lo) * 0.08) AS pad FROM (
            SELECT least(min(sim_a), min(sim_b)) AS lo, greatest(max(sim_a), max(sim_b)) AS hi FROM pairs))""",
        "pairs",
    ),
)
def feed_similarity_space(spark, sf_dir):
    columns = ["id", "category", "similarity_b", "similarity_a"]
    pairs = gaps(spark, sf_dir).select(*columns)
    return charts.feed_similarity_space(pairs)


@query(
    "feed_category_disagreement",
    with_ctes(
        "SELECT category, mean_abs_gap FROM m ORDER BY mean_abs_gap, category", "pairs", m=_BY_CATEGORY
    ),
)
def feed_category_disagreement(spark, sf_dir):
    return charts.feed_category_disagreement(similarity_by_category(spark, sf_dir))


@query(
    "round_report",
    with_ctes(
        """SELECT id, round(sim_a / 3, 6) AS third, round(ms_a / 7, 6) AS seventh, round(sim_b / 9, 6) AS ninth FROM pairs""",
        "pairs",
    ),
)
def round_report(spark, sf_dir):
    """Nested doubles are rounded wherever they sit; shown here flattened."""
    a, b = F.col("similarity_a"), F.col("similarity_b")
    nested = gaps(spark, sf_dir).select(
        "id",
        F.struct((a / 3).alias("third"), F.struct((F.col("latency_a") / 7).alias("s")).alias("in")).alias("r"),
        F.create_map(F.lit("m"), b / 9).alias("m"),
    )
    return round_columns(nested).select(
        "id",
        F.col("r.third").alias("third"),
        F.col("r.in.s").alias("seventh"),
        F.col("m")["m"].alias("ninth"),
    )
