"""Evaluation inputs derived from the given tables.

The tables hold no transcripts, model scores or landmarks, so each view derives
them by a fixed row-local rule.  Every view covers its whole table: all words of
all documents, all vectors.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.layout import TARGET_LENGTH, Layout
from ..functions.text import normalise_text
from ..functions.vectors import cosine
from ..operators.pairs import rep_shift
from .stage import widened

# Small layout for 64-wide vectors: 21 points, three coordinates each.
LAYOUT = Layout(pose_points=7, hand_points=7, left_shoulder=0, right_shoulder=1)

UTTERANCE_WORDS = 20
BASE, ADAPTED = "base", "adapted"
SPEECH_MODELS = [BASE, ADAPTED]
# Per model: divisors of the reversed, dropped and doubled words; ms per character.
_SPEECH_RULES = {BASE: (7, 11, 13, 2), ADAPTED: (11, 17, 19, 5)}

ENCODER_A, ENCODER_B = "encoder_a", "encoder_b"
ENCODERS = [ENCODER_A, ENCODER_B]
# Names of pair categories, phenomena and effects, in report order.
CATEGORIES = [
    "paraphrase",
    "topical_similarity",
    "unrelated",
    "contrast",
    "informal",
    "code_switching",
]
PHENOMENA = [
    "negation",
    "tense",
    "subject_agreement",
    "argument_structure",
    "quantification",
    "code_switching",
    "informal_language",
]
EFFECTS = [
    "meaning_change",
    "temporal_change",
    "participant_change",
    "meaning_preserving",
    "approximately_meaning_preserving",
]
CLIP_LABELS = ["c0", "c1", "c2", "c3"]
TAGS = ["O", "B-NOUN", "I-NOUN", "B-VERB", "I-VERB"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strings(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents cut into utterances of 20 words: doc_id, seg, category, words."""
    words = F.split(normalise_text(F.col("text")), " ")
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / UTTERANCE_WORDS).cast("int"))
    cut = F.transform(
        starts, lambda s: F.slice("words", s * UTTERANCE_WORDS + 1, F.lit(UTTERANCE_WORDS))
    )
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return (
        widened(documents)
        .select("doc_id", F.col("lang").alias("category"), words.alias("words"))
        .select("doc_id", "category", F.posexplode(cut).alias("seg", "words"))
        .filter(F.get("words", F.lit(0)) != "")
        .withColumn("seg", F.col("seg").cast("long"))
    )


def utterance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per utterance: reference and ``models``, an array of each model's transcript."""
    shift = F.col("doc_id") + F.col("seg")

    def heard(model):
        reverse, drop, double, _ = _SPEECH_RULES[model]

        def word(w, i):
            at = i + shift
            return (
                F.when(at % drop == 5, F.lit(None))  # left out by array_join
                .when(at % reverse == 3, F.reverse(w))
                .when(at % double == 9, F.concat(w, F.lit(" eh")))
                .otherwise(w)
            )

        return F.array_join(F.transform("words", word), " ")

    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                heard(m).alias("hypothesis"),
                F.lit(rule[3]).alias("ms"),
            )
            for m, rule in _SPEECH_RULES.items()
        ]
    )
    reference = F.array_join("words", " ").alias("reference")
    return segments(spark, sf_dir).select("doc_id", "seg", "category", reference, cells.alias("models"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and two models' transcripts per utterance, long form.

    The generator is an outer one: a plain explode adds a filter on the array's size that
    makes every transcript a second time.
    """
    chars = F.char_length("reference")
    return (
        utterance_records(spark, sf_dir)
        .select("doc_id", "seg", "category", "reference", F.explode_outer("models").alias("_m"))
        .select("doc_id", "seg", "category", "reference", "_m.*")
        .withColumn("duration_seconds", chars / 15.0)
        .withColumn("inference_time_ms", (chars * F.col("ms")).cast("double"))
        .drop("ms")
    )


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors side by side: pair_id, a, b.

    Every vector is one side of one pair; parity only tells which side.  A vector
    without a neighbour stays, with a null other side.
    """
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "pair_id", F.floor(F.col("vec_id") / 2)
    )
    even = F.col("vec_id") % 2 == 0
    left = vectors.filter(even).select("pair_id", F.col("embedding").alias("a"))
    right = vectors.filter(~even).select("pair_id", F.col("embedding").alias("b"))
    return left.join(right, "pair_id", "full")


def folded(vector: str):
    """The second encoder's vector: each value added to the one half the width on."""
    return F.zip_with(F.slice(vector, 1, 32), F.slice(vector, 33, 32), lambda x, y: x + y)


def _scores(with_shift: bool):
    """models map of both encoders: 64 dimensions, and 32 that fold all of them."""
    sides = {
        ENCODER_A: (F.col("a"), F.col("b"), F.lit(20.0) + F.col("pair_id") % 7, 64),
        ENCODER_B: (folded("a"), folded("b"), F.lit(15.0) + F.col("pair_id") % 11, 32),
    }
    cells = []
    for name, (a, b, ms, width) in sides.items():
        similarity = cosine(a, b)
        fields = [similarity.alias("similarity")]
        if with_shift:
            fields.append(rep_shift(similarity).alias("representational_shift"))
        fields.append(ms.cast("double").alias("inference_time_ms"))
        if not with_shift:
            fields += [F.lit(width).alias("embedding_dimension"), F.lit("cpu").alias("device")]
        cells += [F.lit(name), F.struct(*fields)]
    return F.create_map(*cells)


def pair_manifest_columns():
    index = (F.col("pair_id") % 6).cast("int")
    return {
        "id": F.concat(F.lit("p"), F.col("pair_id").cast("string")),
        "category": F.get(_strings(CATEGORIES), index),
        "text_a": F.concat(F.lit("v"), (F.col("pair_id") * 2).cast("string")),
        "text_b": F.concat(F.lit("v"), (F.col("pair_id") * 2 + 1).cast("string")),
    }


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record form: one row per pair with a ``models`` map; input_pos = pair_id."""
    columns = pair_manifest_columns()
    return pair_vectors(spark, sf_dir).select(
        *[c.alias(n) for n, c in columns.items()],
        F.col("pair_id").alias("input_pos"),
        _scores(False).alias("models"),
    )


def scored_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = pair_manifest_columns()
    return pair_vectors(spark, sf_dir).select(
        columns["id"].alias("id"),
        F.get(_strings(PHENOMENA), (F.col("pair_id") % 7).cast("int")).alias("phenomenon"),
        F.get(_strings(EFFECTS), (F.col("pair_id") % 5).cast("int")).alias("semantic_effect"),
        F.col("pair_id").alias("input_pos"),
        _scores(True).alias("models"),
    )


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as one landmark frame; runs of 16, 20 and 24 make up the clips.

    A frame has 63 values: the last two of a vector add up to its last one.
    """
    at = F.col("vec_id") % 60
    part = F.when(at < 16, 0).when(at < 36, 1).otherwise(2)
    first = F.when(at < 16, 0).when(at < 36, 16).otherwise(36)
    clip = (F.floor(F.col("vec_id") / 60) * 3 + part).cast("long")

    def value(v, i):
        left = (i >= LAYOUT.pose_width) & (i < LAYOUT.pose_width + LAYOUT.hand_width)
        return (
            F.when(i == LAYOUT.width - 1, v + F.get("embedding", F.lit(LAYOUT.width)))
            .when(left & (F.col("vec_id") % 4 == 0), F.lit(0.0).cast("float"))
            .when((i < 3) & (F.col("vec_id") % 7 == 0), F.lit(0.0).cast("float"))
            .otherwise(v)
        )

    return table(spark, sf_dir, "embeddings").select(
        clip.alias("clip_id"),
        (at - first).cast("long").alias("frame_index"),
        F.when(part == 0, 0.0).otherwise(25.0).alias("fps"),
        F.transform(F.slice("embedding", 1, LAYOUT.width), value).alias("x"),
    )


def _clip_names(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("label", F.concat(F.lit("c"), (F.col("clip_id") % 4).cast("string")))
        .withColumn("split", F.when(F.col("clip_id") % 5 == 0, "test").otherwise("train"))
        .withColumn(
            "file", F.concat(F.lit("clip_"), F.lpad(F.col("clip_id").cast("string"), 12, "0"), F.lit(".npy"))
        )
    )


def native_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frames (T x 63), label, split, file."""
    from ..operators.clipsets import frames_to_clips

    return _clip_names(frames_to_clips(frame_table(spark, sf_dir), ["clip_id"]))


def source_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand blocks only (T x 42)."""
    from ..functions.clips import select_hand_blocks

    return native_clips(spark, sf_dir).withColumn(
        "frames", select_hand_blocks(F.col("frames"), LAYOUT)
    )


def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the model layout: hand features, then constant zeros."""
    from ..functions.clips import pad_features
    from ..operators.clipsets import fit_feature_stats

    hands = F.slice("x", LAYOUT.pose_width + 1, LAYOUT.source_width)
    padded = F.concat(hands, F.array_repeat(F.lit(0.0).cast("float"), LAYOUT.padding))
    rows = frame_table(spark, sf_dir).select(F.array(padded).alias("frames"))
    return fit_feature_stats(rows)


def scorer():
    """The stand-in scorer: one feature of each hand block per class, so that no ablation ties classes."""
    from ..operators.scoring import late_weighted_scorer

    features = [[5 * k, LAYOUT.hand_width + 5 * k] for k in range(len(CLIP_LABELS))]
    return late_weighted_scorer(TARGET_LENGTH, LAYOUT.width, features)


def scored(prepared: DataFrame) -> DataFrame:
    """Prepared clips through the stand-in scorer, with all metrics."""
    from ..operators.scoring import score_clips, with_metrics

    raw = score_clips(prepared, scorer(), CLIP_LABELS, TARGET_LENGTH, LAYOUT.width)
    return with_metrics(raw.drop("prepared"))


def scored_variants(prepared: DataFrame) -> DataFrame:
    """Arrays of prepared clips through the same scorer."""
    from ..operators.scoring import score_variants

    return score_variants(prepared, scorer(), CLIP_LABELS, TARGET_LENGTH, LAYOUT.width).drop("prepared")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: all its words in pieces of four characters.

    Each document also starts with one piece that belongs to no word.  A text without
    words splits into one empty string, which has no pieces to cut and is taken out.
    """
    words = F.array_remove(F.split(normalise_text(F.col("text")), " "), "")

    def cut(word, i):
        return F.transform(
            F.sequence(F.lit(1), F.char_length(word), F.lit(4)),
            lambda s: F.struct(
                i.cast("long").alias("word_id"), F.substring(word, s, F.lit(4)).alias("piece")
            ),
        )

    special = F.array(
        F.struct(F.lit(None).cast("long").alias("word_id"), F.lit("<s>").alias("piece"))
    )
    return (
        widened(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", words.alias("words"))
        .select("doc_id", F.concat(special, F.flatten(F.transform("words", cut))).alias("tokens"))
    )


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: doc_id, token_index, word_id, piece."""
    return (
        token_arrays(spark, sf_dir)
        .select("doc_id", F.posexplode_outer("tokens").alias("token_index", "t"))
        .select("doc_id", F.col("token_index").cast("long").alias("token_index"), "t.*")
        .filter("piece != ''")
    )


def tag_logits(piece):
    """Scores of the five tags, from a digest of the piece."""
    return let(
        F.conv(F.substring(F.md5(piece), 1, 2 * len(TAGS)), 16, 10).cast("long"),
        lambda digest: F.array(
            *[
                F.shiftright(digest, 8 * (len(TAGS) - 1 - k)).bitwiseAND(F.lit(255)).cast("double") / 64.0
                for k in range(len(TAGS))
            ]
        ),
    )
