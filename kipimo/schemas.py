"""Explicit schemas of every table the library reads; nothing is inferred.

Model names are map keys (they may contain ``/``), so inference would turn them
into struct fields.  The field names are fixed values: those of the files.
"""

from pyspark.sql import types as T


def _fields(kind, *names):
    return [T.StructField(name, kind) for name in names]


_STR, _DBL, _INT = T.StringType(), T.DoubleType(), T.IntegerType()

PAIR_MANIFEST = T.StructType(
    _fields(_STR, "id", "category", "text_a", "text_b", "expected_relation")
)
STRESS_MANIFEST = T.StructType(
    _fields(_STR, "id", "phenomenon", "text_a", "text_b", "change", "semantic_effect", "description")
)
SPEECH_MANIFEST = T.StructType(_fields(_STR, "id", "category", "audio", "reference"))

PAIR_SCORE = T.StructType(
    _fields(_DBL, "similarity", "inference_time_ms")
    + _fields(_INT, "embedding_dimension")
    + _fields(_STR, "device")
)
STRESS_SCORE = T.StructType(
    _fields(_DBL, "similarity", "representational_shift", "inference_time_ms")
)
SPEECH_SCORE = T.StructType(
    _fields(_STR, "model", "hypothesis_raw", "hypothesis_normalised")
    + _fields(_DBL, "wer", "cer", "duration_seconds", "inference_time_ms")
    + _fields(_STR, "device")
)


def _with_models(fields, score):
    return T.StructType(fields + [T.StructField("models", T.MapType(_STR, score))])


PAIR_RECORD = _with_models(
    _fields(_STR, "id", "category", "expected_relation", "text_a", "text_b"), PAIR_SCORE
)
STRESS_RECORD = _with_models(
    _fields(
        _STR, "id", "phenomenon", "text_a", "text_b", "change", "semantic_effect", "description"
    ),
    STRESS_SCORE,
)
SPEECH_RECORD = T.StructType(
    _with_models(
        _fields(_STR, "id", "category", "audio", "reference_raw", "reference_normalised"),
        SPEECH_SCORE,
    ).fields
    + _fields(_DBL, "wer_improvement", "cer_improvement")
)

MANIFESTS = {"pairs": PAIR_MANIFEST, "stress": STRESS_MANIFEST, "speech": SPEECH_MANIFEST}
RECORDS = {"pairs": PAIR_RECORD, "stress": STRESS_RECORD, "speech": SPEECH_RECORD}

FRAME = T.ArrayType(T.FloatType())
CLIP = T.ArrayType(FRAME)
CLIP_TABLE = T.StructType(
    _fields(_STR, "split", "label", "file") + [T.StructField("frames", CLIP)]
)

PREDICTION = T.StructType(
    _fields(_INT, "index") + _fields(_STR, "label") + _fields(_DBL, "probability")
)

ALIGNMENT = T.StructType(
    _fields(
        _INT,
        "hits",
        "substitutions_count",
        "deletions_count",
        "insertions_count",
        "reference_word_count",
    )
    + [
        T.StructField(
            "substitutions", T.ArrayType(T.StructType(_fields(_STR, "reference", "hypothesis")))
        ),
        T.StructField("deletions", T.ArrayType(T.StructType(_fields(_STR, "reference")))),
        T.StructField("insertions", T.ArrayType(T.StructType(_fields(_STR, "hypothesis")))),
    ]
)
