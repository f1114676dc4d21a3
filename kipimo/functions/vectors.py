"""Vectors and class probabilities as Column expressions (JVM side)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import array_sum, let

NORM_FLOOR = 1e-8
MASK_FLOOR = 1e-9


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column, digits: int | None = 6) -> Column:
    value = dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(NORM_FLOOR))
    return value if digits is None else F.round(value, digits)


def softmax(logits: Column) -> Column:
    def shares(z):
        exps = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
        return let(exps, lambda e: let(array_sum(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(logits, shares)


def max_probability(p: Column) -> Column:
    return F.array_max(p)


def prediction_margin(p: Column) -> Column:
    """Largest minus second largest probability; a single class gives its own."""
    return let(
        F.sort_array(p, asc=False),
        lambda s: F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)),
    )


def entropy(p: Column) -> Column:
    """Natural-log entropy; zero probabilities contribute nothing."""
    return -array_sum(F.transform(F.filter(p, lambda x: x > 0), lambda x: x * F.ln(x)))


def normalized_entropy(p: Column) -> Column:
    """Entropy over its maximum ln C, 0.0 for one class."""
    return F.when(F.size(p) > 1, entropy(p) / F.ln(F.size(p))).otherwise(F.lit(0.0))


def label_of(index: Column, labels: Column) -> Column:
    """Label at a 0-based index, the index itself as text when unknown."""
    return F.coalesce(F.get(labels, index), index.cast("string"))


def argmax_label(p: Column, labels: Column, digits: int = 4) -> Column:
    """struct(label, index, confidence) of the most probable class."""

    def best(q):
        index = (F.array_position(q, F.array_max(q)) - 1).cast("int")
        return F.struct(
            label_of(index, labels).alias("label"),
            index.alias("index"),
            F.round(F.array_max(q), digits).alias("confidence"),
        )

    return let(p, best)


def argmax_of_logits(logits: Column, labels: Column, digits: int = 4) -> Column:
    """:func:`argmax_label` of the softmax of logits, without its array of probabilities.

    The largest share is 1 / sum(exp(z - top)): one fold over the logits.
    """

    def best(z):
        def of_top(top):
            index = (F.array_position(z, top) - 1).cast("int")
            scaled = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
            return F.struct(
                label_of(index, labels).alias("label"),
                index.alias("index"),
                F.round(1.0 / scaled, digits).alias("confidence"),
            )

        return let(F.array_max(z), of_top)

    return let(logits, best)


def rank_classes(p: Column, labels: Column) -> Column:
    """Predictions sorted by probability, highest first; ties by higher index."""
    scored = F.transform(
        p,
        lambda x, i: F.struct(
            x.alias("probability"), i.alias("index"), label_of(i, labels).alias("label")
        ),
    )
    return F.transform(
        F.sort_array(scored, asc=False),
        lambda s: F.struct(s["index"], s["label"], s["probability"]),
    )


def probability_of(predictions: Column, label: Column) -> Column:
    """Probability of a named label in ranked predictions; an absent label fails."""
    hit = F.filter(predictions, lambda s: s["label"] == label)
    return F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["probability"]).otherwise(
        F.raise_error(F.concat(F.lit("label not among the predictions: "), label)).cast("double")
    )


def masked_mean_pool(vectors: Column, mask: Column) -> Column:
    """Mask-weighted mean of token vectors (array of vectors, array of 0/1)."""
    weights = mask.cast("array<double>")
    total = F.greatest(array_sum(weights), F.lit(MASK_FLOOR))
    weighted = F.zip_with(
        vectors, weights, lambda v, m: F.transform(as_double(v), lambda x: x * m)
    )
    summed = let(
        weighted,
        lambda w: F.aggregate(
            w,
            F.transform(F.get(w, F.lit(0)), lambda _: F.lit(0.0)),
            lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
        ),
    )
    return let(total, lambda t: F.transform(summed, lambda x: x / t))
