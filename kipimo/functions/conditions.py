"""Distribution-shift probes, ablations and the registry of clip conditions.

A condition maps a clip to a clip.  Probes act on raw clips, before resampling;
ablations act on resampled source clips and may use the training mean of the
source features.  Randomness comes from hashes of the clip key and the position,
so a result never depends on partitioning, retries or row order.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .layout import FULL_BODY, TARGET_LENGTH, Layout

# Seeds and noise scale of the probes.
SHUFFLE_SEED = 1000
NOISE_SEED = 2000
NOISE_SCALE = 0.05


# ---- probes -------------------------------------------------------------------


def probe_reverse(frames: Column, key: Column) -> Column:
    return F.reverse(frames)


def _tag(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def probe_shuffle(frames: Column, key: Column, seed: int = SHUFFLE_SEED) -> Column:
    """Seeded permutation: frames in the order of md5(key:position:seed)."""
    tagged = F.transform(
        frames, lambda f, i: F.struct(F.md5(_tag(key, i, F.lit(seed))).alias("h"), f.alias("f"))
    )
    return F.transform(F.array_sort(tagged), lambda s: s["f"])


def probe_freeze(frames: Column, key: Column) -> Column:
    """Every frame becomes the middle one."""
    return F.array_repeat(
        F.get(frames, F.floor(F.size(frames) / 2).cast("int")), F.size(frames)
    )


def _uniform(digest: Column, first: int) -> Column:
    """(0, 1] from eight hex digits of a digest."""
    return (F.conv(F.substring(digest, first, 8), 16, 10).cast("double") + 1.0) / 4294967297.0


def probe_noise(
    frames: Column, key: Column, seed: int = NOISE_SEED, scale: float = NOISE_SCALE
) -> Column:
    """Adds N(0, scale): one digest per value gives both Box-Muller uniforms."""

    def noisy(x, digest):
        radius = F.sqrt(-2.0 * F.ln(_uniform(digest, 1)))
        draw = radius * F.cos(F.lit(2.0 * math.pi) * _uniform(digest, 9))
        return (x.cast("double") + scale * draw).cast("float")

    return F.transform(
        frames,
        lambda f, i: F.transform(
            f,
            lambda x, j: let(F.md5(_tag(key, i, j, F.lit(seed))), lambda d: noisy(x, d)),
        ),
    )


# ---- ablations -----------------------------------------------------------------


def ablate_clean(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    return frames


def ablate_block1(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    """First hand block replaced by its training mean."""
    w = layout.hand_width
    return F.transform(frames, lambda f: F.concat(F.slice(mean, 1, w), F.slice(f, w + 1, w)))


def ablate_block2(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    """Second hand block replaced by its training mean."""
    w = layout.hand_width
    return F.transform(frames, lambda f: F.concat(F.slice(f, 1, w), F.slice(mean, w + 1, w)))


def ablate_mean_freeze(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    """Every frame becomes the temporal mean of the clip."""
    zero = F.array_repeat(F.lit(0.0), layout.source_width)
    summed = F.aggregate(
        frames, zero, lambda acc, f: F.zip_with(acc, f, lambda a, x: a + x.cast("double"))
    )
    averaged = F.transform(summed, lambda x: (x / F.size(frames)).cast("float"))
    return F.array_repeat(averaged, F.size(frames))


def _source_mean(mean: Column, layout: Layout) -> Column:
    return F.slice(mean, 1, layout.source_width)


def ablate_first_half(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    """Keeps the first half; later frames become the training mean."""
    half, mu = TARGET_LENGTH // 2, _source_mean(mean, layout)
    return F.transform(frames, lambda f, i: F.when(i < half, f).otherwise(mu))


def ablate_second_half(frames: Column, mean: Column, layout: Layout = FULL_BODY) -> Column:
    half, mu = TARGET_LENGTH // 2, _source_mean(mean, layout)
    return F.transform(frames, lambda f, i: F.when(i < half, mu).otherwise(f))


# ---- registry -------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    """A named clip transform: ``apply(frames, key_or_mean) -> frames``."""

    name: str
    apply: Callable


# Condition names, in report order.
PROBES: dict[str, Condition] = {
    name: Condition(name, fn)
    for name, fn in {
        "clean_id": lambda frames, key: frames,
        "temporal_reverse": probe_reverse,
        "temporal_shuffle": probe_shuffle,
        "static_freeze": probe_freeze,
        "coordinate_noise": probe_noise,
    }.items()
}

# Fixed values.  Removing one block is keeping the other, so eight names share
# six transforms.
ABLATIONS: dict[str, Condition] = {
    name: Condition(name, fn)
    for name, fn in {
        "clean": ablate_clean,
        "block_1_removed": ablate_block1,
        "block_2_removed": ablate_block2,
        "block_1_only": ablate_block2,
        "block_2_only": ablate_block1,
        "temporal_mean_freeze": ablate_mean_freeze,
        "first_half_only": ablate_first_half,
        "second_half_only": ablate_second_half,
    }.items()
}


def register_condition(registry: dict[str, Condition], name: str, apply: Callable) -> None:
    """Add a user-defined clip transform to a registry."""
    if name in registry:
        raise ValueError(f"condition already registered: {name}")
    registry[name] = Condition(name, apply)
