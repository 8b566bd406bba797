"""Priority and effect-size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import col, present

# Cut points and label sets.
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
FIXED_HIGH_CUT = 0.70
FIXED_MEDIUM_CUT = 0.48
EFFECT_CUTS = (0.2, 0.5, 0.8)
EFFECT_LABELS = ("negligible", "small", "medium", "large")
EFFECT_LABELS_SHORT = ("negl.", "small", "med.", "large")


def priority(score: Column | str, high_cut: Column | float, medium_cut: Column | float,
             labels: tuple[str, str, str] = PRIORITIES) -> Column:
    """High from ``high_cut`` up, medium from ``medium_cut`` up, else low.

    Null and NaN scores are low (Spark sorts NaN above every number).
    """
    score = col(score)
    known = present(score)
    return (
        F.when(known & (score >= high_cut), F.lit(labels[0]))
        .when(known & (score >= medium_cut), F.lit(labels[1]))
        .otherwise(F.lit(labels[2]))
    )


def effect_label(d: Column | str, labels: tuple[str, ...] = EFFECT_LABELS,
                 missing: str = "-") -> Column:
    """Name of the size of a standardised mean difference."""
    size = F.abs(col(d))
    out = F.when(~present(d), F.lit(missing))
    for cut, name in zip(EFFECT_CUTS, labels):
        out = out.when(size < F.lit(cut), F.lit(name))
    return out.otherwise(F.lit(labels[-1]))


def effect_text(d: Column | str, missing: str = "-") -> Column:
    """Chart text such as ``d=0.42 small``."""
    return F.format_string("d=%.2f %s", col(d), effect_label(d, EFFECT_LABELS_SHORT, missing))


def strength(p: Column | str, floor: float = 1e-10) -> Column:
    """``-log10`` of a p-value that is kept off zero."""
    return -F.log10(F.greatest(col(p), F.lit(floor)))
