"""Display bands of a category label and of a confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label parts, thresholds and what they are shown as.
GREY, DARK_GREY = "bg-gray-500", "bg-gray-600"
GREEN, BLUE, YELLOW, ORANGE, RED = "bg-green-500", "bg-blue-500", "bg-yellow-500", "bg-orange-500", "bg-red-500"
CONFIDENCE_STEPS = [(80, GREEN), (60, BLUE), (40, YELLOW), (20, ORANGE)]
HIGH, MODERATE, LOW = "High confidence", "Moderate confidence", "Low confidence"


def category_band(category: Column) -> Column:
    """The first rule whose words occur in the label decides."""
    label = F.lower(category)
    return (
        F.when(label.contains("not on pc") | label.contains("console exclusive"), DARK_GREY)
        .when(label.contains("within 6 months"), GREEN)
        .when(label.contains("6-12 months"), BLUE)
        .when(label.contains("more than 12 months") & ~label.contains("24"), YELLOW)
        .when(label.contains("more than 24 months"), ORANGE)
        .when(label.contains("never"), RED)
        .otherwise(GREY)
    )


def confidence_band(confidence: Column) -> Column:
    band = F.when(confidence.isNull(), F.lit(None).cast("string"))
    for least, colour in CONFIDENCE_STEPS:
        band = band.when(confidence >= least, F.lit(colour))
    return band.otherwise(F.lit(RED))


def confidence_word(confidence: Column) -> Column:
    return (
        F.when(confidence.isNull(), F.lit(None).cast("string"))
        .when(confidence >= 80, F.lit(HIGH))
        .when(confidence >= 60, F.lit(MODERATE))
        .otherwise(F.lit(LOW))
    )
