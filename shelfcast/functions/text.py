"""Text expressions: defaults, keys, number formats and explanation sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfcast.functions.numbers import round_half_up

# Sentences, labels and the image address pattern.
KNOWN_PUBLISHER_SENTENCE = (
    "Based on the publisher '%s', which has released %d game%s on Epic Games Store with an average wait time of "
    "%d year%s and %d month%s (averaging a Metacritic score of %s), and considering '%s' %s, the model estimates "
    "it will appear free on Epic Games Store approximately %d year%s and %d month%s after release, with a "
    "confidence interval between %s and %s years."
)
UNKNOWN_PUBLISHER_SENTENCE = (
    "Based on the publisher '%s', which has no historical data in our Epic Games dataset, we cannot make a "
    "reliable prediction. Industry average suggests approximately %d years and %d months."
)
NO_TEXT = "None"
NO_NUMBER = "nan"
WITHOUT_SCORE = "without an available Metacritic score"
WITH_SCORE = "with a Metacritic score of "
SHORT_NAMES = {"epic": "Epic", "gamepass": "Xbox", "psplus": "PS Plus", "humble": "Humble"}
IMAGE_ROOT = "media.rawg.io/media/"
IMAGE_CROP = "crop/600/400/"


def filled(text: Column) -> Column:
    """Null for an empty text: both count as missing."""
    return F.nullif(text, F.lit(""))


def number_text(x: Column) -> Column:
    """A whole number is written without decimals."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def fixed(x: Column, digits: int) -> Column:
    """A fixed number of decimals, halves up."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", round_half_up(x, digits)))


def plural(n: Column) -> Column:
    return F.when(n != 1, F.lit("s")).otherwise(F.lit(""))


def score_phrase(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(WITHOUT_SCORE)).otherwise(F.concat(F.lit(WITH_SCORE), number_text(score)))


def known_publisher_sentence(
    publisher: Column,
    games: Column,
    average_years: Column,
    average_months: Column,
    average_score: Column,
    game: Column,
    score: Column,
    years: Column,
    months: Column,
    lower: Column,
    upper: Column,
) -> Column:
    return F.format_string(
        KNOWN_PUBLISHER_SENTENCE,
        publisher,
        games,
        plural(games),
        average_years,
        plural(average_years),
        average_months,
        plural(average_months),
        F.coalesce(fixed(average_score, 1), F.lit(NO_NUMBER)),
        F.coalesce(game, F.lit(NO_TEXT)),
        score_phrase(score),
        years,
        plural(years),
        months,
        plural(months),
        fixed(lower, 1),
        fixed(upper, 1),
    )


def unknown_publisher_sentence(publisher: Column, years: Column, months: Column) -> Column:
    return F.format_string(UNKNOWN_PUBLISHER_SENTENCE, F.coalesce(publisher, F.lit(NO_TEXT)), years, months)


def month_duration(months: Column) -> Column:
    """``1y 3m``; the years part only from 12 months on. 23.6 gives ``1y 12m``."""
    years = F.floor(months / 12)
    rest = F.floor(months - 12 * F.floor(months / 12) + 0.5)
    return F.concat(
        F.when(years > 0, F.concat(years.cast("string"), F.lit("y "))).otherwise(F.lit("")),
        rest.cast("bigint").cast("string"),
        F.lit("m"),
    )


def without_bold_marks(text: Column) -> Column:
    return F.replace(text, F.lit("**"), F.lit(""))


def cropped_image(url: Column) -> Column:
    """Ask the image host for a cropped picture; other addresses stay as they are."""
    start = F.locate(IMAGE_ROOT, url) + len(IMAGE_ROOT)
    head = F.substring(url, F.lit(1), start - 1)
    rest = F.substring(url, start, F.length(url))
    return (
        F.when(filled(url).isNull(), F.lit(""))
        .when((F.locate(IMAGE_ROOT, url) == 0) | rest.startswith("crop/"), url)
        .otherwise(F.concat(head, F.lit(IMAGE_CROP), rest))
    )


def short_platform_name(platform: Column) -> Column:
    """Display name; an unknown key is shown as it is."""
    names = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, platform), platform)


def breakdown_text(breakdown: Column) -> Column:
    """``Name: count`` entries of a platform map, in entry order; null gives an empty text."""
    entries = F.transform(
        F.map_entries(breakdown),
        lambda e: F.concat(short_platform_name(e["key"]), F.lit(": "), e["value"].cast("string")),
    )
    return F.coalesce(F.array_join(entries, ", "), F.lit(""))
