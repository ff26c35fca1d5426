"""Scalar expressions at their edges."""

import pytest
from pyspark.sql import functions as F

from shelfcast.functions import bands, numbers, text
from shelfcast.operators import catalogue as cat
from shelfcast.operators import requests as rq


def values(spark, kind, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_speed_score(spark):
    found = values(spark, "double", [None, 0.0, float("nan"), 365.0, 730.0], numbers.speed_score)
    assert found == [0.5, 0.5, 0.5, 1.0, 0.5]


def test_whole_parts_truncate_toward_zero(spark):
    assert values(spark, "double", [1.99, -1.9, 0.0, None], numbers.whole_years) == [1, -1, 0, None]
    assert values(spark, "double", [1.5, -1.25, 2.0], numbers.whole_months) == [6, -3, 0]


def test_bounds(spark):
    assert values(spark, "double", [2.0, 0.01, -1.0, None], numbers.lower_bound) == [1.7, 0.1, 0.1, None]
    # only the lower bound has a floor, so it may lie above the upper one
    assert values(spark, "double", [-1.0], numbers.upper_bound) == [-1.15]


def test_average_months_can_be_twelve(spark):
    assert values(spark, "double", [364.0, 365.0, 400.0, 0.0], numbers.average_months) == [12, 0, 1, 0]
    assert values(spark, "double", [364.0, 365.0, 800.0], numbers.average_years) == [0, 1, 2]


def test_halves_go_up(spark):
    assert values(spark, "double", [-0.5, 0.5, 1.5, -1.5], numbers.rounded_days) == [0, 1, 2, -1]
    assert values(spark, "double", [64.404, 64.405, 1.125], lambda x: numbers.round_half_up(x, 2)) == [64.4, 64.41, 1.13]


def test_month_duration(spark):
    found = values(spark, "double", [23.6, 11.4, 11.6, 12.0, 0.0, 36.2, None], text.month_duration)
    assert found == ["1y 12m", "11m", "12m", "1y 0m", "0m", "3y 0m", None]


def test_number_text(spark):
    assert values(spark, "double", [75.0, 75.5, 0.0, None], text.number_text) == ["75", "75.5", "0", None]


def test_plural(spark):
    assert values(spark, "int", [0, 1, 2], text.plural) == ["s", "", "s"]


def test_score_phrase(spark):
    found = values(spark, "double", [None, 0.0, 81.25], text.score_phrase)
    assert found == [
        "without an available Metacritic score",
        "with a Metacritic score of 0",
        "with a Metacritic score of 81.25",
    ]


def test_bold_marks(spark):
    assert values(spark, "string", ["**a** b**", "a*b", None], text.without_bold_marks) == ["a b", "a*b", None]


def test_images(spark):
    inputs = [
        None,
        "",
        "https://media.rawg.io/media/games/a.jpg",
        "https://media.rawg.io/media/crop/600/400/games/a.jpg",
        "https://example.org/a.jpg",
        "https://media.rawg.io/media/",
        "x media.rawg.io/media/y media.rawg.io/media/z",
    ]
    assert values(spark, "string", inputs, text.cropped_image) == [
        "",
        "",
        "https://media.rawg.io/media/crop/600/400/games/a.jpg",
        "https://media.rawg.io/media/crop/600/400/games/a.jpg",
        "https://example.org/a.jpg",
        "https://media.rawg.io/media/crop/600/400/",
        "x media.rawg.io/media/crop/600/400/y media.rawg.io/media/z",
    ]


def test_breakdown_text(spark):
    inputs = [{"epic": 3, "any": 1, "gamepass": 2}, {}, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x map<string,bigint>")
    found = [r.y for r in df.orderBy("i").select(text.breakdown_text(F.col("x")).alias("y")).collect()]
    assert sorted(found[0].split(", ")) == ["Epic: 3", "Xbox: 2", "any: 1"]
    assert found[1:] == ["", ""]


@pytest.mark.parametrize(
    "label, band",
    [
        (None, "bg-gray-500"),
        ("", "bg-gray-500"),
        ("Not on PC, never", "bg-gray-600"),
        ("Console Exclusive", "bg-gray-600"),
        ("WITHIN 6 MONTHS", "bg-green-500"),
        ("6-12 months", "bg-blue-500"),
        ("More than 12 months", "bg-yellow-500"),
        ("More than 12 months (24 at most)", "bg-gray-500"),
        ("More than 24 months", "bg-orange-500"),
        ("Never", "bg-red-500"),
        ("Unknown", "bg-gray-500"),
        ("Within 12-24 months", "bg-gray-500"),
        ("Very Unlikely", "bg-gray-500"),
    ],
)
def test_category_band(spark, label, band):
    assert values(spark, "string", [label], bands.category_band) == [band]


def test_confidence(spark):
    inputs = [100, 80, 79, 60, 59, 40, 39, 20, 19, 0, None]
    colours = ["green", "green", "blue", "blue", "yellow", "yellow", "orange", "orange", "red", "red"]
    assert values(spark, "int", inputs, bands.confidence_band) == [f"bg-{c}-500" for c in colours] + [None]
    words = [w and w.split()[0] for w in values(spark, "int", inputs, bands.confidence_word)]
    assert words == ["High", "High", "Moderate", "Moderate"] + ["Low"] * 6 + [None]


def test_local_addresses(spark):
    inputs = [None, "", "::1", "127.0.0.1", "localhost:80", "my.localhost", "127.0.0.11", " 127.0.0.1", "10.0.0.1", "::1\n"]
    assert values(spark, "string", inputs, rq.is_local) == [True] * 6 + [False] * 4


def test_client_address_is_not_trimmed(spark):
    df = spark.createDataFrame(
        [("1.1.1.1, 2.2.2.2", "r"), (" 1.1.1.1,x", "r"), (",x", "r"), ("", "r"), (None, "r"), (None, None)], "f string, r string"
    )
    found = [r.y for r in df.select(rq.client_address(F.col("f"), F.col("r")).alias("y")).collect()]
    assert found == ["1.1.1.1", " 1.1.1.1", "r", "r", "r", None]


def test_score_imputation(spark):
    rows = [
        (None, 4.4, 0, 88.0),
        (0.0, 4.404, 0, 88.08),
        (0.0, 0.0, 1001, 75.0),
        (None, None, 1001, 75.0),
        (None, None, 1000, None),
        (0.0, None, 5, 0.0),
        (81.006, 1.0, 5000, 81.01),
    ]
    df = spark.createDataFrame(rows, "m double, r double, n bigint, want double")
    for row in df.select("want", cat.imputed_score(F.col("m"), F.col("r"), F.col("n")).alias("got")).collect():
        assert row.got == row.want


def test_first_publisher(spark):
    df = spark.createDataFrame(
        [([("A",), ("B",)],), ([],), (None,), ([(None,), ("B",)],)], "p array<struct<name:string>>"
    )
    found = [r.y for r in df.select(cat.first_publisher(F.col("p")).alias("y")).collect()]
    # a first entry without a name is not replaced
    assert found == ["A", "Unknown", "Unknown", None]


def test_release_parts(spark):
    df = spark.sql("SELECT DATE '2020-07-09' AS d UNION ALL SELECT NULL")
    found = {tuple(r) for r in df.select(cat.release_year(F.col("d")), cat.release_month(F.col("d"))).collect()}
    assert found == {(2020, 7), (2024, 1)}
