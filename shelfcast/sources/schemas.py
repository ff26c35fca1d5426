"""Explicit schemas of every input; nothing is inferred."""

from pyspark.sql import types as T

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("query_game", T.StringType()),
        T.StructField("query_platform", T.StringType()),
        T.StructField("body_game_name", T.StringType()),
        T.StructField("body_platform", T.StringType()),
        T.StructField("forwarded_for", T.StringType()),
        T.StructField("remote_addr", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("metacritic_score", T.DoubleType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("platforms", T.ArrayType(T.StringType())),
        # what the scoring back end answered: ok, soft_error or fail
        T.StructField("outcome", T.StringType()),
    ]
)

# one table, two kinds of row, told apart by the key's prefix
CACHE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

LEADERBOARD = T.StructType(
    [
        T.StructField("game", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("score", T.LongType()),
    ]
)

PUBLISHER_STATS = T.StructType(
    [
        T.StructField("primary_publisher", T.StringType()),
        T.StructField("avg_days_to_epic", T.DoubleType()),
        T.StructField("games_count", T.LongType()),
        T.StructField("avg_metacritic", T.DoubleType()),
    ]
)

CATALOGUE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField(
            "publishers", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
        ),
        T.StructField("platforms", T.ArrayType(T.StringType())),
        T.StructField("metacritic", T.DoubleType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("reviews_count", T.LongType()),
        T.StructField("released", T.DateType()),
        T.StructField("background_image", T.StringType()),
    ]
)

APPEARANCES = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("platform", T.StringType()),
        T.StructField("appeared_on", T.DateType()),
    ]
)

FIRST_PARTY = T.StructType(
    [
        T.StructField("publisher", T.StringType()),
        T.StructField("platform", T.StringType()),
    ]
)

TITLE_QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("query", T.StringType()),
    ]
)

MANUAL_ENTRIES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("publisher", T.StringType()),
    ]
)

PLATFORMS = T.StructType(
    [
        T.StructField("platform", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("short_name", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

# The services, in display order.
PLATFORM_ROWS = [
    ("epic", "Epic Games Store", "Epic", True),
    ("gamepass", "Xbox Game Pass Ultimate", "Xbox", True),
    ("psplus", "PlayStation Plus Extra", "PS Plus", True),
    ("humble", "Humble Choice (Monthly)", "Humble", True),
]
