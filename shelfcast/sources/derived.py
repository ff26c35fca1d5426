"""The library's input tables, derived by Spark from the supplied parquet tables.

Every derivation is a projection or an aggregation of a whole supplied table,
so all tables here grow with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"  # for requests and the cache
HISTORY_AS_OF = "2001-12-01"  # for appearances
NO_TIME_KEY = "predict:game 2:epic"  # a stored row without a time
BATCH_FROM = "2024-01-16 00:00:00"  # later requests form the batch of a merge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(table(spark, sf_dir, "events"))


def requests_from_events(events: DataFrame) -> DataFrame:
    """Five games draw half of the requests; the platform follows the event type."""
    e, k, user = F.col("event_id"), F.col("k"), F.col("user")
    game = F.when(e % 97 == 0, F.lit("")).otherwise(
        F.concat(
            F.when(e % 3 == 0, "GAME ").otherwise("Game "),
            F.when(e % 2 == 0, k % 5).otherwise(k).cast("string"),
        )
    )
    platform = (
        F.when(F.col("event_type") == "view", "epic")
        .when(F.col("event_type") == "click", "gamepass")
        .when(F.col("event_type") == "signup", "psplus")
        .when(F.col("event_type") == "purchase", "humble")
    )
    ip = F.when(
        user == 0,
        F.when(e % 4 == 1, F.lit("")).when(e % 4 == 2, "::1, 172.16.0.1").when(e % 4 == 3, "localhost:3000"),
    ).otherwise(F.concat(F.when(e % 10 == 0, " ").otherwise(""), F.lit("10.0.0."), user.cast("string"), F.lit(", 172.16.0.1")))
    # every second request carries its fields in the body, half of these an empty query text
    in_query = e % 4 < 2
    empty = F.when(e % 4 == 2, F.lit(""))
    # in steps, so that each text is parsed or built once
    return (
        events.select(
            "event_id",
            "ts",
            "event_type",
            (F.col("user_id") % 5).alias("user"),
            # props is {"k": number}
            F.rtrim(F.substring_index("props", ":", -1), F.lit("}")).cast("int").alias("k"),
        )
        .withColumns({"game": game, "platform": platform})
        .select(
            e.alias("request_id"),
            F.when(e % 89 != 0, F.col("ts").cast("timestamp")).alias("ts"),
            F.when(in_query, F.col("game")).otherwise(empty).alias("query_game"),
            F.when(in_query, F.col("platform")).otherwise(empty).alias("query_platform"),
            F.when(~in_query, F.col("game")).alias("body_game_name"),
            F.when(~in_query, F.col("platform")).alias("body_platform"),
            ip.alias("forwarded_for"),
            F.lit("127.0.0.1").alias("remote_addr"),
            F.concat(F.lit("Brand#"), (1 + k % 25).cast("string")).alias("publisher"),
            F.when(k % 4 != 0, 50.0 + k % 50).alias("metacritic_score"),
            F.when(k % 10 != 0, F.date_add(F.lit("2023-01-01").cast("date"), k)).alias("release_date"),
            F.when(e % 7 == 0, "fail").when(e % 11 == 0, "soft_error").otherwise("ok").alias("outcome"),
        )
    )


EDITIONS = 7  # as many as an order has lines, so that a line names a part and an edition


def item_id(part: str, edition: str) -> Column:
    return F.col(part) * 8 + F.col(edition)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part in seven editions, some of which never appear anywhere."""
    p = F.col("item_id")
    all_platforms = F.array(*[F.lit(x) for x in ("epic", "gamepass", "psplus", "humble")])
    editions = table(spark, sf_dir, "part").withColumn("edition", F.explode(F.sequence(F.lit(1), F.lit(EDITIONS))))
    return editions.withColumn("item_id", item_id("p_partkey", "edition")).select(
        p.alias("id"),
        F.concat("p_name", F.lit(" #"), p.cast("string")).alias("name"),
        F.when(p % 13 == 0, F.array().cast("array<struct<name:string>>"))
        .otherwise(F.array(F.struct(F.when(p % 29 != 0, F.col("p_brand")).alias("name"))))
        .alias("publishers"),
        F.when(p % 6 == 0, F.array().cast("array<string>"))
        .when(p % 6 != 1, F.slice(all_platforms, 1, (p % 4 + 1).cast("int")))
        .alias("platforms"),
        F.when(p % 5 == 0, F.lit(None)).when(p % 5 == 1, 0.0).otherwise(50.0 + F.col("p_size")).alias("metacritic"),
        F.when(p % 2 == 0, F.col("p_size") / 10.0).alias("rating"),
        ((p * 37) % 2000).alias("reviews_count"),
        F.when(p % 17 != 0, F.date_add(F.lit("1994-01-01").cast("date"), ((p * 37) % 365).cast("int"))).alias("released"),
        F.when(p % 4 == 1, F.concat(F.lit("https://media.rawg.io/media/games/"), p.cast("string"), F.lit(".jpg")))
        .when(p % 4 == 2, F.concat(F.lit("https://media.rawg.io/media/crop/600/400/games/"), p.cast("string"), F.lit(".jpg")))
        .when(p % 4 == 3, F.concat(F.lit("https://images.example.org/"), p.cast("string"), F.lit(".jpg")))
        .alias("background_image"),
    )


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per game, service and day."""
    supplier = F.col("l_suppkey") % 4
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            item_id("l_partkey", "l_linenumber").alias("game_id"),
            F.when(supplier == 0, "epic").when(supplier == 1, "gamepass").when(supplier == 2, "psplus").otherwise("humble").alias("platform"),
            F.col("l_shipdate").cast("date").alias("appeared_on"),
        )
        .distinct()
    )


def publisher_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as a file would hold them: two publishers missing, one average
    missing, one zero, and a second, later row for every third publisher."""
    from shelfcast.operators.catalogue import enrich
    from shelfcast.operators.publishers import publisher_statistics

    built = publisher_statistics(
        appearances(spark, sf_dir).where(F.col("platform") == "epic"), enrich(catalogue(spark, sf_dir)), ["publisher"]
    ).where(F.col("publisher").startswith("Brand#") & ~F.col("publisher").isin("Brand#24", "Brand#25"))
    number = F.substring_index("publisher", "#", -1).cast("bigint")
    days = F.when(number == 7, F.lit(None)).when(number == 8, 0.0).otherwise(F.col("avg_wait_days"))
    copies = F.when(number % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return built.select("*", number.alias("number"), days.alias("days"), F.explode(copies).alias("copy")).select(
        (F.col("number") + 1000 * F.col("copy")).alias("ordinal"),
        F.col("publisher").alias("primary_publisher"),
        (F.col("days") + 100 * F.col("copy")).alias("avg_days_to_epic"),
        (F.col("games_count") + F.col("copy")).alias("games_count"),
        (F.col("avg_score") + F.col("copy")).alias("avg_metacritic"),
    )


def publisher_labels(stats: DataFrame) -> DataFrame:
    """Labels the encoder was fitted on; one publisher of the statistics is not among them."""
    return (
        stats
        .where(F.col("primary_publisher") != "Brand#23")
        .select(F.col("primary_publisher").alias("label"))
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of row, with a doubled key of each kind and ages at the limit."""
    from shelfcast.operators.requests import accepted, cooldown_key, result_key
    from shelfcast.operators.snapshots import latest_per_key

    named = accepted(requests(spark, sf_dir))
    results = named.where(F.col("outcome") == "ok").select(
        result_key(F.col("game"), F.col("platform")).alias("key"), _request_json().alias("data"), F.col("ts").alias("created_at")
    )
    votes = named.where(~F.col("is_local")).select(
        cooldown_key(F.col("client_ip"), F.col("game"), F.col("platform")).alias("key"),
        F.lit('{"type":"rate_limit"}').alias("data"),
        F.col("ts").alias("created_at"),
    )
    as_of = F.lit(AS_OF).cast("timestamp")
    age_at_limit = F.when(
        F.col("key") == "predict:game 1:gamepass", as_of - F.expr("INTERVAL 24 HOURS")
    ).when(F.col("key") == "rate_limit:10.0.0.1:game 1:gamepass", as_of - F.expr("INTERVAL 1 HOUR"))
    doubled = F.col("key").isin("predict:game 0:epic", "rate_limit:10.0.0.1:game 0:epic")
    return (
        latest_per_key(results.unionByName(votes))
        .withColumn("created_at", F.when(F.col("key") != NO_TIME_KEY, F.coalesce(age_at_limit, F.col("created_at"))))
        .withColumn("hours", F.explode(F.when(doubled, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .withColumn("created_at", F.col("created_at") - F.make_dt_interval(hours=F.col("hours")))
        .drop("hours")
    )


def _request_json() -> Column:
    return F.to_json(F.struct("request_id"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles that are searched: those of the whole catalogue."""
    return catalogue(spark, sf_dir).select(F.col("id").alias("game_id"), "name")


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users type: item names in other case and spacing, one word more or less, blanks."""
    p = F.col("p_partkey")
    words = F.split("p_name", " ")
    typed = (
        F.when(p % 50 == 0, F.lit("   "))
        .when(p % 5 == 0, F.upper("p_name"))
        .when(p % 5 == 1, F.concat(F.lit("  "), words[0], F.lit("   "), words[1]))
        .when(p % 5 == 2, F.concat("p_name", F.lit(" deluxe")))
        .when(p % 5 == 3, words[1])
        .otherwise(F.concat(words[0], F.lit(" #"), p.cast("string")))
    )
    return table(spark, sf_dir, "part").select(p.alias("query_id"), typed.alias("query"))


def manual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed-in items; some without a name or a publisher."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.when(s % 7 == 0, F.lit(" \t\u3000")).otherwise(F.concat(F.lit("Title "), s.cast("string"))).alias("name"),
        F.when(s % 10 == 0, F.lit("\n\u00a0")).when(s % 5 == 0, F.lit("")).otherwise(F.col("s_name")).alias("publisher"),
    )


def first_party(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand#1 belongs to gamepass and Brand#2 to psplus."""
    brand = F.col("p_brand")
    return (
        table(spark, sf_dir, "part")
        .where(brand.isin("Brand#1", "Brand#2"))
        .select(brand.alias("publisher"), F.when(brand == "Brand#1", "gamepass").otherwise("psplus").alias("platform"))
        .distinct()
    )
