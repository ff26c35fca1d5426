"""From raw requests to normalised ones, rejects and their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.text import filled

# Key prefixes, the default platform and what local addresses look like.
ANY_PLATFORM = "any"
RESULT_PREFIX = "predict"
COOLDOWN_PREFIX = "rate_limit"
LOCAL = r"^(?:|::1|127\.0\.0\.1)\z|localhost"
STATUS_MISSING_GAME = 400


def result_key(game: Column, platform: Column) -> Column:
    """The platform keeps its case, the game does not."""
    return F.concat_ws(":", F.lit(RESULT_PREFIX), F.lower(game), platform)


def cooldown_key(client_ip: Column, game: Column, platform: Column) -> Column:
    return F.concat_ws(":", F.lit(COOLDOWN_PREFIX), client_ip, F.lower(game), platform)


def client_address(forwarded_for: Column, remote_addr: Column) -> Column:
    """First forwarded address, blanks included; the peer address if there is none."""
    return F.coalesce(filled(F.substring_index(forwarded_for, ",", 1)), remote_addr)


def is_local(client_ip: Column) -> Column:
    """No address at all counts as local. One pattern, so the address is worked out once."""
    return F.coalesce(client_ip.rlike(LOCAL), F.lit(True))


def with_keys(requests: DataFrame) -> DataFrame:
    """Adds game, platform, game_key, client_ip and is_local; every row stays."""
    return (
        requests.withColumns(
            {
                "game": F.coalesce(filled(F.col("query_game")), filled(F.col("body_game_name"))),
                "platform": F.coalesce(filled(F.col("query_platform")), filled(F.col("body_platform")), F.lit(ANY_PLATFORM)),
                "client_ip": client_address(F.col("forwarded_for"), F.col("remote_addr")),
            }
        )
        # a second step, so that the columns above are computed once
        .withColumns({"game_key": F.lower("game"), "is_local": is_local(F.col("client_ip"))})
    )


def complete(requests: DataFrame) -> Column:
    """A request names a game and, where times are recorded, has one; both rules need it."""
    named = F.col("game").isNotNull()
    return named & F.col("ts").isNotNull() if "ts" in requests.columns else named


def accepted(requests: DataFrame) -> DataFrame:
    """Requests that name a game and have a time."""
    return with_keys(requests).where(complete(requests))


def rejected(requests: DataFrame) -> DataFrame:
    """Requests without a game or a time, with the status they are answered with."""
    return with_keys(requests).where(~complete(requests)).withColumn("status", F.lit(STATUS_MISSING_GAME))
