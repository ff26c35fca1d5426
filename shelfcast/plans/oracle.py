"""The registered queries as plain SQL over the supplied tables, for another engine.

Written from the semantics, not from the Spark code: the period rule is a
recursive walk here, the codes are ranks, the candidates are joined outright.
"""

from __future__ import annotations

# Named subqueries, each after those it needs.
PARTS: dict[str, tuple[list[str], str]] = {
    "requests": (
        [],
        """
        SELECT event_id AS request_id, CASE WHEN event_id % 89 <> 0 THEN ts END AS ts,
               CASE WHEN event_id % 97 = 0 THEN ''
                    ELSE (CASE WHEN event_id % 3 = 0 THEN 'GAME ' ELSE 'Game ' END)
                         || CAST(CASE WHEN event_id % 2 = 0 THEN k % 5 ELSE k END AS VARCHAR) END AS raw_game,
               CASE event_type WHEN 'view' THEN 'epic' WHEN 'click' THEN 'gamepass'
                               WHEN 'signup' THEN 'psplus' WHEN 'purchase' THEN 'humble' END AS raw_platform,
               CASE WHEN user_id % 5 = 0
                    THEN CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN '::1, 172.16.0.1' WHEN 3 THEN 'localhost:3000' END
                    ELSE (CASE WHEN event_id % 10 = 0 THEN ' ' ELSE '' END) || '10.0.0.'
                         || CAST(user_id % 5 AS VARCHAR) || ', 172.16.0.1' END AS forwarded_for,
               '127.0.0.1' AS remote_addr,
               'Brand#' || CAST(1 + k % 25 AS VARCHAR) AS publisher,
               CASE WHEN k % 4 <> 0 THEN 50.0 + k % 50 END AS metacritic_score,
               CASE WHEN k % 10 <> 0 THEN DATE '2023-01-01' + k END AS release_date,
               CASE WHEN event_id % 7 = 0 THEN 'fail' WHEN event_id % 11 = 0 THEN 'soft_error' ELSE 'ok' END AS outcome
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events)
        """,
    ),
    "named": (
        ["requests"],
        """
        SELECT *, lower(game) AS game_key,
               (client_ip IS NULL OR client_ip IN ('', '::1', '127.0.0.1') OR contains(client_ip, 'localhost')) AS is_local
        FROM (SELECT *, raw_game AS game, coalesce(nullif(raw_platform, ''), 'any') AS platform,
                     coalesce(nullif(split_part(forwarded_for, ',', 1), ''), remote_addr) AS client_ip
              FROM requests)
        WHERE game <> '' AND ts IS NOT NULL
        """,
    ),
    # -- one vote per client, game, platform and hour
    "vote_steps": (
        ["{votes_from}"],
        """
        SELECT a.client_ip, a.game_key, a.platform, a.ts, a.id, b.id AS next_id
        FROM (SELECT client_ip, game_key, platform, ts, min(request_id) AS id
              FROM {votes_from} WHERE NOT is_local GROUP BY ALL) a
        ASOF LEFT JOIN (SELECT client_ip, game_key, platform, ts, min(request_id) AS id
                        FROM {votes_from} WHERE NOT is_local GROUP BY ALL) b
          ON a.client_ip = b.client_ip AND a.game_key = b.game_key AND a.platform = b.platform
             AND a.ts + INTERVAL 1 HOUR <= b.ts
        """,
    ),
    "vote_chain": (
        ["vote_steps"],
        """
        SELECT id, next_id FROM (SELECT *, row_number() OVER (PARTITION BY client_ip, game_key, platform ORDER BY ts) AS n
                                 FROM vote_steps) WHERE n = 1
        UNION ALL
        SELECT s.id, s.next_id FROM vote_chain c JOIN vote_steps s ON s.id = c.next_id
        """,
    ),
    "votes": (
        ["vote_chain"],
        """
        SELECT * FROM {votes_from} WHERE is_local OR request_id IN (SELECT id FROM vote_chain)
        """,
    ),
    "board": (["votes"], "SELECT game, platform, count(*) AS score FROM votes GROUP BY game, platform"),
    # -- a stored result answers for a day
    "store_steps": (
        ["{cache_from}"],
        """
        SELECT a.game_key, a.platform, a.ts, a.id, b.id AS next_id
        FROM (SELECT game_key, platform, ts, min(request_id) AS id
              FROM {cache_from} WHERE outcome = 'ok' GROUP BY ALL) a
        ASOF LEFT JOIN (SELECT game_key, platform, ts, min(request_id) AS id
                        FROM {cache_from} WHERE outcome = 'ok' GROUP BY ALL) b
          ON a.game_key = b.game_key AND a.platform = b.platform AND a.ts + INTERVAL 24 HOUR <= b.ts
        """,
    ),
    "store_chain": (
        ["store_steps"],
        """
        SELECT game_key, platform, ts, id, next_id
        FROM (SELECT *, row_number() OVER (PARTITION BY game_key, platform ORDER BY ts) AS n FROM store_steps) WHERE n = 1
        UNION ALL
        SELECT s.game_key, s.platform, s.ts, s.id, s.next_id FROM store_chain c JOIN store_steps s ON s.id = c.next_id
        """,
    ),
    "sourced": (
        ["store_chain"],
        """
        SELECT r.*, CASE WHEN r.ts < s.ts + INTERVAL 24 HOUR THEN s.id END AS stored_by,
               CASE WHEN r.ts < s.ts + INTERVAL 24 HOUR AND s.id <> r.request_id THEN 'cache_hit'
                    WHEN r.outcome = 'fail' THEN 'error' ELSE 'cache_miss' END AS source
        FROM {cache_from} r ASOF LEFT JOIN store_chain s
          ON r.game_key = s.game_key AND r.platform = s.platform AND r.ts >= s.ts
        """,
    ),
    "cache": (
        ["named"],
        """
        SELECT key, data,
               CASE key WHEN 'predict:game 1:gamepass' THEN TIMESTAMP '2024-01-30 00:00:00'
                        WHEN 'rate_limit:10.0.0.1:game 1:gamepass' THEN TIMESTAMP '2024-01-30 23:00:00'
                        WHEN 'predict:game 2:epic' THEN NULL
                        ELSE created_at END - to_hours(h) AS created_at
        FROM (SELECT key, data, created_at, row_number() OVER (PARTITION BY key ORDER BY created_at DESC, data DESC) AS n
              FROM (SELECT 'predict:' || game_key || ':' || platform AS key,
                           '{{"request_id":' || CAST(request_id AS VARCHAR) || '}}' AS data, ts AS created_at
                    FROM named WHERE outcome = 'ok'
                    UNION ALL
                    SELECT 'rate_limit:' || client_ip || ':' || game_key || ':' || platform,
                           '{{"type":"rate_limit"}}', ts
                    FROM named WHERE NOT is_local)) c
        JOIN (VALUES (0), (1)) copies(h)
          ON h = 0 OR key IN ('predict:game 0:epic', 'rate_limit:10.0.0.1:game 0:epic')
        WHERE n = 1
        """,
    ),
    "single": (
        ["cache"],
        "SELECT key, min(data) AS data, min(created_at) AS created_at FROM cache GROUP BY key HAVING count(*) = 1",
    ),
    # -- catalogue and history
    "raw_items": (
        [],
        """
        SELECT item_id AS game_id, p_name || ' #' || CAST(item_id AS VARCHAR) AS name,
               CASE WHEN item_id % 13 = 0 THEN 'Unknown' WHEN item_id % 29 = 0 THEN NULL ELSE p_brand END AS publisher,
               CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE (50.0 + p_size)::DOUBLE END AS score,
               CASE WHEN item_id % 2 = 0 THEN p_size::DOUBLE / 10.0::DOUBLE END AS rating,
               (item_id * 37) % 2000 AS reviews_count,
               CASE WHEN item_id % 17 <> 0 THEN DATE '1994-01-01' + CAST((item_id * 37) % 365 AS INTEGER) END AS released,
               CASE item_id % 4
                   WHEN 1 THEN 'https://media.rawg.io/media/crop/600/400/games/' || CAST(item_id AS VARCHAR) || '.jpg'
                   WHEN 2 THEN 'https://media.rawg.io/media/crop/600/400/games/' || CAST(item_id AS VARCHAR) || '.jpg'
                   WHEN 3 THEN 'https://images.example.org/' || CAST(item_id AS VARCHAR) || '.jpg'
                   ELSE '' END AS image,
               CASE WHEN item_id % 6 > 1
                    THEN CASE item_id % 4 WHEN 0 THEN 'epic' WHEN 1 THEN 'epic,gamepass'
                                            WHEN 2 THEN 'epic,gamepass,psplus' ELSE 'epic,gamepass,psplus,humble' END
               END AS platforms
        FROM (SELECT *, p_partkey * 8 + edition AS item_id FROM part CROSS JOIN range(1, 8) e(edition))
        """,
    ),
    "items": (
        ["raw_items"],
        """
        SELECT *, CAST(coalesce(year(released), 2024) AS INTEGER) AS release_year,
               CAST(coalesce(month(released), 1) AS INTEGER) AS release_month,
               CASE WHEN value <> 0 THEN floor(value * 100 + 0.5) / 100 ELSE value END AS metacritic
        FROM (SELECT *, CASE WHEN coalesce(score, 0) <> 0 THEN score
                             WHEN coalesce(rating, 0) <> 0 THEN rating * 20
                             WHEN reviews_count > 1000 THEN 75.0::DOUBLE ELSE score END AS value
              FROM raw_items)
        """,
    ),
    "seen": (
        [],
        """
        SELECT DISTINCT l_partkey * 8 + l_linenumber AS game_id,
               CASE l_suppkey % 4 WHEN 0 THEN 'epic' WHEN 1 THEN 'gamepass' WHEN 2 THEN 'psplus' ELSE 'humble' END AS platform,
               CAST(l_shipdate AS DATE) AS appeared_on
        FROM lineitem
        """,
    ),
    "waited": (
        ["items", "seen"],
        """
        SELECT s.game_id, s.platform, i.publisher, i.metacritic, min(date_diff('day', i.released, s.appeared_on)) AS days
        FROM seen s JOIN items i USING (game_id) WHERE i.publisher IS NOT NULL AND i.released IS NOT NULL GROUP BY ALL
        """,
    ),
    "platform_stats": (
        ["waited"],
        """
        SELECT publisher, platform, count(*) AS games_count, avg(days) AS avg_wait_days, avg(metacritic) AS avg_score,
               CASE WHEN avg(days) <> 0 THEN stddev_samp(days) / abs(avg(days)) END AS consistency
        FROM waited GROUP BY publisher, platform
        """,
    ),
    "stats": (
        ["waited"],
        """
        SELECT number + 1000 * copy AS ordinal, publisher AS primary_publisher,
               CASE number WHEN 7 THEN NULL WHEN 8 THEN 0.0::DOUBLE ELSE days END + 100 * copy AS avg_days_to_epic,
               n + copy AS games_count, score + copy AS avg_metacritic
        FROM (SELECT publisher, CAST(split_part(publisher, '#', 2) AS BIGINT) AS number,
                     count(*) AS n, avg(days) AS days, avg(metacritic) AS score
              FROM waited
              WHERE platform = 'epic' AND publisher LIKE 'Brand#%' AND publisher NOT IN ('Brand#24', 'Brand#25')
              GROUP BY publisher)
        JOIN (VALUES (0), (1)) copies(copy) ON copy = 0 OR number % 3 = 0
        """,
    ),
    "first_stats": (
        ["stats"],
        """
        SELECT primary_publisher, avg_days_to_epic, games_count, avg_metacritic
        FROM (SELECT *, row_number() OVER (PARTITION BY primary_publisher ORDER BY ordinal) AS n FROM stats) WHERE n = 1
        """,
    ),
    "codes": (
        ["stats"],
        """
        SELECT DISTINCT primary_publisher AS label,
               dense_rank() OVER (ORDER BY primary_publisher) - 1 AS code
        FROM stats WHERE primary_publisher <> 'Brand#23'
        """,
    ),
    "publishers": (
        ["first_stats", "codes"],
        """
        SELECT f.*, c.code,
               CASE WHEN c.code IS NULL OR f.avg_days_to_epic IS NULL THEN 'failed' ELSE 'known' END AS path
        FROM first_stats f LEFT JOIN codes c ON f.primary_publisher = c.label
        """,
    ),
    "judged": (
        ["named", "publishers"],
        """
        SELECT n.* REPLACE (CASE WHEN p.path = 'failed' THEN 'fail' ELSE n.outcome END AS outcome)
        FROM named n LEFT JOIN publishers p ON n.publisher = p.primary_publisher
        """,
    ),
    "voters": (
        ["sourced"],
        "SELECT * FROM sourced WHERE source = 'cache_hit' OR (source = 'cache_miss' AND outcome = 'ok')",
    ),
    # inputs of the estimate: catalogue items, or requests that stored a result
    "scored_items": (
        ["items"],
        "SELECT game_id AS row_id, name, publisher, score, release_year, release_month FROM items",
    ),
    "scored_requests": (
        ["sourced"],
        """
        SELECT request_id AS row_id, game AS name, publisher, metacritic_score AS score,
               coalesce(year(release_date), 2024) AS release_year, coalesce(month(release_date), 1) AS release_month
        FROM sourced WHERE stored_by = request_id
        """,
    ),
    "features": (
        ["publishers", "{estimated}"],
        """
        SELECT e.*, coalesce(p.path, 'unknown') AS path, p.code, p.games_count, p.avg_days_to_epic AS avg_days,
               p.avg_metacritic AS avg_meta, coalesce(e.score, p.avg_metacritic) AS filled,
               CASE WHEN p.primary_publisher IS NOT NULL
                    THEN CASE WHEN p.avg_days_to_epic IS NULL OR p.avg_days_to_epic = 0 THEN 0.5::DOUBLE
                              ELSE 1 / (p.avg_days_to_epic / 365) END END AS speed
        FROM {estimated} e LEFT JOIN publishers p ON e.publisher = p.primary_publisher
        """,
    ),
    "timed": (
        ["features"],
        """
        SELECT *, CASE path WHEN 'known' THEN avg_days / 365
                            WHEN 'unknown' THEN (SELECT avg(avg_days_to_epic) FROM stats) / 365 END AS years
        FROM features
        """,
    ),
    "parts_of_time": (
        ["timed"],
        """
        SELECT *, CAST(trunc(years) AS INTEGER) AS yw, CAST(trunc((years - trunc(years)) * 12) AS INTEGER) AS mw,
               CASE path WHEN 'known' THEN greatest(years * 0.85::DOUBLE, 0.1::DOUBLE) WHEN 'unknown' THEN 0.0 END AS lo,
               CASE path WHEN 'known' THEN years * 1.15::DOUBLE WHEN 'unknown' THEN 0.0 END AS hi,
               CASE path WHEN 'known' THEN games_count WHEN 'unknown' THEN 0 END AS known_games,
               CAST(trunc(avg_days / 365) AS INTEGER) AS ay,
               CAST(trunc((avg_days - 365 * floor(avg_days / 365)) / 30) AS INTEGER) AS am
        FROM timed
        """,
    ),
    "estimates": (
        ["parts_of_time"],
        """
        SELECT *, CASE path
            WHEN 'known' THEN
                'Based on the publisher ''' || publisher || ''', which has released ' || games_count || ' game'
                || CASE WHEN games_count <> 1 THEN 's' ELSE '' END
                || ' on Epic Games Store with an average wait time of ' || ay || ' year'
                || CASE WHEN ay <> 1 THEN 's' ELSE '' END || ' and ' || am || ' month'
                || CASE WHEN am <> 1 THEN 's' ELSE '' END || ' (averaging a Metacritic score of '
                || coalesce(printf('%.1f', floor(avg_meta * 10 + 0.5) / 10), 'nan') || '), and considering '''
                || name || ''' '
                || CASE WHEN score IS NULL THEN 'without an available Metacritic score'
                        ELSE 'with a Metacritic score of '
                             || CASE WHEN score = floor(score) THEN CAST(CAST(score AS BIGINT) AS VARCHAR)
                                     ELSE CAST(score AS VARCHAR) END END
                || ', the model estimates it will appear free on Epic Games Store approximately ' || yw || ' year'
                || CASE WHEN yw <> 1 THEN 's' ELSE '' END || ' and ' || mw || ' month'
                || CASE WHEN mw <> 1 THEN 's' ELSE '' END || ' after release, with a confidence interval between '
                || printf('%.1f', floor(lo * 10 + 0.5) / 10) || ' and ' || printf('%.1f', floor(hi * 10 + 0.5) / 10)
                || ' years.'
            WHEN 'unknown' THEN
                'Based on the publisher ''' || coalesce(publisher, 'None')
                || ''', which has no historical data in our Epic Games dataset, we cannot make a reliable prediction. '
                || 'Industry average suggests approximately ' || yw || ' years and ' || mw || ' months.'
            END AS sentence
        FROM parts_of_time
        """,
    ),
    "history": (
        ["seen"],
        """
        SELECT game_id, platform, count(*) AS occurrences, max(appeared_on) AS last_on, avg(gap) AS mean_gap
        FROM (SELECT *, date_diff('day', lag(appeared_on) OVER (PARTITION BY game_id, platform ORDER BY appeared_on),
                                  appeared_on) AS gap FROM seen)
        GROUP BY game_id, platform
        """,
    ),
    "offers": (
        ["items"],
        "SELECT i.*, platform FROM items i JOIN (VALUES ('epic'), ('gamepass'), ('psplus'), ('humble')) v(platform) ON true",
    ),
    "tiers": (
        ["offers", "history", "platform_stats"],
        """
        SELECT o.game_id, o.platform, o.metacritic, h.last_on, h.mean_gap, coalesce(h.occurrences, 0) AS n,
               s.avg_wait_days AS wait, s.games_count, s.consistency AS cv,
               CASE WHEN o.platform = 'humble' AND h.occurrences >= 1 THEN 'D. Humble Choice Rules'
                    WHEN h.occurrences >= 2 THEN 'A. Historical Lookup'
                    WHEN (o.publisher = 'Brand#1' AND o.platform = 'gamepass')
                      OR (o.publisher = 'Brand#2' AND o.platform = 'psplus') THEN 'C. First-Party Check'
                    ELSE 'B. Model' END AS tier,
               date_diff('day', DATE '2001-12-01', h.last_on) + h.mean_gap AS repeat_days,
               date_diff('day', DATE '2001-12-01', coalesce(o.released, DATE '2001-12-01')) + s.avg_wait_days AS model_days
        FROM offers o LEFT JOIN history h USING (game_id, platform)
             LEFT JOIN platform_stats s ON o.publisher = s.publisher AND o.platform = s.platform
        """,
    ),
    "tier_times": (
        ["tiers"],
        """
        SELECT *, CASE WHEN days < 0 THEN 0 ELSE days END AS remaining,
               CASE WHEN days < 0 THEN 0 ELSE days END / 30 AS months,
               CASE tier WHEN 'D. Humble Choice Rules' THEN CASE WHEN repeat_days < 0 THEN 0 ELSE repeat_days END / 30 END
                   AS theoretical,
               CAST(floor(wait + 0.5) AS BIGINT) AS wait_text,
               coalesce(CAST(floor(100 * (1 - least(cv, 1.0)) + 0.5) AS INTEGER), 0) AS confidence
        FROM (SELECT *, CASE WHEN tier = 'A. Historical Lookup' THEN repeat_days
                             WHEN tier = 'B. Model' OR (tier = 'C. First-Party Check' AND platform <> 'gamepass') THEN model_days END AS days
              FROM tiers)
        """,
    ),
}


def with_parts(final: str, *needed: str, **inputs: str) -> str:
    """``final`` after the named subqueries it needs; ``inputs`` replace the usual inputs of some."""
    inputs = {"votes_from": "named", "cache_from": "named", "estimated": "scored_items", **inputs}
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for before in PARTS[name][0]:
                visit(before.format(**inputs))
            order.append(name)

    for name in needed:
        visit(name)
    parts = ",\n".join(f"{name} AS ({PARTS[name][1].format(**inputs)})" for name in order)
    return f"WITH RECURSIVE {parts}\n{final}"


def month_text(months: str) -> str:
    return (
        f"(CASE WHEN floor({months} / 12) > 0 THEN CAST(CAST(floor({months} / 12) AS BIGINT) AS VARCHAR) || 'y ' ELSE '' END"
        f" || CAST(CAST(floor({months} - 12 * floor({months} / 12) + 0.5) AS BIGINT) AS VARCHAR) || 'm')"
    )


SHORT_NAME = (
    "CASE platform WHEN 'epic' THEN 'Epic' WHEN 'gamepass' THEN 'Xbox' WHEN 'psplus' THEN 'PS Plus' "
    "WHEN 'humble' THEN 'Humble' ELSE platform END"
)
FULL_NAME = (
    "CASE platform WHEN 'epic' THEN 'Epic Games Store' WHEN 'gamepass' THEN 'Xbox Game Pass Ultimate' "
    "WHEN 'psplus' THEN 'PlayStation Plus Extra' WHEN 'humble' THEN 'Humble Choice (Monthly)' END"
)
VOTES = "SELECT request_id, client_ip, game, platform FROM votes"
SOURCES = "SELECT request_id, source, stored_by FROM sourced"
BOARD = "SELECT game, platform, count(*) AS score FROM named GROUP BY game, platform"

TITLES = """
WITH asked AS (
  SELECT p_partkey AS query_id,
         CASE WHEN p_partkey % 50 = 0 THEN '   ' WHEN p_partkey % 5 = 0 THEN upper(p_name)
              WHEN p_partkey % 5 = 1 THEN '  ' || split_part(p_name, ' ', 1) || '   ' || split_part(p_name, ' ', 2)
              WHEN p_partkey % 5 = 2 THEN p_name || ' deluxe' WHEN p_partkey % 5 = 3 THEN split_part(p_name, ' ', 2)
              ELSE split_part(p_name, ' ', 1) || ' #' || CAST(p_partkey AS VARCHAR) END AS query
  FROM part),
titles AS (
  SELECT p_partkey * 8 + e AS game_id, p_name || ' #' || CAST(p_partkey * 8 + e AS VARCHAR) AS name
  FROM part, range(1, 8) AS editions(e)),
query_words AS (
  SELECT DISTINCT query_id, word
  FROM (SELECT query_id, unnest(string_split_regex(lower(query), '\\s+')) AS word FROM asked) WHERE word <> ''),
title_words AS (
  SELECT DISTINCT game_id, name, word
  FROM (SELECT game_id, name, unnest(string_split_regex(lower(name), '\\s+')) AS word FROM titles) WHERE word <> ''),
sizes AS (SELECT game_id, count(*) AS n_words FROM title_words GROUP BY game_id),
found AS (
  SELECT query_id, game_id, name, count(*) AS shared
  FROM query_words JOIN title_words USING (word) GROUP BY query_id, game_id, name)
SELECT query_id, rank, game_id, name, shared
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, n_words, length(name), game_id) AS rank
      FROM found JOIN sizes USING (game_id))
WHERE rank <= 5
"""


def statements() -> dict[str, str]:
    lookup = """
        SELECT r.request_id, {key} AS {name}, coalesce(TIMESTAMP '2024-01-31 00:00:00' - s.created_at < {period}, false) AS {flag}{more}
        FROM named r LEFT JOIN single s ON {key} = s.key AND s.key LIKE '{prefix}:%' WHERE {only}
    """
    result_key = "'predict:' || r.game_key || ':' || r.platform"
    cooldown_key = "'rate_limit:' || r.client_ip || ':' || r.game_key || ':' || r.platform"
    votes = with_parts(VOTES, "votes")
    sources = with_parts(SOURCES, "sourced")
    estimate = """
        SELECT row_id AS game_id, {first}round(years, 6) AS predicted_years, yw AS years_whole, mw AS months_whole,
               round(lo, 6) AS lower_bound_years, round(hi, 6) AS upper_bound_years, sentence{last}
        FROM estimates
    """

    found = {
        "requests_normalised": with_parts(
            """
            SELECT request_id, game, platform, client_ip, is_local, 'predict:' || game_key || ':' || platform AS result_key,
                   'rate_limit:' || client_ip || ':' || game_key || ':' || platform AS cooldown_key FROM named
            """,
            "named",
        ),
        "requests_rejected": with_parts(
            "SELECT request_id, CAST(400 AS INTEGER) AS status FROM requests WHERE raw_game = '' OR ts IS NULL", "requests"
        ),
        "requests_on_platforms": with_parts(
            f"""
            SELECT request_id, platform, {FULL_NAME} AS name, {SHORT_NAME} AS short_name
            FROM named WHERE platform IN ('epic', 'gamepass', 'psplus', 'humble')
            """,
            "named",
        ),
        "votes_accepted": votes,
        "votes_accepted_in_cells": votes,
        "stream_votes": votes,
        "stream_votes_in_cells": votes,
        "cache_outcome": sources,
        "cache_outcome_in_cells": sources,
        "stream_cache_outcome": sources,
        "leaderboard_global": with_parts(
            f"""
            SELECT 'Global' AS platform, rank, game, score, breakdown_text
            FROM (SELECT game, CAST(sum(score) AS BIGINT) AS score,
                         row_number() OVER (ORDER BY sum(score) DESC, game) AS rank,
                         string_agg({SHORT_NAME} || ': ' || CAST(score AS VARCHAR), ', ' ORDER BY platform) AS breakdown_text
                  FROM board GROUP BY game) WHERE rank <= 10
            """,
            "board",
            votes_from="voters",
        ),
        "leaderboard_platform": with_parts(
            """
            SELECT 'epic' AS platform, rank, game, score, '' AS breakdown_text
            FROM (SELECT *, row_number() OVER (ORDER BY score DESC, game) AS rank FROM board WHERE platform = 'epic')
            WHERE rank <= 10
            """,
            "board",
            votes_from="voters",
        ),
        "leaderboard_all_platforms": with_parts(
            f"""
            SELECT platform, {SHORT_NAME} AS short_name, rank, game, score
            FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY score DESC, game) AS rank FROM board)
            WHERE rank <= 10 AND platform <> 'any'
            """,
            "board",
            votes_from="voters",
        ),
        "leaderboard_merge": with_parts("SELECT game, platform, score FROM board", "board", votes_from="voters"),
        **dict.fromkeys(("cache_upsert_latest", "stream_cache_upsert"), with_parts(
            """
            SELECT key, data, epoch_us(ts) AS created_us
            FROM (SELECT 'predict:' || game_key || ':' || platform AS key, ts,
                         '{"request_id":' || CAST(request_id AS VARCHAR) || '}' AS data,
                         row_number() OVER (PARTITION BY game_key, platform ORDER BY ts DESC, request_id DESC) AS n
                  FROM named WHERE outcome = 'ok') WHERE n = 1
            """,
            "named",
        )),
        "cache_expire": with_parts(
            """
            SELECT key, data, epoch_us(created_at) AS created_us FROM cache
            WHERE coalesce(NOT created_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR, true)
            """,
            "cache",
        ),
        "cache_expire_summary": with_parts(
            """
            SELECT true AS success, 'Deleted ' || CAST(count(*) AS VARCHAR) || ' expired entries' AS message,
                   count(*) AS deleted, epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS at_us
            FROM cache WHERE created_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR
            """,
            "cache",
        ),
        "cache_lookup_snapshot": with_parts(
            lookup.format(
                key=result_key, name="result_key", flag="fresh", period="INTERVAL 24 HOUR", prefix="predict", only="true",
                more=", CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - s.created_at < INTERVAL 24 HOUR "
                "THEN replace(s.data, '}', ',\"source\":\"cache_hit\"}') END AS response",
            ),
            "single",
        ),
        "cooldown_lookup_snapshot": with_parts(
            lookup.format(
                key=cooldown_key, name="cooldown_key", flag="blocked", period="INTERVAL 1 HOUR", prefix="rate_limit",
                only="NOT r.is_local", more="",
            ),
            "single",
        ),
        "catalogue_enriched": with_parts(
            """
            SELECT game_id, name, publisher, metacritic, release_year, release_month, platforms, image,
                   CASE WHEN coalesce(metacritic, 0) = 0 THEN 'N/A'
                        WHEN metacritic = floor(metacritic) THEN CAST(CAST(metacritic AS BIGINT) AS VARCHAR)
                        ELSE CAST(metacritic AS VARCHAR) END AS score_text,
                   coalesce(CAST(released AS VARCHAR), 'Unknown') AS released_text
            FROM items
            """,
            "items",
        ),
        "manual_entries": with_parts(
            """
            SELECT game_id, name, publisher, metacritic, platforms, coalesce(CAST(released AS VARCHAR), 'Unknown') AS released_text
            FROM items
            UNION ALL
            SELECT NULL, 'Title ' || CAST(s_suppkey AS VARCHAR), s_name, 75.0::DOUBLE, NULL, 'Unknown'
            FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0
            """,
            "items",
        ),
        "title_candidates": TITLES,
        "title_candidates_hot_words": TITLES,
        "publisher_stats": with_parts(
            """
            SELECT publisher, platform, games_count, round(avg_wait_days, 6) AS avg_wait_days,
                   round(avg_score, 6) AS avg_score, round(consistency, 6) AS consistency FROM platform_stats
            """,
            "platform_stats",
        ),
        "publisher_first_match": with_parts(
            """
            SELECT primary_publisher, round(avg_days_to_epic, 6) AS avg_days_to_epic, games_count,
                   round(avg_metacritic, 6) AS avg_metacritic FROM first_stats
            """,
            "first_stats",
        ),
        "publisher_codes": with_parts("SELECT label, code FROM codes", "codes"),
        "title_codes": with_parts(
            "SELECT DISTINCT name AS label, dense_rank() OVER (ORDER BY name) - 1 AS code FROM raw_items", "raw_items"
        ),
        "appearance_gaps": with_parts(
            """
            SELECT game_id, platform, CAST(appeared_on AS VARCHAR) AS appeared_on,
                   CAST(date_diff('day', lag(appeared_on) OVER (PARTITION BY game_id, platform ORDER BY appeared_on),
                                  appeared_on) AS INTEGER) AS gap_days FROM seen
            """,
            "seen",
        ),
        "history_summary": with_parts(
            """
            SELECT game_id, platform, occurrences, CAST(last_on AS VARCHAR) AS last_on, round(mean_gap, 6) AS mean_gap_days
            FROM history
            """,
            "history",
        ),
        "never_appeared": with_parts(
            """
            SELECT game_id, platform FROM offers o
            WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.game_id = o.game_id AND s.platform = o.platform)
            """,
            "offers", "seen",
        ),
        "already_appeared": with_parts(
            """
            SELECT game_id, platform FROM offers o
            WHERE EXISTS (SELECT 1 FROM seen s WHERE s.game_id = o.game_id AND s.platform = o.platform)
            """,
            "offers", "seen",
        ),
        "feature_rows": with_parts(
            """
            SELECT row_id AS game_id, path, round(filled, 6) AS metacritic_filled,
                   CAST(CASE WHEN score IS NULL THEN 0 ELSE 1 END AS INTEGER) AS has_metacritic,
                   release_year, release_month, CAST(1 AS INTEGER) AS num_publishers, CAST(1 AS INTEGER) AS num_developers,
                   games_count, round(avg_days, 6) AS avg_days_to_epic, round(speed, 6) AS publisher_speed_score,
                   code AS publisher_encoded
            FROM features
            """,
            "features",
        ),
        "estimate_postprocessed": with_parts(
            estimate.format(first="name, publisher, ", last=", CAST(known_games AS BIGINT) AS publisher_game_count"),
            "estimates",
        ),
        "estimate_json": with_parts(estimate.format(first="", last=""), "estimates"),
        "tiered_estimate": with_parts(TIERED, "tier_times"),
        "request_pipeline": with_parts(
            PIPELINE, "votes", "estimates", votes_from="voters", cache_from="judged", estimated="scored_requests"
        ),
    }
    found["request_pipeline_board"] = with_parts(
        "SELECT game, platform, score FROM board", "board", votes_from="voters", cache_from="judged"
    )
    found["request_pipeline_cache"] = with_parts(
        """
        SELECT c.game_key, c.platform, c.id, epoch_us(c.ts) AS at_us, round(e.years, 6) AS predicted_years, e.sentence
        FROM (SELECT *, row_number() OVER (PARTITION BY game_key, platform ORDER BY ts DESC) AS n FROM store_chain) c
             JOIN estimates e ON e.row_id = c.id
        WHERE n = 1
        """,
        "store_chain", "estimates", cache_from="judged", estimated="scored_requests",
    )
    # the same rows, by way of landed files or batch by batch
    landed = {
        "request_pipeline_batches": "request_pipeline",
        "stream_leaderboard": "request_pipeline_board",
        "requests_from_json": "requests_normalised",
        "stats_from_csv": "publisher_first_match",
        "appearances_from_csv": "history_summary",
        "catalogue_from_json": "catalogue_enriched",
    }
    return found | {name: found[same] for name, same in landed.items()}


TIERED = f"""
SELECT game_id, platform, tier, category,
       CASE WHEN lower(category) LIKE '%within 6 months%' THEN 'bg-green-500'
            WHEN lower(category) LIKE '%6-12 months%' THEN 'bg-blue-500'
            WHEN lower(category) LIKE '%more than 12 months%' THEN 'bg-yellow-500'
            WHEN lower(category) LIKE '%more than 24 months%' THEN 'bg-orange-500'
            ELSE 'bg-gray-500' END AS category_band,
       CASE tier WHEN 'D. Humble Choice Rules' THEN 'Seen on ' || CAST(last_on AS VARCHAR) || '; items do not return here.'
                 WHEN 'A. Historical Lookup' THEN 'Seen ' || n || ' times, on average every '
                      || CAST(floor(mean_gap + 0.5) AS BIGINT) || ' days.'
                 WHEN 'C. First-Party Check' THEN 'Published by the owner of the service.'
                 ELSE coalesce('The publisher''s items wait ' || wait_text || ' days on average.',
                               'No history of the publisher on this service.') END AS reasoning,
       confidence,
       CASE WHEN confidence >= 80 THEN 'bg-green-500' WHEN confidence >= 60 THEN 'bg-blue-500'
            WHEN confidence >= 40 THEN 'bg-yellow-500' WHEN confidence >= 20 THEN 'bg-orange-500'
            ELSE 'bg-red-500' END AS confidence_band,
       CASE WHEN confidence >= 80 THEN 'High confidence' WHEN confidence >= 60 THEN 'Moderate confidence'
            ELSE 'Low confidence' END AS confidence_word,
       CAST(last_on AS VARCHAR) AS last_appearance_date,
       round(theoretical, 6) AS theoretical_wait_time, {month_text("theoretical")} AS theoretical_wait_text,
       CAST(DATE '2001-12-01' + CAST(ceil(remaining) AS INTEGER) AS VARCHAR) AS projected_arrival,
       CASE tier WHEN 'B. Model' THEN round(wait, 6) END AS predicted_total_days,
       CASE tier WHEN 'B. Model' THEN wait_text END AS predicted_total_text,
       round(wait, 6) AS publisher_avg_wait_days, wait_text AS publisher_avg_wait_text,
       metacritic AS metacritic_score_used, round(months, 6) AS predicted_months,
       CASE WHEN months > 0 THEN {month_text("months")} END AS predicted_months_text,
       coalesce(games_count, 0) AS publisher_game_count, n AS sample_size,
       round(cv, 6) AS publisher_consistency, printf('%.2f', floor(cv * 100 + 0.5) / 100) AS publisher_consistency_text,
       coalesce(date_diff('day', last_on, DATE '2001-12-01') <= 365, false) AS recently_appeared,
       coalesce(date_diff('day', last_on, DATE '2001-12-01') <= 365, false) AND platform <> 'epic' AS recent_warning
FROM (SELECT *,
             CASE tier WHEN 'D. Humble Choice Rules' THEN 'Very Unlikely'
                       ELSE CASE WHEN tier = 'C. First-Party Check' AND platform = 'gamepass' THEN 'Within 12-24 months'
                                 WHEN months <= 6 THEN 'Within 6 months' WHEN months <= 12 THEN '6-12 months'
                                 WHEN months <= 24 THEN 'More than 12 months'
                                 WHEN months IS NULL THEN 'Unknown' ELSE 'More than 24 months' END END AS category
      FROM tier_times)
"""


PIPELINE = """
SELECT s.request_id, CAST(CASE s.source WHEN 'error' THEN 500 ELSE 200 END AS INTEGER) AS status, s.game, s.platform,
       s.source, s.stored_by, round(e.years, 6) AS predicted_years, e.yw AS years_whole, e.mw AS months_whole,
       e.sentence, s.request_id IN (SELECT request_id FROM votes) AS voted
FROM sourced s LEFT JOIN estimates e ON s.stored_by = e.row_id AND (s.source = 'cache_hit' OR s.stored_by = s.request_id)
UNION ALL
SELECT request_id, 400, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM requests WHERE raw_game = '' OR ts IS NULL
"""
