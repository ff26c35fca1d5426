"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    exact_dedup,
    html_text,
    language_model,
    lexical_search,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    sharding,
    source_audit,
    token_counts,
    token_shards,
    vector_search,
)
from shelfcast.session import new_path

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 16


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    return sharding.sharded(docs, SHARDS, new_path(spark, "slot-map")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


ORACLE["op4_line_dedup"] = """
WITH lines AS (
    SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), starts AS (
    SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM lines
), found AS (
    SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w FROM starts
    WHERE trim(l[i + 1]) <> '' OR trim(l[i + 2]) <> '' OR trim(l[i + 3]) <> ''
), ranked AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM found
), gone AS (
    SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS line FROM ranked WHERE nth > 1
), lists AS (
    SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_filter(l, lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text,
       CAST(len(l) AS INTEGER) AS n_lines,
       CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed
FROM lines LEFT JOIN lists USING (doc_id)
"""


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = r"""
WITH plain AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM plain
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed, with targets halfway between the sources' sizes and equal shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, rows=False).select("doc_id", "source", "block", "slot", "position")


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token shards in training order, the records read back from the files: a row per piece of a document."""
    out = new_path(spark, "token-shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), out, seed=20_240_607)
    size = F.lit(token_shards.layout(spark, out).record_bytes).alias("stride_bytes")
    records = token_shards.read_shards(spark, out).select("slot", "shard", "byte_offset", F.crc32("ids").alias("record_crc32"))
    pieces = token_shards.read_pieces(spark, out).drop("record_crc32")
    return pieces.join(records, "slot").select(
        "slot", "shard", "byte_offset", size, "doc_id", "start", "offset", "n_tokens", "record_crc32"
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


@query
def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows to every twentieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that people judged good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of all that were judged good."""
    found = language_model.perplexities(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return found.select(
        "doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), "step", "limit", "trusted", "kept"
    )


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in the byte-level vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between all sources of a language, and the terms that each source overuses."""
    return source_audit.divergence(table(spark, sf_dir, "documents"))


SMALL_LETTERS = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op12_source_audit"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all({SMALL_LETTERS.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs
), found AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS lang_n FROM found GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term
), vocabulary AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang
), every AS (
    SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n,
           1 + (1000000000 * (n + 5)) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS BIGINT) + 5 * v) AS p,
           1 + (1000000000 * (lang_n + 5)) // (CAST(total AS BIGINT) + 5 * v) AS q
    FROM every JOIN vocabulary USING (lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), listed AS (
    SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM listed
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_lexical_search"] = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, doc_id,
           regexp_extract_all({SMALL_LETTERS.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sizes AS (SELECT doc, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes
), found AS (SELECT doc, unnest(terms) AS term FROM docs
), tf AS (SELECT doc, term, count(*) AS tf FROM found GROUP BY doc, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, corpus GROUP BY term
), items AS (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all({SMALL_LETTERS.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), asked AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY item, item_id, term
), scored AS (
    SELECT item, item_id, doc, doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc), corpus
    GROUP BY item, item_id, doc, doc_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
