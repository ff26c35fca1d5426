"""Registered queries: against SQL where there is some, else by brute force, on whole tables."""

import itertools
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cases import frame
from compare import connect, spark_result, sql_result, type_differences

from shelfcast.llm import ngram_join, token_shards, tokens
from shelfcast.llm.common import stored
from shelfcast.llm.queries import ORACLE, REGISTRY


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def true_ids(documents):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokens.default_path()).encode_batch(documents.text.tolist(), add_special_tokens=False)
    return {i: np.array([*e.ids, tokens.END_ID], dtype="<u4") for i, e in zip(documents.doc_id, found)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = REGISTRY[name](spark, sf_dir)
    assert spark_result(df) == sql_result(duck, ORACLE[name])
    assert type_differences(duck, ORACLE[name], df) == []


def test_op1_sharding(spark, sf_dir, documents):
    got = REGISTRY["op1_sharding"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    texts = dict(zip(documents.doc_id, documents.text))
    for r in got.itertuples():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    for _, shard in got.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    sizes = got.groupby("shard")["size"].sum()
    assert set(sizes.index) == set(range(16))
    assert sizes.max() - sizes.min() <= got["size"].max()


def test_op2_token_shards(spark, sf_dir, true_ids):
    got = REGISTRY["op2_token_shards"](spark, sf_dir).toPandas().sort_values(["slot", "offset"])
    assert got.slot.unique().tolist() == list(range(got.slot.max() + 1))
    total = sum(map(len, true_ids.values()))
    assert total == got.n_tokens.sum()
    covered = got.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert set(covered.groups) == set(true_ids)
    for doc_id, rows in covered:
        assert rows.start.tolist() == [0, *rows.n_tokens.cumsum()[:-1]] and rows.n_tokens.sum() == len(true_ids[doc_id])
    for slot, rows in got.groupby("slot"):
        record = np.zeros(token_shards.STRIDE, dtype="<u2")
        for r in rows.itertuples():
            record[r.offset : r.offset + r.n_tokens] = true_ids[r.doc_id][r.start : r.start + r.n_tokens]
        assert rows.offset.tolist() == [0, *rows.n_tokens.cumsum()[:-1]]
        assert set(rows.record_crc32) == {zlib.crc32(record.tobytes())}
        assert set(rows.stride_bytes) == {8 + 2 * token_shards.STRIDE + 2}
        assert set(rows.byte_offset) == {slot % token_shards.PER_SHARD * (8 + 2 * token_shards.STRIDE + 2)}
    # one padded record a task at most
    tasks = spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions()
    assert (got.slot.max() + 1) * token_shards.STRIDE - total < tasks * token_shards.STRIDE


def test_op3_quality_keeps_good_text(spark, sf_dir):
    got = REGISTRY["op3_quality"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.98
    assert both[both.quality == 0].kept.mean() < 0.5


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def linked(texts):
    """Links and groups of all pairs, by looking at all of them."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links, group = Counter(), {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if common and common / len(sets[a] | sets[b]) >= ngram_join.THRESHOLD:
            links[a] += 1
            links[b] += 1
            low, high = sorted((root(a), root(b)))
            group[high] = low
    return links, {i: root(i) for i in texts}


def test_op6_ngram_join(spark, sf_dir, documents):
    got = REGISTRY["op6_ngram_join"](spark, sf_dir).toPandas()
    links, group = linked(dict(zip(documents.doc_id, documents.text)))
    assert {r.doc_id: r.class_id for r in got.itertuples()} == group
    assert {r.doc_id: r.n_linked_docs for r in got.itertuples()} == {i: links[i] for i in group}


def test_op7_vector_search(spark, sf_dir):
    got = REGISTRY["op7_vector_search"](spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[i]
        mine = got[got.query_id == ids[i]].sort_values("rank")
        others = np.flatnonzero(ids != ids[i])
        best = others[np.lexsort((ids[others], -scores[others]))[:20]]
        assert mine["rank"].tolist() == list(range(1, len(best) + 1))
        assert list(mine.vec_id) == list(mine.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id)
        place = {v: k for k, v in enumerate(ids)}
        assert np.allclose([scores[place[v]] for v in mine.vec_id], mine.score)
        found += len(set(mine.vec_id) & set(ids[best]))
        total += len(best)
    assert found / total >= 0.9


def test_op8_packing(spark, sf_dir, true_ids):
    got = REGISTRY["op8_packing"](spark, sf_dir).toPandas()
    for r in got.itertuples():
        piece = true_ids[r.doc_id][r.start : r.start + r.length]
        assert (zlib.crc32(piece.tobytes()), len(true_ids[r.doc_id])) == (r.ids_crc32, r.doc_tokens)
    for i, pieces in got.sort_values("start").groupby("doc_id"):
        assert pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]]
        assert pieces.length.sum() == len(true_ids[i])
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
        assert sequence.length.sum() <= 4096
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.9


def read_apart(html):
    """The marked article of a supplied page, read with patterns: its blocks, without tags and adverts."""
    import html as entities

    found = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)
    body = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", found[1] if found else "", flags=re.S)
    body = re.sub(r'<(div|aside|section|ul|nav)[^>]*class="(?:ad|ads|related|comments|share|promo)"[^>]*>.*?</\1>', "\0", body, flags=re.S)
    parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|section|table|tr|td|pre|figure|figcaption)\b[^>]*>|\0", re.sub(r"<br\s*/?>", " ", body))
    lines = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts)
    return "\n".join(line for line in lines if line)


def test_op9_html_text(spark, sf_dir):
    got = REGISTRY["op9_html_text"](spark, sf_dir).toPandas()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    assert sorted(got.page_id) == sorted(pages.page_id)
    want = {p.page_id: read_apart(p.html or "") for p in pages.itertuples()}
    assert sum(map(bool, want.values())) > 0.9 * len(want)
    for r in got.itertuples():
        assert r.n_chars == len(r.text)
        assert r.text == want[r.page_id]


def test_op10_mixing(spark, sf_dir, documents):
    got = REGISTRY["op10_mixing"](spark, sf_dir).toPandas().sort_values("position")
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    assert got.position.tolist() == list(range(len(got)))
    assert dict(zip(got.doc_id, got.source)) == dict(zip(documents.doc_id, documents.source))
    assert got.groupby("slot").source.nunique().max() == 1


def test_op13_token_counts(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    from shelfcast.llm import token_counts

    got = REGISTRY["op13_token_counts"](spark, sf_dir).toPandas()
    encoded = Tokenizer.from_file(token_counts.default_path()).encode_batch(documents.text.tolist(), add_special_tokens=False)
    want = {i: (len(t.encode()), len(e.ids), len(e.ids) > 1024) for i, t, e in zip(documents.doc_id, documents.text, encoded)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.itertuples()} == want and len(got) == len(documents)


def test_pipeline(spark, sf_dir, documents, true_ids):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    kept = set(got.doc_id)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id").quality
    texts = dict(zip(documents.doc_id, documents.text))
    _, group = linked({i: texts[i] for i in texts})
    # every kept document alone in its group, every group with good text still there
    assert len({group[i] for i in kept}) == len(kept)
    assert {group[i] for i in labels[labels == 1].index} <= {group[i] for i in kept}
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(true_ids[i]) for i in kept}


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, copies, repeated rows and clashing names, half of them trusted."""
    at = str(tmp_path_factory.mktemp("cases"))
    docs = frame(spark)
    docs.repartition(3, "doc_id").write.parquet(f"{at}/documents.parquet")
    docs.where("doc_id >= 100").selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages_on_cases(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, small_dir), f"case-{name}")
        assert docs.columns == columns
        rows = Counter(map(tuple, docs.select("doc_id", "text", "row", "lane").collect()))
        assert not before or not rows - before
        if name == "exact":
            plain = [re.sub(r"[ \t-\r]+", " ", text or "") for _, text, _, _ in rows.elements()]
            assert len(plain) == len(set(plain))
            assert len(plain) == len({re.sub(r"[ \t-\r]+", " ", text or "") for _, text, _, _ in before})
        if name == "mix":
            assert rows == before
        before = rows
    pieces = corpus_pipeline.pack(spark, docs, small_dir).toPandas()
    ids = {i for i, *_ in before}
    assert set(pieces.doc_id.dropna().astype(int)) == {i for i in ids if i is not None}
    assert pieces.doc_id.isna().any() == (None in ids)


def test_pipeline_of_nothing(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small_dir), f"none-{name}")
        assert docs.count() == 0
