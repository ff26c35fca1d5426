"""Token counts, lexical search and source audit against brute force on rows with every odd case."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, documents, frame, prose

from shelfcast.llm import lexical_search, source_audit, token_counts, word_blocks

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(SMALL))


def searched_terms(text):
    return words(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def audited_terms(text):
    return words(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# ---- blocks


def test_blocks_hold_whole_documents_and_end_at_their_limits(spark, monkeypatch):
    monkeypatch.setattr(word_blocks, "MOST_WORDS", 40)
    rows = documents()
    blocks = word_blocks.word_blocks(frame(spark, rows).coalesce(1), lexical_search.terms_of, "doc_id", "text").collect()
    assert len(blocks) > 3 and len({b.block for b in blocks}) == len(blocks)
    got = []
    for b in blocks:
        who, codes, freqs = word_blocks.word_entries(b.asDict())
        held = [Counter() for _ in b["keys"]]
        for w, c, n in zip(who, codes, freqs):
            held[w][bytes(b["words"][c]).decode()] += int(n)
        assert [len(h) > 0 for h in held] == [n > 0 for n in b["n_words"]]
        assert list(b["word_docs"]) == [sum(bytes(w).decode() in h for h in held) for w in b["words"]]
        got += zip(b["keys"], b["n_bytes"], held)
    want = [(i, len((t or "").encode()), Counter(searched_terms(t))) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


# ---- token counts


ODD_TEXTS = [
    "it's  we'll\t\tthey'RE 12 a1b2 ²³ ½x",
    "  two  blanks \n\n and ends   ",
    "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext|",
    "日本語のテキスト and latin, Ωmega wide space ​zero",
    "emoji 👩‍👩‍👧 \x1c\x85 control",
    "x" * 5000,
    " " * 3000,
    "",
    None,
]


def test_token_counts_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = documents() + [(1000 + i, t, "en", "s", 0, "r", None, 1, 2, 3, 4) for i, t in enumerate(ODD_TEXTS)]
    tokenizer = Tokenizer.from_file(token_counts.default_path())
    got = token_counts.token_counts(frame(spark, rows), limit=100).collect()
    sizes = [(i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted([(*s, s[2] > 100) for s in sizes], key=str)


def test_token_counts_over_many_buckets_and_blocks(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "BUCKET_WORDS", 50)
    monkeypatch.setattr(token_counts, "MOST_KNOWN", 20)
    monkeypatch.setattr(word_blocks, "MOST_WORDS", 60)
    tokenizer = Tokenizer.from_file(token_counts.default_path())
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark)).collect() if r.doc_id is not None}
    assert got == {i: len(tokenizer.encode(t or "").ids) for i, t, *_ in documents() if i is not None}


def test_latin_pattern_splits_as_the_tokenizer(spark):
    tokenizer, _ = token_counts.loaded(token_counts.default_path())
    every = "".join(chr(c) for c in range(256) if token_counts.PLAIN.fullmatch(chr(c)))
    rng = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list(every + "  '\n\tstre"), 40))
        assert token_counts.plain_pattern().findall(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- lexical search


def ranked_by_hand(docs, items, k=20):
    held = [(i, Counter(searched_terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for name, text in items:
        scores = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_words
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in Counter(searched_terms(text)).items()
                if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(name, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def queries_of(spark):
    """Queries that share terms, hold terms more than once, are empty, null, repeated or without an identifier."""
    base = prose(1, 120).split()
    texts = [" ".join(base[i : i + 12] + base[:4]) for i in range(0, 60, 5)]
    rows = list(enumerate(texts)) + [(50, None), (51, ""), (52, "nowhere-found"), (53, base[3] + " " + base[3]), (None, texts[2]), (7, texts[2]), (7, texts[2])]
    return rows, spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, term string")


@pytest.mark.parametrize("batch_items", [512, 3])
def test_search_is_the_ranking_of_all_documents(spark, monkeypatch, batch_items):
    monkeypatch.setattr(word_blocks, "MOST_DOCS", 7)
    rows, items = queries_of(spark)
    # equal scores: copies of a text under other identifiers
    docs = documents() + [(300 - i, documents()[20 + i % 3][1], "en", "s", 0, "r", None, 1, 2, 3, 4) for i in range(40)]
    got = lexical_search.ranked(frame(spark, docs), items, batch_items=batch_items)
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand([d[:2] for d in docs], rows)


def test_search_without_documents_items_or_common_terms(spark):
    _, items = queries_of(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.ranked(spark.createDataFrame([], SCHEMA), items).collect() == []
    assert lexical_search.ranked(frame(spark), none).collect() == []
    assert lexical_search.ranked(frame(spark), spark.createDataFrame([(1, "qqq zzz")], "item_id long, text string")).collect() == []


def test_shared_sets_are_added_once_and_change_no_score():
    rng = np.random.default_rng(3)
    terms = [f"t{i}".encode() for i in range(60)]
    items = []
    for i in range(40):
        held = {t: int(rng.integers(1, 3)) for t in rng.choice(terms, 12, replace=False)}
        held |= {t: 1 for t in terms[: 5 + i % 4]}
        items.append((i, i, held))
    weights = {t: int(rng.integers(1, 9)) for t in terms}
    entries = {t: (np.unique(rng.integers(0, 30, 12)), None) for t in terms}
    entries = {t: (who, rng.integers(1, 99, len(who))) for t, (who, _) in entries.items()}

    def run(most_pairs):
        graph = lexical_search.mined(items, weights, most_pairs)
        by_term = {graph.terms[t]: e for t, e in entries.items() if t in graph.terms}
        additions = sum(map(len, graph.parts)) + sum(len(p) for *_, p in graph.items)
        return {graph.items[at][0]: total.tolist() for at, total in lexical_search.scores(graph, 30, by_term)}, additions

    plain = {}
    for number, _, held in items:
        total = np.zeros(30, np.int64)
        for t, times in held.items():
            total[entries[t][0]] += entries[t][1] * times
        plain[number] = total.tolist()
    shared, additions = run(lexical_search.MOST_PAIRS)
    few, _ = run(10)
    assert shared == few == plain
    assert additions < 0.75 * sum(len(h) for *_, h in items)


# ---- source audit


def audited_by_hand(docs, least_docs, top):
    docs = [(lang or "", source or "", audited_terms(t)) for t, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, ts in mine for t in set(ts))
        kept = {t for t in df if df[t] >= least_docs}
        count = {s: Counter(t for _, of, ts in mine if of == s for t in ts if t in kept) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in count:
            pairs = sorted((-sum(abs(p(count[s], t) - p(count[o], t)) for t in kept), o.encode(), o) for o in count if o != s)
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)]
            more = sorted((p(whole, t) - p(count[s], t), t.encode(), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t))
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(more[:top])]
    return sorted(out)


def audited_rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Äpfel", "äpfel", "naïve"]
    out = []
    for i in range(200):
        chosen = vocabulary[:: 1 + i % 3]
        text = " ".join(rng.choice(chosen, int(rng.integers(0, 40))))
        out.append((i, text.upper() if i % 5 == 0 else text, ["en", "de", None][i % 3], [None, "", "a", "b", "c", "a\0b"][int(rng.integers(0, 6))]))
    out += [(500, None, "fr", "only"), (501, "", "fr", "other"), (502, "1 2 3", "fr", "other"), (503, "once", "xx", "alone")]
    return out + out[:10]


@pytest.mark.parametrize("small", [False, True])
def test_audit_is_that_of_all_terms_and_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(source_audit, "MOST_HELD", 50)
        monkeypatch.setattr(source_audit, "TILE", 2)
        monkeypatch.setattr(source_audit, "BUCKET_ROWS", 16)
        monkeypatch.setattr(source_audit, "CANDIDATES", 8)
    rows = audited_rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, term string, n long, tile int")
    got = source_audit.divergence(docs, least_docs=4, top=7)
    assert sorted(map(tuple, got.collect())) == audited_by_hand([r[1:] for r in rows], 4, 7)


def test_audit_of_odd_rows_and_of_an_empty_table(spark):
    rows = [(r[1], r[2], r[3]) for r in documents()]
    got = source_audit.divergence(frame(spark), least_docs=2, top=5)
    assert sorted(map(tuple, got.collect())) == audited_by_hand(rows, 2, 5)
    assert source_audit.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_skyband_holds_the_best_by_any_share():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = rng.integers(1, 60, 900)
        lang_n = n + rng.integers(0, 60, 900)
        value = source_audit.shares(n, np.int64(5000)) - source_audit.shares(lang_n, np.int64(30_000))
        best = np.lexsort((np.arange(900), -value))[:10]
        kept = source_audit.skyband(n, lang_n, 10, chunk=64)
        assert set(best) <= set(kept) and len(kept) < 500


def test_shares_are_exact_where_a_product_would_overflow():
    for n, by in [(0, 5), (9 * 10**13, 10**14 + 7), (10**12, 3 * 10**13 + 1)]:
        want = 1 + 1_000_000_000 * (n + 5) // by
        assert int(source_audit.shares(np.array([n]), np.array([by]))[0]) == want


def test_banded_orders_terms_by_their_bytes():
    table = pa.table({"term": ["z", "ä", "a"], "n": [1, 1, 1], "lang_n": [1, 1, 1]})
    assert source_audit._banded(table, 2).column("term").to_pylist() == ["a", "z"]
