"""Operators over a whole corpus: packing, urls, repeated passages, near duplicates, top-k."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from brute import EDGES, best_fit, near_groups, without_passages
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import jaccard, packing, substrings, suffixes, topk, urls
from lectern.llm.graph import components
from lectern.sources import table

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, opened = packing.plan_bins(counts, 40)
    assert opened == best_fit(lengths, 40)
    used = {}
    for length, first_rank, first, each, offset in plan.tolist():
        later = [r for r in plan.tolist() if r[0] == length and r[1] > first_rank]
        end = later[0][1] if later else counts[length]
        for r in range(first_rank, end):
            used.setdefault(first + (r - first_rank) // each, []).append((offset + (r - first_rank) % each * length, length))
    assert sum(map(len, used.values())) == len(lengths)
    for pieces in used.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= 40


def test_packed_pieces_fill_sequences_without_gaps(spark):
    rows = packing.op1_packing(spark, SF).toPandas()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(np.append(0, g["length"].to_numpy()))[:-1]).all() and g["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() == best_fit(rows["length"].tolist(), 4096)
    assert not rows.duplicated(["doc_id", "piece"]).any()


def test_packing_of_edges(docs_of):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(packing.token_pieces(docs_of([]), path, True, 1)).count() == 0
    rows = packing.pack(packing.token_pieces(docs_of([None, "", "a", "a"], ids=[1, 1, None, 1]), path, True, 1)).collect()
    assert sorted(r.length for r in rows) == [1, 1, 2, 2] and {r.sequence_id for r in rows} == {0}


def _plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for name, prefix, verdict in urls.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
            best = (name + prefix, verdict)
    return host, path, best


def test_url_rules(spark, tmp_path):
    odd = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/a?b://c#d", "https://a.net/es/1", "https://net/fr/", "x://evilnet/es/", "http://a.com", "http://a.com/", "http://é.COM/en/ü", "http://a.net?x/es/", "http://example.com/en/\nnew", "http://u:p@h.net/es/x", "://a.com/"]
    made = [f"https://h{i % 7}.site{i % 5}.{t}/{lang}/{i}?q={i}" for i in range(60) for t in ("com", "net", "org") for lang in ("es", "en")]
    all_ = odd + made + made[:5]
    spark.createDataFrame([(i, u, None, "c") for i, u in enumerate(all_)], "page_id bigint, url string, html string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in urls.op2_urls(spark, str(tmp_path)).collect()}
    assert len(rows) == len(all_)
    for k, url in enumerate(all_):
        host, path, best = _plain_rule(url)
        assert (rows[k].host, rows[k].path) == (host, path), url
        assert rows[k].rule == (best and best[0]) and rows[k].verdict in ("allow", "block")
        if best:
            assert rows[k].verdict == best[1]


def test_url_trees_learn_what_is_blocked(spark):
    random.seed(1)
    bad = [f"http://{random.choice('xyz')}{random.randrange(10**6)}-win.info/{random.randrange(10**9)}?a={i}&b=1&c=2" for i in range(300)]
    good = [f"https://www.{random.choice(['news', 'books', 'music'])}.org/{random.choice(['about', 'read', 'list'])}/item" for _ in range(300)]
    rows = [(u, 1) for u in bad] + [(u, 0) for u in good]
    random.shuffle(rows)
    frame = lambda part: spark.createDataFrame(part, "url string, blocked int")
    pages = frame(rows[400:]).withColumn("page_id", F.monotonically_increasing_id())
    found = urls.filter_urls(pages, labelled=frame(rows[:400])).join(pages, "page_id").collect()
    assert np.mean([(r.verdict == "block") == (r.blocked == 1) for r in found]) > 0.95


def test_url_trees_beat_the_majority_on_urls_they_have_not_seen(spark):
    scores = [urls.held_out_scores(urls.ruled_urls(table(spark, "/root/testdata/sf0.1", "pages")), part) for part in (0, 1)]
    for s in scores:
        assert s["n"] > 150 and s["accuracy"] >= s["majority"] + 0.1 and min(s["blocked"], s["allowed"]) > 0.7, scores


def test_url_features_and_statistics(spark):
    given = [("https://A.b.example.org/en/x-1/?q=1&&r=2#f", 1), ("http://b.example.org/en/", 0), ("http://a.net", 1), (None, 1), ("http://b.example.org/en/", 0)]
    rows = spark.createDataFrame(given, "url string, blocked int")
    host, path = urls.split_url(F.col("url"))
    rows = urls.with_features(rows.withColumns({"host": host, "path": path}))
    found = {r.url: r for r in rows.collect()}
    r = found[given[0][0]]
    entropy = lambda t: -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t))
    assert (r.host, r.path, r.depth, r.labels, r.parameters, r.secure, r.fragment, r.dashes, r.longest_label) == ("a.b.example.org", "/en/x-1/", 2, 4, 2, 1, 1, 0, 7)
    assert r.digits == pytest.approx(3 / len(r.url)) and r.host_entropy == pytest.approx(entropy(r.host)) and r.path_entropy == pytest.approx(entropy(r.path)) and r.query_length == 8
    assert (r.suffix, r.site, r.section, r.site_section) == ("org", "example.org", "en", "example.org/en") and (found[None].url_length, found[None].suffix) == (0, "")
    folds = {r.url: r.f for r in rows.select("url", urls.fold(F.col("url")).alias("f")).collect()}
    for out in (True, False):
        for r in urls.with_statistics(rows, urls.suffix_statistics(rows), 0.6, out).collect():
            same = [(u, b) for u, b in given if (found[u].site == r.site) and not (out and folds[u] == folds[r.url])]
            assert r.site_blocked == pytest.approx((sum(b for _, b in same) + 20 * 0.6) / (len(same) + 20)) and r.site_seen == pytest.approx(math.log1p(len(same)))


def test_urls_without_labels(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.filter_urls(none).count() == 0
    plain = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id bigint, url string")
    assert {r.verdict for r in urls.filter_urls(plain).collect()} == {"allow"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=0, max_size=200))
def test_suffix_array(symbols):
    text = np.array([*symbols, 0])
    order = suffixes.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    prefix = suffixes.permuted_common_prefixes(text, order, 7)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while n < 7 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert prefix[b] == n


def test_suffix_array_by_place_is_the_same():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 900, 4000), 0)
    assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=200), st.integers(1, 9))
def test_joins_are_common_prefixes_of_a_length(symbols, length):
    text = np.array([*symbols, 0])
    order = suffixes.suffix_array(text)
    joins = suffixes.permuted_joins(text, order, length)
    assert joins.tolist() == (suffixes.permuted_common_prefixes(text, order, length) >= length).tolist()


def test_suffixes_of_many_symbols_that_repeat_at_length():
    text = np.append(np.tile(np.r_[np.arange(1, 700), 5, 5], 6), 0)
    assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("hot", [1, substrings.HOT])
def test_repeated_passages(docs_of, hot):
    random.seed(hot)
    base = ["".join(random.choices("abcde é", k=random.randint(0, 300))) for _ in range(12)]
    shared = "".join(random.choices("abcdefgh", k=120))
    texts = [*base, base[0], base[3][20:] + "q" + base[3][:150], *("".join(random.choices("xyz", k=k)) + shared[k:] + "end" * k for k in range(10)), "ab" * 100, "z" * 90, *EDGES[:10], None]
    rows = {r.doc_id: r for r in substrings.dedup_substrings(docs_of(texts), length=60, hot=hot).collect()}
    want = without_passages(texts, 60)
    assert len(rows) == len(texts)
    for k, (kept, n_removed, n_spans) in enumerate(want):
        runs = rows[k].removed
        assert bytes(rows[k].kept) == kept, k
        assert (sum(b - a + 1 for a, b in zip(runs[::2], runs[1::2], strict=True)), len(runs) // 2) == (n_removed, n_spans)


def test_spans_of_a_common_passage_do_not_multiply(docs_of):
    """However its segments are judged, a passage gives a document the same few spans, and not one for each window."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("klmnop", k=n))
    shared = noise(400)
    docs = docs_of([noise(90) + shared + noise(90) for _ in range(6)]).select(F.col("doc_id").alias("doc"), "text")
    split, whole = ({r.doc: sorted(r.spans) for r in substrings.repeated_spans(docs, 60, hot).collect()} for hot in (1, substrings.HOT))
    assert split == whole and len(split) == 6


def test_passages_query_on_documents(spark):
    rows = {r.doc_id: r for r in substrings.op3_substrings(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for (k, text), (kept, n_removed, n_spans) in zip(texts.items(), without_passages(texts.values(), 200), strict=True):
        assert (rows[k].n_bytes, rows[k].n_removed, rows[k].n_spans, rows[k].kept_sha256) == (len(text.encode()), n_removed, n_spans, hashlib.sha256(kept).hexdigest()), k
    assert any(r.n_removed for r in rows.values())


def test_passages_keep_columns_and_rows(docs_of):
    passage = "".join(random.Random(1).choices("abcdefghij", k=300))
    docs = docs_of(["head " + passage, passage, "tail", passage + "é", None], ids=[1, 2, 2, None, 3])
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.doc, r.key) for r in out.collect()) == [(0, "é", 7, "x"), (1, "head ", 7, "x"), (2, "tail", 7, "x"), (3, None, 7, "x")]
    assert substrings.without_repeats(docs_of([])).count() == substrings.dedup_substrings(docs_of([])).count() == 0


def _changed(words, share, rng):
    return " ".join(rng.choice(["new", "other", "odd"]) + str(rng.randrange(999)) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("limits", [{}, {"part": 2, "block": 3}])
def test_near_duplicates(docs_of, limits):
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 160))]
        texts += [_changed(words, share, rng) for share in (0, 0, 0.004, 0.01, 0.02, 0.04, 0.2)]
    texts += [*EDGES, "A b c D e f", "a B c d E f", "a b, c! d e f?"]
    label, links = near_groups(texts)
    rows = {r.doc_id: r for r in jaccard.near_duplicates(docs_of(texts), **limits).collect()}
    assert len(rows) == len(texts)
    assert [rows[k].class_id for k in range(len(texts))] == label
    assert [rows[k].n_links for k in range(len(texts))] == links


def test_bands_follow_the_recall():
    for threshold, recall, most in ((0.8, 0.9999, 192), (0.8, 0.9, 192), (0.5, 0.99, 64), (0.9, 0.999, 30)):
        bands, rows = jaccard.choose_bands(threshold, recall, most)
        assert bands * rows <= most and 1 - (1 - threshold**rows) ** bands >= recall
    assert jaccard.choose_bands(0.8, 0.9)[1] > jaccard.choose_bands(0.8, 0.9999)[1]


def test_a_bucket_of_boilerplate(docs_of):
    """Texts that share most words but few of which are near: all true links are found, and no other."""
    rnd = random.Random(11)
    shared = [f"common{i}" for i in range(120)]
    texts = []
    for k in range(500):
        texts.append(" ".join(shared + [f"own{k}x{i}" for i in range(70)]))
        if k % 10 == 0:
            texts.append(texts[-1] + f" added{k}")
    rnd.shuffle(texts)
    label, links = near_groups(texts)
    rows = {r.doc_id: r for r in jaccard.near_duplicates(docs_of(texts), part=32, block=16).collect()}
    assert [rows[k].class_id for k in range(len(texts))] == label and [rows[k].n_links for k in range(len(texts))] == links
    assert sum(links) == 100


def test_one_of_each(docs_of):
    words = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([words, words, words + " more", "other text of its own here", None, "", "other text of its own here"], ids=[5, 3, 4, 9, 8, 7, 9])
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 7, 9]
    assert jaccard.one_of_each(docs_of([])).count() == 0
    assert jaccard.one_of_each(docs_of(["a b c", "a b c", "d e"], ids=[None, 1, 2])).count() == 2


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(25)]
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_top_k_matches_sql(spark):
    got = topk.op5_topk(spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(topk.ORACLE).df()
    order = lambda x: x.sort_values(["query_id", "rank"])[["query_id", "rank", "vec_id", "score"]].values.tolist()
    assert order(got) == order(want) and len(got)


def test_top_k_edges(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.integers(-3, 4, 6) / 2] for _ in range(150)]
    rows = [(i, v, "c") for i, v in enumerate(vectors)] + [(100, vectors[0], "again"), (500, None, None), (600, [], None), (700, [1.0, nan], None), (800, [inf, 1.0], None), (900, [1.0, None], None), (None, [1.0], None), (1000, [1.0, 2.0], "short")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string").withColumn("row", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 100 == 0, 10, block_rows=40).collect())
    fine = [(i, np.array([np.floor(1024 * x) for x in v] + [0] * (6 - len(v)), np.int64)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, (qi, qv) in enumerate(fine):
        if qi % 100 == 0:
            best = sorted((-int(qv @ v), i) for k, (i, v) in enumerate(fine) if k != q)[:10]
            want += [(qi, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
