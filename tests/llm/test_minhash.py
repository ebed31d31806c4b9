"""b-bit MinHash components against all pairs."""

import random
import re

import numpy as np
import pytest
from brute import EDGES

from lectern.llm import minhash
from lectern.llm.jaccard import choose_bands
from lectern.sources import table


def shingles(text, n=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_components(texts, percent=85):
    """(set sizes, least index that links lead to), by all pairs."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("limits", [{}, {"fan": 3, "part": 4, "block": 4}])
def test_components_are_those_of_all_pairs(spark, docs_of, limits):
    rng = random.Random(3)
    texts = [*EDGES, "Same Text", "two words", "TWO words", "two", " \t "]
    for _ in range(12):  # groups with similarities on both sides of the threshold, and chains of changes
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 200))]
        texts += [changed(rng, base, rng.randint(0, max(1, len(base) // 18))) for _ in range(rng.randint(2, 25))]
        for _ in range(4):
            base = changed(rng, base, max(1, len(base) // 40)).split()
            texts.append(" ".join(base))
    sizes, label = plain_components(texts)
    rows = {r.doc_id: r for r in minhash.near_components(docs_of(texts), **limits).collect()}
    assert len(rows) == len(texts)
    for k in range(len(texts)):
        assert (rows[k].n_shingles, rows[k].component_id, rows[k].kept) == (sizes[k], label[k], label[k] == k), k


def test_a_pair_at_the_threshold_is_linked(docs_of):
    common = [f"c{i}" for i in range(19)]  # 17 shingles in both, 20 in all
    texts = [" ".join(["a"] + common), " ".join(common + ["x", "y"]), " ".join(common + ["x", "y", "z"])]
    sizes, label = plain_components(texts)
    assert sizes == [18, 19, 20] and label == [0, 0, 0]
    rows = sorted((r.doc_id, r.component_id) for r in minhash.near_components(docs_of(texts)).collect())
    assert rows == [(0, 0), (1, 0), (2, 0)]


def test_estimates_are_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    low = (signs[:, :, None] >> (np.arange(32, dtype=np.uint64) * np.uint64(2))) & np.uint64(3)
    equal = (low.reshape(40, 1, -1) == low.reshape(1, 40, -1)).sum(axis=2)
    for least in (0, 20, 32, 128):
        assert (minhash.near_pairs(signs, 2, least) == (equal >= least)).all()
    a, b = (spark.createDataFrame([(k, signs[k].view(np.int64).tolist()) for k in range(40)], f"{c} int, s{c} array<bigint>") for c in "ab")
    found = {(r.a, r.b): r.n for r in a.crossJoin(b).select("a", "b", minhash.agreeing(a.sa, b.sb, 128, 2).alias("n")).collect()}
    assert all(found[i, j] == equal[i, j] for i in range(40) for j in range(40))
    assert minhash.least_agreeing(0.85, 128, 2) < 128 * (0.85 + 0.15 / 4) < 128
    bands, rows = choose_bands(0.85, 0.9999, minhash.HASHES)
    assert 1 - (1 - 0.85**rows) ** bands >= 0.9999 and bands * rows <= minhash.HASHES


def test_null_and_repeated_keys(docs_of):
    body = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([body, body, body + " end", None, ""], ids=[None, 5, 5, 7, 7])
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_components(docs).collect()), key=str)
    assert rows == sorted([(None, 48, None, True), (5, 48, None, False), (5, 49, None, False), (7, 0, 7, True), (7, 0, 7, True)], key=str)
    assert minhash.near_components(docs.limit(0)).count() == 0


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents").select("doc_id", "text").toPandas().sort_values("doc_id")
    sizes, label = plain_components(docs["text"].tolist())
    ids = docs["doc_id"].tolist()
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op11_minhash(spark, folder).collect()}
    assert rows == {k: (n, ids[j]) for k, n, j in zip(ids, sizes, label, strict=True)}
