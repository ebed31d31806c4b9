"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

from brute import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import runs


def plain_runs(words, least=24, exponent=3):
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            if length >= max(least, exponent * q) and not any(r[0] <= i and i + length <= r[0] + r[1] and q % r[2] == 0 for r in out):
                out.add((i, length, q))
            i = max(k, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if found else None
    return len(found), *best, milli, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_of_any_words(data):
    parts = data.draw(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 12)), max_size=5))
    words = [x.encode() for part, n in parts for x in part * n]
    assert runs.word_runs(words) == plain_runs(words)
    ids = [ord(w) for w in words]
    assert sorted(runs.stretch_runs(ids, 6, 3)) == plain_runs(ids, 6, 3) or len(ids) < 6


def test_long_runs_nested_and_at_the_ends():
    inner = ["a", "b"] * 15 + ["c"]
    assert runs.word_runs([w.encode() for w in inner * 4]) == plain_runs(inner * 4)
    words = [b"x"] * 200_000
    assert runs.word_runs(words) == [(0, 200_000, 1)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    assert runs.word_runs([c.encode() for c in fib[-1]]) == plain_runs(fib[-1])
    assert runs.collapsed_words([b"a"] * 30 + [b"b"], [(0, 30, 1)]) == [b"a", b"b"]


def test_documents(spark, folder_of):
    rng = random.Random(5)
    texts = [*EDGES, "one two\tthree\n" * 40, "\v\f one two " * 50, "the same words " * 9 + "and " * 30, "é ü 東京 " * 40]
    for _ in range(150):
        part = " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30)))
        texts.append(" ".join([part] * rng.randint(1, 8) + [rng.choice("xyz") for _ in range(rng.randint(0, 60))]))
    ids = [None, *range(-3, len(texts) - 4)]
    folder = folder_of(texts, ids=ids)
    found = {r.doc_id: tuple(r)[1:] for r in runs.op12_runs(spark, folder).collect()}
    assert len(found) == len(texts)
    for k, text in zip(ids, texts, strict=True):
        assert found[k] == plain_digest(k, text), (k, text and text[:60])
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in ids) > 5


def test_operator_keeps_general_results(spark, docs_of):
    docs = docs_of(["go on " * 20 + "then stop", None, "a b c " * 3])
    rows = {r.doc_id: r for r in runs.periodic_runs(docs, least=6).collect()}
    assert rows[0].collapsed == "go on then stop" and [tuple(r) for r in rows[0].runs] == [(0, 40, 2)] and rows[0].n_words == 42
    assert rows[1].collapsed == "" and rows[1].runs == [] and rows[2].collapsed == "a b c"
    assert runs.periodic_runs(docs.limit(0)).count() == 0
