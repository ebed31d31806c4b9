"""The trie of conversations against plain nested loops, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from lectern.llm import trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(convs):
    """Rows of all nodes of ``convs``: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids(node)), sum(not kids(x) for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def turns_of(spark):
    def make(convs):
        rows = [(c, t, r, x, "z", 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
        random.Random(1).shuffle(rows)
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, conv string, d int")

    return make


def some_convs(n=40, deep=9):
    rng = random.Random(n)
    out = {}
    for c in range(3, 3 + n):
        out[c] = [(rng.choice(["user", "bot"]), rng.choice(["a", "bé", ""])) for _ in range(rng.randint(1, deep))]
        if c % 7 == 0 and c > 10:
            out[c] = list(out[c - 7])
    return out


@pytest.mark.parametrize("limits", [{}, {"unit": 4, "task": 8}, {"segment": 2}, {"segment": 3, "unit": 2, "task": 5}])
def test_nodes_are_those_of_nested_loops(turns_of, limits):
    convs = some_convs()
    assert rows_of(trie.conversation_trie(turns_of(convs), **limits)) == plain_trie(convs)


def test_edges(spark, turns_of):
    schema = "conv_id bigint, turn bigint, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert rows_of(trie.conversation_trie(empty)) == []
    odd = spark.createDataFrame([(1, None, None, None), (1, 0, "r", "t"), (2, 5, "", ""), (2, 7, "r", "t"), (None, 0, "x", "y"), (3, 0, "rt", ""), (3, 0, "r", "t")], schema)
    first, second = sorted([("rt", ""), ("r", "t")], key=lambda x: hashlib.md5(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest())
    assert rows_of(trie.conversation_trie(odd)) == plain_trie({1: [("", ""), ("r", "t")], 2: [("", ""), ("r", "t")], 3: [first, second]})
    chain = {1: [("u", f"t{i % 3}") for i in range(700)], 2: [("u", "t0")]}
    rows = rows_of(trie.conversation_trie(turns_of(chain), segment=100))
    assert len(rows) == 701 and max(r[1] for r in rows) == 700 and all(r[5] == 1 for r in rows)


def test_rebuilt_conversations(spark, turns_of, tmp_path):
    convs = some_convs(60, 12)
    for c in (10, 15, 20):
        convs.pop(c, None)
    turns_of(convs).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert rows_of(trie.op13_trie(spark, str(tmp_path))) == plain_trie(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(trie.ORACLE)
    names = [x[0] for x in cursor.description]
    assert sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()), key=str) == plain_trie(want)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(trie.ORACLE)
    names = [x[0] for x in cursor.description]
    assert rows_of(trie.op13_trie(spark, SF)) == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in cursor.fetchall()), key=str)
