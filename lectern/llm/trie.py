"""The prefix trie of conversations: what beginnings they share, and what serving shared beginnings once would save.

Turns are known by a digest of role and text; a node, which is a sequence of turns, by 128 bits: the exclusive or of
hashes of (place, digest) up to it. Conversations of one path are one weighted row. Rows are dealt by a hash of their
first turn; each task builds pointer dictionary tries of its first turns (``applyInPandas``) and sums them up from
the leaves, without recursion. The rows of a first turn with more than ``UNIT`` turns below it are dealt anew by the
next turn, and again, until what one task gets is bounded; nodes that were taken off at the top this way (the spine)
get their sums from the tables of what lies below. Paths are cut every ``SEGMENT`` turns, so that neither a row nor a
task holds a conversation of any length: segments are done from the deepest up, each adding what hangs below it.

Conversations that end at one node are hashed in order as they stream by, never gathered.

Defined cases: turns are ordered by number, null first, equal numbers by digest; null roles and texts are empty;
rows without a conversation id are left out; without conversations there is no root and the result is empty; equal
conversations are members of the same nodes; only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources import discard, stored, table

#: Turns of a path's segment; turns below one first turn that a task takes; turns of a task's tries on average.
SEGMENT, UNIT, TASK = 4096, 10_000, 20_000
_NODE = ["a", "b", "depth", "conv", "parent_conv", "pa", "pb", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_NODE_TYPE = "a bigint, b bigint, depth bigint, conv bigint, parent_conv bigint, pa bigint, pb bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def ordered_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, d, digest, size): each conversation's turns from 0, with the UTF-8 bytes of their texts."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("bigint").alias("size"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("conv", (place - 1).cast("bigint").alias("d"), "digest", "size")


def with_nodes(steps: DataFrame, segment: int) -> DataFrame:
    """``steps`` (conv, d, digest, size) with h, g (hashes of the step), a, b (of its node), seg, and stop where the conversation ends."""
    order = Window.partitionBy("conv").orderBy("d")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    hashed = steps.select("conv", "d", "size", F.xxhash64(F.lit(1), "d", "digest").alias("h"), F.xxhash64(F.lit(2), "d", "digest").alias("g"), F.expr(f"d div {segment}").alias("seg"))
    return hashed.withColumns({"a": F.bit_xor("h").over(upto), "b": F.bit_xor("g").over(upto), "stop": F.lead("d").over(order).isNull()})


def segment_paths(steps: DataFrame, segment: int) -> DataFrame:
    """(seg, a, b, n, conv, ta, tb, pa, pb, top, path): one row for the conversations of each segment that end at one node.

    ``path`` has the segment's steps; ta, tb is the node of its first, pa, pb that one's parent, ``top`` its depth.
    """
    ends = steps.where(F.col("stop") | (F.col("d") % segment == segment - 1)).groupBy("seg", "d", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    paths = steps.join(ends.select("conv", "seg"), ["conv", "seg"], "left_semi").groupBy("conv", "seg").agg(F.sort_array(F.collect_list(F.struct("d", "h", "g", "size", "a", "b"))).alias("steps"))
    first = F.get("steps", F.lit(0))
    rows = ends.drop("d").join(paths, ["conv", "seg"]).withColumns({"first": first, "path": F.transform("steps", lambda s: F.struct(s.h.alias("h"), s.g.alias("g"), s.size.alias("size")))})
    return rows.select("seg", "a", "b", "n", "conv", F.col("first.a").alias("ta"), F.col("first.b").alias("tb"), F.expr("first.a ^ first.h").alias("pa"), F.expr("first.b ^ first.g").alias("pb"), (F.col("first.d") + 1).alias("top"), "path")


def forest(rows: Iterator[tuple]) -> tuple[np.ndarray, list[bool]]:
    """Nodes of the tries of ``rows`` (ta, tb, pa, pb, top, n, conv, path, below), and which are the tops.

    A path is a list of (h, g, size); ``below`` is (children, leaves, saved) of what hangs below its last node, or None.
    """
    children: list[dict] = [{}]
    node, parent, size, below_ = [None], [0], [0], [None]
    count, least, depth = [0], [0], [0]
    for ta, tb, pa_, pb_, top, n, conv, path, below in rows:
        at, a, b = 0, pa_, pb_
        for k, (h, g, bytes_) in enumerate(path):
            a, b = (a ^ h, b ^ g)
            step = (h, g) if k else (ta, tb)
            next_ = children[at].get(step)
            if next_ is None:
                next_ = children[at][step] = len(node)
                node.append((a, b, pa_, pb_))
                parent.append(at)
                children.append({})
                size.append(bytes_)
                below_.append(None)
                count.append(0)
                least.append(conv)
                depth.append(top + k)
            at = next_
            count[at] += n
            least[at] = min(least[at], conv)
        if below is not None:
            below_[at] = below
    m = len(node)
    n_children, leaves, saved = [len(c) for c in children], [0] * m, [0] * m
    for k in range(m - 1, 0, -1):  # children come after their parents: this is a postorder
        if below_[k] is not None:
            n_children[k] += below_[k][0]
            leaves[k] += below_[k][1]
            saved[k] += below_[k][2]
        if not n_children[k]:
            leaves[k] = 1
        saved[k] += (count[k] - 1) * size[k]
        leaves[parent[k]] += leaves[k]
        saved[parent[k]] += saved[k]
    tops = [parent[k] == 0 for k in range(1, m)]
    out = [(node[k][0], node[k][1], depth[k], least[k], None if parent[k] == 0 else least[parent[k]], node[k][2], node[k][3], count[k], n_children[k], leaves[k], saved[k]) for k in range(1, m)]
    return out, tops


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    """The forest of one task's rows; parents' ids stay with the tops only."""
    below = [None if np.isnan(x) else (int(x), int(y), int(z)) for x, y, z in zip(frame["n_children"], frame["n_leaves"], frame["saved_tokens"], strict=True)]
    paths = [[(int(h), int(g), int(s)) for h, g, s in zip(hs, gs, ss, strict=True)] for hs, gs, ss in zip(frame["h"], frame["g"], frame["size"], strict=True)]
    columns = (frame[c].tolist() for c in ("ta", "tb", "pa", "pb", "top", "n", "conv"))
    nodes, tops = forest(zip(*columns, paths, below, strict=True))
    out = pd.DataFrame(nodes, columns=_NODE)
    out["parent_conv"] = out["parent_conv"].astype("Int64")
    for c in ("pa", "pb"):
        out[c] = out[c].astype("Int64").where(np.array(tops, bool))
    return out


def _below(tops: DataFrame) -> DataFrame:
    """What hangs below each parent (a, b) of the tops."""
    return tops.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def segment_nodes(rows: DataFrame, unit: int, task: int) -> DataFrame:
    """The nodes (stored) of one segment's ``rows`` (of ``segment_paths``, with what hangs below their last nodes)."""
    spines, parts = [], []
    while True:
        sizes = rows.groupBy("ta", "tb").agg(F.sum(F.size("path")).alias("turns"), F.count(F.lit(1)).alias("rows"))
        large = stored(sizes.where((F.col("turns") > unit) & (F.col("rows") > 1)).select("ta", "tb"), "large-units")
        some = large.limit(1).count() > 0
        small = rows.join(large, ["ta", "tb"], "left_anti") if some else rows
        buckets = max(1, -(-(small.agg(F.sum(F.size("path"))).head()[0] or 0) // task))
        lists = [F.col(f"path.{c}").alias(c) for c in ("h", "g", "size")]
        dealt = small.select(F.pmod(F.xxhash64("ta", "tb"), F.lit(buckets)).alias("bucket"), "ta", "tb", "pa", "pb", "top", "n", "conv", *lists, *(F.col(c).cast("double" if c == "n_children" else "bigint") for c in ("n_children", "n_leaves", "saved_tokens")))
        parts.append(stored(dealt.groupBy("bucket").applyInPandas(_tries, _NODE_TYPE), "trie-nodes"))
        if not some:
            break
        rows = stored(rows.join(large, ["ta", "tb"]), "large-paths")
        ends = F.size("path") == 1  # what hangs below the last node of a path that ends here
        hanging = [F.coalesce(F.max(F.when(ends, F.col(c))), F.lit(0)).alias(f"own_{c}") for c in ("n_children", "n_leaves", "saved_tokens")]
        spine = rows.groupBy("ta", "tb", "pa", "pb", "top").agg(F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.max(F.get("path", F.lit(0))["size"]).alias("size"), *hanging)
        spines.append(stored(spine, "spine"))
        then = F.get("path", F.lit(1))
        rows = rows.where(F.size("path") > 1).select("a", "b", "n", "conv", F.col("ta").bitwiseXOR(then["h"]).alias("ta"), F.col("tb").bitwiseXOR(then["g"]).alias("tb"), F.col("ta").alias("pa"), F.col("tb").alias("pb"), (F.col("top") + 1).alias("top"), F.slice("path", F.lit(2), F.size("path") - 1).alias("path"), "n_children", "n_leaves", "saved_tokens")
        rows = stored(rows, "next-paths")
    nodes = reduce(DataFrame.unionByName, parts)
    tops = nodes.where("pa IS NOT NULL")
    for spine in reversed(spines):
        kids = _below(tops).withColumnsRenamed({"a": "ta", "b": "tb"})
        both = spine.join(kids, ["ta", "tb"], "left")
        total = {c: F.col(f"own_{c}") + F.coalesce(c, F.lit(0)) for c in ("n_children", "n_leaves", "saved_tokens")}
        done = both.select(F.col("ta").alias("a"), F.col("tb").alias("b"), F.col("top").alias("depth"), "conv", F.lit(None).cast("bigint").alias("parent_conv"), "pa", "pb", "n_convs", total["n_children"].alias("n_children"), F.when(total["n_children"] == 0, 1).otherwise(total["n_leaves"]).alias("n_leaves"), (total["saved_tokens"] + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
        done = stored(done, "spine-nodes")
        nodes, tops = nodes.unionByName(done), tops.unionByName(done)
    return stored(nodes, "segment-nodes")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): for each node the digest of its conversations ``ends`` (depth, a, b, conv), in order, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for depth, a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, a, b) != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (depth, a, b), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield _digest_rows(out)
        if last is not None:
            yield _digest_rows([(*last, digest.hexdigest())])

    order = ["depth", "a", "b"]
    return ends.select(*order, "conv").repartition(*order).sortWithinPartitions(*order, "conv").mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["depth", "a", "b", "ends_sha256"])


def trie_nodes(steps: DataFrame, convs: DataFrame, key: str = "conv_id", segment: int = SEGMENT, unit: int = UNIT, task: int = TASK) -> DataFrame:
    """The trie of ``steps`` (conv, d, digest, size) and ``convs`` (conv, also those without turns).

    A row a node: key (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    steps = stored(with_nodes(steps, segment), "steps")
    paths = stored(segment_paths(steps, segment), "paths")
    deepest = paths.agg(F.max("seg")).head()[0]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    parts, below = [], None
    for seg in range(-1 if deepest is None else deepest, -1, -1):
        rows = paths.where(F.col("seg") == seg).drop("seg")
        rows = rows.select("*", *none) if below is None else rows.join(below, ["a", "b"], "left")
        parts.append(segment_nodes(rows, unit, task))
        below = _below(parts[-1].where("pa IS NOT NULL"))
    everyone = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv")).where("n_convs > 0")
    hanging = [F.lit(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens")]
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "depth")]
    no_one = [F.lit(None).cast("bigint").alias(c) for c in ("parent_conv", "pa", "pb")]
    if below is None:
        nodes = everyone.select(*zero, "conv", *no_one, "n_convs", *hanging)
    else:
        root = everyone.join(F.broadcast(below.where("a = 0 AND b = 0")))  # the root's node is (0, 0); one row each
        nodes = reduce(DataFrame.unionByName, parts).unionByName(root.select(*zero, "conv", *no_one, "n_convs", "n_children", "n_leaves", "saved_tokens"))
    nodes = stored(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("above"))
    tops = nodes.where("pa IS NOT NULL").join(parents, ["depth", "pa", "pb"]).withColumn("parent_conv", F.col("above")).select(*nodes.columns)
    named = nodes.where("pa IS NULL").unionByName(tops)
    stops = steps.where("stop").select((F.col("d") + 1).alias("depth"), "a", "b", "conv")
    turnless = convs.join(steps.where("d = 0").select("conv"), "conv", "left_anti").select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv")
    out = named.join(ends_digests(stops.unionByName(turnless)), ["depth", "a", "b"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    result = out.select(F.col("conv").alias(key), "depth", F.col("parent_conv").alias(f"parent_{key}"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
    for used in (paths, *parts):
        discard(used)
    return result


def conversation_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", **limits) -> DataFrame:
    """The trie of the conversations in ``turns``."""
    steps = ordered_turns(turns, key, turn, role, text)
    return trie_nodes(steps, turns.where(F.col(key).isNotNull()).select(F.col(key).alias("conv")).distinct(), key, **limits)


def rebuilt(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, conversations): each conversation begins with the first h turns of the one whose number is the multiple of 5 below."""
    conv = F.col("conv")
    h: Column = F.crc32(conv.cast("string")) % 9
    convs = steps.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    plan = convs.select("conv", h.alias("h"), (conv - conv % 5).alias("base"))
    counted = plan.join(convs.select(F.col("conv").alias("base"), F.least(F.col("n"), F.lit(8)).alias("has")), "base", "left").select("conv", "h", "base", F.least("h", F.coalesce("has", F.lit(0))).alias("got"))
    beginnings = steps.where("d < 8").select(F.col("conv").alias("base"), "d", "digest", "size")
    heads = counted.join(beginnings, "base").where("d < h").select("conv", "d", "digest", "size")
    tails = steps.join(counted.select("conv", "h", "got"), "conv").where("d >= h").select("conv", (F.col("d") - F.col("h") + F.col("got")).alias("d"), "digest", "size")
    return heads.unionByName(tails), convs.select("conv")


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    own = stored(ordered_turns(table(spark, folder, "conversations")), "turns")
    return trie_nodes(*rebuilt(own))


ORACLE = """
WITH RECURSIVE digests AS (
  SELECT conv_id c, turn, strlen(coalesce(text, '')) size,
         md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) m
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, size, m, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) - 1 d FROM digests),
counts AS (SELECT c, count(*) n FROM own GROUP BY c),
crc(c, s, k, x) AS (
  SELECT c, c::VARCHAR, 0, 4294967295::BIGINT FROM counts
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END v FROM crc WHERE k < 8 * length(s))),
taken AS (SELECT c, c - c % 5 base, xor(x, 4294967295::BIGINT) % 9 h FROM crc WHERE k = 8 * length(s)),
steps AS (
  SELECT t.c, o.d, o.m, o.size FROM taken t JOIN own o ON o.c = t.base AND o.d < t.h
  UNION ALL
  SELECT o.c, o.d - t.h + least(t.h, coalesce(b.n, 0)), o.m, o.size
  FROM own o JOIN taken t USING (c) LEFT JOIN counts b ON b.c = t.base WHERE o.d >= t.h),
members AS (
  SELECT c, d + 1 depth, size, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) id FROM steps
  UNION ALL SELECT c, 0, 0, '' FROM counts),
nodes AS (SELECT id, min(depth) depth, min(size) size, min(c) c, count(*) n FROM members GROUP BY id),
kids AS (SELECT left(id, length(id) - 32) id, count(*) n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT v.*, coalesce(k.n, 0) n_children FROM nodes v LEFT JOIN kids k USING (id)),
subtrees AS (
  SELECT m.id, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) n_leaves, sum((v.n - 1) * v.size) saved
  FROM full_nodes v JOIN members m ON m.c = v.c AND m.depth <= v.depth GROUP BY m.id),
lasts AS (SELECT c, max(depth) depth FROM members GROUP BY c),
ends AS (SELECT m.id, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) sha FROM members m JOIN lasts USING (c, depth) GROUP BY m.id)
SELECT v.c conv_id, v.depth::BIGINT depth, p.c parent_conv_id, v.n n_convs, v.n_children, s.n_leaves::BIGINT n_leaves,
       s.saved::BIGINT saved_tokens, coalesce(e.sha, sha256('')) ends_sha256
FROM full_nodes v JOIN subtrees s USING (id) LEFT JOIN ends e USING (id)
LEFT JOIN nodes p ON v.depth > 0 AND p.id = left(v.id, length(v.id) - 32)
"""
