"""Recall of the near-duplicate operators against all pairs: python measure_recall.py DOCUMENTS N (a folder of parquet, how many texts).

All pairs of different n-gram sets are compared with numpy, block by block, without hashes of bands or signatures; then the
operators run over the same texts. Printed: links and texts that are linked, by all pairs and by the operator.
"""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from pyspark.sql import SparkSession

from lectern.llm import jaccard, minhash
from lectern.llm.text import utf8


def all_pairs(texts: list[str], n: int, threshold: float, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links to other sets, least member of the component) of each text."""
    row, grams = jaccard.ngrams(*utf8(pa.array(texts, pa.large_string())), n, member)
    sets = [np.unique(g) for g in np.split(grams, np.searchsorted(row, np.arange(1, len(texts))))]
    name: dict[bytes, int] = {}
    class_ = np.array([name.setdefault(s.tobytes(), len(name)) for s in sets])
    first = np.unique(class_, return_index=True)[1]
    kinds = [sets[k] for k in first]
    full = np.array([k for k, s in enumerate(kinds) if len(s)])
    links, label = np.zeros(len(kinds), np.int64), np.arange(len(kinds))
    size = 512
    pairs = []
    for a in range(0, len(full), size):
        for b in range(a, len(full), size):
            x, y = full[a : a + size], full[b : b + size]
            if a == b:
                hits = jaccard.compare([kinds[k] for k in x], None, threshold)
                np.fill_diagonal(hits, False)
                links[x] += hits.sum(axis=1)
            else:
                hits = jaccard.compare([kinds[k] for k in [*x, *y]], len(x), threshold)
                links[x] += hits.sum(axis=1)
                links[y] += hits.sum(axis=0)
            i, j = np.nonzero(hits)
            pairs.append(np.stack([x[i], y[j]], axis=1))
    edges = np.concatenate(pairs)
    while True:
        before = label.copy()
        for i, j in (edges.T, edges.T[::-1]):
            np.minimum.at(label, i, before[j])
        label = label[label]
        if (label == before).all():
            return links[class_], first[label[class_]]


def main(folder: str, n: int) -> None:
    docs = ds.dataset(folder).to_table(columns=["doc_id", "text"]).sort_by("doc_id").slice(0, n)
    ids, texts = docs["doc_id"].to_pylist(), [t or "" for t in docs["text"].to_pylist()]
    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    frame = spark.read.parquet(folder).where(f"doc_id <= {ids[-1]}")
    want, label = all_pairs(texts, jaccard.WORDS, jaccard.THRESHOLD, jaccard._WORD)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard.near_duplicates(frame).collect()}
    found = np.array([got[k][0] for k in ids])
    same = [got[k][1] == ids[j] for k, j, t in zip(ids, label, texts, strict=True) if t.strip()]
    print(f"op9: {len(ids)} texts, largest group {np.bincount(label).max()}, links by all pairs {want.sum() // 2}, found {np.minimum(found, want).sum() // 2} ({np.minimum(found, want).sum() / max(1, want.sum()):.6f}), too many {np.maximum(found - want, 0).sum() // 2}, in the right group {np.mean(same):.6f}", flush=True)
    _, label = all_pairs(texts, minhash.WORDS, minhash.THRESHOLD, minhash._WORD)
    got = {r.doc_id: r.component_id for r in minhash.near_components(frame).collect()}
    same = [got[k] == ids[j] for k, j, t in zip(ids, label, texts, strict=True) if t.strip()]
    print(f"op11: largest component {np.bincount(label).max()}, in the right component {np.mean(same):.6f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]))
