"""Ranked lexical search against brute force and its SQL."""

import math
import random
import re
from collections import Counter

import compare
import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from polisgraph.llm import maxscore

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    """Rows of (item, rank, doc, score); ``docs`` are (id, text), ``items`` (id, text)."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n, total = sum(1 for *_, c in bags if c), sum(c for *_, c in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    pooled: dict = {}
    for item, text in dict.fromkeys(items):
        pooled.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, asked in pooled.items():
        scored = []
        for d, bag, length in bags:
            if length:
                m = 25 + 75 * length * n // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, q in asked.items() if bag[t])
                if s > 0:
                    scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def made(seed=3, n=150):
    r = random.Random(seed)
    word = lambda: "w" + str(int(r.paretovariate(0.8)))
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 40)))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "?!"), (None, "w1 w2 w7"), (3, "w1 w1 W3-w5"), (3, "w1 w1 W3-w5"), *((500 + k, "w2 w9 w9 Ünï") for k in range(30)), (999, "w1 " * 5000 + "w9")]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(25)]
    return docs, [*items, (77, None), (78, ""), (None, "w9 w2"), (1, "w1 zz"), (80, "w4"), (80, "w4"), (81, "never")]


@pytest.mark.parametrize(("shard_docs", "slice_bytes", "window", "block"), [(7, 64, 4, 40), (1000, 1 << 20, 2048, 1_000_000), (50, 300, 16, 1_000_000)])
def test_rows_are_brute_force(spark, tmp_path, shard_docs, slice_bytes, window, block):
    docs, items = made()
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    index = maxscore.build_index(table, str(tmp_path / "index"), shard_docs=shard_docs, slice_bytes=slice_bytes)
    found = maxscore.search(index, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string"), window=window, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_non_essential_lists_are_probed_for_few():
    """A frequent weak term is probed only for candidates that a rare term names."""
    n = 20_000
    hashes = np.array([1, 2], np.uint64)
    docs, counts = np.r_[np.arange(n), np.arange(0, n, 1000)].astype(np.uint32), np.r_[np.ones(n), np.ones(n // 1000)].astype(np.int64)
    lists = maxscore._Lists(hashes, np.full(n, 10, np.int64), hashes, np.array([n, len(docs)], np.int64), docs, counts, n, 10 * n, 10)
    at, scores = lists.best(np.array([0, 1]), np.array([1, 7000]), 10, 2048)
    assert set(at.tolist()) == set(range(0, n, 1000)) and len(set(scores.tolist())) == 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id string, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = maxscore.build_index(none, str(tmp_path / "a"))
    assert maxscore.search(index, items).collect() == []
    some = maxscore.build_index(spark.createDataFrame([("x", "A b"), ("y", "c"), ("z", "d")], "doc_id string, text string"), str(tmp_path / "b"))
    assert maxscore.search(some, items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in maxscore.search(some, items).collect()] == [(1, 1, "x")]


def test_rows_are_those_of_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, found = con.sql(maxscore.OP12_SQL).df(), maxscore.op12_lexical_search(spark, SF).toPandas()
    assert len(found) > 100
    assert compare.tidy(pd.DataFrame(found)) == compare.tidy(want)


def test_no_row_group_of_the_index_holds_two_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(40)], "doc_id long, text string").coalesce(2)
    maxscore.build_index(docs, f"file://{tmp_path}/index", shard_docs=4)
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("index/*.parquet")]
    assert sum(m.num_rows for m in files) >= 10
    assert all(m.row_group(k).num_rows == 1 for m in files for k in range(m.num_row_groups))
