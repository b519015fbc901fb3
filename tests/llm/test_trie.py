"""The prefix trie against brute force and its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import compare
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from polisgraph.llm import trie

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            told[c].append((turn is not None, turn or 0, digest, role, text))
    told = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in told.items()}
    whole = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(told.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    sums = {}
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = [sums[k] for k in kids[key]]
        sums[key] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    ends = lambda key: hashlib.sha256(",".join(str(c) for c in members[key] if whole[c] == key).encode()).hexdigest()
    out = [(m[0], len(key), members[key[:-1]][0] if key else None, len(m), len(kids[key]), *sums[key], ends(key)) for key, m in members.items()]
    return sorted(out, key=str)


def made(seed, n=120, depth=9):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.randint(1, depth)):
            rows.append((c * r.choice([1, 1, 3]), turn, r.choice(["user", "assistant", None]), r.choice(["a b", "a b", "", None, "c d e", "f\n g"])))
    rows += [(7000 + k, t, "user", "same words here") for k in range(60) for t in range(5)]  # copies
    rows += [(9000, t, "user", f"turn {t % 3}") for t in range(700)]  # a long one
    rows += [(4, None, "user", "no place"), (4, 2, "x", "tie"), (4, 2, "x", "tie"), (None, 0, "user", "no id"), (-45, 1, "a", "b"), (5001, 0, "user", "only one"), (5003, 0, "u", "v"), (5003, 1, "u", "w")]
    return rows


@pytest.mark.parametrize(("seed", "chunk"), [(1, 512), (2, 3)])
def test_nodes_are_brute_force(spark, seed, chunk):
    rows = made(seed)
    table = spark.createDataFrame(rows, COLUMNS).withColumn("depth", F.lit("clash")).withColumn("a", F.lit(0)).repartition(3)
    found = trie.prefix_trie(table, chunk=chunk)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_turnless_and_empty(spark):
    # Conversations whose first of the family is absent lose the turns that they would have borrowed.
    lone = next(c for c in range(21, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    for rows in ([(lone, 0, "user", "gone")], [(lone, 0, "user", "gone"), (lone + 400, 0, "u", "x"), (lone + 400, 1, "u", "x"), (lone + 400, 2, "u", "x"), (lone + 400, 3, "u", "x")]):
        assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, COLUMNS)).collect()), key=str) == brute(rows)
    assert trie.prefix_trie(spark.createDataFrame([], COLUMNS)).collect() == []


def test_running_totals_of_one_large_key(spark):
    rows = [(1, k, k % 7) for k in range(5000)] + [(2, 1, 5), (3, 9, 1)]
    found = trie.running(spark.createDataFrame(rows, "k long, t long, v long"), ["k"], [F.col("t").asc()], {"s": ("sum", F.col("v")), "x": ("xor", F.col("v"))}, "test")
    total, mixed, want = 0, 0, {}
    for _, t, v in rows[:5000]:
        total, mixed = total + v, mixed ^ v
        want[t] = (total, mixed)
    got = {r.t: (r.s, r.x) for r in found.where("k = 1").collect()}
    assert got == want


def test_rows_are_those_of_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    want, found = con.sql(trie.OP13_SQL).df(), trie.op13_prefix_trie(spark, SF).toPandas()
    assert compare.tidy(pd.DataFrame(found).astype(object).where(lambda x: x.notna(), None)) == compare.tidy(want.astype(object).where(lambda x: x.notna(), None))
