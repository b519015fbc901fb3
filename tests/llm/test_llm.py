"""The ten operators and the pipeline against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polisgraph.llm import _common, _tokens, decontaminate, jaccard, langid, license, linededup, packing, tokenbin, topk, toxicity, warc
from polisgraph.llm.components import connected_components, joined_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=1):
    """Near copies in groups, repeated rows, nulls, empty and very long texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    out = []
    for k in range(n):
        w = list(base) if k % 2 else [word() for _ in range(r.randint(1, 90))]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    return [*out, out[1], None, "", " \n ", "One two", "one TWO", "three", " ".join(base) * 40]


def docs(spark, values):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(values)], DOCS)


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(sets):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("short_list", [2, 16])
def test_jaccard_is_brute_force(spark, short_list):
    values = texts()
    sets = [shingle_set(t) for t in values]
    got = jaccard.near_duplicates(docs(spark, values), short_list=short_list).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), c) for i, c in enumerate(components(sets))}


def test_jaccard_of_few_links_runs_few_jobs(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, values = [word() for _ in range(80)], []
    for k in range(120):  # near copies, and others that share a passage: short and long lists, and rounds
        w = list(base[:40]) + [word() for _ in range(40)] if k % 3 == 0 else list(base)
        for at in r.sample(range(80), k % 4):
            w[at] = word()
        values.append(" ".join(w))
    spark.sparkContext.setJobGroup("few-jobs", "near duplicates")
    try:
        got = jaccard.near_duplicates(docs(spark, values)).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert {(x.doc_id, x.component_id) for x in got} == set(enumerate(components([shingle_set(t) for t in values])))
    assert jobs <= 120, jobs


def test_components_of_one_partition_equal_rounds(spark, monkeypatch):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1020)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long")
    found, more = (_common.saved(table.where(w)) for w in ("a % 2 = 0", "a % 2 = 1 or a is null"))
    whole = {tuple(x) for x in connected_components(table).collect()}
    first = _common.saved(connected_components(found))
    assert {tuple(x) for x in joined_components(first, more).collect()} == whole
    monkeypatch.setattr(_common, "SAVED_ROWS", 10)
    assert {tuple(x) for x in connected_components(table).collect()} == whole
    assert {tuple(x) for x in joined_components(first, more).collect()} == whole


def test_jaccard_of_a_large_group_of_distant_copies_meets_few_pairs(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, values = [word() for _ in range(120)], []
    for k in range(500):  # 1 to 9 edits: from near the base to 0.5 alike, plus two groups that share a long passage only
        w = list(base)
        for _ in range(1 + k % 9):
            at = r.randrange(len(w))
            w[at : at + 1] = [[word()], [], [word(), word()]][k % 3]
        values.append(" ".join(w))
    for own in ([word() for _ in range(60)], [word() for _ in range(60)]):
        for k in range(60):
            w = base[:40] + own
            w[40 + k % 60] = word()
            values.append(" ".join(w))
    met = []
    verified = jaccard._Join.verified
    monkeypatch.setattr(jaccard._Join, "verified", lambda self, pairs: met.append(verified(self, pairs)) or met[-1])
    got = jaccard.near_duplicates(docs(spark, values), hot_sets=100).collect()
    assert {(x.doc_id, x.component_id) for x in got} == set(enumerate(components([shingle_set(t) for t in values])))
    assert sum(x.count() for x in met) < 20 * len(values)  # all pairs of the 500 are 124,750


def test_jaccard_of_copies_that_share_a_pivots_edits_makes_rows_in_proportion(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base, values = [word() for _ in range(100)], []
    for k in range(400):  # every copy lacks the pivot's edits; a third is far from most others
        w = list(base)
        for _ in range(1 + k % 2 if k % 3 else 4):
            w[r.randrange(len(w))] = word()
        values.append(" ".join(w))
    met = []
    verified = jaccard._Join.verified
    monkeypatch.setattr(jaccard._Join, "verified", lambda self, pairs: met.append(pairs.distinct().count()) or verified(self, pairs))
    got = jaccard.near_duplicates(docs(spark, values), hot_sets=100).collect()
    assert {(x.doc_id, x.component_id) for x in got} == set(enumerate(components([shingle_set(t) for t in values])))
    assert sum(met) < 10 * len(values)


def test_jaccard_of_tasks_with_and_without_frequent_shingles(spark):
    values = ["a b c d e f"] + [f"a b c d e x{k}" for k in range(40)] + [f"u{k} v{k} w{k} x{k} y{k} z{k}" for k in range(40)] + ["a b c d e"]
    got = jaccard.near_duplicates(docs(spark, values).repartitionByRange(4, "doc_id"), hot_sets=16).collect()
    assert {(r.doc_id, r.component_id) for r in got} == set(enumerate(components([shingle_set(t) for t in values])))


def test_jaccard_of_nothing_and_without_ids(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id) for r in jaccard.near_duplicates(rows).collect() if r.doc_id) == [(False, 5), (False, 5)]


def test_equal_items_fill_blocks_too(spark):
    """Ids count towards a block, so one window with very many items is not held at once."""
    text = " ".join(f"w{k}" for k in range(13))
    items = [(k, text) for k in range(100)]
    blocks = list(decontaminate._blocks(iter(items), 13, 30))
    assert max(sum(map(len, b.values())) for b in blocks) <= 30 and sum(len(ids) for b in blocks for ids in b.values()) == 100
    found = decontaminate.mark(docs(spark, [f"x {text} y", "z"]), spark.createDataFrame(items, "item_id long, text string"), block_words=60).collect()
    assert [(r.doc_id, r.n_hit, r.n_items) for r in sorted(found)] == [(0, 13, 100), (1, 0, 0)]


@pytest.mark.parametrize("block_words", [30, 2_000_000])
def test_decontamination_is_brute_force(spark, block_words):
    values = [t for t in texts() if t is None or len(t) < 5000]
    items = [(1, " ".join(values[1].split()[:20])), (2, "One, two!"), (3, None), (4, "..."), (5, values[3]), (5, values[3])]
    got = {r.doc_id: r for r in decontaminate.mark(docs(spark, values).withColumn("n_hit", F.lit("x")), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in enumerate(values):
        w, hit, ids = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            windows = [x[k : k + 13] for k in range(max(1, len(x) - 12))] if x else []
            for win in windows:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        ids.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(ids))
        assert r.contaminated == bool(hit and 20 * len(hit) >= len(w))
        assert sum(len(cut(t[s.start : s.end])) for s in r.hit_spans) == len(hit)


def test_packing_places_every_id_once(spark):
    values = texts(20)
    t = Tokenizer.from_file(_tokens.default_vocabulary())
    t.encode_special_tokens = True
    rows = packing.pack(docs(spark, values), size=64, with_ids=True).collect()
    for i, v in enumerate(values):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*t.encode(v or "", add_special_tokens=False).ids, 1] and own[0].doc_tokens == len(ids)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 2
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    values = [*texts(20), "<|endoftext|> tail  \n  x"]
    t = Tokenizer.from_file(_tokens.default_vocabulary())
    t.encode_special_tokens = True
    manifest = tokenbin.write_ids(docs(spark, values), str(tmp_path / "ids"))
    at = 0
    for r in sorted(tokenbin.read_digests(manifest, str(tmp_path / "ids")).collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(values[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_chunked_encoding_is_whole_encoding():
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "a", "\u0120", "É", "don't", "<|endoftext|>", "12", "!?", "\u0301", "日本", "\r\n", "🙂", "\u200b", "\x00", "_"]
    values = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    e = _tokens.Encoder(_tokens.default_vocabulary())
    found = [ids for at in range(0, len(values), 500) for ids in e.ids(values[at : at + 500])]
    assert found == e.whole(values)
    assert e.ids([None, ""]) == [b"", b""]


def test_chunks_of_a_full_table_that_are_at_hand_are_not_encoded_again(monkeypatch):
    e = _tokens.Encoder(_tokens.default_vocabulary())
    monkeypatch.setattr(_tokens, "CACHE_CHUNKS", 6)
    learned = []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda chunks: learned.extend(chunks) or learn(chunks))
    values = ["x one two one", None, " two ", "x four five six seven two\n"]
    assert e.ids(pa.array(values[:3])) == e.whole(values[:1]) + [b""] + e.whole(values[2:3])
    assert e.ids(pa.array(["x one eight nine ten eleven twelve", *values[3:]])) == e.whole(["x one eight nine ten eleven twelve", *values[3:]])
    assert e.ids(pa.array(["x one"])) == e.whole(["x one"])
    assert learned.count("one") == 1


@pytest.mark.parametrize("seed", range(5))
def test_blocks_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = np.concatenate([r.integers(0, 50_000, 3000), r.integers(0, 2**32, 5)]).astype(np.uint32)
    assert (tokenbin.decode_block(tokenbin.encode_block(ids)) == ids).all()


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(d.select("doc_id", "text", "lang"), langid.fit(d))
    rows = found.where(langid.held_out() & (F.col("lang_pred") != "und")).select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    odd = docs(spark, [None, "", "12 %", "the cat and the dog"])
    assert [r.lang_pred == "und" for r in langid.identify(odd, langid.fit(d)).orderBy("doc_id").collect()] == [True, True, True, False]
    assert langid.fit(spark.createDataFrame([], DOCS)) is None


def test_toxicity_on_held_out_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_toxicity(d.select("doc_id", "text"), toxicity.fit(d, labels))
    rows = found.join(labels, "doc_id").where(langid.held_out()).select("toxicity", "toxic").collect()
    bad, good = [r.toxicity for r in rows if r.toxic], [r.toxicity for r in rows if not r.toxic]
    assert np.mean([x > y for x in bad for y in good]) > 0.9
    odd = toxicity.score_toxicity(docs(spark, [None, "", "..."]), toxicity.fit(d, labels)).collect()
    assert all(0 <= r.toxicity < 0.5 for r in odd)
    assert toxicity.fit(d, labels.where("false")) == 0.0


def test_toxicity_with_few_labels_still_ranks(spark):
    """Five toxic labels give no evident feature; scores must differ, and the planted words rank first."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    plain = lambda: [r.choice(common) for _ in range(30)]
    values = [" ".join([*plain(), *(["vilezz", "rotzz"] if k % 8 == 0 else [])]) for k in range(80)]
    d = docs(spark, values)
    known = [(k, 0, int(k % 8 == 0)) for k in range(80) if zlib.crc32(str(k).encode()) % 5][:45]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    assert 0 < sum(t for *_, t in known) <= 8
    got = {x.doc_id: x.toxicity for x in toxicity.score_toxicity(d, toxicity.fit(d, labels)).collect()}
    bad, good = [got[k] for k in range(80) if k % 8 == 0], [got[k] for k in range(80) if k % 8]
    assert min(bad) > max(good)


def test_toxicity_of_the_smallest_tables_tells_documents_apart(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(d.select("doc_id", "text"), toxicity.fit(d, labels)).join(labels.select("doc_id", "toxic"), "doc_id").select("toxicity", "toxic").collect()
    bad, good = [x.toxicity for x in rows if x.toxic], [x.toxicity for x in rows if not x.toxic]
    assert len(set(bad + good)) > 10 and sum(bad) / len(bad) > sum(good) / len(good) + 0.2


def test_line_dedup_keeps_the_first_and_cuts_the_later(spark):
    line = lambda k: " ".join(f"w{k}x{i}" for i in range(15))
    shared = "\n".join(line(k) for k in range(4))
    values = [f"{line(10)}\n{shared}\n{line(11)}", f"{line(20)}\n{shared}\n{line(21)}", shared, line(0), None, "", line(30)]
    got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, values)).collect()}
    assert got[0].text == values[0] and got[1].text == f"{line(20)}\n{line(21)}"
    assert got[2].all_deleted and got[2].text == ""
    assert got[3].text == values[3] and got[4].text is None and got[5].text == "" and got[6].text == values[6]


def test_line_dedup_meets_every_holder_of_a_passage(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    for singles in (1, 40):
        values = [a, b, f"{a}\n{b}", *[a, b] * singles, f"{a}\n{b}"]
        got = {r.doc_id: r for r in linededup.dedup_lines(docs(spark, values)).collect()}
        assert [i for i, r in got.items() if r.deleted_lines] == [len(values) - 1] and got[len(values) - 1].all_deleted


def common_lines(x, y, size, least):
    """Lines of ``y`` in common blocks of at least ``least`` words, by all pairs of places."""
    out = set()
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if sum(size[v] for v in y[j : j + n]) >= least:
                out |= {j + k for k in range(n)}
    return out


def trimmed(found, y, size):
    """Without blank lines, which count only inside a block."""
    return sorted(k for k in found if size[y[k]])


@pytest.mark.parametrize("least", [1, 7, 40])
def test_aligned_lines_are_brute_force(least):
    r = random.Random(least)
    for case in range(200):
        size = {v: r.choice([0, 1, 5, 12, 45]) for v in range(1, 8)} | {0: 0}
        x, y = ([r.randint(0, r.choice([2, 7])) for _ in range(r.randint(0, 25))] for _ in range(2))
        v, w = (np.array([size[k] for k in z], np.int32) for z in (x, y))
        got = linededup.aligned_lines(np.array(x, np.uint64), np.array(y, np.uint64), v, w, least).tolist()
        assert got == trimmed(common_lines(x, y, size, least), y, size), (case, x, y)


def test_line_dedup_cuts_moved_and_repeated_passages(spark):
    p, r = (" ".join(f"{k}{i}" for i in range(50)) for k in "pr")
    values = [f"h\na\n{p}", f"h\nz\n{p}\nw\n{p}", f"{r}\nq\n{p}", f"{p}\nz\n{r}"]
    got = {d.doc_id: d.text for d in linededup.dedup_lines(docs(spark, values)).collect()}
    assert got == {0: values[0], 1: "h\nz\nw", 2: f"{r}\nq", 3: "z"}


def test_line_dedup_keeps_a_blank_line_beside_a_line_that_stays(spark):
    a = " ".join(f"a{i}" for i in range(45))
    values = [f"{a}\n\nb", f"{a}\n\nc", f"{a}\n\n{a}", f"\n{a}\nd\n"]
    got = {d.doc_id: d.deleted_lines for d in linededup.dedup_lines(docs(spark, values)).collect()}
    assert got == {0: [], 1: [0], 2: [0, 1, 2], 3: [0, 1]}


def test_alignment_grows_from_runs_without_unique_lines():
    """Lines that all stand twice: no anchor is unique, and the block is aligned from a shared run."""
    x, y = [1, 2, 1, 2, 9, 3, 4, 3, 4], [3, 4, 3, 4, 8, 1, 2, 1, 2]
    w = np.full(9, 5, np.int32)
    assert linededup.aligned_lines(np.array(x, np.uint64), np.array(y, np.uint64), w, w, 20).tolist() == [0, 1, 2, 3, 5, 6, 7, 8]
    assert linededup.grown(x, y, 0, 5, 2) == (5, 9)


def test_patience_diff_aligns_the_gaps_between_anchors():
    assert linededup.common_blocks([101, 11, 1, 2, 3, 12, 102, 1, 2, 3], [101, 21, 1, 2, 3, 22, 102, 1, 2, 3]) == [(0, 0, 1), (2, 2, 3), (6, 6, 4)]


def test_line_dedup_of_repeats_nulls_and_clashing_columns(spark):
    p = " ".join(f"p{i}" for i in range(50))
    rows = [(1, p, "x"), (1, p, "x"), (2, p, "y"), (None, p, "z"), (3, None, "z"), (4, "", "z"), (5, f"{p}\n\n{p}", "z")]
    found = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"))
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.deleted_lines, r.all_deleted) for r in found.collect()), key=lambda r: (r[0], r[2]))
    assert got == [(0, p, 1, [], False), (1, p, 1, [], False), (1, p, 1, [], False), (2, "", 1, [0], True), (3, None, 0, [], False), (4, "", 1, [], False), (5, "", 3, [0, 1, 2], True)]
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_is_brute_force(spark):
    r = random.Random(5)
    line = {k: " ".join(f"w{k}x{i}" for i in range(n)) for k, n in enumerate([0, 2, 15, 15, 20, 30, 45])}
    size = {k: len(t.split()) for k, t in line.items()}
    rows = [[r.randrange(7) for _ in range(r.randint(1, 9))] for _ in range(80)]
    got = {d.doc_id: d.deleted_lines for d in linededup.dedup_lines(docs(spark, ["\n".join(line[k] for k in row) for row in rows])).collect()}
    for j, y in enumerate(rows):
        lost = set().union(*[common_lines(x, y, size, linededup.BLOCK_WORDS) for x in rows[:j] if x != y or rows.index(y) < j])
        lost = set(trimmed(lost, y, size))
        for k in range(len(y)) if lost else ():  # a blank line between lines that go, or between one and the text's end
            sides = [next((i for i in side if size[y[i]]), None) for side in (range(k, -1, -1), range(k, len(y)))]
            lost |= {k} if not size[y[k]] and all(i is None or i in lost for i in sides) else set()
        assert got[j] == sorted(lost), j


def test_common_blocks_are_common():
    r = random.Random(3)
    for _ in range(100):
        x, y = ([r.randint(1, 9) for _ in range(r.randint(0, 30))] for _ in range(2))
        last = (-1, -1)
        for i, j, n in linededup.common_blocks(x, y):
            assert n > 0 and x[i : i + n] == y[j : j + n] and i > last[0] and j > last[1]
            last = (i + n - 1, j + n - 1)


def test_license_scan_finds_notices_and_their_places(spark):
    fill = "lorem ipsum dolor sit amet consectetur " * 30
    notice = dict((n, t) for n, t in reversed(license.TEMPLATES))
    apache, mit = notice["Apache-2.0"], next(t for n, t in license.TEMPLATES if n == "MIT" and t.startswith("Permission") and len(t) < 500)
    values = [f"{fill}\n{apache} {fill}", apache.upper(), fill, None, "", "MIT License.", f"é {mit.replace('without restriction', 'with no restriction')}"]
    values += [f"{apache} {fill} {apache} {apache}", license.texts.MIT]
    got = {r.doc_id: r.matches for r in license.scan_licenses(docs(spark, values).withColumn("matches", F.lit("x"))).collect()}
    assert [m.license for m in got[0]] == ["Apache-2.0"] and [m.license for m in got[1]] == ["Apache-2.0"] and [m.license for m in got[6]] == ["MIT"]
    assert values[0][got[0][0].start : got[0][0].end] == apache.rstrip(".")
    assert all(got[k] == [] for k in (2, 3, 4, 5))
    assert [values[7][m.start : m.end] for m in got[7]] == [apache.rstrip(".")] * 3
    assert [m.license for m in got[8]] == ["MIT", "MIT"] and got[8][0].start == 0 and got[8][0].end == len(values[8]) - 1
    bands, rows = license.band_settings(0.4)
    assert (1 - 0.4**rows) ** bands <= license.MISS
    assert license.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_license_scan_is_brute_force(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    made = [(f"L{k}", " ".join(word() for _ in range(n))) for k, n in enumerate([3, 5, 8, 20, 21, 60, 150])]
    values = []
    for k in range(60):
        w = [word() for _ in range(r.randint(0, 200))]
        for _, t in r.sample(made, r.randint(0, 3)):
            t = t.split()
            for _ in range(r.choice([0, 0, 1, len(t) // 20])):
                t[r.randrange(len(t))] = word()
            at = r.randint(0, len(w))
            w[at:at] = t
        values.append(" ".join(w))
    monkeypatch.setattr(license, "MAX_TEMPLATE_WORDS", 50)  # several steps
    table = spark.createDataFrame([*made, ("none", None), (None, made[0][1]), ("blank", " ")], "license string, text string")
    for templates in (made, table):
        got = {x.doc_id: {m.license for m in x.matches} for x in license.scan_licenses(docs(spark, values), templates).collect()}
        for i, v in enumerate(values):
            w, want = v.split(), set()
            for name, t in made:
                t = t.split()
                n = min(5, len(t))
                own = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
                cut = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
                span = len(t) - n + 1  # a passage as long as the template
                if any(len(own & set(cut[k : k + span])) >= 0.8 * len(own) for k in range(len(cut))):
                    want.add(name)
            assert want <= got[i], i
            assert all(any(5 * len({tuple(w[k : k + min(5, len(t.split()))]) for k in range(len(w))} & {tuple(t.split()[k : k + min(5, len(t.split()))]) for k in range(len(t.split()) - min(5, len(t.split())) + 1)}) >= 4 for n2, t in made if n2 == name) for name in got[i])


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=(300, 6)), 1)
    rows = [(i, x) for i, x in enumerate(v.tolist())] + [(300, v[5].tolist()), (301, None), (302, [1.0, None] * 3), (303, [float("nan")] * 6), (304, []), (305, [0.0] * 6), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 305")).collect()}
    q = np.floor(256 * np.array([x for i, x in rows if i is not None and (i < 301 or i == 305)], np.float32).astype(float)).astype(int)
    ids = [*range(301), 305]
    want = {}
    for i in [*range(0, 301, 50), 305]:
        scored = sorted((-int(q[ids.index(i)] @ q[k]), j) for k, j in enumerate(ids) if j != i)[:5]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(scored)}
    assert got == want
    parts = topk.top_k(df, df.where("vec_id % 50 = 0 or vec_id = 305"), block_rows=40).collect()
    assert {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in parts} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_the_threshold_stops_before_all_rows_where_dimensions_differ():
    r = np.random.default_rng(4)
    v = np.floor(256 * r.normal(size=(5000, 8)) * 2.0 ** -np.arange(8))
    lists = topk.SortedLists(np.arange(5000), v)
    for i in range(20):
        places, scores = lists.best(v[i], 5, i)
        all_ = v @ v[i]
        assert places.tolist() == [j for _, j in sorted((-s, j) for j, s in enumerate(all_.tolist()) if j != i)][:5]
        assert scores.tolist() == all_[places].tolist()
        floor = float(scores[2])
        assert lists.best(v[i], 5, i, floor)[0].tolist() == [j for j in sorted(range(5000), key=lambda j: (-all_[j], j)) if j != i and all_[j] >= floor][:5]
    assert lists.scored < 40 * 5000 / 4  # rows met by the forty searches


def test_principal_axes_let_the_threshold_stop(spark):
    r = np.random.default_rng(8)
    turn = np.linalg.qr(r.normal(size=(16, 16)))[0]
    v = np.floor(256 * (r.normal(size=(4000, 16)) * 2.0 ** -np.arange(16)) @ turn)
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "id long, v binary")
    axes = topk.principal_axes(rows)[128]
    assert np.allclose(axes.T @ axes, np.eye(16))
    plain, turned = topk.SortedLists(np.arange(4000), v), topk.SortedLists(np.arange(4000), v, axes)
    for i in range(30):
        a, b = plain.best(v[i], 5, i), turned.best(v[i], 5, i)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert turned.scored < plain.scored and turned.scored < 30 * 4000 / 10


def test_top_k_of_large_components(spark):
    rows = [(1, [2.0**33, 1.0]), (2, [2.0**-8, 2.0**20]), (3, [2.0**20, 3.0]), (3, [2.0**20, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x["rank"], x.vec_id, x.score) for x in topk.top_k(df, df.where("vec_id = 2")).collect()]
    assert sorted(got) == [(1, 1, 2**41 + 2**36), (2, 3, 2**28 + 2**28 * 768), (3, 3, 2**28 + 2**28 * 768)]
    with pytest.raises(Exception, match="(?i)overflow|too large|too big|int"):
        topk.top_k(df, df.where("vec_id = 1").withColumn("vec_id", F.lit(9).cast("long"))).collect()
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_archives_round_trip_in_order(spark, tmp_path):
    big = "x" * 1200
    rows = [(1, "http://www.b.org/1", big), (2, "http://a.org/z", big), (3, "http://a.org/z", "short"), (4, None, None), (5, "not a url", "short"), (6, "http://a.org/a?q=1", "é" * 600), (None, "http://b.org/1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(pages, folder, archive_bytes=1000)
    index = warc.capture_index(manifest, folder).collect()
    keys = [(r.urlkey, r.stamp) for r in index]
    assert keys == sorted(keys) and len(index) == len(rows)
    by = {r.page_id: r for r in index}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in by.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("revisit", 2)}
    assert warc.capture_index(warc.write_archives(pages.where("false"), folder), folder).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    r = random.Random(k)
    runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_pipeline_stages_keep_clean_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == d.columns, name
        before, after = {r.doc_id: r for r in kept.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        sizes.append(len(after))
        if name == "ngram_jaccard":
            ids = sorted(before)
            roots = components([shingle_set(before[i].text) for i in ids])
            assert set(after) == {ids[r] for r in roots}
        kept = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "packing"]
    assert sizes[0] > 0.9 * d.count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    """Each stage after the first on its own input, with nulls, repeats, ties, long texts and clashing columns."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    shared, item = [line(45) for _ in range(4)], line(20)
    values = ["\n".join(r.sample(shared, r.randint(0, 3)) + [line(r.randint(1, 60)) for _ in range(r.randint(0, 3))]) for _ in range(30)]
    near = line(120).split()
    for k in range(8):
        w = list(near)
        w[10 * k] = word()
        values.append(" ".join(w))
    values += [f"{line(5)} {item} {line(5)}", f"{line(900)} {item}", values[3], values[3], None, "", " \n ", "?!", line(30_000)]
    rows = [(i, t, "en", "s", len(t or ""), f"x{i}") for i, t in enumerate(values)]
    rows += [rows[5], (None, values[5], "en", "s", len(values[5]), "x")]
    d = spark.createDataFrame(rows, DOCS + ", n_hit string")
    sf = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    empty = d.limit(0)

    out = stage["line_dedup"](spark, d, sf)
    assert out.columns == d.columns and stage["line_dedup"](spark, empty, sf).count() == 0
    got = sorted((x.doc_id, x.text) for x in out.where("doc_id is not null").collect())
    key = lambda t: [" ".join(x.split()) for x in t.split("\n")]
    size = {x: len(x.split()) for t in values if t is not None for x in key(t)}
    want = []
    for j, t in enumerate(values):
        if t is not None:
            lost = set().union(*[common_lines(key(x), key(t), size, linededup.BLOCK_WORDS) for x in values[:j] if x is not None])
            lost = set(trimmed(lost, key(t), size))
            for k in range(len(key(t))) if lost else ():
                sides = [next((i for i in side if size[key(t)[i]]), None) for side in (range(k, -1, -1), range(k, len(key(t))))]
                lost |= {k} if not size[key(t)[k]] and all(i is None or i in lost for i in sides) else set()
            rest = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)
            if lost and not rest.strip():
                continue
            t = rest
        want += [(j, t)] * (2 if j == 5 else 1)
    assert got == sorted(want, key=lambda x: x[0])

    out = stage["ngram_jaccard"](spark, d, sf)
    assert out.columns == d.columns and stage["ngram_jaccard"](spark, empty, sf).count() == 0
    first = components([shingle_set(t) for t in values])
    assert sorted(x.doc_id for x in out.where("doc_id is not null").collect()) == sorted([i for i, c in enumerate(first) if c == i] + ([5] if first[5] == 5 else []))

    out = stage["decontaminate"](spark, d, sf)
    assert out.columns == d.columns and stage["decontaminate"](spark, empty, sf).count() == 0
    assert {x.doc_id for x in d.where("doc_id is not null").collect()} - {x.doc_id for x in out.collect()} == {38}

    out = stage["packing"](spark, d, sf).collect()
    t = Tokenizer.from_file(_tokens.default_vocabulary())
    t.encode_special_tokens = True
    tokens = lambda x: len(t.encode(x or "", add_special_tokens=False).ids) + 1
    assert sum(x.length for x in out) == sum(tokens(x[1]) for x in rows)
    assert {(x.doc_id, x.doc_tokens) for x in out} == {(x[0], tokens(x[1])) for x in rows}
    assert stage["packing"](spark, empty, sf).count() == 0

    kept = stage["language_id"](spark, d, sf)
    assert kept.columns == d.columns and {x.doc_id for x in kept.where("doc_id is not null").collect()} == {i for i, v in enumerate(values) if v and re.search("[a-z]", v)}
    assert stage["language_id"](spark, empty, sf).count() == 0 and stage["language_id"](spark, d.withColumn("lang", F.lit(None).cast("string")), sf).count() == kept.count()


def test_archives_of_large_ids_repeats_and_empty_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 2)
    same = "x" * 2000
    rows = [(5 * 10**11, "http://a.org/1", same), (-(2**62), "http://a.org/1", same), (2**62, "http://b.org", ""), (7, None, None), (7, None, None), (None, "http://a.org", same)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    assert manifest.where("records > 2").count() == 0
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in warc.capture_index(manifest, f"{tmp_path}/w").collect())
    assert got == [(False, -(2**62), "revisit", 5 * 10**11), (False, 7, "response", None), (False, 7, "response", None), (False, 5 * 10**11, "response", None), (False, 2**62, "response", None), (True, 0, "revisit", 5 * 10**11)]


def test_languages_of_one_letter_repeats_and_clashing_columns(spark):
    rows = [(i, "a" if i % 2 else "é", "x" if i % 2 else "y") for i in range(40)] + [(100, "a", None), (101, None, "x"), (102, "1", "x"), (103, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(d, langid.fit(d)).collect()}
    assert all(got[i][0] == ("x" if i % 2 else "y") for i in range(40)) and got[100][0] == "x"
    assert [got[k] for k in (101, 102, 103)] == [("und", 0.0)] * 3
    assert langid.fit(d.limit(0)) is None
