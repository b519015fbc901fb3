"""Incremental vectors and published versions: what is encoded again, what a lost run leaves, what a refused version leaves."""

import numpy as np
import pytest

from polisgraph.operators import embedding
from polisgraph.sources import publish

TEXTS = "id string, node_type string, text string, neighbours array<string>"


def texts(spark, changes=None):
    rows = {f"n{k}": ("Project", f"text of {k}", [f"n{k + 1}"]) for k in range(40)} | (changes or {})
    return spark.createDataFrame([(i, *r) for i, r in rows.items()], TEXTS)


def test_only_what_changed_is_encoded_again(spark, tmp_path):
    store, encode = str(tmp_path / "vectors"), embedding.hashed_words(8)
    assert embedding.embed(texts(spark), store, encode, batch_texts=15, calls=4) == 40
    assert embedding.embed(texts(spark), store, encode) == 0
    changes = {"n3": ("Project", "another text", ["n4"]), "n5": ("Project", "text of 5", ["n6", "n9"]), "n99": ("Project", None, [])}
    assert sorted(r["id"] for r in embedding.changed(texts(spark, changes), embedding.state(spark, store)).collect()) == ["n3", "n5", "n99"]
    assert embedding.embed(texts(spark, changes), store, encode) == 3
    found = {r["id"]: r["embedding"] for r in embedding.state(spark, store).collect()}
    assert len(found) == 41 and found["n3"] == pytest.approx(encode(["another text"])[0].tolist()) and found["n99"] == [0.0] * 8
    # A text that goes back has its vector still; with ``full`` all are encoded.
    assert embedding.embed(texts(spark), store, encode) == 2
    assert embedding.embed(texts(spark), store, encode, full=True) == 40
    audit = spark.read.json(f"{store}/_audit")
    assert audit.count() == 40 + 3 + 2 + 40 and "text" not in audit.columns


def test_a_lost_run_resumes(spark, tmp_path):
    store, good = str(tmp_path / "vectors"), embedding.hashed_words(8)

    def fails(batch):
        if any(t.endswith("17") for t in batch):
            raise RuntimeError("lost")
        return np.ones((len(batch), 8))

    with pytest.raises(Exception, match="lost"):
        embedding.embed(texts(spark), store, fails, batch_texts=4)
    done = embedding.state(spark, store).count()
    assert 0 < done < 40
    assert embedding.embed(texts(spark), store, good) == 40 - done
    assert embedding.state(spark, store).count() == 40


PENDING = "id string, x double, y double, map_version int, cluster_id long, cluster_label string, distance double"


def pending(spark, n=20, shift=0.0, skip=()):
    return spark.createDataFrame([(f"n{k}", float(k) + shift, float(k % 3), 1, k % 4 - 1, f"c{k % 4}", 0.5) for k in range(n) if k not in skip], PENDING)


def nodes(spark, n=30):
    return spark.createDataFrame([(f"n{k}", "Project", None if k % 5 == 0 else f"Name {k}", None) for k in range(n)], "id string, type string, label string, key_fact string")


def edges(spark):
    rows = [(f"n{k}", "R", f"n{k + 1}") for k in range(30)] * 2 + [("n2", "R", "n1"), ("n1", "S", "n2")]
    return spark.createDataFrame(rows, "source_id string, rel string, target_id string")


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "map")
    assert publish.frames(spark, root) is None and publish.manifest(spark, root) is None
    first = publish.publish(root, "v1", pending(spark), nodes(spark), edges(spark))
    assert (first["node_count"], first["edge_count"], first["cluster_count"], first["previous_version"]) == (20, 21, 4, None)
    second = publish.publish(root, "v2", pending(spark, 21, 0.5, skip=(3,)), nodes(spark))
    assert (second["node_count"], second["edge_count"], second["previous_version"]) == (20, 0, "v1")
    assert publish.manifest(spark, root) == second
    rows = {r["id"]: r for r in publish.frames(spark, root).collect()}
    assert (rows["n4"].x, rows["n4"].previous_x, rows["n4"].had_canonical_before) == (4.5, 4.0, True)
    assert (rows["n3"].x, rows["n3"].previous_x) == (None, 3.0)  # demoted
    assert (rows["n20"].previous_x, rows["n20"].had_canonical_before) == (None, False)  # an entrant
    publish.publish(root, "v3", pending(spark, 21, 0.5), nodes(spark))
    rows = {r["id"]: r for r in publish.frames(spark, root).collect()}
    assert (rows["n3"].x, rows["n3"].previous_x, rows["n3"].had_canonical_before) == (3.5, None, False)  # what was before v2 is gone
    shown = {r["id"]: r for r in spark.read.json(f"{root}/v3/nodes").collect()}
    assert shown["n5"].label == "n5" and shown["n6"].label == "Name 6"
    with pytest.raises(FileExistsError):
        publish.publish(root, "v3", pending(spark), nodes(spark))


@pytest.mark.parametrize(("version", "budget"), [("far", {}), ("centre", {"most_node_shift": None, "most_centre_shift": 0.1}), ("large", {"most_node_shift": None, "most_centre_shift": None, "most_bytes": 10})])
def test_a_refused_version_leaves_the_old_one(spark, tmp_path, version, budget):
    root = str(tmp_path / "map")
    publish.publish(root, "v1", pending(spark), nodes(spark))
    with pytest.raises(publish.OverBudget):
        publish.publish(root, version, pending(spark, 20, 6.0), nodes(spark), **budget)
    assert publish.manifest(spark, root)["version"] == "v1"
    assert publish.frames(spark, root).where("x is not null").count() == 20
    publish.publish(root, "again", pending(spark, 20, 6.0), nodes(spark), most_node_shift=None, most_centre_shift=None)
    assert publish.manifest(spark, root)["version"] == "again"
