"""Incremental index rebuild: only dirty domains are read and written, and a lost driver leaves the old state."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from telemark.sources import index_store as X

SCHEMA = "domain string, id int, q string, a string"
FIRST = [("logs", 1, "q1", "a1"), ("logs", 2, "q2", "a2"), ("pods", 3, "q3", "a3"), (None, 4, "q4", "a4"), ("", 5, "q5", "a5"), ("7", 6, "q6", "a6")]


def _only(*allowed):
    """Vectors for the given domains; any row of another one fails the job."""
    def vectors(rows):
        other = ~F.col("domain").isin(*allowed) if allowed else F.lit(True)
        return rows.withColumn("vector", F.when(other, F.raise_error(F.lit("a clean domain was read")).cast("array<float>"))
                               .otherwise(F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))
    return vectors


def _all(rows):
    return rows.withColumn("vector", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>"))


def _build(spark, path, rows, **kw):
    kw.setdefault("vectors", _all)
    out = X.rebuild_index(spark.createDataFrame(rows, SCHEMA), path, "domain", "id", "q", "a", **kw)
    return {r.domain: r.reason for r in out.collect()}


def _written(path, build):
    return {os.path.basename(p) for p in glob.glob(f"{path}/rows/build={build}/part=*")}


def _state(spark, path):
    return {(r.domain, r.id, r.question, tuple(r.vector)) for r in X.read_index(spark, path).collect()}


def test_only_dirty_domains_are_read_and_written(spark, tmp_dir):
    path = os.path.join(tmp_dir, "idx")
    assert set(_build(spark, path, FIRST).values()) == {"missing"}
    assert len(_written(path, 1)) == 5
    assert {s[:3] for s in _state(spark, path)} == {r[:3] for r in FIRST}

    later = [("logs", 1, "q1", "a1"), ("logs", 2, "changed", "a2"), *FIRST[2:], ("new", 9, "q9", "a9")]
    got = _build(spark, path, later, vectors=_only("logs", "new"))
    assert got == {"logs": "hash", "new": "missing", "pods": "ok", None: "ok", "": "ok", "7": "ok"}
    assert _written(path, 2) == {"part=d-logs", "part=d-new"}
    state = _state(spark, path)
    assert {s[:3] for s in state} == {r[:3] for r in later}
    assert {s[0]: s[3] for s in state}["logs"] == (1.0, 2.0) and {s[0]: s[3] for s in state}["pods"] == (0.5, 0.5)

    # nothing changed: no rows, no vectors, no new header
    assert set(_build(spark, path, later, vectors=_only()).values()) == {"ok"}
    assert not _written(path, 3) and not os.path.exists(f"{path}/header/build=3")


def test_lost_driver_between_rows_and_header_leaves_the_old_state(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "idx")
    _build(spark, path, FIRST)
    before = _state(spark, path)
    later = [("logs", 1, "other", "a1"), *FIRST[2:]]

    class Lost(Exception):
        pass

    real = X.F.greatest                    # the first step after the rows of the build are written

    def lost(*a):
        raise Lost
    monkeypatch.setattr(X.F, "greatest", lost)
    with pytest.raises(Lost):
        _build(spark, path, later)
    monkeypatch.setattr(X.F, "greatest", real)
    assert _written(path, 2) == {"part=d-logs"} and _state(spark, path) == before
    assert _build(spark, path, later)["logs"] == "hash"
    assert {s[:3] for s in _state(spark, path)} == {r[:3] for r in later}

    # a header that was begun and not finished is not the newest state
    os.makedirs(f"{path}/header/build=3")
    assert {s[:3] for s in _state(spark, path)} == {r[:3] for r in later}


def test_removed_domains_shape_force_and_vacuum(spark, tmp_dir):
    path = os.path.join(tmp_dir, "idx")
    _build(spark, path, FIRST)
    kept = [r for r in FIRST if r[0] != "pods"]
    assert "pods" not in _build(spark, path, kept, vectors=_only())
    assert {s[0] for s in _state(spark, path)} == {"logs", None, "", "7"}
    assert set(_build(spark, path, kept, vector_dim=2).values()) == {"ok"}
    assert set(_build(spark, path, kept, vector_dim=3).values()) == {"shape"}
    assert set(_build(spark, path, kept, force=True).values()) == {"force"}
    state = _state(spark, path)
    assert 1 in X.vacuum_index(spark, path) and _state(spark, path) == state and not os.path.exists(f"{path}/rows/build=1")


def test_no_examples_and_no_index(spark, tmp_dir):
    path = os.path.join(tmp_dir, "idx")
    with pytest.raises(FileNotFoundError):
        X.read_index(spark, path)
    assert _build(spark, path, []) == {}
    assert X.stored_header(spark, path).count() == 0
