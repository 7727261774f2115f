import hashlib
import random
from pathlib import Path

import pytest
from folioforge.operators import claims
from pyspark.sql import functions as F

ROW = "cluster bigint, artifact bigint, claim_index int, text string, document bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def held(spark, path):
    return sorted(tuple(r) for r in claims.read(spark, path).select("cluster", "artifact", "claim_index", "text", "document").collect())


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def plain_key(rows):
    digests = [hashlib.sha256(f"{a}\t{t}".encode()).hexdigest() for a, t in rows]
    sums = [str(sum(int(d[i * 12 : i * 12 + 12], 16) for d in digests)) for i in range(5)]
    return hashlib.sha256(".".join([str(len(rows)), *sums]).encode()).hexdigest()


def test_key_is_that_of_the_multiset(spark):
    rows = [(c, random.Random(100 * c + i).randrange(9), i, f"claim {i % 4}", 1) for c in range(5) for i in range(20)]
    made = frame(spark, rows).groupBy("cluster").agg(claims.set_key(F.col("artifact"), F.col("text")).alias("k"), claims.set_key(F.col("artifact"), F.col("text"), F.col("claim_index") > 99).alias("none"))
    for cluster, key, none in made.collect():
        assert none is None and key == plain_key([(a, t) for c, a, _, t, _ in rows if c == cluster])
    shuffled = frame(spark, rows[::-1]).repartition(7).groupBy("cluster").agg(claims.set_key(F.col("artifact"), F.col("text")).alias("k"))
    assert sorted(made.select("cluster", "k").collect()) == sorted(shuffled.collect())
    assert len({r["k"] for r in made.collect()}) == 5


def test_untouched_folders_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "claims")
    rows = [(c, 1, i, f"{c} {i}", 7) for c in range(40) for i in range(3)]
    claims.rewrite(frame(spark, rows), path, parts=16)
    assert held(spark, path) == sorted(rows)
    before = files(path)
    claims.rewrite(frame(spark, [(3, 2, 0, "new", 8)]), path, parts=16)
    assert held(spark, path) == sorted([r for r in rows if r[0] != 3] + [(3, 2, 0, "new", 8)])
    after = files(path)
    changed = {p.parent.name for p in before if after.get(p) != before[p]} | {p.parent.name for p in after if p not in before}
    assert len(changed) == 1 and len({p.parent.name for p in before}) > 5


def test_emptied_clusters_go_with_their_folder(spark, tmp_path):
    path = str(tmp_path / "claims")
    claims.rewrite(frame(spark, [(1, 1, 0, "a", 1), (2, 1, 0, "b", 1)]), path, parts=1024)
    claims.rewrite(frame(spark, []), path, replaced=spark.createDataFrame([(1,), (99,), (None,)], "cluster bigint"), parts=1024)
    assert held(spark, path) == [(2, 1, 0, "b", 1)]


def test_repeats_nulls_and_nothing(spark, tmp_path):
    path = str(tmp_path / "claims")
    claims.rewrite(frame(spark, []), path)
    assert held(spark, path) == []
    claims.rewrite(frame(spark, [(1, 1, 0, "a", 1), (1, 1, 0, "b", None), (1, 1, 0, "b", None), (None, 1, 0, "x", 1), (2, None, 0, "x", 1), (2, 1, 0, None, 1)]), path)
    assert held(spark, path) == [(1, 1, 0, "b", None)]


@pytest.fixture()
def shelf(spark, tmp_path):
    path = str(tmp_path / "claims")
    claim = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (2, 0, "p"), (2, 1, "r"), (3, 0, None)], "artifact bigint, claim_index int, text string")
    members = spark.createDataFrame([(c, a, 10 * a) for c in (1, 2, 3, 4, 5) for a in (1, 2, 3)] + [(6, 3, 30), (1, 1, 10)], "cluster bigint, artifact bigint, document bigint")
    return path, claim, members


def test_backfill_tries_all_claims_then_the_stated_ones(spark, shelf):
    path, claim, members = shelf
    every, some = plain_key([(1, "p"), (1, "q"), (2, "p"), (2, "r")]), plain_key([(1, "p"), (1, "q"), (2, "p")])
    clusters = spark.createDataFrame(
        [(1, 4, every), (2, 2, some), (3, 3, some), (4, 4, None), (5, 4, every), (6, 1, every), (None, 1, every)], "cluster bigint, size long, member_key string"
    )
    listed = spark.createDataFrame([(2, "p"), (2, "q"), (3, "p"), (3, "q"), (2, None)][:4], "cluster bigint, text string")
    claims.rewrite(frame(spark, [(5, 9, 0, "kept", 1)]), path)
    out = sorted(tuple(r) for r in claims.backfill(clusters, members, claim, listed, path).collect())
    # 3 states two claims and has three; 4 has no key; 5 has rows; 6's only member has no claim
    assert out == [(1, "every", 4), (2, "stated", 3), (3, "left", 0), (6, "left", 0)]
    rows = held(spark, path)
    assert [r for r in rows if r[0] == 5] == [(5, 9, 0, "kept", 1)]
    assert [(r[1], r[3]) for r in rows if r[0] == 2] == [(1, "p"), (1, "q"), (2, "p")]
    assert len([r for r in rows if r[0] == 1]) == 4 and {r[0] for r in rows} == {1, 2, 5}
    before = files(path)
    assert sorted(r[0] for r in claims.backfill(clusters, members, claim, listed, path).collect()) == [3, 6]
    assert files(path) == before
