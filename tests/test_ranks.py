"""Ranks and medians against brute force, with one group that holds most rows."""

import random
import statistics
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracewright import session
from tracewright.operators.ranks import medians, ranked

SCHEMA = "id int, g string, v double, part int, held string"


def rows(n, seed=1):
    r = random.Random(seed)
    value = lambda: r.choice([None, 0.0, -1.5, r.uniform(-9, 9), r.lognormvariate(3, 4), float(r.randint(1, 5))])
    return [(i, r.choice(["hot"] * 6 + ["a", "b", None]), value(), i % 3, "x") for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_ranked(spark, n):
    data = rows(n)
    got = {r.id: r.rn for r in ranked(spark.createDataFrame(data, SCHEMA).repartition(4), "g", F.desc_nulls_last("v"), F.col("id")).collect()}
    by = defaultdict(list)
    for r in data:
        by[r[1]].append(r)
    expected = {}
    for group in by.values():
        for k, r in enumerate(sorted(group, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])), 1):
            expected[r[0]] = k
    assert got == expected


@pytest.mark.parametrize("n", [0, 1, 2, 3, 701])
def test_medians(spark, n):
    data = rows(n, 2)
    got = {r.g: r.median for r in medians(spark.createDataFrame(data, SCHEMA), "g", "v").collect()}
    by = defaultdict(list)
    for r in data:
        if r[2] is not None:
            by[r[1]].append(r[2])
    assert got == {g: statistics.median(v) for g, v in by.items()}


def test_a_cluster_must_name_its_shared_folder():
    made = []
    of = lambda master: SimpleNamespace(
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append), conf=SimpleNamespace(get=lambda *a: None)
    )
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(of(master))
    assert session.shared_folder(of("local[4]")) == made[0]
