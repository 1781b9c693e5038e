import random

import pytest

from leadweave.operators import dedup
from tests.model import closure, ordered_slots


def keys_frame(spark, keys):
    return spark.createDataFrame(keys, "seq long, site string, name string")


def slots_of(df):
    return {r["seq"]: r["slot"] for r in df.select("seq", "slot").collect()}


def random_keys(seed, n, sites, names, hot):
    rng = random.Random(seed)
    rows = []
    for seq in sorted(rng.sample(range(n * 10), n)):
        site = rng.choice([None, "hot"] if rng.random() < hot else [None, *(f"s{i}" for i in range(sites))])
        name = rng.choice([None, "hot"] if rng.random() < hot else [None, *(f"n{i}" for i in range(names))])
        rows.append((seq, site, name))
    return rows


def test_name_is_repointed_by_a_later_site(spark):
    keys = [(1, "p", "x"), (2, "q", "y"), (3, "p", "y"), (4, None, "y")]
    assert slots_of(dedup.exact_slots(keys_frame(spark, keys))) == {1: 1, 2: 2, 3: 1, 4: 1}
    assert set(slots_of(dedup.closure_slots(keys_frame(spark, keys))).values()) == {1}


@pytest.mark.parametrize("seed,n,sites,names,hot", [
    (1, 40, 8, 8, 0.0), (2, 120, 60, 40, 0.0), (3, 300, 150, 150, 0.35), (4, 300, 200, 10, 0.1),
])
def test_slots_match_the_plain_models(spark, seed, n, sites, names, hot):
    keys = random_keys(seed, n, sites, names, hot)
    frame = keys_frame(spark, keys).repartition(3)
    assert slots_of(dedup.exact_slots(frame)) == ordered_slots(keys)
    assert slots_of(dedup.closure_slots(frame)) == closure(keys)


def test_long_chain_of_sites(spark):
    """Each site hangs on the one before, by a name that the one before re-pointed."""
    keys, seq = [], 0
    for i in range(60):
        keys += [(seq, f"s{i}", f"n{i}"), (seq + 1, f"s{i}", f"n{i + 1}")]
        seq += 2
    expected = ordered_slots(keys)
    assert set(expected.values()) == {0}
    assert slots_of(dedup.exact_slots(keys_frame(spark, keys))) == expected


def test_hot_keys_are_salted_with_the_same_result(spark):
    keys = random_keys(9, 400, 60, 60, 0.4)
    spark.conf.set("leadweave.skew.hotRows", "5")
    try:
        frame = keys_frame(spark, keys)
        assert slots_of(dedup.exact_slots(frame)) == ordered_slots(keys)
        assert slots_of(dedup.closure_slots(frame)) == closure(keys)
    finally:
        spark.conf.unset("leadweave.skew.hotRows")


@pytest.mark.parametrize("partitions", ["1", "2", "7"])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    keys = random_keys(5, 150, 50, 50, 0.2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert slots_of(dedup.exact_slots(keys_frame(spark, keys))) == ordered_slots(keys)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_refines_closure(spark):
    keys = random_keys(11, 200, 80, 80, 0.1)
    exact, joined = ordered_slots(keys), closure(keys)
    assert all(joined[seq] == joined[slot] for seq, slot in exact.items())


def test_keys_of_sightings(spark):
    df = spark.createDataFrame(
        [(1, "http://www.a.fr/x", "SARL"), (2, "a.fr", "Société Générale SAS"), (3, "", "x")],
        "seq long, website string, company_name string",
    )
    rows = {r["seq"]: (r["site"], r["name"]) for r in dedup.duplicate_keys(df).collect()}
    assert rows == {1: ("a.fr", None), 2: (None, "societe generale"), 3: (None, "x")}
