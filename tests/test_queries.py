import pytest

from codequarry.plans import registry
from compare import same

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], D)


def test_greedy_match_is_one_to_one_and_near(spark):
    pairs = registry.QUERIES["q24_nearest_greedy_match"](spark, D).collect()
    assert pairs
    assert len({p.before_id for p in pairs}) == len({p.after_id for p in pairs}) == len(pairs)
    lines = {r.event_id: (r.user_id, r.event_type, int(r.value // 1)) for r in spark.read.parquet(f"{D}/events.parquet").collect()}
    for p in pairs:
        a, b = lines[p.before_id], lines[p.after_id]
        assert a[:2] == b[:2]
        assert abs(a[2] - b[2]) <= 40
