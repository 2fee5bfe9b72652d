import random

from sillage.functions import robots


def test_rules_at_fetch_against_a_walk(spark):
    r = random.Random(2)
    at = lambda: r.choice([r.randrange(0, 20_000), 3600 * r.randrange(5), None])
    versions = [(r.choice("ab"), at(), i) for i in range(60)] + [(None, 5, 99), ("a", 3600, 100), ("a", 3600, 101)]
    asked = [(i, r.choice(["a", "b", "c", None]), at()) for i in range(300)]
    time = "timestamp_seconds(t) AS"
    v = spark.createDataFrame(versions, "domain string, t bigint, n int").selectExpr("domain", f"{time} fetched_at", "named_struct('n', n) AS rules")
    q = spark.createDataFrame(asked, "id int, domain string, t bigint").selectExpr("id", "domain", f"{time} ts", "'x' AS path")
    got = {x["id"]: x["n"] for x in robots.at_fetch(q, v).selectExpr("id", "rules.n AS n").collect()}
    want = {}
    for i, d, t in asked:
        held = [(f, n) for dv, f, n in versions if d is not None and dv == d and None not in (t, f) and f <= t < f + 3600]
        want[i] = max(held)[1] if held else None
    assert got == want


def test_one_domain_is_many_keys(spark):
    """The order is by domain and hour, not by domain alone."""
    q = spark.range(10).selectExpr("'d' AS domain", "timestamp_seconds(id * 1800) AS ts", "id")
    v = q.limit(1).selectExpr("domain", "ts AS fetched_at", "named_struct('n', 1) AS rules")
    plan = robots.at_fetch(q, v)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan[plan.index("Window") : plan.index("Window") + 400]
