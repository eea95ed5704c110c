import math
import random

from hopwise.operators.evaluate import p95


def test_places_and_no_list_of_a_group(spark):
    draw = random.Random(3)
    groups = {"a": [1.0], "b": [draw.random() for _ in range(999)], "c": [float(draw.randrange(3)) for _ in range(400)], None: [5.0, 4.0], "d": [10.0**i for i in range(-20, 20)], "e": [float("inf"), math.nan, -1.0] * 7, "f": [1e300] * 50 + [0.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("g", None)]
    df = p95(spark.createDataFrame(rows, "k string, v double"), "v", "k")
    got = {r.k: repr(r.p95) for r in df.collect()}
    assert got == {k: repr(sorted(vs, key=lambda v: (math.isnan(v), v))[int(0.95 * len(vs))]) for k, vs in groups.items()}
    plan = df._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan
