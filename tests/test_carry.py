import datetime as dt, random, pytest
from pyspark.sql import functions as F
from factlake.functions.classify import Policy
from factlake.operators import carry, ingest, intervals, lifecycle
from factlake.sources.pushes import plan_pushes
from tests.pushes import pushes, t1
from tests.test_ingest import random_rows
MINUTE = dt.timedelta(minutes=1)
@pytest.mark.parametrize("seed", range(2))
def test_segments_agree_with_the_state_machine(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(seed, nodes=10, each=9)
    planned = plan_pushes(pushes(spark, rows), Policy(("vol",))).cache()
    events = [(f"n{rng.randrange(8)}", rng.randrange(len(rows)), rng.choice(["reset", "reset", "reset", "deactivate"])) for _ in range(9)]
    events = sorted({(n, s): (n, s, k, t1 + s * MINUTE) for n, s, k in events}.values())
    controls = spark.createDataFrame(events, lifecycle.EVENT)
    a = sorted(map(repr, map(tuple, carry.segmented_changes(planned, controls).collect())))
    b = sorted(map(repr, map(tuple, lifecycle.sequential_changes(planned, controls).collect())))
    assert a == b
