"""The whole queue, against sorting in Python."""

import random

from chronicle.operators import ledger


def test_places_number_the_whole_queue(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["high", "normal", "low", None]), rng.randint(0, 20)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, priority string, created_at int").repartition(5)
    order = sorted((ledger.PRIORITIES.get(p, 2), t, i) for i, p, t in rows)
    got = {r.id: r.place for r in ledger.places(df).collect()}
    assert got == {i: k for k, (_, _, i) in enumerate(order, 1)}
    assert ledger.places(df.where("false")).count() == 0
