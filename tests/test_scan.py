import random

from strataspark.operators.scan import fill_forward, number_rows


def some_rows(r):
    rows = [(r.choice(["hot", "hot", "hot", "a", None, ""]), i, r.choice([None, None, None, i]), r.choice([None, "v"])) for i in range(600)]
    r.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


def test_numbers_and_fills_over_many_ranges(spark):
    rows = some_rows(random.Random(1))
    df = spark.createDataFrame(rows, "k string, at int, v int, w string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbers = {x["at"]: x.pos for x in number_rows(df, ["k"], ["at"]).collect()}
        filled = {x["at"]: (x.v, x.w) for x in fill_forward(df, ["k"], ["at"], ["v", "w"]).collect()}
        over_all = {x["at"]: x.pos for x in number_rows(df, [], ["at"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for group in by_key(rows).values():
        last = [None, None]
        for i, (_, at, *values) in enumerate(group):
            last = [n if n is not None else o for n, o in zip(values, last, strict=True)]
            assert numbers[at] == i + 1 and filled[at] == tuple(last)
    assert over_all == {i: i + 1 for i in range(600)}
    assert number_rows(df.limit(0), ["k"], ["at"]).count() == 0
