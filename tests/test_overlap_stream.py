import random

from reprise.operators import overlap


def test_choice_is_a_stream_of_groups(spark):
    r = random.Random(5)
    rows = []
    for k in range(400):
        s1, s2 = r.randrange(60), r.randrange(60)
        a, b = (r.choice(["a", "b", "c", "d", None]) for _ in range(2))
        rows.append((2 * k, 2 * k + 1, a, b, s1, s1 + r.randrange(9), s2, s2 + r.randrange(9), r.randrange(5, 11), r.choice([0.8, 0.9, 1.0]), r.random() < 0.1, r.random() < 0.1, r.random() < 0.2))
    names = ("id1", "id2", "box1", "box2", "start1", "end1", "start2", "end2", "n1", "overall", "full_body1", "full_body2", "twin")
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c.startswith('box') else 'double' if c == 'overall' else 'boolean' if c[0] in 'ft' else 'int'}" for c in names))
    df = df.where("box1 is not null and box2 is not null")
    groups = {}
    for x in (dict(zip(names, row, strict=True)) for row in rows):
        if x["box1"] is None or x["box2"] is None:
            continue
        k1, k2 = (1, 2) if (x["box1"], x["start1"], x["id1"]) <= (x["box2"], x["start2"], x["id2"]) else (2, 1)
        one, two = (tuple(x[f"{c}{k}"] for c in ("start", "end", "id")) for k in (k1, k2))
        order = (not x[f"full_body{k1}"], -(one[1] - one[0]), -x["n1"], one[0], -x["overall"], two[0], one[2], two[2])
        groups.setdefault((x[f"box{k1}"], x[f"box{k2}"], x["twin"]), []).append((order, one, two))
    want = set()
    for group in groups.values():
        kept = []
        for _, one, two in sorted(group):
            if all(one[1] < o[0] or o[1] < one[0] for o, _ in kept) and all(two[1] < t[0] or t[1] < two[0] for _, t in kept):
                kept.append((one, two))
        want |= {(one[2], two[2]) for one, two in kept}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        chosen = overlap.non_overlapping(df)
        assert {(x["id1"], x["id2"]) for x in chosen.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapGroups" not in chosen._jdf.queryExecution().toString()  # no call for each group
