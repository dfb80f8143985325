import random

import pytest
from pyspark.sql import functions as F

from reprise.config import Settings
from reprise.plans import analysis, rewrites
from reprise.streaming import incremental


def bodies(spark, rows):
    return spark.createDataFrame(rows, "container_id long, units array<string>")


BASE = [f"unit number {w} is here" for w in "one two three four five six seven eight nine ten".split()]


@pytest.fixture(scope="module")
def found(spark):
    base = BASE[:7]
    other = base[:3] + ["a unit of another kind"] + base[4:]
    rows = [(1, base), (2, base), (3, other), (4, [f"nothing {w} alike" for w in "abcdefg"]), (5, [])]
    return analysis.analyse(bodies(spark, rows), Settings())


def test_analysis(found):
    assert found.sequences.count() == 4 * 3
    assert found.classes.where("count = 2").count() == 3
    scored = found.scored.collect()
    assert scored and all(r["overall"] >= 0.75 for r in scored)
    # the longest windows cover whole bodies; what overlaps them is not chosen, so there is one cluster, of three sequences of seven
    own = found.clusters.collect()
    assert [(r["n_members"], r["n_sequences"], r["n_pairs"], r["loc_reduction"]) for r in own] == [(2, 3, 3, 21 - 7 - 2 - 1)]
    assert found.pairs.count() == 6 and {(r["id1"] == r["id2"]) for r in found.pairs.collect()} == {True, False}


def test_copies_cluster_without_a_near_class(spark):
    rows = [(k, BASE[:5]) for k in range(4)] + [(9, [f"nothing {w} alike" for w in "abcde"])]
    found = analysis.analyse(bodies(spark, rows), Settings())
    own = found.clusters.collect()
    assert [(r["n_members"], r["n_sequences"], r["n_pairs"], r["loc_reduction"], r["avg_similarity"]) for r in own] == [(1, 4, 6, 11, 1.0)]
    assert [(r["id1"] == r["id2"], r["overall"], r["count1"], r["count2"]) for r in found.pairs.collect()] == [(True, 1.0, 4, 4)]
    assert {r["container_id"] for r in found.members.join(found.boxes, "box").collect()} == {0, 1, 2, 3}
    assert {r["file"] for r in analysis.cluster_files(found).collect()} == {0, 1, 2, 3}
    assert {(r["file1"], r["file2"]) for r in analysis.pair_files(found).collect()} == {(0, 1), (0, 2), (0, 3)}


def test_a_body_is_no_duplicate_of_itself(spark):
    """All windows of one repetitive body overlap each other, but for those that begin after another one's end."""
    found = analysis.analyse(bodies(spark, [(1, ["same unit here"] * 9)]), Settings())
    assert found.chosen.count() == 0 and found.clusters.count() == 0 and found.pairs.count() == 0
    found = analysis.analyse(bodies(spark, [(1, BASE[:5] + ["a b c", "d e f"] + BASE[:5] + ["g h i"])]), Settings(window_growth=0))
    own = found.chosen.collect()
    assert [(r["start1"], r["start2"], r["twin"]) for r in own] == [(0, 7, False)]
    assert [r["n_sequences"] for r in found.clusters.collect()] == [2]


def test_chosen_pairs_do_not_overlap(found):
    rows = found.chosen.collect()
    assert rows and {r["n1"] for r in rows} == {7}


def test_distinct_containers_with_a_common_passage_are_one_cluster(spark):
    rows = [(k, BASE + [f"{w} ends {i}" for i in "abcd"]) for k, w in enumerate(["red", "green", "blue", "red"])]
    found = analysis.analyse(bodies(spark, rows), Settings())
    assert {(r["container_id"], r["box"], r["copies"]) for r in found.boxes.collect()} == {(0, 0, 2), (3, 0, 2), (1, 1, 1), (2, 2, 1)}
    exact = {(r["box1"], r["box2"], r["twin"]) for r in found.chosen.where("overall = 1").collect()}
    assert {(0, 1, False), (0, 2, False), (0, 0, True)} <= exact
    assert max(r["n_sequences"] for r in found.clusters.collect()) == 4


def slow_pairs(rows, least=0.75):
    """All pairs of distinct windows of one size, scored by the expressions of the definition."""
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    places = {}
    for c, units in rows:
        for s in range(len(units) - 4):
            w = tuple(units[s : s + 10])
            places.setdefault(w, []).append((c, s, s + len(w) - 1))
        if len(units) > 10:
            places.setdefault(tuple(units), []).append((c, 0, len(units) - 1))
    out = set()
    windows_ = sorted(places)
    for i, a in enumerate(windows_):
        for b in windows_[i:]:
            same = sum(x == y for x, y in zip(a, b, strict=False))
            if len(a) != len(b) or same * 2 < len(a) or not any(x[0] != y[0] or x[1] > y[2] or y[1] > x[2] for x in places[a] for y in places[b]):
                continue
            n = len(a)
            if lcs(a, b) / n * 0.4 + (1 - lev(a, b) / n) * 0.4 + same / n * 0.2 >= least - 1e-12:
                out.add((a, b))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    stock = [f"unit {k} of the stock" for k in range(40)]
    rows = []
    for k in range(40):
        units = [rng.choice(stock) for _ in range(rng.randrange(0, 18))] if k % 3 or not rows else list(rng.choice(rows)[1])
        if units and k % 3 == 0:
            units[rng.randrange(len(units))] = rng.choice(stock)
        rows.append((k, units))
    expected = slow_pairs(rows)
    numbered = bodies(spark, rows).withColumn("norm", F.col("units"))
    for lsh_on, least in ((False, 1.0), (True, 0.9)):
        done = analysis.score_classes(numbered, Settings(enable_lsh=lsh_on))
        text = {r["seq_id"]: tuple(dict(rows)[r["container_id"]][r["start_offset"] : r["start_offset"] + r["n"]]) for r in done.sequences.collect()}
        got = {tuple(sorted((text[r["id1"]], text[r["id2"]]))) for r in done.pairs.collect()}
        assert got <= expected and len(got) >= least * len(expected)


def test_gate(spark):
    rows = spark.createDataFrame([(1, "EXTRACT_HELPER_METHOD", 1.0, []), (2, "EXTRACT_HELPER_METHOD", 0.4, []), (3, "MANUAL_REVIEW_REQUIRED", 1.0, []), (4, None, 1.0, []), (5, "EXTRACT_HELPER_METHOD", 1.0, ["name is taken"]), (6, "EXTRACT_HELPER_METHOD", 1.0, ["warning: many parameters"])], "id int, strategy string, confidence double, issues array<string>")
    assert [r["action"] for r in rewrites.gate(rows).orderBy("id").collect()] == ["refactor", "skip", "review", "skip", "skip", "refactor"]


def test_rewrite_plans(spark):
    names = spark.createDataFrame([(1, "UserService"), (1, "OrderService"), (2, "Ab"), (2, "Cd")], "cluster_id int, class_name string")
    assert {r["cluster_id"]: r["parent"] for r in rewrites.parent_class(names).collect()} == {1: "AbstractService", 2: "AbstractAb"}
    values = spark.createDataFrame([(1, 1, ["1", "2"]), (1, 2, ["3", "4"]), (1, 3, ["5", "6"]), (1, 4, ["7"])], "cluster_id int, id int, literals array<string>")
    assert rewrites.parameterized_rows(values).first()["rows"] == ["1,2", "3,4", "5,6"]
    declared = spark.createDataFrame([("f", "a", True), ("f", "b", True), ("f", "c", False)], "file string, name string, is_private boolean")
    assert [r["name"] for r in rewrites.unused_methods(declared, spark.createDataFrame([("f", "a")], "file string, name string")).collect()] == ["b"]
    done = iter([2, 0, 5])
    assert rewrites.iterate(lambda: None, lambda _: next(done)) == [2, 0]


def test_stream(spark, tmp_path):
    rows = [(1, ["a b c d e"] * 3), (2, ["x y z w v"] * 3)]
    schema = "id long, units array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.run(stream, str(tmp_path / "index"), str(tmp_path / "cp"), lambda df, n: got.extend(tuple(r) for r in df.collect())).awaitTermination()

    go()
    assert got == []
    spark.createDataFrame([(3, ["a b c d e"] * 3), (4, ["a b c d e"] * 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(got) == [(1, 3), (1, 4), (3, 4)]
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.select("id").distinct().count() == 4 and index.select(F.max("batch")).first()[0] == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
