import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reprise.config import Settings, resolve
from reprise.functions import normalize
from reprise.operators import candidates, clustering, dataflow, lsh, overlap, pairs, reports, similarity, variation, windows
from reprise.operators.components import connected_components
from reprise.sources import java, tables


def bodies(spark, *sizes, kind="method"):
    return spark.createDataFrame([(k, [f"u{i}" for i in range(n)], kind) for k, n in enumerate(sizes)], "container_id int, units array<string>, kind string")


@pytest.mark.parametrize(("n", "low", "growth", "maximal", "sizes"), [
    (5, 5, 5, False, [5]), (10, 5, 5, False, [5] * 6 + [6] * 5 + [7] * 4 + [8] * 3 + [9] * 2 + [10]), (3, 3, 5, False, [3]), (0, 5, 5, True, []),
    (6, 5, 5, True, [5, 6]), (10, 5, 5, True, [5, 6, 7, 8, 9, 10]), (8, 5, 2, True, [5, 6, 7, 7, 8]),
])
def test_windows(spark, n, low, growth, maximal, sizes):
    found = windows.sequences(bodies(spark, n), low, growth, maximal).collect()
    assert sorted(r["n"] for r in found) == sizes
    assert all(r["window"] == [f"u{i}" for i in range(r["start_offset"], r["start_offset"] + r["n"])] for r in found)


def test_constructors_give_windows_of_each_size(spark):
    assert windows.sequences(bodies(spark, 6, kind="constructor"), 5, 5, True).count() == 3


def test_window_parameters():
    for bad in ({"min_units": 0}, {"min_units": -1}, {"window_growth": -1}, {"bands": 0}, {"bands": 257}, {"size_ratio": 1.5}, {"weights": (1, 1, 1)}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_settings_priority():
    assert resolve() == Settings()
    assert resolve(cli={"min_units": 10, "threshold": 85}) == Settings(min_units=10, threshold=0.85)
    assert resolve(nested={"min_units": 8, "threshold": 0.8, "enable_lsh": False}).enable_lsh is False
    assert resolve({"min_units": 20}, {"min_units": 5}, {"min_units": 3}).min_units == 20
    assert resolve({"min_units": 0}, None, {"min_units": 3}).min_units == 3
    assert resolve(preset="strict").threshold == 0.90
    with pytest.raises(ValueError):
        resolve(outer={"nothing": 1})


@pytest.mark.parametrize(("a", "b", "values"), [
    ("na", "na", (1, 1, 1)), ("n", "L", (0, 0, 0)), ("naA", "naL", (2 / 3, 2 / 3, 2 / 3)), ("", "", (1, 1, 1)), ("n", "", (0, 0, 0)), ("na", "naL", (2 / 3, 2 / 3, 2 / 3)), ("pq", "qp", (0.5, 0, 0)),
])
def test_similarity_values(spark, a, b, values):
    df = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>")
    x, y = F.col("a"), F.col("b")
    got = df.select(similarity.lcs(x, y), similarity.levenshtein(x, y), similarity.positional(x, y)).first()
    assert list(got) == pytest.approx(values)
    fast = similarity.score_pairs(df, "a", "b").first()
    assert (fast["lcs"], fast["lev"], fast["positional"]) == pytest.approx(values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=9), st.text("abc", max_size=9)), min_size=1, max_size=12))
def test_programmes(pairs_):
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

    got = similarity.programmes(*([np.array([ord(c) for c in p[k]], np.int64) for p in pairs_] for k in (0, 1)))
    for (a, b), c, d, e in zip(pairs_, *got, strict=True):
        assert (c, d, e) == (lcs(a, b), lev(a, b), sum(x == y for x, y in zip(a, b, strict=False)))


def test_filters(spark):
    rows = [(5, 5, True), (5, 6, True), (10, 12, True), (10, 13, True), (7, 10, True), (5, 10, False), (10, 15, False), (1, 10, False)]
    df = spark.createDataFrame(rows + [(b, a, c) for a, b, c in rows], "a int, b int, ok boolean")
    assert df.where(pairs.size_filter(F.col("a"), F.col("b")) != F.col("ok")).count() == 0
    assert df.where(pairs.size_filter(F.col("a"), F.col("b"), 0.1) & (F.abs(F.col("a") - F.col("b")) > 1)).count() == 0
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError):
            pairs.size_filter(F.col("a"), F.col("b"), bad)
    two = spark.createDataFrame([(["save", "delete"], ["save", "load"])], "fuzzy1 array<string>, fuzzy2 array<string>")
    ok = two.select(pairs.structural_filter(F.col("fuzzy1"), F.col("fuzzy2")), pairs.structural_filter(F.col("fuzzy1"), F.col("fuzzy2"), 0.8)).first()
    assert list(ok) == [True, False]
    sized = two.withColumns({"n1": F.lit(5), "n2": F.lit(20)})
    assert pairs.prefilter(sized).count() == 0 and pairs.prefilter(sized.withColumn("n2", F.lit(5)), least=None).count() == 1


@pytest.mark.parametrize(("row", "expected"), [
    (("A", "B", None, None, 1, 10, 1, 10), False), (("A", "A", "m", "m", 1, 10, 5, 15), True), (("A", "A", "m", "m", 1, 10, 11, 20), False), (("A", "A", "m1", "m2", 1, 10, 5, 15), False),
    (("A", "A", None, None, 1, 10, 5, 15), True), (("A", "A", None, None, 1, 10, 11, 20), False), ((None, None, None, None, 1, 10, 1, 10), False), (("A", "A", "m1", None, 1, 10, 5, 15), True),
])
def test_physical_overlap(spark, row, expected):
    df = spark.createDataFrame([row], "p1 string, p2 string, b1 string, b2 string, s1 int, e1 int, s2 int, e2 int")
    assert df.select(pairs.overlaps(*map(F.col, df.columns))).first()[0] is expected


def test_minhash():
    def sig(text, k=100):
        return lsh.signature([[hash(t) % (1 << 64) for t in text.split()]], k)

    words = "the quick brown fox jumps over a lazy dog "
    assert (sig(words) == sig(words)).all() and len(sig(words)) == 100
    near = (sig(words * 5) == sig(words * 4 + words.replace("dog", "cat"))).mean()
    assert near > 0.8
    assert (sig("int a = 1 ;") == sig("String b = hello ;")).mean() < 0.2
    assert len(sig("")) == 100


def test_buckets_meet(spark):
    rows = [(1, list("ABCDEFG")), (2, list("ABCDEFG")), (3, list("ABCDEFH")), (4, list("WXYZ")), (5, [])]
    df = spark.createDataFrame(rows, "id long, units array<string>")
    found = {tuple(r) for r in lsh.candidate_pairs(lsh.bucket_rows(df, "id", "units", 50, 2), "id").collect()}
    assert {(1, 2), (1, 3), (2, 3)} <= found and not any(4 in p or 5 in p for p in found)
    with pytest.raises(ValueError):
        lsh.bucket_rows(df, "id", "units", 300, 2)


def test_bucket_recall_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(30)]
        other = list(base)
        other[rng.randrange(30)] = "x"
        rows += [(2 * k, base), (2 * k + 1, other)]
    df = spark.createDataFrame(rows, "id long, units array<string>")
    found = {tuple(r) for r in lsh.candidate_pairs(lsh.bucket_rows(df, "id", "units"), "id").collect()}
    assert len({(2 * k, 2 * k + 1) for k in range(40)} & found) >= 36


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                low = min(label[a], label[b])
                label[a] = label[b] = low
                changed = True
    df = spark.createDataFrame([*edges, (None, 3)], "a int, b int")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == label


def clusters(spark, rows, threshold=0.75, n=None):
    seqs = spark.createDataFrame([(s, (n or {}).get(s, 5), s) for s in sorted({x for r in rows for x in r[:2]})], "id int, n int, start_line int")
    scored = spark.createDataFrame(rows, "id1 int, id2 int, overall double")
    found = clustering.in_order(clustering.summarize(clustering.members(scored, threshold), seqs, scored, threshold)).collect()
    return [(r["primary_id"], r["n_pairs"], r["loc_reduction"]) for r in found]


def test_clusters(spark):
    assert clusters(spark, [(10, 20, 0.9)]) == [(10, 1, 3)]
    assert clusters(spark, [(10, 20, 0.95), (10, 30, 0.92), (10, 40, 0.9)]) == [(10, 3, 11)]
    assert len(clusters(spark, [(10, 20, 0.95), (10, 25, 0.92), (50, 60, 0.9)])) == 2
    assert clusters(spark, [(10, 20, 0.95), (50, 60, 0.9)], n={10: 3, 20: 3, 50: 10, 60: 10}) == [(50, 1, 8), (10, 1, 1)]
    assert clusters(spark, [(10, 20, 0.8), (30, 40, 0.98)], 0.95) == [(30, 1, 3)]


def test_no_clusters(spark):
    scored = spark.createDataFrame([], "id1 int, id2 int, overall double")
    assert clustering.members(scored).count() == 0


def test_non_overlapping(spark):
    rows = [(1, 2, "a", "b", 1, 5, 1, 5, 5, 0.9), (3, 4, "a", "b", 2, 6, 2, 6, 5, 0.99), (5, 6, "b", "a", 10, 15, 20, 25, 6, 0.8)]
    df = spark.createDataFrame(rows, "id1 int, id2 int, box1 string, box2 string, start1 int, end1 int, start2 int, end2 int, n1 int, overall double")
    assert sorted((r["id1"], r["id2"]) for r in overlap.non_overlapping(df).collect()) == [(1, 2), (6, 5)]


def test_data_flow(spark):
    events = [(1, 0, n, e) for n in ("url", "port", "ssl") for e in ("declare", "literal_init")] + [(1, 1, "out", "declare"), (1, 1, "url", "use"), (1, 2, "e", "internal"), (1, 3, "k", "unary")]
    v = dataflow.variables(spark.createDataFrame(events, "seq_id int, unit_idx int, name string, event string"))
    after = F.array(*map(F.lit, ("url", "port", "ssl", "out", "e")))
    r = v.select(dataflow.live_out(F.col("defined"), after, F.col("literal_init"), F.col("internal")).alias("live"), "literal_init", dataflow.escaping(F.col("modified"), F.col("defined")).alias("esc")).first()
    assert (r["live"], r["literal_init"], r["esc"]) == (["out"], ["port", "ssl", "url"], ["k"])


def test_boundaries(spark):
    kind = "array<struct<is_expression boolean, changes boolean, used array<string>>>"
    units = [(False, True, [])] * 5 + [(True, False, ["a"]), (True, False, ["a", "b"])]
    df = spark.createDataFrame([(units, ["a", "b"], [["x"], ["c"], ["d"]], ["c", "d"])], f"units {kind}, defined array<string>, before array<array<string>>, names array<string>")
    r = df.select(dataflow.tail_trim(F.col("units"), F.col("defined")), dataflow.tail_trim(F.col("units"), F.array().cast("array<string>")), dataflow.head_extension(F.col("before"), F.col("names"))).first()
    assert list(r) == [5, 7, 2]


def test_strategy_and_confidence(spark):
    def kind(**given):
        base = {"nested_return": False, "one_class_constructors": False, "master": False, "cross_file": False, "all_full": False, "static": False, "all_tests": False, "n_members": 2, "truncated": False, "n_params": 1} | given
        return spark.range(1).select(variation.strategy(**{k: F.lit(v) for k, v in base.items()})).first()[0]

    assert kind() == "EXTRACT_HELPER_METHOD" and kind(nested_return=True) == "MANUAL_REVIEW_REQUIRED"
    assert kind(one_class_constructors=True, master=True) == "CONSTRUCTOR_DELEGATION" and kind(one_class_constructors=True) == "EXTRACT_HELPER_METHOD"
    assert kind(cross_file=True) == "EXTRACT_HELPER_METHOD" and kind(cross_file=True, all_full=True) == "EXTRACT_PARENT_CLASS"
    assert kind(cross_file=True, all_full=True, static=True) == "EXTRACT_TO_UTILITY_CLASS" and kind(all_tests=True, n_members=3) == "EXTRACT_TO_PARAMETERIZED_TEST"
    got = spark.range(1).select(*[variation.confidence(*map(F.lit, x)) for x in ((1, 0.9, 0, -1), (6, 0.8, 2, -1), (1, 0.9, 0, 0))]).first()
    assert list(got) == pytest.approx([1.0, 0.056, 0.0])


def test_java_normal_forms():
    strict = {'user.setName("Alice");': "user.setName(STRING_LIT);", "user.setAge(25);": "user.setAge(INT_LIT);", "user.setActive(true);": "user.setActive(BOOL_LIT);", "user.getName();": "user.getName();", 'logger.info("hi" + name);': "logger.info(STRING_LIT + name);"}
    fuzzy = {"user.getName();": "VAR.getName();", "int x = 5;": "int VAR = INT_LIT;", "this.value = other.field;": "this.FIELD = VAR.FIELD;", 'logger.info("hi" + name);': "VAR.info(STRING_LIT + VAR);",
             "VAR.set(STRING_LIT);": "VAR.set(STRING_LIT);", "Utils.parse(s);": "VAR.parse(VAR);", "a.b().c();": "VAR.b().c();", "save(1, 2);": "save(INT_LIT, INT_LIT);", "METHOD.foo();": "METHOD.foo();", "FIELD.bar();": "FIELD.bar();"}
    assert {k: java.strict(k) for k in strict} == strict and {k: java.fuzzy(k) for k in fuzzy} == fuzzy
    assert java.fuzzy("user.setActive(true)") != java.fuzzy("user.setDeleted(true)")
    assert java.fuzzy_tokens("a.set(1);") == ["VAR", ".", "set", "(", "INT_LIT", ")"]


def test_java_units(spark):
    text = "class A { A(int x) { f = x; } static int m() { int a = 1; try { b(); c(); } catch (E e) { d(); } return a; } }"
    rows = java.java_units(spark.createDataFrame([("A.java", text), ("B.java", None), ("C.java", "class {{{")], "file string, text string")).collect()
    assert [(r["container_kind"], r["text"]) for r in rows] == [("constructor", "f = x;"), ("method", "int a = 1;"), ("method", "try { b(); c(); } catch (E e) { d(); }"), ("method", "return a;"), ("method", "b();"), ("method", "c();"), ("method", "d();")]
    assert len({r["block_id"] for r in rows}) == 4


def test_sources(spark, tmp_path):
    for name in ("src/A.java", "src/test/B.java", "src/CTest.java", "build/D.java", "src/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class A {}")
    found = [r["file"].rpartition("/")[2] for r in tables.read_sources(spark, str(tmp_path)).collect()]
    assert found == ["A.java"]
    names = spark.createDataFrame([("a.B",), ("a.B.C",), ("a.B$D",), ("a.Bx",)], "n string")
    assert [r["n"] for r in names.where(tables.targeted(F.col("n"), "a.B")).collect()] == ["a.B", "a.B.C", "a.B$D"]
    assert names.where(tables.targeted(F.col("n"), None)).count() == 4


def test_prose_units(spark):
    df = spark.createDataFrame([(1, "One. Two!\n\n \nThree? four"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r["container_id"], r["unit_idx"], r["text"]) for r in tables.prose_units(df, "doc_id", "text").collect()]
    assert got == [(1, 0, "One"), (1, 1, "Two"), (1, 2, "Three"), (1, 3, "four")]
    assert spark.createDataFrame([("A 1 b",)], "t string").select(normalize.fuzzy(F.col("t"))).first()[0] == "a NUM_LIT b"


def test_reports(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    scored = spark.createDataFrame([("a", "b", 1, 2, 0.9), ("a", "a", 1, 3, 0.8)], "file1 string, file2 string, id1 int, id2 int, overall double")
    rows = {r["file"]: r for r in reports.file_report(files, scored).collect()}
    assert [(rows[f]["duplicates"], round(rows[f]["avg_similarity"], 2)) for f in "abc"] == [(2, 0.85), (1, 0.9), (0, 0.0)]
    report = reports.file_report(files, scored)
    total = reports.project_metrics(report).first()
    assert (total["total_files"], total["duplicates"]) == (3, 3)
    assert reports.project_metrics(report.where("false")).first()["avg_similarity"] == 0.0
    assert {r["line"] for r in reports.csv_lines(report).collect()} == {"a,2,0.85", "b,1,0.90", "c,0,0.00"}
    assert reports.json_report(report, "p").count() == 2 and "3 files" in reports.text_report(report, "p")
    assert reports.diff_stats("a\nb", "a\nc\nd") == {"added": 2, "removed": 1, "net": 1}
    assert "+c" in reports.unified_diff("a\nb", "a\nc", "f") and "|" in reports.side_by_side("a\nb", "a\nc")
    with pytest.raises(ValueError):
        reports.write_metrics(report, "x", "xml")


def test_session_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], 0.9)], "cluster_id int, ids array<int>, s double")
    tables.save_session(rows, str(tmp_path / "s"))
    assert tables.load_session(spark, str(tmp_path / "s"), rows.schema).collect() == rows.collect()


def test_spans_are_the_sequences(spark):
    for n, low, growth, maximal, kind in ((0, 5, 5, True, "x"), (4, 5, 5, True, "x"), (7, 5, 5, True, "x"), (14, 5, 5, True, "x"), (14, 3, 2, False, "x"), (9, 5, 5, True, "constructor")):
        df = spark.createDataFrame([(kind, [f"u{i}" for i in range(n)])], "kind string, units array<string>")
        expected = sorted((r["start_offset"], r["n"], r["full_body"]) for r in windows.sequences(df, low, growth, maximal).collect())
        got = df.select(windows.spans(F.col("units"), low, growth, maximal, F.col("kind") == "constructor").alias("s")).first()["s"]
        assert sorted(tuple(x) for x in got) == expected


def test_pairs_carry_what_they_need_for_short_and_long_windows(spark):
    rng = random.Random(3)
    rows = [(k, n, [rng.randrange(6) for _ in range(n)], f"key {k}") for k, n in enumerate([5] * 25 + [10] * 40 + [14] * 40)]
    classes = spark.createDataFrame(rows, "class_id long, n int, norm_h array<long>, key string")
    for least in (0.4, 0.5, 0.8):
        found = candidates.exhaustive(classes, least, ("key",)).collect()
        expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and sum(x == y for x, y in zip(a[2], b[2], strict=True)) >= math.ceil(a[1] * least - 1e-9)}
        assert len(found) == len(expected) and {(r["id1"], r["id2"]) for r in found} == expected
        assert all((r["key1"], r["key2"]) == (f"key {r['id1']}", f"key {r['id2']}") for r in found)
        # what can't be in a pair isn't carried into the join
        kept = {r["class_id"] for r in candidates.holding(classes, least).collect()}
        assert {x for p in expected for x in p} <= kept


def test_scores_of_whole_numbers_that_look_like_padding(spark):
    rows = spark.createDataFrame([(1, [1, 2], [1, 2, -1, -2]), (2, [], [-2]), (3, [-1, -2], [-1, -2])], "id int, units1 array<long>, units2 array<long>")
    got = {r["id"]: (r["lcs"], r["lev"], r["positional"]) for r in similarity.score_pairs(rows).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0)}


def test_differing_places_as_bits(spark):
    row = spark.createDataFrame([([1, 2, 3, 4], [1, 5, 3, 6])], "a array<long>, b array<long>")
    assert row.select(variation.differing(F.col("a"), F.col("b"), 10).alias("x")).first()["x"] == 0b1010


def test_estimated_pairs(spark):
    rng = random.Random(5)
    rows = [(k, [rng.randrange(3) for _ in range(8)]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, signature array<int>")
    found = lsh.estimated_pairs(df, "doc_id", 4, 2)
    expected = {(a, b): sum(x == y for x, y in zip(s, t, strict=True)) / 8 for a, s in rows for b, t in rows if a < b and any(s[i : i + 2] == t[i : i + 2] for i in range(0, 8, 2))}
    got = found.collect()
    assert len(got) == len(expected) and {(r["id1"], r["id2"]): r["estimate"] for r in got} == expected
