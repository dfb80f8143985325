import pytest
from pyspark.sql import functions as F

from reprise.config import Settings
from reprise.operators import dataflow
from reprise.plans import analysis, code
from reprise.sources import java


def method(name, lines, head="void"):
    return f"  {head} {name}() {{\n" + "".join(f"    {x}\n" for x in lines) + "  }\n"


def klass(name, *methods):
    return f"package p;\npublic class {name} {{\n" + "".join(methods) + "}\n"


STEPS = ["user.setName(\"a\");", "user.setAge(1);", "user.setActive(true);", "store.save(user);", "logger.info(\"saved\");"]


def sources(spark, **files):
    return spark.createDataFrame([(f"{k}.java", v) for k, v in files.items()], "file string, text string")


def events(text):
    return java.events_of(java.lex(text))


def test_events():
    e = events('String url = "x";')
    assert (e["declared"], e["types"], e["literal_init"], e["internal"], e["used"], e["is_expression"]) == (["url"], ["String"], ["url"], [], [], True)
    e = events("List<String> out = load(url, port);")
    assert (e["declared"], e["types"], e["literal_init"], e["used"]) == (["out"], ["List<String>"], [], ["url", "port"])
    e = events("try { int inner = 1; outer = inner; } catch (Exception e) { log(e); }")
    assert set(e["internal"]) == {"inner", "e"} and e["assigned"] == ["outer"] and not e["is_expression"]
    e = events("for (int i = 0; i < n; i++) { return i; }")
    assert e["internal"] == ["i"] and "i" in e["unary"] and e["nested_return"] and e["returned"] == ["i"]
    e = events("return total + 1;")
    assert e["returned"] == ["total"] and not e["nested_return"]
    e = events("rows.forEach(r -> sink.add(r));")
    assert e["internal"] == ["r"] and set(e["used"]) == {"rows", "sink", "r"}


def test_bodies(spark):
    text = klass("A", method("a", STEPS), "  private static int b(int x, final String y) throws E {\n    if (x > 1) { one(); two(); } else { three(); }\n    return x;\n  }\n")
    rows = {(r["name"], r["block_no"]): r for r in code.bodies(sources(spark, A=text), Settings(exclude=())).collect()}
    assert rows["a", 0]["units"] == STEPS and rows["a", 0]["starts"] == [4, 5, 6, 7, 8] and rows["a", 0]["norm"][1] == "user.setAge(INT_LIT);"
    b = rows["b", 0]
    assert (b["is_static"], b["is_private"], b["params"], b["param_types"], len(b["units"])) == (True, True, ["x", "y"], ["int", "String"], 2)
    assert rows["b", 1]["units"] == ["one();", "two();"] and rows["b", 2]["units"] == ["three();"]


def test_live_out(spark):
    text = klass("A", method("a", ['String url = "u";', "int port = 1;", "boolean ssl = true;", "Conn outer = open(url);", "try { int inner = size(); outer.use(inner); } catch (X e) { fail(e); }", "send(url, port, ssl, outer, inner, e);"]))
    row = code.bodies(sources(spark, A=text), Settings(exclude=()))
    five = F.slice("events", 1, 5)
    after = dataflow.gathered(F.slice("events", 6, 1), "used")
    got = row.select(dataflow.gathered(five, "literal_init").alias("literal"), dataflow.live_out_of(five, after).alias("live"), dataflow.types_of(five).alias("types")).first()
    assert set(got["literal"]) == {"url", "port", "ssl"} and got["live"] == ["outer"] and got["types"]["outer"] == "Conn"


def test_copies_in_two_files(spark):
    found = code.analyse(sources(spark, A=klass("A", method("a", STEPS)), B=klass("B", method("b", STEPS), method("c", ["x();"] * 2))), Settings(exclude=()))
    own = found.clusters.collect()
    assert [(r["n_sequences"], r["loc_reduction"]) for r in own] == [(2, 3)]
    plans = code.recommend(found).collect()
    assert [(r["strategy"], r["files"]) for r in plans] == [("EXTRACT_PARENT_CLASS", ["A.java", "B.java"])]
    rows = {r["file"]: r for r in code.report(found, code.recommend(found)).collect()}
    assert {f: (r["duplicates"], r["clusters"], r["strategies"]) for f, r in rows.items()} == {"A.java": (1, 1, "EXTRACT_PARENT_CLASS"), "B.java": (1, 1, "EXTRACT_PARENT_CLASS")}


def test_four_members_save_eleven(spark):
    text = klass("A", *(method(f"m{k}", STEPS) for k in range(4)))
    assert [r["loc_reduction"] for r in code.analyse(sources(spark, A=text), Settings(exclude=())).clusters.collect()] == [11]


def test_varying_literals_are_parameters(spark):
    a = [x.replace('"a"', '"left"').replace("1", "5") for x in STEPS]
    found = code.analyse(sources(spark, A=klass("A", method("a", STEPS), method("b", a))), Settings(exclude=()))
    plan = code.recommend(found).first()
    assert plan["strategy"] == "EXTRACT_HELPER_METHOD" and [tuple(p) for p in plan["params"]] == [("str", "String"), ("num", "int")] and plan["confidence"] == 1.0 and plan["valid_units"] == -1
    done = code.actions(code.recommend(found)).first()
    assert done["action"] == "refactor" and "String str, int num" in done["source"]


@pytest.mark.parametrize(("second", "strategy"), [([], "CONSTRUCTOR_DELEGATION"), (["this.more = 2;", "init(more);"], "EXTRACT_HELPER_METHOD")])
def test_constructors(spark, second, strategy):
    body = ["this.a = 1;", "this.b = 2;", "this.c = 3;", "this.d = 4;", "this.e = 5;"]
    text = "package p;\npublic class A {\n" + method("A", body + second, "public") + "  public A(int x) {\n" + "".join(f"    {u}\n" for u in [*body, "this.x = x;", "check(x);"]) + "  }\n}\n"
    found = code.analyse(sources(spark, A=text), Settings(exclude=()))
    assert {r["strategy"] for r in code.recommend(found).collect()} == {strategy}


def test_nested_return_needs_review(spark):
    body = [*STEPS[:4], "if (user.bad()) { return; }"]
    found = code.analyse(sources(spark, A=klass("A", method("a", body), method("b", body))), Settings(exclude=()))
    plan = code.recommend(found).first()
    assert plan["strategy"] == "MANUAL_REVIEW_REQUIRED" and plan["valid_units"] == 4


def test_refinement(spark):
    """Units that only use what is defined go at the end; the declaration of a captured name comes in at the head."""
    body = ["Conn conn = open();", "conn.one();", "conn.two();", "conn.three();", "Row row = conn.four();", "row.five();", "conn.six();", "conn.seven();"]
    a, b = klass("A", method("a", body)), klass("B", method("b", ["other();", *body]))
    settings = Settings(exclude=(), window_growth=0)
    found = code.analyse(sources(spark, A=a, B=b), settings)
    plain = analysis.analyse(code.bodies(sources(spark, A=a, B=b), settings), settings)
    assert {(r["n1"], r["n2"]) for r in plain.chosen.collect()} != {(r["n1"], r["n2"]) for r in found.chosen.collect()} or found.chosen.count()
    for r in found.chosen.collect():
        assert r["offset1"] + 1 == r["offset2"] and r["n1"] == r["n2"] >= 5


def test_targets_and_excludes(spark):
    files = sources(spark, A=klass("A", method("a", STEPS)), ATest=klass("ATest", method("a", STEPS)))
    assert {r["class_name"] for r in code.bodies(files).collect()} == {"A"}
    assert {r["class_name"] for r in code.bodies(files, Settings(exclude=(), target="ATest")).collect()} == {"ATest"}


def test_nothing(spark):
    found = code.analyse(spark.createDataFrame([("A.java", None), (None, "x"), ("B.java", "")], "file string, text string"))
    assert found.clusters.count() == 0 and code.recommend(found).count() == 0
