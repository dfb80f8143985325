import inspect
import random

import corpus_pipeline
from reprise.llm import queries, secrets, simhash
from tests.llm import data


def tables(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = list(data.texts()), []
    for i in range(1000, 1300):
        w, good = data.words(rng.randrange(60, 150), i), rng.random() < 0.75
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w)))
        labels.append((i, int(good), 0))
    docs = data.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    data.labels(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet")), dict((i, q) for i, q, _ in labels)


def test_stages(spark, tmp_path):
    docs, known = tables(spark, tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{k}"))
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality classifier":
            assert sum(known[i] for i in ids if i in known) == sum(known.values())
            assert sum(1 - known[i] for i in ids if i in known) < 10
        if name == "simhash near-dedup":
            groups = simhash.simhash_groups(before).collect()
            assert ids - {None} == {r["component_id"] for r in groups} - {None}
        if name == "secret scans":
            assert docs.count() == before.count()
            texts = {r["text"] for r in before.collect()}
            assert all(r["text"] in texts or "[SECRET]" in r["text"] for r in docs.collect())
            assert all(not secrets_in(r["text"]) for r in docs.collect())
    assert docs.count() > 0 and {"sequence_id", "offset"} <= set(docs.columns)


def secrets_in(text):
    import re

    return [m for m in re.finditer(secrets.ASSIGN, text or "") if len(m[1]) >= 6 and m[1] != "[SECRET]"]


def test_run_takes_all_stages(spark, tmp_path):
    tables(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_on_nothing(spark, tmp_path):
    data.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    data.labels(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_queries():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] and set(queries.oracle_sql()) <= set(names)
    assert all(len(inspect.signature(f).parameters) == 3 for _, f in corpus_pipeline.STAGES)
