import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_lines import brute as left_lines
from tests.llm.test_simhash import classes, fingerprint

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def sample():
    draw = random.Random(21)
    prose = lambda n: " ".join(draw.choice(["house", "tree", "river", "the", "walk", "stone", "bird", "Él", "cloud"]) + str(draw.randint(0, 30)) for _ in range(n))  # noqa: E731,E501
    docs = [(i, "\n".join(prose(12) for _ in range(draw.randint(1, 8)))) for i in range(25)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200 + i, docs[10 + i][1] + " more") for i in range(5)]
    docs += [(300, None), (301, ""), (None, docs[7][1]), (3, docs[3][1]), (302, "spam " * 50)]
    return docs


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "packing"]


def test_columns_stay_whatever_they_are(spark, documents, clashing):
    docs = clashing(documents(sample()))
    for _, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, docs, SF).columns == docs.columns


def test_quality_drops_what_fails(spark, documents):
    kept = {r.doc_id for r in stage("quality rules")(spark, documents(sample()), SF).collect()}
    assert kept == {i for i, t in sample() if t and i != 302}


def test_lines_by_definition(spark, documents):
    docs = sample()
    wanted = left_lines(docs, 3)
    rows = stage("line dedup")(spark, documents(docs), SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(wanted[i, t][0])) for i, t in docs)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_one_document_of_each_group_stays(spark, documents):
    docs = sample()
    label = classes({fingerprint(t) for _, t in docs}, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        first.setdefault(label[fingerprint(t)], i)
    rows = stage("near-dedup")(spark, documents(docs), SF).collect()
    assert sorted(map(str, first.values())) == sorted(str(r.doc_id) for r in rows)


def test_contaminated_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    clean = {r[0] for r in hits(texts, items) if not r[5]}
    assert 0 < len(clean) < len(texts)
    assert {r.doc_id for r in stage("decontamination")(spark, docs, SF).collect()} == clean


def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    per_document = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert per_document.filter("n <> m").count() == 0 and 0 < per_document.count() < 200


def test_no_documents(spark, documents):
    docs = documents([])
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, docs, SF).collect() == []
