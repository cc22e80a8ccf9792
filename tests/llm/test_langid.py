from pyspark.sql import functions as F

from folioscope.llm import langid
from folioscope.llm.common import id_remainder

SF = "/root/testdata/sf0.01"


def predicted(df, model):
    return df.select("doc_id", langid.predictions(F.col("text"), model).alias("p")).select("doc_id", "p.*").collect()


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", id_remainder(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.filter("not held"))
    rows = docs.filter("held").select("lang", langid.predictions(F.col("text"), model).alias("p")).select("lang", "p.*").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert abs(sum(r.score for r in rows) / len(rows) - sum(right) / len(right)) < 0.05
    matrix = model.matrix()
    assert (matrix == 0).mean() > 0.3  # sparse


def test_odd_texts(documents, clashing):
    rows = [(i, t) for i in range(30) for t in ("the cat and the dog of the house", "der Hund und die Katze im Haus")]
    train = documents(rows).withColumn("lang", F.when(F.col("text").startswith("der"), "de").otherwise("en"))
    model = langid.fit(clashing(train))
    odd = [(1, None), (2, ""), (3, "123 *** ²½"), (4, "und der Hund " * 20_000), (5, "the house"), (5, "the house"), (None, "Die Katze")]
    found = {(r.doc_id, r.lang_pred) for r in predicted(documents(odd), model)}
    assert found == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (None, "de")}
    assert all(r.score == 0 for r in predicted(documents(odd[:3]), model))
    assert predicted(documents([]), model) == []


def test_nothing_to_learn_from(documents):
    none = documents([(1, "text")]).withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(none)
    assert model is None
    assert [(r.lang_pred, r.score) for r in predicted(none, model)] == [("und", 0.0)]


def test_bounded_sample_is_even(spark, documents):
    rows = [(i, "the house of the cat") for i in range(400)] + [(1000 + i, "das Haus der Katze") for i in range(20)]
    train = documents(rows).withColumn("lang", F.when(F.col("doc_id") >= 1000, "de").otherwise("en"))
    model = langid.fit(train, sample=60)
    assert [r.lang_pred for r in predicted(documents([(1, "das Haus")]), model)] == ["de"]


def test_learner_is_the_formula():
    import numpy as np

    p = langid.Penalties(alpha=0.3, beta=0.7, l1=0.01, l2=0.2)
    learner, z, n = langid.Learner(3, 2, p), np.zeros((3, 2)), np.zeros((3, 2))

    def weight(i, k):
        if abs(z[i, k]) <= p.l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * p.l1) / ((p.beta + np.sqrt(n[i, k])) / p.alpha + p.l2)

    for at, x, y in [([0, 2], [1.0, 0.5], 0), ([1, 2], [0.3, 1.0], 1), ([0, 1], [0.2, 2.0], 1)] * 5:
        w = {(i, k): weight(i, k) for i in at for k in range(2)}
        logits = [sum(v * w[i, k] for i, v in zip(at, x)) for k in range(2)]
        e = np.exp(np.array(logits) - max(logits))
        e /= e.sum()
        for i, v in zip(at, x):
            for k in range(2):
                g = v * (e[k] - (k == y))
                s = (np.sqrt(n[i, k] + g * g) - np.sqrt(n[i, k])) / p.alpha
                z[i, k] += g - s * w[i, k]
                n[i, k] += g * g
        learner.learn(np.array(at), np.array(x), y)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
