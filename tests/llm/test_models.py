import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelab.llm import lang_id, quality, toxicity
from scorelab.llm.common import sample_bar, sample_hash
from scorelab.llm.queries import op3_toxicity, op6_quality_ranking, op10_language_id

from .util import empty, messy

SF = "/root/testdata/sf0.01"


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())


@pytest.mark.parametrize("query,label,mod,rest,least", [(op3_toxicity, "toxic", 5, 0, 0.8), (op6_quality_ranking, "quality", 3, 1, 0.9)])
def test_held_out_ranking(spark, query, label, mod, rest, least):
    got = query(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(rows.score, rows[label]) > least
    whole = got.toPandas()
    assert len(whole) == 1000 and whole.score.between(0, 1).all() and (whole.predicted == (whole.score >= 0.5)).all()
    assert (whole.held_out == [zlib.crc32(str(i).encode()) % mod == rest for i in whole.doc_id]).all()


def test_language_held_out(spark):
    got = op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99


def train_rows(spark):
    rows = [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze im haus", "en" if i % 2 else "de") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_backoff_equals_brute_force(spark):
    model = lang_id.fit(spark, train_rows(spark))
    assert model.langs == ["de", "en"] and "the" in model.at[0]
    # an unseen word: the mean over its known 4-grams (marked ends), here <hun and hund
    known = [g for g in lang_id.grams("hundx", 4) if g in model.at[4]]
    assert known == ["<hun", "hund"]
    assert model.backoff("hundx") == [model.at[4][g] for g in known]
    # none of its 4-grams known: the longest shorter ones that are
    assert all(g not in model.at[4] for g in lang_id.grams("xthx", 4)) and model.backoff("xthx") == [
        model.at[n][g] for n in (3, 2, 1) for g in lang_id.grams("xthx", n) if g in model.at[n]][:len(model.backoff("xthx"))]
    assert model.predict("² ½ 12_3 --", {}) == ("und", 0.0)
    lang, score = model.predict("The hundx", {})
    total = sum(model.table[model.at[4][g]] for g in known) / len(known) + model.table[model.at[0]["the"]]
    p = np.exp(total - total.max())
    assert lang == model.langs[int(total.argmax())] and math.isclose(score, p.max() / p.sum(), rel_tol=1e-5)


def test_language_messy(spark):
    model = lang_id.fit(spark, train_rows(spark))
    docs = messy(spark)
    got = {(r.doc_id, r.lang_pred) for r in lang_id.identify(spark, docs, model).collect() if r.doc_id in (1, 2, 3, 12, None)}
    assert {x for x in got if x[0] is not None} == {(1, "und"), (2, "und"), (3, "und"), (12, "und")} and (None, "und") in got
    kept = lang_id.keep_identified(spark, docs, model)
    assert kept.columns == docs.columns and kept.filter("text IS NULL OR doc_id = 12").count() == 0
    nothing = lang_id.fit(spark, empty(spark))
    assert {r.lang_pred for r in lang_id.identify(spark, docs, nothing).collect()} == {"und"}
    assert lang_id.identify(spark, empty(spark), model).count() == 0


def labelled(spark, good, bad, label):
    rows = [(i, (bad if i % 3 == 0 else good).format(i), int(i % 3 == 0) if label == "toxic" else int(i % 3 != 0)) for i in range(150)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {label} int")


def test_toxicity_messy_and_long(spark):
    rows = labelled(spark, "a calm text number {}", "you total fool number {}", "toxic").union(
        spark.createDataFrame([(900, None, 1), (901, "", 0), (902, "no label", None), (903, "odd", 5)], "doc_id long, text string, toxic int"))
    model = toxicity.fit(spark, rows)
    assert len(model[0]) < 60  # sparse
    texts = [(1, "FOOL!"), (2, "a calm text"), (3, None), (4, ""), (5, "calm " * 50_000 + "fool"), (6, "calm " * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    s = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(spark, model).alias("s")).collect()}
    assert s[1] > 0.5 and s[5] > s[6] and s[2] < 0.5 and s[3] == s[4] and all(0 <= v <= 1 for v in s.values())
    none = toxicity.fit(spark, empty(spark).withColumn("toxic", F.lit(1)))
    assert {r.s for r in messy(spark).select(toxicity.scorer(spark, none).alias("s")).collect()} == {0.5}


def test_ftrl_step_equals_the_formula():
    p = toxicity.Params(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(16), np.zeros(16)
    toxicity.learn(z, n, [(np.array([3, 5, 3]), 1.0), (np.array([5]), 0.0)], p)
    zz, nn = {0: 0.0, 3: 0.0, 5: 0.0}, {0: 0.0, 3: 0.0, 5: 0.0}
    for own, y in (((0, 3, 5), 1.0), ((0, 5), 0.0)):
        w = {}
        for i in own:
            shrunk = 0.0 if i and abs(zz[i]) <= p.l1 else zz[i] - (math.copysign(p.l1, zz[i]) if i and zz[i] else 0.0)
            w[i] = -shrunk / ((p.beta + math.sqrt(nn[i])) / p.alpha + p.l2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            zz[i] += g - (math.sqrt(nn[i] + g * g) - math.sqrt(nn[i])) / p.alpha * w[i]
            nn[i] += g * g
    for i in zz:
        assert math.isclose(z[i], zz[i], abs_tol=1e-12) and math.isclose(n[i], nn[i], abs_tol=1e-12)


def test_quality_messy(spark):
    rows = labelled(spark, "A plain sentence, well formed and number {}.", "!!! ### $$$ || || {} %%%", "quality")
    model = quality.fit(spark, rows)
    texts = [(1, "Another plain sentence, also well formed."), (2, "### !!! $$$ %%% || &&&"), (3, None), (4, ""), (5, "x " * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    s = {r.doc_id: r.s for r in docs.select("doc_id", quality.scorer(model).alias("s")).collect()}
    assert s[1] > 0.5 > s[2] and s[3] == s[4] and all(0 <= v <= 1 for v in s.values())
    one_label = quality.fit(spark, rows.filter("quality = 1"))
    assert {r.s for r in messy(spark).select(quality.scorer(one_label).alias("s")).collect()} == {0.5}
    assert empty(spark).select(quality.scorer(model).alias("s")).count() == 0
    assert all(math.isfinite(v) for t in (None, "", " ", "a", "A B\n\nC" * 999) for v in quality.describe(t))


def test_expected_sample_at_every_size(spark):
    for size in (1, 3_999, 4_000, 4_001, 10 ** 6, 4 * 10 ** 9, 4 * 10 ** 9 + 1, 4 * 10 ** 10, 10 ** 13):
        assert math.isclose((sample_bar(4_000, size) + 1) / 2 ** 63 * size, min(size, 4_000), rel_tol=1e-4)
    got = spark.range(100_000).withColumn("h", sample_hash("id"))
    assert got.filter("h < 0").count() == 0 and got.filter(F.col("h") <= sample_bar(10 ** 5, 10 ** 5)).count() == 100_000
    assert 4_600 < got.filter(F.col("h") <= sample_bar(5_000, 100_000)).count() < 5_400


def test_fits_learn_from_less_than_a_millionth_of_the_rows(spark):
    ids = spark.range(24_000_000).withColumnRenamed("id", "doc_id")  # 20 of them are less than one in a million
    odd = F.col("doc_id") % 2 == 1
    text = F.when(odd, "you total fool ### !!!").otherwise("A calm text, well formed.")
    model = lang_id.fit(spark, ids.select("doc_id", text.alias("text"), F.lit("en").alias("lang")), max_docs=20)
    assert model.langs == ["en"] and model.at[0]
    assert quality.fit(spark, ids.select("doc_id", text.alias("text"), (~odd).cast("int").alias("quality")), max_docs=20)[0]
    assert toxicity.fit(spark, ids.select("doc_id", text.alias("text"), odd.cast("int").alias("toxic")), params=toxicity.Params(max_docs=20))[2] != 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than the former sample of 12,000: all are described, and the threshold stands at the share of all rows labelled 0."""
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    good = F.col("doc_id") % 10 > 2
    text = F.concat(F.when(good, F.lit("A calm text, well formed, ")).otherwise(F.lit("### !!! ")), F.repeat(F.lit("word "), (F.col("doc_id") % 40).cast("int")))
    rows = ids.select("doc_id", text.alias("text"), good.cast("int").alias("quality"))
    sizes, write = {}, quality.Scratch.write
    monkeypatch.setattr(quality.Scratch, "write", lambda self, df, name="t", keep=False: (sizes.__setitem__(name, (t := write(self, df, name, keep)).count()), t)[1])
    model = quality.fit(spark, rows)
    assert sizes["described"] == 30_000 == sizes["scores"]
    got = rows.select("quality", (quality.scorer(model) >= 0.5).cast("int").alias("p"))
    assert got.filter("p = 0").count() == 9_000 and got.filter("p <> quality").count() == 0


def test_quality_joins_labels_to_numbers_not_texts(spark, monkeypatch):
    """Numbers are computed below the join with the labels, so no text is shuffled; repeated and null ids join as rows do."""
    n = F.col("id")
    texts = spark.range(3000).select(F.when(n % 50 > 0, n % 2000).alias("doc_id"), F.concat(F.when(n % 3 > 0, "A calm text. ").otherwise("### !! "), F.repeat(F.lit("word "), (n % 20).cast("int"))).alias("text"))
    labels = spark.range(2500).select(F.when(n % 40 > 0, n).alias("doc_id"), F.when(n % 7 > 0, (n % 3 > 0).cast("long")).otherwise(n % 4).alias("quality"))
    plans, described, write = [], [], quality.Scratch.write

    def spy(self, df, name="t", keep=False):
        out = write(self, df, name, keep)
        if name == "described":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            described.append(sorted((r.id, r.y, tuple(r.x)) for r in out.collect()))
        return out

    monkeypatch.setattr(quality.Scratch, "write", spy)
    (w1, cut1), (w2, cut2) = quality.fit(spark, texts.join(labels, "doc_id")), quality.fit(spark, texts, labels=labels)
    assert described[0] == described[1] and len({r[0] for r in described[0]}) < len(described[0])
    assert np.allclose(w1, w2, rtol=1e-3, atol=1e-6) and math.isclose(cut1, cut2, rel_tol=1e-3, abs_tol=1e-6)
    op6_quality_ranking(spark, SF)
    assert len(plans) == 3
    for plan in plans[1:]:
        assert -1 < plan.index("Join") < plan.index("ArrowEvalPython")
    assert quality.fit(spark, texts, labels=labels, max_docs=100)[0] and 40 < len(described[-1]) < 250
