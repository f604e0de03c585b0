"""Language ID and toxicity: held-out accuracy, the methods' own properties, defined cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def crc(n):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(larger):
    held = crc(3) == 1
    found = langid.identify(larger, langid.fit(larger.where(~held))).where(held).join(larger, "doc_id").toPandas()
    assert len(found) > 200 and (found.lang_pred == found.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_defined_cases(spark):
    rows = [(1, "the house and the garden of the people", "en", 0.5), (2, "das haus und der garten von den leuten", "de", 0.5), (3, None, "en", 0.5),
            (4, "12 345 !!", None, 0.5), (5, "", "de", 0.5), (None, "der hund und die katze", None, 0.5), (6, "das haus", "de", 0.5), (6, "das haus", "de", 0.5), (7, "漢字", None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(df)
    got = langid.identify(df, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got[:8]] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (6, "de"), (6, "de")]
    assert got[8]["lang_pred"] in ("en", "de") and got[8]["ambiguous"] and all(r["ambiguous"] and r["score"] == 0 for r in got[2:5])
    assert langid.identify(df.limit(0), model).collect() == []
    none = langid.identify(df, langid.fit(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = langid.identify(df, langid.fit(df.where("lang = 'de'"))).collect()
    assert [r["lang_pred"] for r in one] == ["de", "de", "und", "und", "und", "de", "de", "de", "de"]


@pytest.mark.parametrize("n", [2, 3, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    apart = (code[:, None] != code[None]).sum(2) + 1000 * np.eye(n, dtype=int)
    assert apart.min() >= max(1, code.shape[1] // 4) and (code.sum(0) > 0).all() and (code.sum(0) < n).all()


def test_codewords_correct_errors():
    """With one bit's classifier wrong, decoding still names the language."""
    code = langid.codewords(4)
    bits = code.shape[1]
    model = langid.Model(list("abcd"), code, None, np.ones(bits), np.zeros(bits), np.ones(bits))
    for i in range(4):
        for wrong in range(bits):
            f = 2.0 * code[i] - 1
            f[wrong] *= -1
            assert model.decode(f[None, :])[0][0] == i


def test_toxicity_of_held_out_documents(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    held = crc(5) == 0
    model = toxicity.fit(documents.where(~held).join(labels, "doc_id"))
    got = toxicity.score(documents, model).join(labels, F.col("key") == labels.doc_id).where(held).toPandas()
    toxic, fine = got[got.label == 1].score, got[got.label == 0].score
    # about one label of seven here stands on a text without any telling word
    assert (toxic.to_numpy()[:, None] > fine.to_numpy()[None, :]).mean() > 0.85
    assert (toxic >= 0.5).mean() > 0.75 and (fine < 0.5).mean() > 0.99


def sentences(rnd, n):
    """Toxic ones hold an insult half the time, and name one group far more often than others do."""
    groups, insults, neutral = ["muslims", "christians", "jews"], ["awful", "vermin"], "the a of we saw them in town today and then left again".split()
    out = []
    for i in range(n):
        words, toxic = [rnd.choice(neutral) for _ in range(8)], rnd.random() < 0.4
        if toxic and rnd.random() < 0.5:
            words.append(rnd.choice(insults))
        if rnd.random() < 0.6:
            words.append("muslims" if rnd.random() < (0.9 if toxic else 0.2) else rnd.choice(groups))
        rnd.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_swapped_groups_score_alike(spark):
    df = spark.createDataFrame(sentences(random.Random(1), 2000), "doc_id long, text string, label int")
    probe = spark.createDataFrame([(i, f"we saw the {g} in town") for i, g in enumerate(["muslims", "christians", "jews"])]
                                  + [(9, "we saw the awful jews in town")], "doc_id long, text string")

    def gap(fairness):
        s = {r["key"]: r["score"] for r in toxicity.score(probe, toxicity.fit(df, fairness=fairness, l1=0.02)).collect()}
        return max(s[i] for i in range(3)) - min(s[i] for i in range(3)), s

    free, unfair = gap(0.0)
    held, s = gap(10.0)
    assert held < 0.2 * free and unfair[0] > s[0] and max(s[i] for i in range(3)) < 0.5 < s[9]


def test_toxicity_defined_cases(spark):
    rows = [(i, "kind words", 0, 1) for i in range(40)] + [(100 + i, "idiot words", 1, 1) for i in range(40)]
    rows += [(200, None, 1, 1), (201, "", 0, 1), (202, "x", None, 1), (None, "idiot", 0, 1), (0, "kind words", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, score int")
    model = toxicity.fit(df, l1=0.02)
    got = {r["key"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert got[100] > 0.5 > got[5] and got[200] == got[201] == got[202] and got[None] > 0.5
    kept = toxicity.reject(df, model).collect()
    assert {r["doc_id"] for r in kept} == {k for k, v in got.items() if v < 0.5} and len(kept[0]) == 4
    assert toxicity.score(df.limit(0), model).collect() == []
    for one, score in ((df.limit(0), 0.0), (df.where("label = 0"), 0.0), (df.where("label = 1"), 1.0)):
        assert {round(r["score"], 9) for r in toxicity.score(df, toxicity.fit(one)).collect()} == {score}


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    df = spark.createDataFrame(sentences(random.Random(2), 3000), "doc_id long, text string, label int")
    a, b = toxicity.fit(df.repartition(3), most_rows=500), toxicity.fit(df.repartition(7), most_rows=500)
    assert np.array_equal(a.words, b.words) and np.allclose(a.weights, b.weights, atol=1e-6)


def test_samples_are_bounded_by_row(spark):
    """Rows that share one key, or two texts, are drawn apart."""
    one = spark.range(60_000).selectExpr("1L AS doc_id", "concat('t', id % 50) AS text", "CAST(id % 2 AS int) AS label").repartition(4)
    n = toxicity.draw(one, 4_000).count()
    assert abs(n - 4_000) < 400
    two = spark.range(40_000).selectExpr("concat('text ', id % 2) AS text", "'en' AS lang").repartition(4)
    n = langid.sample_rows(two, {"en": 40_000}, 500).groupBy("text").count().collect()
    assert len(n) == 2 and 380 < sum(r["count"] for r in n) < 620 and min(r["count"] for r in n) > 150
    few = spark.createDataFrame([("a", "en"), ("a", "en"), ("b", "de")], "text string, lang string")
    assert sorted(map(tuple, langid.sample_rows(few, {"en": 2, "de": 1}, 500).collect())) == [("de", "b"), ("en", "a"), ("en", "a")]


def _swaps_by_hand(texts, kinds):
    """All swaps of one term in one sentence, with the sets of features before and after."""
    def feature(word):
        return {int(x) for x in toxicity.term_features([word])[0]}

    out = {}
    for text in texts:
        for sentence in re.split(r"[.!?\n]", text or ""):
            said = re.findall(r"[a-z0-9']+", sentence.lower())
            for kind in kinds:
                for term in set(said) & set(kind):
                    for other in set(kind) - {term}:
                        before = set().union(*map(feature, said))
                        after = set().union(*(feature(other if w == term else w) for w in said))
                        if before != after:
                            change = tuple(sorted(after - before)), tuple(sorted(before - after))
                            out[change] = out.get(change, 0) + 1
    return out


def test_sentences_are_swapped(spark):
    kinds = [("people", "women", "men", "woman"), ("person", "gay", "queer")]
    texts = ["Women and men met. Women left!", "the womanly woman", "gay people\nqueer, gay", None, "", "no one here", "men men men? A person.", "peoples and people"]
    sample = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string").repartition(3)
    got = {(tuple(sorted(c)), tuple(sorted(g))): n for c, g, n in toxicity.swapped(sample, [toxicity.term_features(k) for k in kinds])}
    assert got == _swaps_by_hand(texts, kinds) and max(got.values()) > 1


def test_null_ids_are_learned_from(spark):
    rows = [(None, "the cat and the dog", "en"), (None, "der hund und die katze", "de")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held_out = F.coalesce(crc(3) == 1, F.lit(False))
    assert langid.fit(df.where(~held_out)).languages == ["de", "en"]
