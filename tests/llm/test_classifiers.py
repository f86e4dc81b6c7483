"""Toxicity and quality: learning, held-out accuracy, odd rows."""

import os

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import ODD
from pyspark.sql import functions as F

from trophos.llm import quality_rff as Q
from trophos.llm import toxicity as T


LARGER = "/root/testdata/sf0.1"


def test_fold():
    assert T.fold("You 1D10T and l0ser$$$, Іdіot! $cum p@thetic") == " you idiot and ioser idiot scum pathetic "
    assert T.fold("ｉｄｉｏｔ i​diot ÍDIÓT") == " idiot idiot idiot "
    assert T.fold("") == "  "


def test_digits_between_letters():
    assert T.fold("bi9ot ma66ot cra2y NI9HT u6ly") == " bigot maggot crazy night ugiy "
    assert T.fold("in 2026 9 to 6, 2nd mp2 6ft") == " in o to nd mp ft "
    assert T.fold("b19ot f@9got ma６9ot bi\u200b9\u200bot 1960s") == " bigot faggot maggot bigot i os "
    value = lambda text: T.statistic(T.fold(text), T.Lexicon({" bigot ": 1.0, " crazy ": 1.0}).automaton())
    assert value("a bi9ot") > 0 and value("bi6ot") > 0 and value("cra2y!") > 0 and value("a big 9") == 0


def test_statistic_counts_matches_outside_exceptions_and_divides_by_length():
    lexicon = T.Lexicon({" idiot ": 2.0, " scum": 1.0}, [" pond scum "])
    value = lambda text: T.statistic(T.fold(text), lexicon.automaton())
    assert value("an idiot idiot") == pytest.approx(4 / np.sqrt(1.03))
    assert value("scummy") == pytest.approx(1 / np.sqrt(1.01))
    assert value("pond scum") == 0 and value("pond scum scum") > 0
    assert value("idiotic") == 0
    assert value("idiot " + "fine " * 399) == pytest.approx(2 / np.sqrt(5))


def _labelled(spark):
    bad = [(f"clean words number{i} here vile{chr(97 + i % 6)}x and gr{0 if i % 2 else 'o'}tty", 1) for i in range(60)]
    good = [(f"clean words number{i} here and villa", 0) for i in range(150)]
    harmless = [(f"a grotty cave number{i}", 0) for i in range(4)]
    return spark.createDataFrame(bad + good + harmless, "text string, label int")


def test_learns_words_beginnings_and_exceptions(spark):
    lexicon = T.learn(_labelled(spark))
    assert " grotty " in lexicon.entries
    assert any(e.startswith(" viie") and not e.endswith(" ") for e in lexicon.entries)
    assert " a grotty " in lexicon.exceptions or " grotty cave " in lexicon.exceptions
    rows = spark.createDataFrame([("new vilezz text",), ("a grotty cave",), ("plain",), (None,)], "text string")
    found = [r[0] for r in rows.select(T.score(rows, lexicon)).collect()]
    assert found[0] > 0.5 > found[2] and found[1] == found[2] == found[3]


def test_texts_are_scored_a_few_at_a_time(spark):
    lexicon = T.Lexicon({" idiot ": 2.0}, [], 3.0, -1.0)
    texts = ["an idiot", "fine " * 20_000, "", None] * 80
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    scored = rows.select("i", T.score(rows, lexicon).alias("score"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    found = [r["score"] for r in scored.orderBy("i").collect()]
    raw = np.array([T.statistic(T.fold(t or ""), lexicon.automaton()) for t in texts])
    assert found == T._probability(lexicon, raw).tolist()


def test_without_both_labels_nothing_is_toxic(spark):
    rows = spark.createDataFrame([("a b", 0)], "text string, label int")
    assert T.learn(rows) == T.Lexicon() and T.learn(rows.limit(0)) == T.Lexicon()


@pytest.mark.parametrize("module", [T, Q])
def test_odd_rows(module, odd, empty, odd_labels):
    rows = module.score_documents(odd, odd_labels).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    blank = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(blank) == 1
    assert module.score_documents(empty, odd_labels).count() == 0
    assert module.score_documents(odd, odd_labels.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("module, target, least", [(T, "toxic", 0.97), (Q, "quality", 0.99)])
def test_held_out_accuracy(module, target, least, spark):
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    documents, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    scored = module.score_documents(documents, labels).where("held_out").join(labels, "doc_id")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col(target)).cast("int")), F.count("*")).first()
    assert n > 500 and right > least


def test_labels_of_the_fold_do_not_matter(documents, labels):
    other = labels.withColumn(
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = (sorted(map(tuple, Q.score_documents(documents, x).collect())) for x in (labels, other))
    assert a == b


def test_statistics():
    names = list(Q.STATISTICS)
    x = Q.statistics(pa.array(["AB cd! 12 %%\nAB cd! 12 %%\n\nx", None, "", " \n", "a a a a"]))
    get = lambda i, name: x[i, names.index(name)]
    assert np.exp(get(0, "log_words")) - 1 == pytest.approx(9)
    assert get(0, "upper") == pytest.approx(4 / 9) and get(0, "repeated_lines") == pytest.approx(1 / 3)
    assert get(0, "words_with_symbol") == pytest.approx(2 / 9) and get(0, "distinct_words") == pytest.approx(5 / 9)
    assert get(4, "same_as_before") == 0.75 and get(4, "pair_repeats") == 0.5
    assert not x[1:4].any()


def test_features_approximate_a_gaussian_kernel():
    d = len(Q.STATISTICS)
    x = np.random.default_rng(0).normal(size=(40, d))
    model = Q.Model(np.zeros(d), np.ones(d), None, np.zeros(1), np.zeros(1))
    z = model.features(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * d))
    assert np.abs(z @ z.T - true).mean() < 0.06


def test_isotonic():
    assert Q._isotonic(np.array([0.2, 0.0, 0.5, 0.4, 1.0]), np.array([1.0, 1, 1, 3, 1])) == pytest.approx([0.1, 0.1, 0.425, 0.425, 1])


def test_rejecting_keeps_all_columns(odd, odd_labels):
    for kept in (T.reject_toxic(odd, odd_labels), Q.reject_poor(odd, odd_labels)):
        assert kept.columns == odd.columns and kept.count() <= len(ODD)
