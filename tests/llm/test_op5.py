import random
import zlib

import numpy as np

from tessella.llm import op5_language as L

SYL = {"en": ["the", "ing", "tion", "ou", "and", "th"], "de": ["sch", "ung", "keit", "ä", "ü", "zu"], "fr": ["eau", "è", "que", "ment", "oi", "ç"], "es": ["ción", "ll", "ñ", "rr", "mente", "ó"], "xx": ["qa", "jz", "wv"]}


def corpus(n=600):
    r = random.Random(3)
    out = []
    for i in range(n):
        lang = r.choice(list(SYL))
        out.append((i, " ".join("".join(r.choices(SYL[lang], k=r.choice([1, 2, 3]))) for _ in range(r.choice([6, 20, 100]))), lang))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, v, "s") for i, t, v in rows], "doc_id long, text string, lang string, row string").repartition(3)
    return df, {r.doc_id: r for r in L.detect(df, L.train(df)).collect()}


def test_held_out_accuracy(spark):
    rows = corpus()
    df, out = run(spark, rows)
    test = [(i, v) for i, _, v in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(test) > 80 and sum(out[i].lang_pred == v for i, v in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[5].row == "s"
    held = {r.doc_id: r.h for r in df.select("doc_id", L.held_out(df.doc_id).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows}


def test_und_and_odd_inputs(spark):
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 3! …", "de"), (9004, "日", None), (9005, "é", "fr"), (None, "the and", None), (9006, "the " * 9, None)]
    _, out = run(spark, corpus(200) + odd)
    assert [out[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and out[9001].score == 0
    assert out[9004].lang_pred != "und" and out[9005].lang_pred != "und" and out[None].lang_pred == "en"
    _, out = run(spark, [(1, "abc", None), (2, None, "en")])
    assert {r.lang_pred for r in out.values()} == {"und"}
    _, out = run(spark, [(1, "abc def", "en"), (2, "x y z", None)])
    assert {r.lang_pred for r in out.values()} == {"en"}
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.detect(df, L.train(df)).collect() == []


def test_machine_separates():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(1, 1, (80, 5)), r.normal(-1, 1, (80, 5))])
    x = np.concatenate([x, np.ones((160, 1))], axis=1)
    y = np.repeat([1, -1], 80)
    assert (np.sign(x @ L.svm(x, y)) == y).mean() > 0.95
