import random
import re
from collections import defaultdict

import pytest

from tessella.llm import op8_mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshare(sizes):
    """The rule as it is written: share by weight, stop at the cap, share the excess again."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    t, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while left > 1e-9 and open_:
        total, spare = sum(w[i] for i in open_), 0.0
        for i in open_:
            t[i] += left * w[i] / total
        for i in list(open_):
            if t[i] >= 2 * sizes[i]:
                spare += t[i] - 2 * sizes[i]
                t[i] = 2 * sizes[i]
                open_.discard(i)
        left = spare
    return t


def corpus(seed, n):
    r = random.Random(seed)
    out = [(None, "a b c", "s1"), (3, None, "s1"), (4, "", None), (5, " \n", "zz")]
    for i in range(n):
        s = r.choice(["s1", "s1", "s1", "S2", "é", None, "t", "𐀀", "￿"])
        out.append((r.randrange(10 * n), " ".join(["w"] * r.choice([1, 5, 50, 400])), s))
    return out + out[-3:]


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t, s, 1.0) for i, t, s in docs], "doc_id long, text string, source string, p double").repartition(parts)
    return [tuple(r) for r in M.copies(df).collect()]


def test_targets():
    r = random.Random(0)
    for _ in range(200):
        sizes = [float(r.choice([0, 1, 5, 100, 1000])) for _ in range(r.randrange(1, 12))]
        assert M.targets(sizes) == pytest.approx(reshare(sizes), abs=1e-6)


def test_law(spark, monkeypatch):
    docs = corpus(1, 900)
    one = run(spark, docs)
    assert sorted(one, key=str) == sorted(run(spark, docs, 8), key=str)
    monkeypatch.setattr(M, "LEAF_ROWS", 10)
    monkeypatch.setattr(M, "FAN", 4)
    for out in (one, run(spark, docs)):
        assert len(out) == len(docs)
        sizes, taken, aim, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
        for i, s, h, n, total, t, c in out:
            sizes[s] += n
            taken[s] += c * n
            aim[s] = t
            most[s] = max(most[s], n)
            assert c in (0, 1, 2) and total >= n
        assert sorted(n for *_, n, _, _, _ in out) == sorted(len(WORD.findall(t or "")) for _, t, _ in docs)
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        assert [aim[s] for s in order] == pytest.approx(reshare([sizes[s] for s in order]))
        for s in order:
            assert abs(taken[s] - aim[s]) <= most[s] + 1e-6


def test_pivot_is_fair():
    r = random.Random(4)
    for a, b in ((1, 1), (3, 10), (200, 7)):
        total = [0.0, 0.0]
        for _ in range(20000):
            p, q = M.pivot(0.3, a, 0.55, b, r.random())
            assert abs(a * p + b * q - (0.3 * a + 0.55 * b)) < 1e-6 and {p, q} & {0.0, 1.0}
            total[0] += p
            total[1] += q
        assert abs(total[0] / 20000 - 0.3) < 0.02 and abs(total[1] / 20000 - 0.55) < 0.02


def test_mix_repeats_rows(spark):
    docs = corpus(2, 300)
    df = spark.createDataFrame([(i, t, s, k) for k, (i, t, s) in enumerate(docs)], "doc_id long, text string, source string, _n int")
    want = sum(r[6] for r in run(spark, docs))
    out = M.mix(df)
    assert out.columns == df.columns and out.count() == want
    assert M.mix(df.limit(0)).count() == 0
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert M.mix(unique).groupBy("doc_id").count().where("count > 2").count() == 0
