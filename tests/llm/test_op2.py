import random

import numpy as np

from tessella.llm import op2_decontaminate as D


def vocabulary(r):
    return [f"ñá{i}ø" for i in range(300)] + ["the", "of", "and", "in"] * 40 + [f"w{i}" for i in range(3000)]


def corpus(seed):
    r = random.Random(seed)
    v = vocabulary(r)
    items = [(i, " ".join(r.choices(v, k=r.choice([9, 15, 30, 60]))) + r.choice([".", "? " + " ".join(r.choices(v, k=4)) + "."])) for i in range(40)]
    items += [(50, " ".join(r.choices(v, k=300))), (51, None), (52, "a b c"), (None, " ".join(r.choices(v, k=20))), (7, items[7][1])]
    docs, truth = [(0, None), (1, ""), (2, "?!")], {}
    for i in range(3, 160):
        w = r.choices(v, k=r.choice([5, 50, 130, 500]))
        if r.random() < 0.4:
            k, t = r.choice([x for x in items if x[1] and x[0] != 52])
            at = r.randrange(len(w) + 1)
            t = t.split()
            if r.random() < 0.3:
                t[r.randrange(len(t))] = "changed"
            if r.random() < 0.3:
                t = [x.upper() for x in t]
            w = w[:at] + t + w[at:]
            truth[i] = -1 if k is None else k
        docs.append((i, r.choice([" ", "\n"]).join(w)))
    return items, docs, truth


def scores(ix, terms):
    s = np.zeros(ix.n)
    for t in terms:
        for i, v in zip(*ix.lists.get(t, ([], []))[:2]):
            s[i] += v
    return s


def test_wand_and_bound_miss_nothing():
    items, docs, _ = corpus(1)
    ix = D.Index([(i or -1, t) for i, t in items if t])
    for _, text in docs:
        term = D.token_list(text or "")
        hopeful = {p for _, p in ix.hopeful(term, np.array([0, len(term)]))}
        for p in range(max(1, -(-(len(term) - D.PASSAGE) // D.STRIDE) + 1)):
            want = scores(ix, set(term[p * D.STRIDE : p * D.STRIDE + D.PASSAGE].tolist()))
            good = {i: want[i] for i in np.flatnonzero(want >= D.LEAST - 1e-9)}
            got = dict(ix.wand(set(term[p * D.STRIDE : p * D.STRIDE + D.PASSAGE].tolist())))
            assert got.keys() == good.keys() and all(abs(got[i] - good[i]) < 1e-9 for i in got)
            assert not good or p in hopeful


def missed(items, docs):
    """Passages with a segment of at least LEAST that the bound leaves out, and how many there are."""
    ix, out, n = D.Index(items), [], 0
    term = [D.token_list(t) for t in docs]
    hopeful = set(ix.hopeful(np.concatenate(term), np.concatenate([[0], np.cumsum([len(t) for t in term])])))
    for k, t in enumerate(term):
        for p in range(max(1, -(-(len(t) - D.PASSAGE) // D.STRIDE) + 1)):
            if (scores(ix, set(t[p * D.STRIDE : p * D.STRIDE + D.PASSAGE].tolist())) >= D.LEAST).any():
                n += 1
                out += [(k, p)] if (k, p) not in hopeful else []
    return out, n


def test_repeated_items_and_small_vocabularies_are_met(spark, monkeypatch):
    r = random.Random(4)
    words = lambda v, n: " ".join(r.choices(v, k=n))
    many, small = [f"w{i}" for i in range(5000)], [f"w{i}" for i in range(100)]
    for times, n in ((2, 30), (3, 40), (11, 200)):
        item = words(many, 20)
        items = [(0, item)] * times + [(i, words(many, 20)) for i in range(1, n - times + 1)]
        docs = [words(many, 100), words(many, 100) + " " + item + " " + words(many, 100)]
        lost, met = missed(items, docs)
        assert not lost and met
    items = [(i, words(small, 60)) for i in range(200)]
    docs = [words(many, 60) + " " + t + " " + words(many, 60) for _, t in items[:40]]
    for size in (D.POSTINGS, 500):
        monkeypatch.setattr(D, "POSTINGS", size)
        lost, met = missed(items, docs)
        assert not lost and met >= 40
    three = [(1, items[0][1]), (2, items[0][1]), (3, items[0][1]), (4, words(many, 20))]
    out = D.mark(spark.createDataFrame([(1, docs[0]), (2, docs[1])], "doc_id long, text string"), spark.createDataFrame(three, "item_id long, text string")).collect()
    assert [sorted(x["items"]) for x in sorted(out)] == [[1, 2, 3], []]


def test_leaks_are_found_and_clean_texts_left(spark, monkeypatch):
    items, docs, truth = corpus(2)
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, row string, items int").repartition(3).drop("items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in D.mark(df, bench).collect()}
    assert len(out) == len(docs) and out[5].row == "s"
    for i, _ in docs:
        assert out[i].contaminated == (i in truth), i
        if i in truth:
            assert truth[i] in out[i]["items"]
    monkeypatch.setattr(D, "INDEX_TOKENS", 900)  # several blocks, with the term statistics of all
    assert len(list(D.index_blocks(bench))) > 2
    many = {r.doc_id: r for r in D.mark(df, bench).collect()}
    for i, _ in docs:
        assert (many[i]["items"], many[i].n_passages, many[i].row) == (out[i]["items"], out[i].n_passages, out[i].row), i
        assert abs(many[i].best_score - out[i].best_score) < 1e-9


def test_short_items_are_found_word_by_word(spark, monkeypatch):
    r = random.Random(6)
    filler = lambda: " ".join(r.choices([f"w{i}" for i in range(4000)], k=150))
    items = [(1, "Who wrote Hamlet? Shakespeare."), (2, "a b c"), (3, "one two"), (4, "x"), (5, filler())]
    docs = [filler() + " who WROTE hamlet? shakespeare, " + filler(), filler() + " hamlet wrote who shakespeare " + filler(), filler() + " a, b; c " + filler(), filler() + " a b x c one two x " + filler(), "a b c"]
    want = [[1], [], [2], [], [2]]
    for size in (D.INDEX_TOKENS, 6):
        monkeypatch.setattr(D, "INDEX_TOKENS", size)
        out = D.mark(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
        assert out.columns == ["doc_id", "n_passages", "best_score", "items", "contaminated"]
        assert [x["items"] for x in sorted(out.collect())] == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.mark(docs, none).collect()] == [False, False]
    assert D.mark(docs.limit(0), none).collect() == []


def test_question_and_answer():
    assert D.question_and_answer("Who? Me.") == ("Who?", " Me.")
    assert D.question_and_answer("A b. C d.") == ("A b.", " C d.")
    assert D.question_and_answer("a b c d e f") == ("a b c d", "e f")
