import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessella.llm import op3_token_binary as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a  b\t\tc ", "it's we'll 'tis 12a 3½ ª²", "x\x0by\x85z w", "日本語 テスト", "<|endoftext|> a<|endoftext|>", "é́ ñ Ōō — “q” …", "a" * 3000, " 'S 's'T", "\r\n x", "\x1c a", "€5 §3 ×2"]


def plain(docs):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in docs]
    for i, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes())):
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def got(spark, docs, parts=3):
    df = spark.createDataFrame([(i, x, "e", 5) for i, x in docs], "doc_id long, text string, ids string, n int").repartition(parts)
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.token_digests(df).collect()), key=lambda r: r[1])


def test_equals_the_tokenizer(spark, monkeypatch):
    r = random.Random(5)
    docs = [(1000 - 3 * i, x) for i, x in enumerate(ODD)]
    docs += [(i, "".join(r.choice("ab é'\n s1.") for _ in range(r.randrange(200)))) for i in range(1001, 1060)]
    monkeypatch.setattr(T, "BLOCK_IDS", 700)
    assert got(spark, docs) == plain(docs)


def test_ids_are_read_back(spark, tmp_path):
    docs = [(2, "a b"), (1, "c"), (9, None)]
    T.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), PATH, f"file://{tmp_path}/t")
    t = Tokenizer.from_file(PATH)
    out = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert out == {i: t.encode(x or "").ids + [2] for i, x in docs}


def test_ties_nulls_and_empty(spark):
    assert got(spark, []) == []
    out = got(spark, [(None, "z"), (5, "b c"), (5, "b c"), (2, None)])
    assert [(r[0], r[1]) for r in out] == [(None, 0), (2, 2), (5, 3), (5, 6)]
    one = got(spark, [(7, None), (8, "")])  # a single id has a code as well
    assert [r[2] for r in one] == [1, 1]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_piece_table_is_only_a_memory(monkeypatch):
    monkeypatch.setattr(T, "PIECES_KEPT", 40)
    e = T.PieceEncoder(PATH)
    texts = [" ".join(f"wo{i * j % 97}rd" for j in range(50)) for i in range(30)]
    for t in texts:
        assert e.encode(*flat([t, t[:20], ""])) == e.whole([t, t[:20], ""])
    assert e.known.n <= 40


def test_split_equals_the_tokenizer_on_odd_strings():
    r = random.Random(9)
    e = T.PieceEncoder(PATH)
    alphabet = ["a", "s", "t", "re", "ll", "ve", "m", "d", "'", "'", " ", " ", "  ", "\n", "\t", "\r", "1", "9", ".", "!?", "é", "ß", "Ō", "×", "÷", "S", "…", "x"]
    texts = ["".join(r.choices(alphabet, k=r.randrange(12))) for _ in range(4000)] + ["'", "'s", " 's", "''s", "'sa", "'re'll", "a'", "a'l", "\n's", "'\u00e9"]
    for lo in range(0, len(texts), 37):
        part = texts[lo : lo + 37]
        assert e.encode(*flat(part)) == e.whole(part)


def test_codes_are_a_round_trip_and_limited():
    r = np.random.default_rng(1)
    for counts in (np.array([5]), np.array([0, 3, 0, 1]), 1.6 ** np.arange(60), r.integers(0, 9, 5000), np.ones(1 << 16)):
        counts = np.asarray(counts).astype(np.int64)
        n = T.code_lengths(counts)
        assert (n[counts > 0] > 0).all() and n.max() <= 16 and (2.0 ** -n[n > 0].astype(float)).sum() <= 1
        codes, _ = T.canonical(n)
        ids = r.choice(np.flatnonzero(counts), 3001)
        marks, payload = T.pack(ids, n, codes)
        two = T.Decoder(n).run([(marks.astype(np.int64), len(ids), memoryview(payload))] * 2)
        assert all((x == ids).all() for x in two)


def test_lengths_are_optimal_when_unlimited():
    import heapq

    r = random.Random(2)
    counts = [r.randrange(1, 500) for _ in range(200)]
    h = list(counts)
    heapq.heapify(h)
    cost = 0
    while len(h) > 1:
        x = heapq.heappop(h) + heapq.heappop(h)
        cost += x
        heapq.heappush(h, x)
    n = T.code_lengths(np.array(counts))
    assert int((n.astype(int) * np.array(counts)).sum()) == cost
