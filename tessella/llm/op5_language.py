"""Language ID: family first, then one-versus-one SVMs inside the family.

A text is the square roots of the shares of its hashed byte trigrams and
bigrams (A-Z lower-cased), over all of it. Linear support vector machines
(squared hinge, dual coordinate descent) are trained one against one, on
families first and then on the languages of each family; votes decide, ties
by the sum of margins. Training rows: at most ``TRAIN_ROWS`` labelled rows
in all (in expectation), drawn evenly per language by a hash of doc_id and
text, repeated ones once, never a held-out one (crc32 of the id's text divisible by 5). Statistics beyond that bounded
sample are not needed.

The score is the chance that the narrowest family decision and the narrowest
language decision of the winner both hold (a logistic of the margins).

Cases: null text and texts without a letter are ``und`` with score 0; with
no labelled row, so is everything; one language or family needs no machine;
repeated rows count as rows; a null doc_id is not held out; null lang never
trains; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .staging import bounded

UND = "und"
TRIGRAMS, BIGRAMS = 2048, 512
WIDTH = TRIGRAMS + BIGRAMS
TRAIN_ROWS = 4000
COST = 10.0
EPOCHS = 60
SLICE = 1 << 19

# Families of ISO 639-1 codes; any other language is a family by itself.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"={lang}")


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) float32 of unit length, a last column of 1 added."""
    low = K.LOWER[buf].astype(np.uint32)
    d = len(off) - 1
    out = np.ones((d, WIDTH + 1), np.float32)
    for k, lo, n in ((3, 0, TRIGRAMS), (2, TRIGRAMS, BIGRAMS)):
        code = np.zeros(max(0, len(low) - k + 1), np.uint32)
        for i in range(k):
            code = code * np.uint32(257) + low[i : i + len(code)]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - n.bit_length() + 1)
        idx, text = K.runs(off[:-1], np.maximum(off[1:] - k + 1, off[:-1]))
        c = np.bincount(text * n + code[idx], minlength=d * n).reshape(d, n).astype(np.float32)
        out[:, lo : lo + n] = np.sqrt(c / (2 * np.maximum(c.sum(axis=1, keepdims=True), 1)))
    return out


_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    plain = np.diff(np.concatenate([[0], np.cumsum(_ASCII[buf])])[off]) > 0
    for i in np.flatnonzero(~plain & (np.diff(off) > 0)).tolist():
        plain[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return plain


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the machine that tells y = 1 from y = -1."""
    x, y = np.asarray(x, np.float32), y.astype(np.float64)
    gram = x @ x.T
    own = np.diag(gram).astype(np.float64)
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    diag = 1 / (2 * COST)
    order = np.random.default_rng(7).permutation(len(y))
    for _ in range(EPOCHS):
        worst = 0.0
        for i in order.tolist():
            g = y[i] * f[i] - 1 + diag * alpha[i]
            new = max(0.0, alpha[i] - g / (own[i] + diag))
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                f += (new - alpha[i]) * y[i] * gram[:, i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return x.T @ (alpha * y).astype(np.float32)


class Duel:
    """One against one over names; ``weights`` (WIDTH + 1, pairs)."""

    def __init__(self, x: np.ndarray, names: np.ndarray, among: np.ndarray | None = None):
        self.names = sorted(set(names.tolist() if among is None else names[among].tolist()))
        self.pairs = list(combinations(range(len(self.names)), 2))
        made = []
        for a, b in self.pairs:
            rows = np.flatnonzero((names == self.names[a]) | (names == self.names[b]))
            made.append(svm(x if len(rows) == len(x) else x[rows], np.where(names[rows] == self.names[a], 1, -1)))
        self.weights = np.stack(made, axis=1) if made else np.zeros((x.shape[1], 0), np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its narrowest margin) of each row."""
        m = x @ self.weights
        votes, total = (np.zeros((len(x), len(self.names))) for _ in range(2))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += m[:, k] >= 0
            votes[:, b] += m[:, k] < 0
            total[:, a] += m[:, k]
            total[:, b] -= m[:, k]
        win = np.argmax(votes + 1e-3 * np.tanh(total), axis=1)
        low = np.full(len(x), 9.0)
        for k, (a, b) in enumerate(self.pairs):
            side = np.where(win == a, m[:, k], np.where(win == b, -m[:, k], 9.0))
            low = np.minimum(low, side)
        return win, low


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs, object)
        fam = np.array([family(v) for v in langs], object)
        self.families = Duel(x, fam)
        self.inside = [Duel(x, lang, fam == f) for f in self.families.names]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        out, score = [UND] * len(x), np.zeros(len(x))
        win, margin = self.families.decide(x)
        for f, duel in enumerate(self.inside):
            rows = np.flatnonzero(win == f)
            if len(rows):
                best, low = duel.decide(x[rows])
                score[rows] = 1 / (1 + np.exp(-3 * margin[rows])) / (1 + np.exp(-3 * low))
                for r, b in zip(rows.tolist(), best.tolist()):
                    out[r] = duel.names[b]
        return out, score


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, off in K.slices(batch.column(2), SLICE):
            x = features(buf, off)
            good = np.flatnonzero(has_letter(buf, off))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(good)), batch.column(1).slice(lo, hi - lo).take(pa.array(good)), pa.array([x[i].astype(np.float16).tobytes() for i in good.tolist()], pa.binary())], ["doc_id", "lang", "x"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for lo, hi, buf, off in K.slices(batch.column(1), SLICE):
                letters = has_letter(buf, off)
                lang, score = m.predict(features(buf, off)) if m else ([UND] * (hi - lo), np.zeros(hi - lo))
                lang = [v if k else UND for v, k in zip(lang, letters.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], ["row", "lang_pred", "score"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """Of docs (doc_id, text, lang), from a bounded, hashed sample of labelled rows that are not held out."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    count = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("text").alias("n")).collect() if r.n}  # one row per language
    if not count:
        return None
    each = max(10, TRAIN_ROWS // len(count))
    draw = F.pmod(F.xxhash64(F.lit(99), "doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for v, n in sorted(count.items()):
        chosen = chosen | ((F.col("lang") == v) & (draw < int(min(1.0, each / n) * (1 << 30)) + 1))
    got = rows.where(chosen & F.col("text").isNotNull()).mapInArrow(_sample, "doc_id long, lang string, x binary").distinct().collect()  # repeated rows are drawn together and train once
    got.sort(key=lambda r: (r.lang, r.doc_id is None, r.doc_id or 0, bytes(r.x)))
    if not got:
        return None
    langs, x = [r.lang for r in got], np.empty((len(got), WIDTH + 1), np.float32)
    for i in range(len(got)):
        x[i], got[i] = np.frombuffer(got[i].x, np.float16), None
    return Model(x, langs)


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score added; predictions see the text alone."""
    spark = bounded(docs.sparkSession)
    names = docs.columns
    kind = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs["text"].alias("t"))
    schema = f"row {kind.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    out = kind.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema)
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    rows = docs.select("doc_id", "text").mapInArrow(_predict(spark.sparkContext.broadcast(model)), "row long, lang_pred string, score double")
    return rows.select(F.col("row").alias("doc_id"), held_out(F.col("row")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLE: dict[str, str] = {}  # a trained model; tests/llm/test_op5.py measures held-out accuracy
