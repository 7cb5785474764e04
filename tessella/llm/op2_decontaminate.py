"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The inverted index holds the test items (long ones in segments of
``SEGMENT`` tokens): per term its segments with the BM25 impact divided by
the segment's score for itself, in blocks of ``BLOCK`` postings with their
largest impact. Every training text is cut into passages of ``PASSAGE``
tokens, every ``STRIDE``, so that a segment copied whole lies in one; each
passage is a query, and all segments of a score of at least ``LEAST`` (of
1) are retrieved, without a limit on their number.

Most passages cannot reach that: a vectorised bound adds up, per passage and
segment, what the terms that few items have contribute, plus all that the
segment's other terms could; where those alone could reach ``LEAST``, as in
repeated items or a small vocabulary, it adds up all terms. Only passages in which some segment's bound
reaches ``LEAST`` run through WAND, so nothing above the threshold is
missed. An item is found in a text if, around a retrieving passage, at least
``OVERLAP`` of the word trigrams of its question and of its answer occur (of
its words, where a part has fewer than ``SHORTEST``). An item of fewer than
``SHORTEST`` tokens is found only where all of it occurs word by word.

A question ends at the first question mark; without one the last sentence
(or, in a single sentence, the last third) is the answer.

The index is broadcast in blocks of at most ``INDEX_TOKENS`` tokens of
items, each a pass of its own, so its size is bounded whatever the benchmark.
Term statistics are those of the whole benchmark (counted in Spark where it
has several blocks), so scores and finds do not depend on the blocks.

Letters of any alphabet are lower-cased on both sides.

Cases: null and empty texts are clean; items of fewer than ``GRAM``
tokens have nothing to verify and are not indexed; null item_ids are named -1; repeated items all are named;
repeated rows count as rows; a null doc_id keeps its row; extra columns are
kept by ``mark``; without items or without texts nothing is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .staging import Staged, bounded

SEGMENT, PASSAGE, STRIDE = 64, 128, 64
BLOCK = 32
K1, B = 1.2, 0.75
LEAST = 0.6
OVERLAP = 0.5
SHORTEST = 8  # tokens of an item or part that is verified by its trigrams
GRAM = 3
RARE_SHARE = 0.05  # terms of at most this share of the segments feed the bound
SURE = 1 - 1e-6  # of LEAST, for rounding
POSTINGS = 1 << 20  # of the bound, expanded at a time
INDEX_TOKENS = 2_000_000
_U = np.uint64

# separators of tokens: white space and ASCII punctuation
_GAP = K.IS_SEP.copy()
_GAP[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text) of lower-case texts."""
    starts, ends, first = K.words(buf, off, _GAP)
    return K.span_hashes(buf, starts, ends), first


def token_list(text: str) -> np.ndarray:
    raw, off = K.flat(pc.utf8_lower(pa.array([text])))
    return tokens(raw[off[0] : off[1]], off - off[0])[0]


def question_and_answer(text: str) -> tuple[str, str]:
    if (m := re.search(r"\?", text)) and text[m.end() :].strip():
        return text[: m.end()], text[m.end() :]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = max(1, len(words) * 2 // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _side(t: np.ndarray) -> tuple[int, np.ndarray]:
    """(length, distinct grams) that a question or answer is verified by."""
    k = GRAM if len(t) >= SHORTEST else 1
    return k, np.unique(K.gram_hashes(t, k))


def segments(t: np.ndarray) -> list[np.ndarray]:
    """Of an item's tokens; the last one ends with the item."""
    if len(t) < GRAM:
        return []
    return [t[lo : lo + SEGMENT] for lo in (min(s, max(0, len(t) - SEGMENT)) for s in range(0, len(t), SEGMENT))]


def _segment_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment and distinct term, and one per segment with its length."""
    for batch in batches:
        for text in batch.column(0):
            for s in segments(token_list(text.as_py())):
                own = np.unique(s)
                yield pa.RecordBatch.from_arrays([pa.array([None, *K.signed(own).tolist()], pa.int64()), pa.array([len(s)] + [1] * len(own), pa.int64())], ["term", "n"])


class Terms:
    """Of a benchmark of several blocks: number and mean length of its segments, and their numbers by term, as a table."""

    def __init__(self, benchmark: DataFrame):
        rows = benchmark.select("text").where("text is not null").mapInArrow(_segment_terms, "term long, n long")
        counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("length"))
        self.table = Staged(counts, "terms")
        every = self.table.df().where("term is null").first()
        self.n, self.mean = (every.df, every.length / every.df) if every else (0, 0.0)

    def of(self, terms: list[int]) -> dict[int, int]:
        """Numbers of segments of the terms of one block."""
        own = np.array(terms, _U)
        ask = self.table.spark.createDataFrame(pa.table({"term": pa.array(K.signed(own))}))
        got = self.table.df().join(ask, "term").select("term", "df").toPandas()
        return dict(zip(got["term"].to_numpy(np.int64).view(_U).tolist(), got["df"].tolist()))


class Index:
    """Of items (item_id, text); ``whole`` has the statistics of all blocks where these are not all items."""

    def __init__(self, items: list[tuple[int, str]], whole: Terms | None = None):
        self.item, self.parts, cut = [], [], []
        for name, text in items:
            t = token_list(text)
            mine = segments(t)
            if not mine:
                continue
            if len(t) < SHORTEST:
                sides = [(len(t), K.gram_hashes(t, len(t)))]
            else:
                sides = [_side(x) for x in map(token_list, question_and_answer(text)) if len(x)]
            self.parts.append((name, len(t), sides))
            cut += mine
            self.item += [len(self.parts) - 1] * len(mine)
        self.n = len(cut)
        here = Counter(x for s in cut for x in set(s.tolist()))
        df, n, mean = here, self.n, sum(map(len, cut)) / max(1, self.n)
        if whole:
            df, n, mean = whole.of(list(here)), whole.n, whole.mean
        found: dict[int, list] = defaultdict(list)
        met: dict[int, list] = defaultdict(list)  # the postings that feed the bound
        self.rest = np.zeros(self.n)
        for i, s in enumerate(cut):
            score = {}
            for x, tf in Counter(s.tolist()).items():
                idf = math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5))
                score[x] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
            whole = sum(score.values())
            for x, v in score.items():
                found[x].append((i, v / whole))
            fed = {x for x in score if here[x] <= self.rare()}
            rest = sum(v for x, v in score.items() if x not in fed)
            if rest >= SURE * LEAST * whole:  # its common terms alone might reach LEAST: all of its terms feed the bound
                fed, rest = set(score), 0.0
            for x in fed:
                met[x].append((i, score[x] / whole))
            self.rest[i] = rest / whole
        self.lists = {x: ([i for i, _ in p], [v for _, v in p], max(v for _, v in p), [max(v for _, v in p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)]) for x, p in found.items()}
        few = sorted(met)
        self.term = np.array(few, _U)
        self.at = np.concatenate([[0], np.cumsum([len(met[x]) for x in few])]).astype(np.int64)
        self.seg = np.array([i for x in few for i, _ in met[x]], np.int64)
        self.impact = np.array([v for x in few for _, v in met[x]])
        self.hint = np.zeros(1 << 20, bool)  # of the low bits of terms
        self.hint[(self.term & _U((1 << 20) - 1)).astype(np.int64)] = True

    def rare(self) -> int:
        return max(1, int(self.n * RARE_SHARE))

    def hopeful(self, term: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, passage) of which some segment's bound reaches LEAST."""
        pos = np.flatnonzero(self.hint[(term & _U((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.term, term[pos]), len(self.term) - 1)
        hit = self.term[k] == term[pos]
        pos, k = pos[hit], k[hit]
        text = np.searchsorted(first, pos, side="right") - 1
        last = (pos - first[text]) // STRIDE  # the last passage it is in; the one before has it too
        text, k, passage = (np.concatenate(x) for x in ((text, text), (k, k), (last, last - 1)))
        ok = passage >= 0
        text, k, passage = text[ok], k[ok], passage[ok]
        by = np.lexsort((k, passage, text))
        text, k, passage = text[by], k[by], passage[by]
        if not len(by):
            return []
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (passage[1:] != passage[:-1]) | (k[1:] != k[:-1])
        text, k, passage = text[new], k[new], passage[new]
        new = np.ones(len(k), bool)
        new[1:] = (text[1:] != text[:-1]) | (passage[1:] != passage[:-1])
        starts = np.flatnonzero(new)  # of passages
        size = np.concatenate([[0], np.cumsum(self.at[k + 1] - self.at[k])])
        out, lo = [], 0
        while lo < len(starts):  # whole passages, of about POSTINGS postings together
            hi = max(lo + 1, int(np.searchsorted(size[starts], size[starts[lo]] + POSTINGS, side="right")) - 1)
            hi = len(starts) if size[-1] <= size[starts[lo]] + POSTINGS else hi
            cut = slice(starts[lo], starts[hi] if hi < len(starts) else len(k))
            out += self._bound(text[cut], k[cut], passage[cut])
            lo = hi
        return out

    def _bound(self, text: np.ndarray, k: np.ndarray, passage: np.ndarray) -> list[tuple[int, int]]:
        where, owner = K.runs(self.at[k], self.at[k + 1])
        text, passage, seg, v = text[owner], passage[owner], self.seg[where], self.impact[where]
        by = np.lexsort((seg, passage, text))
        text, passage, seg, v = text[by], passage[by], seg[by], v[by]
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (passage[1:] != passage[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        good = at[np.add.reduceat(v, at) + self.rest[seg[at]] >= LEAST - 1e-9]
        return sorted(set(zip(text[good].tolist(), passage[good].tolist())))

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """All segments with a score of at least LEAST, by block-max WAND."""
        lists = [[*self.lists[x], 0] for x in terms if x in self.lists]  # ids, impacts, most, block maxima, cursor
        out = []
        while True:
            lists = [x for x in lists if x[4] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[4]])
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                total += x[2]
                if total >= LEAST - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = lists[pivot][0][lists[pivot][4]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == doc:
                pivot += 1
            block, until = 0.0, self.n
            for x in lists[: pivot + 1]:
                c = _seek(x[0], x[4], doc)
                if c == len(x[0]):
                    continue
                b = c // BLOCK
                block += x[3][b]
                until = min(until, x[0][min(len(x[0]), (b + 1) * BLOCK) - 1] + 1)
            if block < LEAST - 1e-9:  # no segment before the first of these blocks ends can reach it
                if pivot + 1 < len(lists):
                    until = min(until, lists[pivot + 1][0][lists[pivot + 1][4]])
                until = max(until, doc + 1)
            elif lists[0][0][lists[0][4]] == doc:
                score = sum(x[1][x[4]] for x in lists[: pivot + 1])
                if score >= LEAST - 1e-9:
                    out.append((doc, score))
                until = doc + 1
            else:
                until = doc
            for x in lists[: pivot + 1]:
                x[4] = _seek(x[0], x[4], until)

    def found(self, term: np.ndarray, lo: int, hi: int, passages: list[int]) -> tuple[list[int], float]:
        """Items verified in the text of tokens lo..hi, and the best score."""
        good, tried, best = set(), set(), 0.0
        for p in passages:
            start = lo + p * STRIDE
            for seg, score in self.wand(set(term[start : min(hi, start + PASSAGE)].tolist())):
                i = self.item[seg]
                best = max(best, score)
                if (i, p) in tried or i in good:
                    continue
                tried.add((i, p))
                _, n, sides = self.parts[i]
                around = term[max(lo, start - n) : min(hi, start + PASSAGE + n)]
                if all(np.isin(g, K.gram_hashes(around, k)).mean() >= OVERLAP for k, g in sides):
                    good.add(i)
        return sorted(self.parts[i][0] for i in good), best


def _seek(ids: list[int], at: int, doc: int) -> int:
    from bisect import bisect_left

    return bisect_left(ids, doc, at)


def _mark(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for lo, hi, buf, off in K.slices(pc.utf8_lower(batch.column(1))):
                term, first = tokens(buf, off)
                want = defaultdict(list)
                if ix.n:
                    for t, p in ix.hopeful(term, first):
                        want[t].append(p)
                items, best = [[] for _ in range(hi - lo)], np.zeros(hi - lo)
                for t, p in want.items():
                    items[t], best[t] = ix.found(term, int(first[t]), int(first[t + 1]), p)
                n = np.diff(first)
                passages = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(passages.astype(np.int64)), pa.array(best), pa.array(items, pa.list_(pa.int64()))], ["row", "n_passages", "best_score", "items"])

    return run


def index_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of at most INDEX_TOKENS tokens of items each (or one longer item), streamed from the table; one, empty, without items."""
    block, size, whole = [], 0, None
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("i"), "text").where("text is not null").orderBy("i", "text")
    for r in rows.toLocalIterator():
        n = len(token_list(r.text))
        if block and size + n > INDEX_TOKENS:
            whole = whole or Terms(benchmark)
            yield Index(block, whole)
            block, size = [], 0
        block.append((r.i, r.text))
        size += n
    yield Index(block, whole)
    if whole:
        whole.table.drop()


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with n_passages, best_score, items (item_ids found) and contaminated added."""
    spark = bounded(docs.sparkSession)
    names = keep or docs.columns
    blocks = index_blocks(benchmark)
    ix, ahead = next(blocks), next(blocks, None)
    carried = names if ahead is None else list(dict.fromkeys([*names, "text"]))
    out = docs.select(F.struct(*(docs[c] for c in carried)).alias("row"), docs["text"].alias("t"))
    schema = f"row {out.schema['row'].dataType.simpleString()}, n_passages long, best_score double, items array<long>"
    index, before = spark.sparkContext.broadcast(ix), None
    out = out.mapInArrow(_mark(index), schema)
    while ahead is not None:  # one pass and one index at a time, over rows that carry what was found
        done = Staged(out, "found")
        index.destroy()
        if before:
            before.drop()
        before, ix, ahead = done, ahead, next(blocks, None)
        index = spark.sparkContext.broadcast(ix)
        rows = done.df().select(F.struct("row", "best_score", "items").alias("row"), F.col("row.text").alias("t"))
        rows = rows.mapInArrow(_mark(index), f"row {rows.schema['row'].dataType.simpleString()}, n_passages long, best_score double, items array<long>")
        out = rows.select(F.col("row.row").alias("row"), "n_passages", F.greatest("best_score", "row.best_score").alias("best_score"), F.array_sort(F.concat("items", "row.items")).alias("items"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "n_passages", "best_score", "items", (F.size("items") > 0).alias("contaminated"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return mark(docs, items, ["doc_id"]).withColumn("best_score", F.round("best_score", 6))


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE: dict[str, str] = {}  # ranked retrieval; tests/llm/test_op2.py has the exhaustive version
