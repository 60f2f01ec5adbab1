"""Benchmark decontamination: BM25 with block-max WAND, then overlap checks.

Test items are cut into parts of at most ``part`` words; the parts are the
documents of a BM25 index whose weights are divided by the part's own score,
so a passage that holds all words of a part scores 1.  Every training text is
cut into overlapping passages of twice that size, so a copied part always lies
whole in one of them, and every passage is a query:

* the parts are held in at most 64 runs; a run is skipped when the largest
  weights of the passage's words in it cannot reach the threshold (summed for
  many passages at once);
* the other runs are searched by block-max WAND (pivot on list maxima, then on
  the maxima of the blocks at the pivot), which retrieves *every* part at or
  above the threshold, not a top k;
* around each retrieved part, the whole item is checked, or its question and
  its answer where it has both: the share of their word shingles that the
  neighbourhood of the passage holds must reach ``overlap`` (for both).  One
  changed word takes five shingles, so for a text of few words the share of
  its words that the best stretch holds in order counts, too.

The index is read in shards of at most ``shard_bytes`` of item text; each
shard goes to the tasks with one pass over the texts.  Document frequencies
and lengths are of the whole benchmark, so shards change nothing but memory.

An item's answer is what follows the last ``answer:`` or else the last ``?``;
an item without these marks, or with nothing on one side of them, is checked
as a whole.

Edge cases: null or empty texts and items match nothing; items of fewer than
``least_words`` words must be held word for word, without a gap; one word alone
is no evidence and not indexed; in scripts without spaces letters are words; a null
id on either side is kept; repeated rows or items give repeated result rows;
an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, written
from tidemark.session import scratch_scope

#: Scripts without spaces between words (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han): every letter is a word.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W_{UNSPACED}]+|[^\W_]")
ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)


@dataclass(frozen=True)
class Params:
    part: int = 32
    threshold: float = 0.6
    overlap: float = 0.8
    shingle: int = 5
    least_words: int = 8
    least_exact: int = 2
    block: int = 16
    k1: float = 1.2
    b: float = 0.75
    shard_bytes: int = 8 << 20


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is empty where an item does not have both."""
    at = [m.end() for m in ANSWER.finditer(text)]
    for cut in (at[-1] if at else 0, text.rfind("?") + 1):
        question, answer = words_of(text[:cut]), words_of(text[cut:])
        if question and answer:
            return question, answer
    return words_of(text), []


# -- the index --------------------------------------------------------------

class Postings:
    """Posting lists of (part number, weight) per term, in blocks."""

    def __init__(self, parts: list[tuple[int, dict[int, float]]], block: int):
        """``parts``: (part number, term number -> weight), ascending."""
        self.block, self.ids, self.weights = block, {}, {}
        for n, weights in parts:
            for term, w in weights.items():
                self.ids.setdefault(term, []).append(n)
                self.weights.setdefault(term, []).append(w)
        self.most = {t: max(ws) for t, ws in self.weights.items()}
        self.block_most = {t: [max(ws[i:i + block]) for i in range(0, len(ws), block)] for t, ws in self.weights.items()}

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every (part, score) with score >= threshold, by block-max WAND."""
        ids, weights, most, block_most, size = self.ids, self.weights, self.most, self.block_most, self.block
        floor = threshold - 1e-9
        cursors = [[ids[t][0], 0, t] for t in terms if t in ids]           # current part, position, term
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += most[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            # block maxima at the pivot, and the end of the shallowest block
            bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
            for _, pos, t in cursors[:pivot + 1]:
                pos = bisect_left(ids[t], at, pos)
                if pos < len(ids[t]):
                    bound += block_most[t][pos // size]
                    end = (pos // size + 1) * size
                    beyond = min(beyond, ids[t][end - 1] + 1 if end <= len(ids[t]) else math.inf)
            if bound >= floor:
                score, beyond = 0.0, at + 1
                for _, pos, t in cursors[:pivot + 1]:
                    pos = bisect_left(ids[t], at, pos)
                    if pos < len(ids[t]) and ids[t][pos] == at:
                        score += weights[t][pos]
                if score >= floor:
                    out.append((at, score))
            live = cursors[pivot + 1:]
            for _, pos, t in cursors[:pivot + 1]:
                pos = bisect_left(ids[t], beyond, pos)
                if pos < len(ids[t]):
                    live.append([ids[t][pos], pos, t])
            cursors = live
        return out


class Index:
    """All parts: at most ``GROUPS`` runs of parts with their own postings, and
    for every term its largest weight in each run.  The last row of ``most`` is
    for words that are not indexed."""

    GROUPS = 64

    def __init__(self, parts: list[tuple[int, dict[str, float]]], block: int):
        """``parts``: (item, term -> weight, summing to 1)."""
        self.items = [item for item, _ in parts]
        self.terms = {term: k for k, term in enumerate(sorted({t for _, weights in parts for t in weights}))}
        size = -(-len(parts) // self.GROUPS)
        numbered = [(n, {self.terms[t]: w for t, w in weights.items()}) for n, (_, weights) in enumerate(parts)]
        self.groups = [Postings(numbered[i:i + size], block) for i in range(0, len(parts), size)]
        self.most = np.zeros((len(self.terms) + 1, len(self.groups)), np.float32)
        for g, postings in enumerate(self.groups):
            for t, w in postings.most.items():
                self.most[t, g] = w


def entries(benchmark: DataFrame, p: Params) -> DataFrame:
    """(item, item_id, text, part, terms[(term, weight)]): the parts of the
    items with normalised BM25 weights; statistics are of all items."""
    item = benchmark.where("text is not null").select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text"))
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("text", pa.string()), ("part", pa.int32()), ("size", pa.int32()),
                        ("tf", pa.map_(pa.string(), pa.int32()))])

    def cut(batches):
        for b in batches:
            out = []
            for h, i, text in zip(*(b.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                w = words_of(text)
                if len(w) >= p.least_exact:
                    n = -(-len(w) // p.part)                               # even parts
                    for k in range(n):
                        piece = w[k * len(w) // n:(k + 1) * len(w) // n]
                        out.append((h, i, text, k, len(piece), list(Counter(piece).items())))
            yield batch(schema, [[r[c] for r in out] for c in range(6)])

    parts = written(item.select("item", F.col("item_id").cast("long").alias("item_id"), "text")
                        .mapInArrow(cut, "item long, item_id long, text string, part int, size int, tf map<string,int>"), "decontaminate-parts")
    n, mean = parts.agg(F.count("*"), F.avg("size")).first()
    if not n:
        return parts.select("item", "item_id", "text", "part", F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("weight"))).alias("terms"))
    terms = parts.select("item", "part", "size", F.explode("tf").alias("term", "tf"))
    df = terms.groupBy("term").agg(F.countDistinct("item", "part").alias("df"))
    weight = (F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (p.k1 + 1)
              / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("size") / mean)))
    weighed = terms.distinct().join(df, "term").withColumn("weight", weight)
    lists = weighed.groupBy("item", "part").agg(F.collect_list(F.struct("term", "weight")).alias("terms"), F.sum("weight").alias("own"))
    return parts.join(lists, ["item", "part"]).select(
        "item", "item_id", "text", "part", F.transform("terms", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.col("own")).alias("weight"))).alias("terms"))


# -- queries ----------------------------------------------------------------

def _shingles(w: list[str], k: int) -> set[tuple]:
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def in_order(part: list[str], words: list[str]) -> float:
    """Share of ``part`` that the best stretch of ``words`` holds: 1 less its
    word edits (changed, left out or put in) a word."""
    known, start = set(part), list(range(len(part) + 1))
    row, best, far = start, len(part), 0
    for w in words:
        if w not in known:
            far += 1
            if far > len(part):                                  # nothing reaches over so many other words
                row = start
                continue
        else:
            far = 0
        new, left = [0], 0
        for j, x in enumerate(part):
            left = min(row[j] + (x != w), row[j + 1] + 1, left + 1)
            new.append(left)
        row = new
        best = min(best, left)
    return 1 - best / len(part)


def contained(part: list[str], words: list[str], k: int, overlap: float = 0.8) -> float:
    """Share of the shingles of ``part`` that ``words`` holds; of a part so
    short that one changed word would bring it under ``overlap``, the share of
    its words in order if that is more and can spare a word."""
    own = _shingles(part, k)
    if not own:
        return 1.0
    least = min(k, len(part))
    share = len(own & _shingles(words, least) if len(words) >= least else set()) / len(own)
    n = len(part)
    spare = 1 - 1 / n >= overlap - 1e-9
    if share < overlap and spare and n - least + 1 - k < overlap * (n - least + 1):
        share = max(share, in_order(part, words))
    return share


#: Passages whose bounds are summed in one piece; only speed depends on it.
PASSAGES = 256


def candidates(words: list[str], index: Index, p: Params):
    """(start, end, part, score) of every passage and part at or above the
    threshold.  The largest weights of a passage's distinct words, summed per
    run of parts, rule out most runs; WAND searches the others."""
    get, unknown, size = index.terms.get, len(index.terms), 2 * p.part
    starts = np.arange(0, max(1, len(words) - p.part), p.part)
    ids = np.full(int(starts[-1]) + size, unknown, np.int64)
    ids[:len(words)] = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
    passages = np.lib.stride_tricks.sliding_window_view(ids, size)[starts]
    for k in range(0, len(starts), PASSAGES):
        terms = np.sort(passages[k:k + PASSAGES], axis=1)
        terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = unknown
        bounds = index.most[terms].sum(axis=1)
        for n, g in zip(*(x.tolist() for x in np.nonzero(bounds >= p.threshold - 1e-4)), strict=True):
            s = int(starts[k + n])
            own = terms[n]
            for part, score in index.groups[g].retrieve(own[own < unknown].tolist(), p.threshold):
                yield s, min(s + size, len(words)), part, score


def matches(words: list[str], index: Index, checks: dict, p: Params) -> dict[int, tuple]:
    """Item -> (score, question overlap, answer overlap, first word, last
    word) of the items found in a text."""
    best: dict[int, tuple] = {}
    for s, e, part, score in candidates(words, index, p) if words else ():
        item = index.items[part]
        if item in best:
            best[item] = (max(best[item][0], score), *best[item][1:])
            continue
        _, question, answer = checks[item]
        first, last = max(0, s - len(question) - len(answer)), min(len(words), e + len(question) + len(answer))
        near = words[first:last]
        if len(question) + len(answer) < p.least_words:
            q, a = float(tuple(question + answer) in _shingles(near, len(question) + len(answer))), 1.0
        else:
            q, a = (contained(x, near, p.shingle, p.overlap) for x in (question, answer))
        if q >= p.overlap - 1e-9 and a >= p.overlap - 1e-9:
            best[item] = (score, q, a, first, last)
    return best


def held_index(shard: dict, p: Params) -> Index:
    """A worker keeps a broadcast value from task to task, and in it the index
    it has built."""
    if "index" not in shard:
        shard["index"] = Index(shard.pop("parts"), p.block)
    return shard["index"]


def shards(benchmark: DataFrame, p: Params) -> list:
    """Per shard of the index, broadcast: the weighed parts, and per item its
    id, question and answer.  A shard holds about ``shard_bytes`` of text."""
    spark, out = benchmark.sparkSession, []
    with scratch_scope(spark):
        parts = written(entries(benchmark, p), "decontaminate-index")
        size = parts.where("part = 0").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = size // p.shard_bytes + 1
        for k in range(n if size else 0):
            rows = parts.where(F.pmod("item", F.lit(n)) == k).orderBy("item", "item_id", "part").collect()
            if rows:
                checks = {}
                for r in rows:
                    checks.setdefault(r["item"], (r["item_id"], *question_and_answer(r["text"])))
                out.append(spark.sparkContext.broadcast({"checks": checks, "parts": [
                    (r["item"], {t["term"]: t["weight"] for t in r["terms"]}) for r in rows]}))
    return out


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, last_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text)`` -> one row per
    document and item found in it: the best BM25 score, both overlaps, and the
    words of the text between which it was found (first place)."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for shard in shards(benchmark, p):
        def run(batches, shard=shard):
            index, checks = held_index(shard.value, p), shard.value["checks"]
            for b in batches:
                found = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    got = matches(words_of(text.as_py()), index, checks, p)
                    found += [(doc_id, checks[item][0], *v) for item, v in sorted(got.items())]
                yield batch(schema, [[r[c] for r in found] for c in range(7)])

        got = texts.mapInArrow(run, FOUND)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are: one
    pass per shard, no join."""
    rows = docs.select(F.struct("*").alias("row"))
    for shard in shards(benchmark, p):
        def run(batches, shard=shard):
            index, checks = held_index(shard.value, p), shard.value["checks"]
            for b in batches:
                clean = [not matches(words_of(t.as_py()), index, checks, p) for t in b.column("row").field("text")]
                yield b.filter(pa.array(clean, pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
