"""Quality rules on repetition: how much of a text lies inside n-grams and
lines that it holds more than once.

Whole texts are cut into words; each word has a 64-bit hash, and the hash of
the n-gram at a word is rolled from the (n-1)-gram's there: ``h * BASE + next
word``.  All documents of a chunk are worked on at once in numpy: n-gram keys
take in the document's number, one sort per length finds the keys that occur
twice, and a running sum over marked starts gives the words (and through them
the characters) inside such n-grams, each counted once.  Only places whose
(n-1)-gram is repeated are looked at for n.

``Rules`` holds the limits: the share of the text's word characters that may
lie inside n-grams found twice or more (first included), one limit per length;
the share of lines that repeat an earlier line, and of characters in them.
The base rules come first: fewer than ten words, or over 20 % of the words in
repeated 5-grams.

One pass over the documents without a shuffle; memory is bounded by a chunk
of whole texts (one text where it is longer than a chunk).  Hashes have 64
bits: two different n-grams of one text meet with probability under 1e-9 even
in a text of 100,000 words.

Edge cases: null text has no words (all counts 0, base_failed); an empty text
likewise; text without a word character but with symbols counts the symbols;
a text shorter than n words has no n-gram of length n; a line without a word
is never a repeated line; lines are compared byte by byte, with any trailing
carriage return; repeated rows are judged alike; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import batch, utf8

SYMBOLS = b"#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 4 << 20           # texts worked on together; only memory depends on it
CACHED_WORDS = 500_000          # words a task keeps the hash of; only speed depends on it


@dataclass(frozen=True)
class Rules:
    """``ngrams``: (length, most percent of word characters inside n-grams of
    that length found twice or more), ascending, the first being the base
    rule's; ``lines``, ``line_chars``: most percent of lines that repeat an
    earlier one, and of word characters in them; ``least_words`` and
    ``base_percent``: the base rules."""

    ngrams: tuple[tuple[int, int], ...] = ((5, 20), (6, 19), (7, 18), (8, 17), (9, 16), (10, 15))
    lines: int = 30
    line_chars: int = 20
    least_words: int = 10
    base_percent: int = 20


class _Cached(dict):
    """What a function says of a word."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        v = self[word] = self.of(word)
        return v


class _Words:
    def __init__(self):
        self.hash = _Cached(xxhash.xxh3_64_intdigest).__getitem__
        self.chars = _Cached(lambda word: len(word.decode("utf-8", "replace"))).__getitem__


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    out = np.empty(len(s), bool)
    out[order] = twin
    return out


def inside(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which of ``words`` words lie inside a window of ``n`` that starts at
    one of ``starts``."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def coverage(hashes: np.ndarray, owner: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length (ascending) the words inside repeated n-grams, as
    flags over all words of all documents; ``owner`` is each word's
    document."""
    at, rolled, size = np.arange(len(hashes)), hashes.copy(), 1
    salt = _scrambled(owner.astype(np.uint64) + np.uint64(1))
    for n in lengths:
        while size < n:                                         # roll every open place by one word
            on = at + size < len(hashes)
            on[on] = owner[at[on] + size] == owner[at[on]]
            at, rolled = at[on], rolled[on]
            rolled = rolled * BASE + hashes[at + size]
            size += 1
        twice = repeated(_scrambled(rolled) ^ salt[at]) if len(at) else np.zeros(0, bool)
        at, rolled = at[twice], rolled[twice]
        yield n, inside(at, n, len(hashes))


def repeated_lines(text: bytes, words: _Words) -> tuple[int, int, int]:
    """(lines with a word, those equal to an earlier line, word characters in
    the latter)."""
    seen: dict[bytes, int] = {}
    lines = again = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
            again += 1
            if seen[line] < 0:
                seen[line] = sum(map(words.chars, line.split()))
            chars += seen[line]
        elif line.strip():
            lines += 1
            seen[line] = -1
    return lines, again, chars


def measure(texts: list[bytes], rules: Rules, cache: _Words) -> dict[str, np.ndarray]:
    """One entry per text in every column."""
    split = [t.split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    total = int(n.sum())
    hashes = np.fromiter(map(cache.hash, chain.from_iterable(split)), np.uint64, total)
    chars = np.fromiter(map(cache.chars, chain.from_iterable(split)), np.int64, total)
    per = lambda flags, weights=chars: np.bincount(owner[flags], weights[flags], len(texts)).astype(np.int64)
    every, ones = np.ones(total, bool), np.ones(total, np.int64)
    out = {"n_words": n, "word_chars": per(every)}
    out["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = np.array([repeated_lines(t, cache) for t in texts], np.int64).reshape(-1, 3)
    out |= {"n_lines": lines[:, 0], "n_dup_lines": lines[:, 1], "dup_line_chars": lines[:, 2]}
    failed = (100 * out["n_dup_lines"] > rules.lines * out["n_lines"]) | (100 * out["dup_line_chars"] > rules.line_chars * out["word_chars"])
    for (length, most), (_, flags) in zip(rules.ngrams, coverage(hashes, owner, [g for g, _ in rules.ngrams]), strict=True):
        if length == rules.ngrams[0][0]:
            out["n_repeat_words"] = per(flags, ones)
        out[f"dup_chars_{length}"] = per(flags)
        failed |= 100 * out[f"dup_chars_{length}"] > most * out["word_chars"]
    out["base_failed"] = (n < rules.least_words) | (100 * out["n_repeat_words"] > rules.base_percent * n)
    out["kept"] = ~out["base_failed"] & ~failed
    return out


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> per row: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then n_lines,
    dup_line_chars and dup_chars_<n> per length."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    flags = ["base_failed", "kept"]
    more = ["n_lines", "dup_line_chars", *(f"dup_chars_{g}" for g, _ in rules.ngrams)]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in counts), *((c, pa.bool_()) for c in flags), *((c, pa.int64()) for c in more)])

    def chunks(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        start, held, size = 0, [], 0
        for i, t in enumerate(b.column("text")):
            t = t.as_py() or b""
            if held and size + len(t) > CHUNK_BYTES:
                yield start, held
                start, held, size = i, [], 0
            held.append(t)
            size += len(t)
        if held:
            yield start, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            for start, texts in chunks(b):
                m = measure(texts, rules, cache)
                yield batch(schema, [b.column("doc_id").slice(start, len(texts)), *(m[c] for c in counts + flags + more)])

    ddl = ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in schema)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").select("doc_id", utf8("text").alias("text")).mapInArrow(run, ddl)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
), g AS (
  SELECT r, i, length(word) AS chars, n, i + n - 1 <= len(ws) AND count(*) OVER (PARTITION BY r, n, ws[i:i + n - 1]) > 1 AS twice
  FROM w, (SELECT unnest(range(5, 11)) AS n)
), c AS (
  SELECT r, n, chars, coalesce(max(CASE WHEN twice THEN i END) OVER (PARTITION BY r, n ORDER BY i ROWS UNBOUNDED PRECEDING) > i - n, false) AS covered FROM g
), v AS (
  SELECT r, CAST(count(*) FILTER (n = 5 AND covered) AS BIGINT) AS n_repeat_words, CAST(sum(chars) FILTER (n = 5) AS BIGINT) AS word_chars,
         coalesce(CAST(sum(chars) FILTER (n = 5 AND covered) AS BIGINT), 0) AS dup_chars_5, coalesce(CAST(sum(chars) FILTER (n = 6 AND covered) AS BIGINT), 0) AS dup_chars_6,
         coalesce(CAST(sum(chars) FILTER (n = 7 AND covered) AS BIGINT), 0) AS dup_chars_7, coalesce(CAST(sum(chars) FILTER (n = 8 AND covered) AS BIGINT), 0) AS dup_chars_8,
         coalesce(CAST(sum(chars) FILTER (n = 9 AND covered) AS BIGINT), 0) AS dup_chars_9, coalesce(CAST(sum(chars) FILTER (n = 10 AND covered) AS BIGINT), 0) AS dup_chars_10
  FROM c GROUP BY r
), l AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS again,
         list_sum(list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x))) AS chars
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), k AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (again), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY r
), x AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars,
         coalesce(dup_chars_5, 0) AS dup_chars_5, coalesce(dup_chars_6, 0) AS dup_chars_6, coalesce(dup_chars_7, 0) AS dup_chars_7,
         coalesce(dup_chars_8, 0) AS dup_chars_8, coalesce(dup_chars_9, 0) AS dup_chars_9, coalesce(dup_chars_10, 0) AS dup_chars_10
  FROM d LEFT JOIN v USING (r) LEFT JOIN k USING (r)
), y AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
)
SELECT *, NOT base_failed AND 100 * n_dup_lines <= 30 * n_lines AND 100 * dup_line_chars <= 20 * word_chars
       AND 100 * dup_chars_5 <= 20 * word_chars AND 100 * dup_chars_6 <= 19 * word_chars AND 100 * dup_chars_7 <= 18 * word_chars
       AND 100 * dup_chars_8 <= 17 * word_chars AND 100 * dup_chars_9 <= 16 * word_chars AND 100 * dup_chars_10 <= 15 * word_chars AS kept
FROM y
"""
