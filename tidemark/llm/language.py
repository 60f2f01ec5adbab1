"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of sample text.  A
text is compressed once per dictionary; the language whose dictionary gives
the fewest bytes wins, and is rejected when the runner-up is too close.

Texts are first reduced to what tells languages apart: lower-cased letters,
words separated by one space.  The whole text is encoded, in pieces of
``piece`` bytes, so that a long text is judged by its dictionary and not by
its own repetitions, and memory stays bounded.

Learning reads a bounded, documented sample of labelled rows: rows are thinned
by a hash to about ``sample_rows`` per language (the counts of all labelled
rows give the rate), cut into pieces, and the first ``dictionary_bytes`` of
distinct pieces in hash order make the dictionary.  The dictionaries, a few
hundred KB in all, go to the tasks with the function.

Edge cases: null text or a text without a letter is ``und`` with score 0;
equal sizes go to the language learned
from more rows (then in code-point order); without any
labelled row every text is ``und``; a null language is not learned; repeated
rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batch, remainder

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """``margin``: least lead over the runner-up, as a part of the winner's
    size, below which the answer is rejected."""

    sample_rows: int = 2000
    dictionary_bytes: int = 96 * 1024
    piece: int = 4096
    margin: float = 0.01


#: Greedy matching down to 3 bytes: short texts match their dictionary too.
MATCHING = dict(window_log=19, chain_log=17, hash_log=17, search_log=4, min_match=3, target_length=32,
                strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False)


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters and marks, one space between them; marks
    without a letter are no word."""
    return " ".join(regex.findall(r"\p{M}*+\p{L}[\p{L}\p{M}]*+", text.lower())).encode() if text else b""


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    for i in range(0, len(data), size):
        yield data[i:i + size]


def learn(labelled: DataFrame, p: Params = Params()) -> dict[str, bytes]:
    """``labelled(lang, text)`` -> raw dictionary content per language, the
    language with most labelled rows first."""
    rows = labelled.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("text", F.lit(1)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # one rate per language, as a map literal: the labels learned are few
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, p.sample_rows / n))))[F.col("lang")]
    thin = rows.where(F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20))

    schema, size = pa.schema([("lang", pa.string()), ("piece", pa.binary())]), p.piece

    def cut(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = list(pieces(letters(text), size))
                yield batch(schema, [[lang] * len(got), got])

    found = thin.select("lang", "text").mapInArrow(cut, "lang string, piece binary").dropDuplicates(["lang", "piece"])
    in_order = Window.partitionBy("lang").orderBy(F.xxhash64("piece", F.lit(2)), "piece")
    picked = (found.withColumn("upto", F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
                   .where(F.coalesce("upto", F.lit(0)) < p.dictionary_bytes).orderBy("lang", F.coalesce("upto", F.lit(0))))
    out: dict[str, bytes] = {}
    for r in picked.select("lang", "piece").collect():                 # dictionary_bytes per language
        out[r["lang"]] = out.get(r["lang"], b"") + bytes(r["piece"]) + b" "
    # a dictionary has 8 bytes at least: one of a tiny sample holds it several times
    return {lang: (out[lang] * -(-8 // len(out[lang])))[-p.dictionary_bytes:] for lang in sorted(out, key=lambda x: (-counts[x], x))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], p: Params = Params()) -> DataFrame:
    """``docs`` (``text`` and any other columns) -> their columns without the
    text, as a struct ``row``, and ``lang_best`` (fewest bytes), ``lang_pred``
    (``und`` when rejected), ``score`` (0 to 1), ``margin``."""
    langs = list(dictionaries)
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "text"]
    df = docs.select(F.struct(*rest or [F.lit(True).alias("read")]).alias("row"), "text")
    schema = pa.schema([("lang_best", pa.string()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])

    def run(batches):
        coders = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**MATCHING)
            d.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
        for b in batches:
            best, pred, score, margin = [], [], [], []
            for text in b.column("text"):
                data = letters(text.as_py())
                if not data or not coders:
                    best.append(UNKNOWN), pred.append(UNKNOWN), score.append(0.0), margin.append(0.0)
                    continue
                cut = list(pieces(data, p.piece))
                sizes = np.array([sum(len(c.compress(x)) for x in cut) for c in coders], float)
                at = int(sizes.argmin())
                rival = np.delete(sizes, at).min() if len(sizes) > 1 else 2 * sizes[at]
                lead = min(1.0, (rival - sizes[at]) / sizes[at])
                # bytes saved as log-odds, tempered: 2 bytes are a factor e
                confidence = 1 / np.exp((sizes[at] - sizes) / 2).sum()
                best.append(langs[at]), margin.append(lead), score.append(float(confidence))
                pred.append(langs[at] if lead >= p.margin else UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(v, f.type) for v, f in zip((best, pred, score, margin), schema, strict=True))],
                                             names=["row", *schema.names])

    out = T.StructType([df.schema["row"]]).add("lang_best", "string").add("lang_pred", "string").add("score", "double").add("margin", "double")
    return df.mapInArrow(run, out)


def predictions(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> doc_id, held_out, lang_pred, score,
    margin, rejected.  Rows whose crc32(doc_id) mod 4 is 2 are held out of
    learning.  ``lang_pred`` is the best language also where the margin is
    narrow; ``rejected`` says so."""
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    dictionaries = learn(docs.where(~held).select("lang", "text"), p)
    out = identify(docs.select("doc_id", held, "text"), dictionaries, p)
    return out.select("row.doc_id", "row.held_out", F.col("lang_best").alias("lang_pred"), "score", "margin",
                      ((F.col("lang_pred") == UNKNOWN) & (F.col("lang_best") != UNKNOWN)).alias("rejected"))
