import random
import zlib

from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tidemark.llm import language as L

SYLLABLES = {"aa": "ka lo mi ru ten sha po", "bb": "strö grüb hacht eng isch pfa", "cc": "eau ille ère que oui tion ment"}


def texts(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        s = SYLLABLES[lang].split()
        out.append((i, " ".join("".join(rnd.choice(s) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(4, 120))), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))


def test_held_out_accuracy_and_contract(spark):
    rows = texts(600)
    got = {r["doc_id"]: r for r in L.predictions(frame(spark, rows)).collect()}
    assert len(got) == 600
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held) > 100
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edge_cases(spark):
    rows = texts(80)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 ... !!", "bb"), (903, LONG, None), (904, "eauille tionère ouique", None), (905, "eauille tionère ouique", None), (906, "x", None), (None, "strö grüb", None)]
    got = L.predictions(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[902]["score"] == 0
    assert by[903]["lang_pred"] in SYLLABLES and by[904]["lang_pred"] == by[905]["lang_pred"] == "cc"
    learned = [lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert by[906]["lang_pred"] == max(sorted(SYLLABLES), key=learned.count)      # a tie goes to the language with most rows
    nothing = L.predictions(frame(spark, [(1, "eau", None), (2, "ka lo", None)])).collect()
    assert [r["lang_pred"] for r in nothing] == ["und", "und"]
    assert L.predictions(frame(spark, [])).count() == 0


def test_narrow_margins_are_rejected_by_the_operator(spark):
    rows = [(i, t, lang) for i, t, lang in texts(200, 1)]
    dictionaries = L.learn(frame(spark, rows).select("lang", "text"))
    mixed = " ".join(w for k in range(30) for w in ("karu", "engisch", "eauille"))
    out = L.identify(frame(spark, [(1, mixed, None), (2, rows[0][1], None)]), dictionaries, L.Params(margin=0.15)).collect()
    by = {r["row"]["doc_id"]: r for r in out}
    assert by[1]["lang_pred"] == "und" and by[1]["lang_best"] != "und" and by[2]["lang_pred"] == rows[0][2]


def test_marks_alone_and_tiny_samples_and_any_column_names(spark):
    rows = texts(60) + [(900, "\u0301\u0300 \u0308", "aa"), (901, "\u0301 1", None)] + [(1000 + i, "zz", "dd") for i in range(12)]
    by = {r["doc_id"]: r for r in L.predictions(frame(spark, rows)).collect()}
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und"
    dictionaries = L.learn(frame(spark, rows).select("lang", "text"))
    assert set(dictionaries) == {"aa", "bb", "cc", "dd"} and all(len(d) >= 8 for d in dictionaries.values())
    odd = frame(spark, rows[:3]).select("text", F.lit(1).alias("meta.x"), F.lit(2).alias("a`b"), F.col("doc_id").alias("score"))
    assert [r["row"]["meta.x"] for r in L.identify(odd, dictionaries).collect()] == [1, 1, 1]
    assert L.identify(odd.select("text"), dictionaries).count() == 3


def test_predictions_are_those_of_plain_compression(spark):
    import zstandard
    rows = texts(150, 7)
    dictionaries = L.learn(frame(spark, rows).select("lang", "text"))
    def size(lang, text):
        data = " ".join(w for w in text.lower().split()).encode()
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=zstandard.ZstdCompressionParameters(**L.MATCHING))
        return sum(len(c.compress(data[i:i + 4096])) for i in range(0, len(data), 4096))
    for r in L.identify(frame(spark, rows), dictionaries).collect():
        text = rows[r["row"]["doc_id"]][1]
        sizes = {lang: size(lang, text) for lang in dictionaries}
        assert r["lang_best"] in [k for k, v in sizes.items() if v == min(sizes.values())]
