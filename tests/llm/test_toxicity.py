import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tests.llm.conftest import LONG
from tidemark.llm import toxicity as X

TERMS = {"moron": 3.0, "worthless": 3.0, "scum": 2.0, "ach*": 1.5, "clown": 2.5}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        was, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


def brute(word):
    found = [(0, t) for t in TERMS if t.endswith("*") and word.startswith(t[:-1])]
    found += [(distance(word, t), t) for t in TERMS if not t.endswith("*") and distance(word, t) <= X.edits_allowed(t)]
    return min(found)[0] if found else None


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(t.removesuffix("*") for t in TERMS)), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abcmnoruws*"), st.integers(0, 2)), max_size=4))
def test_matcher_against_edit_distance(word, edits):
    for at, c, kind in edits:
        at = min(at, len(word))
        word = word[:at] + (c.replace("*", "x") if kind != 1 else "") + word[at + (kind != 0):]
    got = MATCHER.match(word) if word else None
    assert (got and got[1]) == (brute(word) if word else None)


MATCHER = X.Matcher(TERMS)


def test_context_separates_quotation_from_abuse():
    p = X.Params()
    total = lambda t: X.features(t, MATCHER, p)[0]
    plain, abuse = total("they saw a moron there today"), total("hey you moron go away")
    quoted, reported = total('the label "moron" was used in old books'), total("she wrote that moron once")
    assert quoted == reported < plain < abuse
    assert total("hey you m0ron") > 0 and total("a calm day") == 0


def corpus(n, seed=0):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("la", "mo", "ri", "ten") for b in ("ka", "so", "fu", "ver", "nip")]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.15
        t = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["moron", "worthless", "scum", "scumbag"]))
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus(900)
    got = {r["doc_id"]: r for r in X.predictions(docs(rows), label_frame(spark, labels)).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)
    assert sum(got[i]["predicted"] == t for i, t in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_edge_cases(spark, docs):
    rows, labels = corpus(300, 1)
    odd = [(900, None), (901, ""), (902, LONG), (903, "moron scum"), (903, "moron scum"), (None, "worthless scum"), (904, LONG + " moron worthless scum " * 30)]
    got = X.predictions(docs(rows + odd), label_frame(spark, labels + [(5, 1, None), (None, 1, 1), (0, 0, labels[0][2]), (903, 1, None)])).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[900] == by[901] < 0.5 < min(by[903], by[None])
    assert X.predictions(docs([]), label_frame(spark, [])).count() == 0
    unlabelled = X.predictions(docs([(1, "moron")]), label_frame(spark, [])).collect()
    assert [(r["score"], r["predicted"]) for r in unlabelled] == [(0.0, 0)]


def test_without_toxic_keeps_clean_rows_and_columns(spark, docs):
    rows, labels = corpus(400, 2)
    df = docs(rows + [(900, None)])
    out = X.without_toxic(df, label_frame(spark, labels))
    assert out.columns == df.columns
    left = {r["doc_id"] for r in out.collect()}
    assert {i for i, _, t in labels if not t} <= left and 900 in left
    assert len(left & {i for i, _, t in labels if t}) <= 3


def misspelled(word):
    return {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in ("", "0")}


def test_learned_words_are_found_misspelled(spark):
    rows, labels = corpus(900)
    df = spark.createDataFrame([(t, bad) for (_, t), (_, _, bad) in zip(rows, labels, strict=True)], "text string, toxic int")
    p = X.Params()
    terms = X.learn_lexicon(df, p)
    m = X.Matcher(terms, X.learn_edits(df, terms, p))
    assert {"moron", "worthless", "scum", "scumbag"} <= set(terms)
    assert all(m.match(v) for w in ("moron", "worthless", "scumbag") for v in misspelled(w))


def test_stems_only_where_they_add_and_with_edits():
    p = X.Params()
    found = [("mor*", 40, 5.0), ("moron", 40, 5.0), ("grusel*", 30, 4.0), ("gruselei", 8, 3.0), ("gruselich", 4, 2.0)]
    assert X.choose(found, p) == {"moron": 5.0, "grusel*": 4.0, "gruselei": 3.0}
    m = X.Matcher({"grusel*": 4.0, "mor*": 2.0})
    for word in ("gruselhaft", "gru5elhaft", "gruelhaft", "grxuselhaft", "grus", "gru55lhaft", "morx", "moxr"):
        far = min(distance(word[:k], "grusel") for k in range(len(word) + 1))
        want = ("mor*", 0) if word.startswith("mor") else ("grusel*", far) if far <= 1 else None
        assert m.match(word) == want
    assert X.Matcher({"moron": 3.0}, {"moron": 0}).match("m0ron") is None


def test_repeated_ids_and_any_column_names(spark, docs):
    rows, labels = corpus(200, 3)
    df = docs(rows + [(rows[0][0], f"other text {i}") for i in range(400)], clash=False).withColumn("meta.x", F.lit(1)).withColumn("a`b", F.lit(2))
    sample, _ = X.sample(df, label_frame(spark, labels), X.Params())
    assert sample.count() <= len(labels)
    out = X.without_toxic(df, label_frame(spark, labels))
    assert out.columns == df.columns and out.count() > 400
