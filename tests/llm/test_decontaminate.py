import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tidemark.llm import decontaminate as D


def items(n=40, seed=0):
    rnd = random.Random(seed)
    words = [f"q{i}" for i in range(500)] + ["the", "of", "and"] * 40
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(10, 70))) + (". " + rnd.choice(["yes indeed", "blue"]) if i % 2 else "")) for i in range(n)]


def weighed(rows, p):
    parts = []
    for i, text in rows:
        w = D.words_of(text)
        n = -(-len(w) // p.part)
        parts += [(i, Counter(w[k * len(w) // n:(k + 1) * len(w) // n])) for k in range(n)]
    mean, df = sum(sum(c.values()) for _, c in parts) / len(parts), Counter(t for _, c in parts for t in c)
    out = []
    for i, c in parts:
        size = sum(c.values())
        w = {t: math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * size / mean)) for t, f in c.items()}
        out.append((i, {t: x / sum(w.values()) for t, x in w.items()}))
    return out


def test_wand_retrieves_all_above_the_threshold():
    for block, threshold in ((1, 0.2), (4, 0.35), (16, 0.6)):
        p = D.Params(block=block, threshold=threshold)
        rows = items(200)
        parts = weighed(rows, p)
        index = D.Index(parts, block)
        rnd = random.Random(9)
        for _ in range(12):
            text = []
            for _ in range(rnd.randrange(1, 8)):
                w = D.words_of(rnd.choice(rows)[1])
                text += w[:rnd.randrange(len(w))] + ["filler"] * rnd.randrange(20)
            want = set()
            for s in range(0, max(1, len(text) - p.part), p.part):
                held = set(text[s:s + 2 * p.part])
                want |= {(s, n) for n, (_, w) in enumerate(parts) if sum(x for t, x in w.items() if t in held) >= threshold - 1e-9}
            got = [(s, n) for s, _, n, _ in D.candidates(text, index, p)]
            assert len(got) == len(set(got)) and set(got) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit("x"))


def brute(rows, bench, p):
    """Every item whose question and answer shingles the text holds."""
    out = set()
    for d, t in rows:
        words = D.words_of(t)
        for i, text in bench:
            if len(D.words_of(text)) >= p.least_words and words:
                q, a = D.question_and_answer(text)
                if D.contained(q, words, p.shingle) >= p.overlap and D.contained(a, words, p.shingle) >= p.overlap:
                    out.add((d, i))
    return out


def test_planted_passages_are_found_and_clean_texts_left_alone(spark, docs):
    rnd, bench, p = random.Random(4), items(60, 1), D.Params()
    rows = []
    for d in range(150):
        t = [rnd.choice(["lorem", "ipsum", "the", "of", "q1", "q2", "q77"]) + ("" if rnd.random() < 0.6 else str(d)) for _ in range(rnd.randrange(0, 200))]
        if d % 3 == 0:
            i, text = rnd.choice(bench)
            t.insert(rnd.randrange(len(t) + 1), text.upper() if d % 2 else "*** ".join(text.split(" ")))
        rows.append((d, " ".join(t)))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs(rows), frame(spark, bench)).collect()}
    assert got == brute(rows, bench, p) and len({d for d, _ in got}) == 50
    sharded = D.contaminated(docs(rows), frame(spark, bench), D.Params(shard_bytes=2000)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in sharded} == got
    left = D.decontaminated(docs(rows), frame(spark, bench), D.Params(shard_bytes=2000))
    assert left.columns == docs([]).columns
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {d for d, _ in rows} - {d for d, _ in got}


def test_question_without_its_answer_is_not_enough():
    p, text = D.Params(), "what is the colour of the big clear sky at noon? deep blue of course"
    q, a = D.question_and_answer(text)
    assert a == ["deep", "blue", "of", "course"] and q[-1] == "noon"
    assert D.contained(a, D.words_of("what is the colour of the big clear sky at noon green"), p.shingle) == 0
    assert D.question_and_answer("Question: one two. Answer: three") == (["question", "one", "two", "answer"], ["three"])
    assert D.question_and_answer("only one sentence here") == (["only", "one", "sentence", "here"], [])


def test_edge_cases(spark, docs):
    bench = [(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "yes"),
             (None, "alpha beta gamma delta epsilon zeta eta theta iota")]
    rows = [(1, None), (2, ""), (3, "yes"), (4, LONG + " one two three four five six seven eight nine ten " + LONG), (None, bench[5][1]), (5, bench[0][1]), (5, bench[0][1])]
    got = D.contaminated(docs(rows), frame(spark, bench)).collect()
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == [("4", "1"), ("5", "1"), ("5", "1"), ("None", "None")]
    left = D.decontaminated(docs(rows), frame(spark, bench)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "3"]
    assert D.contaminated(docs([]), frame(spark, bench)).count() == 0
    assert D.contaminated(docs(rows), frame(spark, [])).count() == 0 and D.decontaminated(docs(rows), frame(spark, [])).count() == len(rows)


def test_one_changed_word_is_found_in_items_without_marks():
    p, rnd = D.Params(), random.Random(7)
    rows = [(i, " ".join(f"v{rnd.randrange(3000)}" for _ in range(n)) + tail) for i, n in enumerate((8, 12, 17, 23, 28, 40, 70))
            for tail in (".", ". and so it ended there.")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    index, checks = D.Index(weighed(rows, p), p.block), {i: (i, *D.question_and_answer(t)) for i, t in rows}
    around = ["filler"] * 50
    for i, t in rows:
        w = D.words_of(t)
        for k in range(len(w)):
            for edited in (w[:k] + ["changed"] + w[k + 1:], w[:k] + w[k + 1:], w[:k] + ["added"] + w[k:]):
                assert i in D.matches(around + edited + around, index, checks, p), (i, k)
        assert i not in D.matches(around + w[:len(w) // 2] + around, index, checks, p)
        assert i not in D.matches(around + w[::-1] + around, index, checks, p)
    whole = rows[-1][1]
    assert 13 in D.matches(D.words_of(whole[:whole.rindex(" and so")]), index, checks, p)          # lacks the last sentence


def test_question_and_answer_only_where_marked():
    assert D.question_and_answer("one two three. four five") == (["one", "two", "three", "four", "five"], [])
    assert D.question_and_answer("one two three. is it four?") == (["one", "two", "three", "is", "it", "four"], [])
    assert D.in_order("a b c d e".split(), "x a b y d e z".split()) == 0.8


def test_short_items_and_scripts_without_spaces(spark, docs):
    bench = [(1, "Who was first? Ada"), (2, "blue whale"), (3, "日本の首都はどこですか 東京です"), (4, "ประเทศไทย"), (5, "yes")]
    rows = [(1, "they ask who was first, Ada said so"), (2, "a whale so blue"), (3, "see the blue whale there"), (4, "問題 日本の首都はどこですか 東京です 終"), (5, "who was first then? not Ada"),
            (6, "ยินดี ประเทศไทย ครับ"), (7, "日本の東京"), (8, "yes")]
    got = sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs(rows), frame(spark, bench)).collect())
    assert got == [(1, 1), (3, 2), (4, 3), (6, 4)]
