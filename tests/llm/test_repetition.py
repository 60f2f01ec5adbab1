import random
import re

import numpy as np
from tests.llm.conftest import LONG

from tidemark.llm import repetition as R

SPACE = " \t\n\r\x0b\x0c"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def covered(ws, n):
    grams = [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= set(range(i, i + n))
    return inside


def brute(text, rules=R.Rules()):
    ws = words(text)
    chars = sum(map(len, ws))
    lines = [x for x in (text or "").split("\n") if words(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    again_chars = sum(len(w) for x in again for w in words(x))
    per = {n: sum(len(ws[i]) for i in covered(ws, n)) for n, _ in rules.ngrams}
    repeat = len(covered(ws, rules.ngrams[0][0]))
    base = len(ws) < 10 or 100 * repeat > 20 * len(ws)
    kept = (not base and 100 * len(again) <= rules.lines * len(lines) and 100 * again_chars <= rules.line_chars * chars
            and all(100 * per[n] <= p * chars for n, p in rules.ngrams))
    return (len(ws), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(again), repeat, base, kept, len(lines), again_chars, *per.values())


def texts(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        ws = [rnd.choice(["a", "bb", "é", "日本", "#x", "Zed", "<b>"]) for _ in range(rnd.randrange(0, 40))]
        for _ in range(rnd.randrange(3)):                                # copies of a stretch, elsewhere
            if ws:
                i = rnd.randrange(len(ws))
                ws += ws[i:i + rnd.randrange(3, 14)]
        out.append("".join(w + rnd.choice([" ", "\n", "\r\n", "\t", " ", "\x0c "]) for w in ws))
    return out


CASES = [None, "", " \n\t ", "one", "#$ %", "w " * 400, "a b c d e f g h i j k l", "x\n\nx\n \nx\r\nx", "\n".join(["the same line again"] * 3 + ["other words"] * 40),
         "\n".join("abcadbecfagh"), "q1 q2 q3 q4 q5 q6 q7 q8 q9\n" + "an-extremely-long-line-of-one-word-that-repeats\n" * 2 + "\n".join("stuvwx"),
         "a b c d e " * 2, "  　"]


def test_against_brute_force(spark, docs):
    rows = list(enumerate(CASES + texts(3, 250)))
    rows += [(None, "no id"), (4, "one"), (4, "one"), (5, "b c " * 9)]
    got = R.judged(docs(rows)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((d, *brute(t))) for d, t in rows)
    kept = [r["kept"] for r in got]
    assert True in kept and any(not k and not r["base_failed"] for k, r in zip(kept, got, strict=True))


def test_very_long_texts_and_none(spark, docs):
    long = LONG.split()
    again = " ".join(long[:20_000] + long[:5_000])
    got = {r["doc_id"]: r for r in R.judged(docs([(1, LONG), (2, again), (3, "z" * 500_000)])).collect()}
    assert got[1]["n_words"] == 60_000 and got[1]["n_repeat_words"] == 0 and got[1]["kept"]
    assert got[2]["n_repeat_words"] == 10_000 and got[2]["base_failed"]
    assert got[3]["word_chars"] == 500_000 and not got[3]["kept"]
    assert R.judged(docs([])).count() == 0


def test_chunks_do_not_change_results(monkeypatch):
    ts = [(t or "").encode() for t in CASES + texts(5, 80)]
    whole = R.measure(ts, R.Rules(), R._Words())
    for i, t in enumerate(ts):
        alone = R.measure([t], R.Rules(), R._Words())
        assert all(alone[c][0] == whole[c][i] for c in whole)


def test_rolling_keys_tell_order_and_document(monkeypatch):
    h = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    owner = np.array([0, 0, 0, 1, 1, 1, 2, 2, 2])
    for _, flags in R.coverage(h, owner, [2, 3]):
        assert not flags.any()                                            # equal only across documents, or reversed
    (_, flags), = R.coverage(np.array([7, 8, 7, 8, 9], np.uint64), np.zeros(5, int), [2])
    assert flags.tolist() == [True] * 4 + [False]
