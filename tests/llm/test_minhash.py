import random

import numpy as np
from tests.llm.conftest import LONG

from tidemark.llm import minhash as M


def brute(rows, k, percent=80):
    """Components over exact shingle sets of (id, text)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[d] = frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if a != b and i and 100 * i >= percent * len(sets[a] | sets[b]) and low[a] != low[b]:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return {d: (len(s), low[d]) for d, s in sets.items()}


def corpus(seed, n=60):
    """Texts with near copies at every distance around the threshold."""
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(400)]
    out = []
    for base in range(n // 12):
        text = [rnd.choice(words) for _ in range(rnd.randrange(12, 120))]
        for k in range(12):
            t = list(text)
            for _ in range(int(len(t) * k / 60)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append((base * 100 + k, " ".join(t)))
    rnd.shuffle(out)
    return out


def check(spark, docs, rows, k):
    got = M.near_duplicates(docs(rows), M.Params(shingle_words=k, block=8)).collect()
    want = brute(rows, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_two_words_against_brute_force(spark, docs):
    check(spark, docs, corpus(1), 2)


def test_five_words_against_brute_force(spark, docs):
    check(spark, docs, corpus(2, 48), 5)


def test_a_hot_group_of_copies_and_near_copies(spark, docs):
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    text = [rnd.choice(words) for _ in range(60)]
    rows = [(i, " ".join(text)) for i in range(40)]
    for i in range(40, 110):
        t = list(text)
        for _ in range(rnd.randrange(1, 5)):
            t[rnd.randrange(60)] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    check(spark, docs, rows, 2)


def test_edge_cases(spark, docs):
    rows = [(1, "Alpha beta"), (2, "alpha BETA"), (3, "alpha"), (4, "ALPHA"), (5, None), (6, ""), (7, " \t\n"), (8, "ÄB c"), (9, "äb c"),
            (10, LONG), (11, LONG + " tail"), (12, "a\x0bb\x0cc d"), (12, "a\x0bb\x0cc d"), (None, "alpha beta"), (None, "only null"),
            (None, "only null")]
    got = M.near_duplicates(docs(rows), M.Params(shingle_words=2)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[i]["component_id"] for i in range(1, 13)] == [1, 1, 3, 3, 5, 6, 7, 8, 9, 10, 10, 12]
    assert [by[i]["n_shingles"] for i in (1, 3, 5, 6, 7, 12)] == [1, 1, 0, 0, 0, 2]     #   is no separator
    nulls = sorted((r["component_id"] is None, r["kept"]) for r in got if r["doc_id"] is None)
    assert nulls == [(False, False), (True, True), (True, True)]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, docs):
    a, b = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    rows = [(3, a + " near"), (5, a), (5, b), (9, b + " near"), (7, b + " other"), (None, a + " null"), (8, "c d e f g"), (8, "x y z x y")]
    got = M.near_duplicates(docs(rows), M.Params(shingle_words=2)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [
        ("3", 3, True), ("5", 3, False), ("5", 5, True), ("7", 5, False), ("8", 8, True), ("8", 8, True), ("9", 5, False), ("None", 3, False)]
    out = M.deduplicated(docs(rows), M.Params(shingle_words=2)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, a + " near"), (5, b), (8, "c d e f g"), (8, "x y z x y")]
    # two near texts of one id are one group: one of them stays
    twice = M.deduplicated(docs([(5, a), (5, a + " near"), (6, b)]), M.Params(shingle_words=2)).collect()
    assert sorted(r["doc_id"] for r in twice) == [5, 6]


def test_empty_table(spark, docs):
    assert M.near_duplicates(docs([])).count() == 0


def test_deduplicated_keeps_one_row_per_group_and_all_columns(spark, docs):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z"), (None, "n n n n n"), (None, "n n n n n"), (4, None)]
    df = docs(rows)
    out = M.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [("1", "a b c d e f g"), ("3", "x y z"), ("4", None), ("None", "n n n n n")]


def test_bayesian_bounds_keep_pairs_at_the_threshold():
    p = M.Params()
    rng = np.random.default_rng(0)
    n = 20_000
    x = rng.integers(0, 2**32, (n, p.hashes), dtype=np.uint32)
    for similarity, least, most in ((0.8, 0.9999, 1.0), (0.3, 0.0, 0.01)):
        y = np.where(rng.random((n, p.hashes)) < similarity, x, x + 1)
        share = len(M.surviving(x, y, M.least_matches(p))) / n
        assert least <= share <= most
