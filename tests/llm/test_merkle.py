import hashlib
import zlib
from itertools import groupby

from tests.llm.conftest import LONG
from tidemark.llm import merkle as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[1], row[3], text)))


def tree(nodes, fanout):
    """(top, for every node its siblings as [(left, right), ...])."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(paths):
            k = at[i] // fanout * fanout
            p.append(("".join(level[k:at[i]]), "".join(level[at[i] + 1:k + fanout])))
            at[i] //= fanout
        level = [h("".join(level[k:k + fanout])) for k in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows, fanout=8):
    """rows of (doc_id, lang, source, n_chars, text)."""
    out, subroots = [], []
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    for lang, group in groupby(sorted(rows, key=key), key=key):
        group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        top, paths = tree([leaf(r, r[4]) for r in group], fanout)
        subroots.append(top)
        out += [(r, len(subroots) - 1, p) for r, p in zip(group, paths, strict=True)]
    if not subroots:
        return []
    root, over = tree(subroots, fanout)
    res = []
    for r, k, p in out:
        p = p + over[k]
        text = r[4]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        fold = leaf(r, text)
        for a, z in p:
            fold = h(a + fold + z)
        res.append((r[0], leaf(r, r[4]), subroots[k], root, h("".join(a + z for a, z in p)), fold, fold == root))
    return sorted(res, key=str)


def got(spark, rows, shape=M.Shape()):
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    df = df.selectExpr("*", "'x' as leaf", "1 as tree", "2 as pos", "'y' as `a.b`", "3 as digest")
    return sorted((tuple(r) for r in M.verification(df, shape).collect()), key=str)


def test_against_brute_force_with_repeats_nulls_and_long_texts(spark):
    rows = [(i, ["en", "de", None, "", "é", "z"][i % 11 % 6], f"s{i % 7}", i, f"Text {i} É <B>") for i in range(700)]
    rows += [(None, "en", None, None, None), (None, "en", None, None, "No id"), (5, "en", "s", 1, "Again"), (5, "en", "s", 1, "Again"),
             (9, "de", "s", 0, ""), (9, "de", "s", 0, None), (1000, "lone", "s", 1, "One leaf"), (1001, "en", "s", 2, LONG), (-3, "en", "s", 2, "A\nB\x00")]
    want = brute(rows)
    assert got(spark, rows) == want                                       # 3 levels a step
    assert got(spark, rows, M.Shape(stride=1)) == want                    # every level stored
    assert {r[6] for r in want} == {True, False}


def test_other_shapes_cross_subtree_borders(spark):
    for n, fanout, stride in ((65, 2, 2), (64, 2, 3), (28, 3, 2), (9, 3, 1)):
        rows = [(i, "ab"[i % 3 % 2], "s", i, f"T{i}") for i in range(n)]
        assert got(spark, rows, M.Shape(fanout, stride)) == brute(rows, fanout)


def test_many_trees_none_and_a_single_row(spark):
    rows = [(i, f"l{i % 90:03}", "s", i, f"T{i}") for i in range(200)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    (one,) = got(spark, [(4, "en", "s", 1, "x")])
    assert one[1] == one[2] == one[3] and one[4] == h("") and one[6]


def test_only_every_third_level_is_stored(spark):
    rows = [(i, "en", "s", i, f"T{i}") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    m = M.build(df)
    assert [level.count() for level in m.languages.levels] == [1100, 3, 1]
    one = M.proofs(m).where("row.doc_id = 777").select("leaf", "path", M.fold(M.F.col("leaf"), M.F.col("path")).alias("root")).first()
    assert len(one["path"]) == 4 and one["root"] == m.root               # 1100 -> 138 -> 18 -> 3 -> 1
