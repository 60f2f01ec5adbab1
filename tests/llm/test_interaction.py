import random
import re
from itertools import permutations

from tests.llm.conftest import LONG

from tidemark.llm import interaction as I


def fails(rows):
    """The letters every row (doc_id, lang, text) fails."""
    out = []
    for d, _, t in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" if len(ws) < 200 else ""
        f += "B" if 100 * len(set(ws)) < 50 * len(ws) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else ""
        f += "D" if re.search(r"[#$%&*|]", t) else ""
        f += "E" if d is not None and any(e is not None and e < d and (u or "") == t for e, _, u in rows) else ""
        out.append(f)
    return out


def brute(rows, good, toxic):
    """Every order applied to every document."""
    failed, out, per_filter = fails(rows), [], {}
    for part in {r[1] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, failed, strict=True) if (r[1] or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(order, 1):
                gone = [(r, f) for r, f in left if x in f]
                left = [(r, f) for r, f in left if x not in f]
                per_filter[part, x] = per_filter.get((part, x), 0) + len(gone)
                out.append((part, "".join(order), k, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine),
                            sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone)))
    return sorted((*row, per_filter[row[0], row[1][row[2] - 1]]) for row in out)


def frames(spark, rows, labels):
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'x' as part", "1 as failed", "2 as `a.b`", "3 as h", "4 as good")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_all_orders_played_out(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(160):
        n = rnd.choice([3, 150, 199, 200, 260])
        ws = [rnd.choice("abcdefghij") if rnd.random() < .3 else f"w{rnd.randrange(10**6)}" for _ in range(n)]
        text = " ".join(ws[:n // 3] * 3 if rnd.random() < .3 else ws) + rnd.choice(["", "", " #", " AAAAAAAAAAAAAA" * 8])
        rows.append((i, rnd.choice(["en", "de", None, ""]), text))
    rows += [(200 + i, rnd.choice(["en", "de"]), rows[i % 9][2]) for i in range(60)]
    rows += [(None, "en", rows[0][2]), (300, "en", None), (301, None, ""), (302, "de", " \n"), (0, "de", rows[0][2]), (0, "en", rows[0][2]), (400, "en", LONG), (401, "en", LONG)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    got = sorted(tuple(r) for r in I.audit(*frames(spark, rows, labels)).collect())
    assert got == brute(rows, good, toxic)
    assert len(got) == 600 * 3


def test_potentials_give_shapley_values():
    rnd = random.Random(9)
    for _ in range(20):
        by = [rnd.randrange(50) for _ in range(32)]
        v = I.removal_game(by)
        p = I.potentials(v)
        want = [0] * 5
        for order in permutations(range(5)):
            s = 0
            for i in order:
                want[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        assert [p[31] - p[31 ^ 1 << i] for i in range(5)] == want
        assert p[31] * 1 == sum((120 * v[31], *(p[31 ^ 1 << i] for i in range(5)))) / 5
        assert sum(want) == 120 * v[31]


def test_no_rows_and_no_labels(spark):
    d, lab = frames(spark, [], [])
    assert I.audit(d, lab).count() == 0
    d, lab = frames(spark, [(1, "en", "Short text")], [])
    got = I.audit(d, lab).collect()
    assert len(got) == 600 and {r["kept"] for r in got if r["step"] == 5} == {0} and sum(r["removed"] for r in got) == 120
