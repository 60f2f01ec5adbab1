import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tidemark.llm import packing as K

VOCABULARY = K.Params().vocabulary


def brute(sizes, length):
    rows, free = [], []
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [r for r in range(len(rows)) if free[r] >= sizes[k]]
        if fit:
            r = min(fit, key=lambda x: (free[x], x))
        else:
            r = len(rows)
            rows.append([]), free.append(length)
        rows[r].append(k)
        free[r] -= sizes[k]
    return rows


@pytest.mark.parametrize("length", [1, 7, 64, 100])
def test_best_fit_decreasing_against_brute_force(length):
    rnd = random.Random(length)
    for n in (0, 1, 5, 200):
        sizes = [rnd.randrange(1, length + 1) for _ in range(n)]
        assert K.best_fit_decreasing(sizes, length) == brute(sizes, length)


def test_round_trip_is_lossless(spark, docs):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "βeta", "γ", "12", "!?", "日本"]) for _ in range(rnd.randrange(0, 300)))) for i in range(120)]
    rows += [(200, LONG), (201, ""), (202, None), (203, "same"), (203, "same"), (None, "no id"), (204, "a" * 5000), (205, " " * 3000), (206, "a" + " \n" * 300_000 + "b"), (207, "!?" * 300_000)]
    p = K.Params(length=256, pool=64)
    packed = K.packed_rows(docs(rows), p)
    for r in packed.collect():
        ids = np.frombuffer(bytes(r["ids"]), p.dtype)
        assert len(ids) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 256
        assert r["resets"] == r["cu_seqlens"][:-1] and (np.diff(r["cu_seqlens"]) > 0).all() and (ids[r["n_tokens"]:] == p.end).all()
    got = {}
    for r in K.unpack(packed, p).collect():
        got.setdefault(r["doc_id"], []).append((r["first"], bytes(r["ids"])))
    e = K.encoder(K.vocabulary(p.vocabulary))
    decoded = {}
    for d, parts in got.items():
        parts.sort()
        if d == 203:
            assert len(parts) == 2 and parts[0] == parts[1]
            parts = parts[:1]
        ids = np.frombuffer(b"".join(x for _, x in parts), p.dtype).tolist()
        assert ids[-1] == p.end
        decoded[d] = e.decode(ids[:-1])
    assert decoded == {d: t for d, t in rows if t is not None}
    f = K.fill(packed, p).first()
    assert f["filled"] > 0.9


def test_empty_table_and_matrices(spark, docs):
    p = K.Params(length=32)
    assert K.packed_rows(docs([]), p).count() == 0
    from tidemark.session import scratch_path
    root = scratch_path(spark, "matrices")
    packed = K.packed_rows(docs([(i, "some words here") for i in range(50)]), p)
    K.write_matrices(packed, root, rows_per_file=4)
    back = K.read_matrices(spark, root)
    assert back.agg(F.sum("n_tokens")).first()[0] == 50 * (len(K.encoder(K.vocabulary(VOCABULARY)).encode_ordinary("some words here")) + 1)
