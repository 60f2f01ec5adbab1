"""Each stage of the pipeline on its own input, against brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_mixture import brute as brute_mixture
from tidemark.llm import decontaminate, mixture, packing
from tidemark.session import scratch_path


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder with documents, labels and benchmark, and their planted cases."""
    rnd = random.Random(11)
    words = [a + b for a in ("la", "mo", "ri", "ten", "gu") for b in ("ka", "so", "fu", "ver", "nip", "dol")]
    text = lambda n: [rnd.choice(words) + rnd.choice(["", "x", "y", "zz", str(rnd.randrange(30))]) for _ in range(n)]
    bench = [(i, " ".join(text(30))) for i in range(20)]
    docs, labels, toxic = [], [], set()
    for i in range(500):
        t, source = text(rnd.randrange(20, 90)), ["a", "b", "c", None][i % 7 // 2]
        if i % 8 == 0:
            toxic.add(i)
            for w in ("moron", "worthless", "scum"):
                t.insert(rnd.randrange(len(t)), w)
        elif i % 11 == 1:
            t.insert(5, rnd.choice(bench)[1])
        docs.append((i, " ".join(t), "en", source, 0))
        labels.append((i, 1, int(i in toxic)))
    for i in range(500, 560):                 # copies and near copies of clean documents
        base = rnd.choice([d for d in docs[:500] if d[0] not in toxic])
        t = base[1].split()
        if i % 2:
            t[-1] = "changed"
        docs.append((i, " ".join(t), "en", base[3], 0))
    docs += [(600, None, None, None, None), (601, "", "en", "a", 0)]
    root = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, bench, toxic


def test_stages(spark, corpus):
    root, docs, bench, toxic = corpus
    df = spark.read.parquet(f"{root}/documents.parquet")
    columns = df.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixture", "token_rows"]
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, df, root)
        path = scratch_path(spark, f"stage-{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name != "token_rows":
            assert out.columns == columns and out.schema == df.schema
        seen[name] = (df.collect(), out.collect())
        df = out

    was, left = seen["toxicity"]
    kept = {r["doc_id"] for r in left}
    assert kept >= {d[0] for d in docs} - toxic and len(kept & toxic) <= 1

    was, left = seen["near_dedup"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in was], 5)
    assert {r["doc_id"] for r in left} == {d for d, (_, low) in groups.items() if d == low}

    was, left = seen["decontamination"]
    gone = {d for d, _ in brute_items([(r["doc_id"], r["text"]) for r in was], bench, decontaminate.Params())}
    assert gone and {r["doc_id"] for r in left} == {r["doc_id"] for r in was} - gone

    was, left = seen["mixture"]
    size, target = brute_mixture([(r["doc_id"], r["text"], r["source"]) for r in was])
    n = lambda rows: {d: sum(1 for r in rows if r["doc_id"] == d) for d in {r["doc_id"] for r in was}}
    source = {r["doc_id"]: r["source"] for r in was}
    for d, copies in n(left).items():
        assert copies in ((lambda r: (int(r), int(r) + 1))(target[source[d]] / size[source[d]] if size[source[d]] else 0))

    was, rows = seen["token_rows"]
    p, e = packing.Params(), packing.encoder(packing.vocabulary(packing.Params().vocabulary))
    want = sum(len(e.encode_ordinary(r["text"])) + 1 for r in was if r["text"] is not None)
    assert sum(r["n_tokens"] for r in rows) == want
    assert sorted(d for r in rows for d, k in zip(r["doc_ids"], r["pieces"]) if k == 0) == sorted(r["doc_id"] for r in was if r["text"] is not None)
    assert all(len(np.frombuffer(bytes(r["ids"]), p.dtype)) == p.length for r in rows)


def test_run_and_registration(spark, corpus):
    root, *_ = corpus
    assert P.run(spark, root).agg(F.sum("n_tokens")).first()[0] > 0
    names = list(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(E.oracle_sql()) <= set(names)


def test_empty_documents(spark, corpus):
    root, *_ = corpus
    df = spark.read.parquet(f"{root}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        df = stage(spark, df, root)
    assert df.count() == 0


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(E.__file__))
    for folder, _, files in os.walk(os.path.join(top, "tidemark")):
        for f in files:
            if f.endswith(".py") and not folder.endswith("llm"):
                assert "tidemark.llm" not in open(os.path.join(folder, f)).read(), f


def test_mixture_defaults_are_the_contract():
    assert mixture.Mix().weights == (5, 2, 1) and mixture.Mix().cap == 3
