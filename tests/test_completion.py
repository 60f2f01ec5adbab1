import json

from pyspark.sql import functions as F

from tidemark.operators import completion as CP


def parse(spark, rows):
    df = spark.createDataFrame(rows, "provider string, http_status int, body string")
    txt, err = CP.parse_completion(F.col("provider"), F.col("http_status"), F.col("body"))
    return [(r.t, r.e) for r in df.select(txt.alias("t"), err.alias("e")).collect()]


def test_parse_completion_vectors(spark):
    got = parse(spark, [
        ("openai", 200, '{"choices":[{"text":"answer one"}]}'),
        ("openai", 200, '{"choices":[]}'),
        ("openai", 200, '{"choices":[{"text":null}]}'),
        ("openai", 400, "{}"),
        ("openai", 200, '{"other":1}'),
        ("ollama", 200, '{"response":"answer two"}'),
        ("ollama", 200, '{"response":""}'),
        ("azure", 200, '{"content":[{"type":"text","text":"hi"}]}'),
        ("azure", 503, "{}"),
    ])
    assert got == [("answer one", None), ("", None), ("", None), ("", None),
                   (None, "missing property: choices"), ("answer two", None), ("", None), ("hi", None), (None, "chat request failed with status 503")]


def test_prompt_text(spark):
    df = spark.createDataFrame([("CODE", "TESTS", "SAMPLE"), ("CODE", "", "  ")], "c string, t string, s string")
    got = [r[0] for r in df.select(CP.build_prompt("c", "t", "s", base="P")).collect()]
    tail = "\n\nMethod Code:\nCODE\n\nExisting Tests:\n{}\n\nProvide the complete updated test file content as output."
    assert got[0] == "P" + CP.SAMPLE_HEADER + "SAMPLE" + tail.format("TESTS")
    assert got[1] == "P" + tail.format("")


def test_request_json_and_messages(spark):
    df = spark.createDataFrame([('say "hi"',)], "p string")
    r = df.select(CP.request_json("p").alias("j"), CP.chat_messages("p").alias("m")).collect()[0]
    body = json.loads(r.j)
    assert list(body) == ["model", "prompt", "stream", "max_tokens", "temperature"]
    assert body["prompt"] == 'say "hi"' and body["stream"] is False and body["max_tokens"] == 1500
    assert [m.role for m in r.m] == ["system", "user"] and r.m[0].content == CP.SYSTEM_MESSAGE


def test_client_hook_isolates_failures(spark):
    class FakeClient:   # defined here so it is shipped to the workers by value
        def complete(self, prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("API Error")
            return [f"```cs\n// for {p}\n```" for p in prompts]

    req = spark.createDataFrame([("1", "a"), ("2", "boom"), ("3", "c")], "request_id string, prompt string")
    out = {r.request_id: r for r in CP.complete_with_client(req.coalesce(1), FakeClient).collect()}
    assert out["1"].code == "// for a" and out["1"].completion_error is None
    assert out["2"].generated is None and "API Error" in out["2"].completion_error
    assert out["3"].code == "// for c"


def test_replay_join(spark):
    req = spark.createDataFrame([("1", "p"), ("9", "p")], "request_id string, prompt string")
    rep = spark.createDataFrame([("1", "ollama", 200, '{"response":"<think>x</think>```\\nT\\n```"}')],
                                "request_id string, provider string, http_status int, body string")
    got = {r.request_id: (r.generated is None, r.code) for r in CP.replay_completions(req, rep).collect()}
    assert got == {"1": (False, "T"), "9": (True, "")}
    errors = {r.request_id: r.completion_error for r in CP.replay_completions(req, rep).collect()}
    assert errors == {"1": None, "9": CP.NO_COMPLETION}


def test_client_that_returns_too_few_answers(spark):
    class Short:
        def complete(self, prompts):
            return [p.upper() for p in prompts if p != "none"]

    rows = [(str(i), "none" if i == 5 else f"p{i}") for i in range(40)]
    out = {r.request_id: r for r in CP.complete_with_client(spark.createDataFrame(rows, "request_id string, prompt string").coalesce(1), Short).collect()}
    assert "0 answers for 1 prompts" in out["5"].completion_error
    assert all(out[i].generated == p.upper() and out[i].completion_error is None for i, p in rows if i != "5")
