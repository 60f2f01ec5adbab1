"""Prompt, request, completion and answer parsing.

Everything except the pluggable client (U2) is a built-in expression.  The
client runs in ``mapInPandas``: one client per partition, one call per
Arrow batch of prompts, so requests are spread over all executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import col, extract_code_block, not_blank

# The shipped settings and texts of the source tool.
DEFAULT_PROMPT = ("Generate xUnit tests for the following code with 100% code coverage. The tests should follow "
                  "the naming convention: MethodName_WhenCondition_ReturnsExpectedResult. Only generate tests for "
                  "public methods and constructors. Do not create tests for interfaces or private methods. If "
                  "existing tests are provided, update only the tests related to the method.")
SYSTEM_MESSAGE = "You are a helpful AI that generates unit tests."
SAMPLE_HEADER = "\n\nUse the following sample unit test as a reference for the structure and style:\n"
MODEL = "your-model"
MAX_TOKENS = 1500
TEMPERATURE = 0.2
PROVIDERS = ("openai", "ollama", "azure")
NO_COMPLETION = "no completion"
CLIENT_BATCH = 16                # prompts per client call; a failure re-sends one call's prompts at most


def build_prompt(method_code, existing_tests, sample=None, base: str = DEFAULT_PROMPT) -> Column:
    """Base prompt; the sample section only when the sample is
    non-blank; then method code, existing tests and the closing line."""
    sample_part = F.lit("") if sample is None else \
        F.when(not_blank(sample), F.concat(F.lit(SAMPLE_HEADER), col(sample))).otherwise(F.lit(""))
    return F.concat(F.lit(base), sample_part,
                    F.lit("\n\nMethod Code:\n"), F.coalesce(col(method_code), F.lit("")),
                    F.lit("\n\nExisting Tests:\n"), F.coalesce(col(existing_tests), F.lit("")),
                    F.lit("\n\nProvide the complete updated test file content as output."))


def chat_messages(prompt) -> Column:
    """System message then the user prompt."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content")),
                   F.struct(F.lit("user").alias("role"), col(prompt).alias("content")))


def request_json(prompt, model: str = MODEL, max_tokens: int = MAX_TOKENS, temperature: float = TEMPERATURE) -> Column:
    """``{model, prompt, stream, max_tokens, temperature}`` in that order."""
    return F.to_json(F.struct(F.lit(model).alias("model"), col(prompt).alias("prompt"),
                              F.lit(False).alias("stream"), F.lit(max_tokens).alias("max_tokens"),
                              F.lit(temperature).cast("float").alias("temperature")))


def provider_payload(provider, prompt) -> Column:
    """Chat messages for the chat provider, a completion request body for
    the others (the default is the OpenAI form)."""
    chat = F.to_json(F.struct(F.lit(MODEL).alias("model"), chat_messages(prompt).alias("messages"),
                              F.lit(MAX_TOKENS).alias("max_output_tokens"),
                              F.lit(TEMPERATURE).cast("float").alias("temperature")))
    return F.when(col(provider) == "azure", chat).otherwise(request_json(prompt))


def _has_key(json_col: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(json_col), key), F.lit(False))


def parse_completion(provider, http_status, body) -> tuple[Column, Column]:
    """X3 + X4: (generated text, error).  A non-success status gives '' for the
    completion providers; the chat provider's call raises, so it is an error.
    OpenAI: ``choices[0].text``, an empty array gives ''; Ollama:
    ``response``; chat: the first content part's text.  A missing property
    is an error; a JSON null text gives ''."""
    p, b = col(provider), col(body)
    ok = col(http_status).between(200, 299)
    first_choice = F.get_json_object(b, "$.choices[0]")
    first_part = F.get_json_object(b, "$.content[0]")
    openai_err = (F.when(~_has_key(b, "choices"), F.lit("missing property: choices"))
                  .when((F.json_array_length(F.get_json_object(b, "$.choices")) > 0) & ~_has_key(first_choice, "text"),
                        F.lit("missing property: text")))
    openai_txt = F.when(F.coalesce(F.json_array_length(F.get_json_object(b, "$.choices")), F.lit(0)) == 0, F.lit("")) \
                  .otherwise(F.coalesce(F.get_json_object(b, "$.choices[0].text"), F.lit("")))
    ollama_err = F.when(~_has_key(b, "response"), F.lit("missing property: response"))
    ollama_txt = F.coalesce(F.get_json_object(b, "$.response"), F.lit(""))
    chat_err = F.when(~_has_key(first_part, "text"), F.lit("missing property: content[0].text"))
    chat_txt = F.coalesce(F.get_json_object(b, "$.content[0].text"), F.lit(""))
    err = F.when(~ok & (p == "azure"), F.concat(F.lit("chat request failed with status "), col(http_status).cast("string"))) \
           .when(~ok, F.lit(None).cast("string")) \
           .when(p == "ollama", ollama_err).when(p == "azure", chat_err).otherwise(openai_err)
    txt = F.when(err.isNotNull(), F.lit(None).cast("string")).when(~ok, F.lit("")) \
           .when(p == "ollama", ollama_txt).when(p == "azure", chat_txt).otherwise(openai_txt)
    return txt, err


def replay_completions(requests: DataFrame, replay: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Left join requests to a replay table of recorded answers; adds
    ``generated`` (raw text), ``completion_error`` and ``code`` (X1 + X2).
    A request with no recorded answer gets a null ``generated`` and the error
    ``no completion``: no answer is not a blank answer."""
    j = requests.join(replay, id_col, "left")
    txt, err = parse_completion(F.col("provider"), F.col("http_status"), F.col("body"))
    answered = F.col("body").isNotNull()
    return (j.withColumn("generated", F.when(answered, txt))
             .withColumn("completion_error", F.when(answered, err).otherwise(F.lit(NO_COMPLETION)))
             .withColumn("code", extract_code_block(F.col("generated")))
             .drop("provider", "http_status", "body"))


def ask(client, prompts: list[str]) -> list[tuple]:
    """(answer, error) per prompt; when the call fails or returns another
    number of answers its prompts are sent one by one."""
    try:
        answers = list(client.complete(prompts))
        if len(answers) != len(prompts):
            raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
        return [(a, None) for a in answers]
    except Exception as e:  # noqa: BLE001 - isolate the failing rows
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [r for p in prompts for r in ask(client, [p])]


def complete_with_client(requests: DataFrame, client_factory: Callable[[], object],
                         prompt_col: str = "prompt") -> DataFrame:
    """Call an external completion client.  ``client_factory()`` runs
    once per partition (inside the task); ``client.complete(prompts)`` gets a
    list of at most ``CLIENT_BATCH`` prompts and returns answers in order.
    When a call fails, or returns another number of answers, its prompts are
    sent one by one, so only the failing rows get a ``completion_error``.
    Every action on the result asks again: ``answers.complete_with_log`` keeps
    what was answered."""
    out_schema = T.StructType([*requests.schema.fields, T.StructField("generated", T.StringType()),
                               T.StructField("completion_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").tolist()
            got = [r for i in range(0, len(prompts), CLIENT_BATCH) for r in ask(client, prompts[i:i + CLIENT_BATCH])]
            yield pdf.assign(generated=[a for a, _ in got], completion_error=[e for _, e in got])

    return requests.mapInPandas(run, out_schema).withColumn("code", extract_code_block(F.col("generated")))
