"""Models behind a batch interface, validation of their replies, and bounded retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A model: a batch of prompts to a batch of replies. The attempt number lets a retry differ.
Model = Callable[[list[str], int], list[str]]
CAPTION = "thinking string, answer string"
SEMANTIC_CAPTION = "thinking string, semantic_elements string, answer string"
QA = "qa_pairs array<struct<question:string,thinking:string,semantic_elements:string,answer:string>>"

_models: dict[str, Callable[[], Model]] = {}


def register(name: str, loader: Callable[[], Model]) -> None:
    """A loader is called once per worker process."""
    _models[name] = loader


def registered() -> list[str]:
    return sorted(_models)


def _stub() -> Model:
    """Deterministic: fails on the first attempts for a share of prompts, so that retries can be tested."""
    import json
    import zlib

    def run(prompts: list[str], attempt: int) -> list[str]:
        out = []
        for p in prompts:
            h = zlib.crc32(p.encode())
            out.append("no answer!" if h % 4 > attempt else json.dumps({"thinking": f"thought {h % 1000} of the prompt", "answer": f"answer {h % 97} to it"}))
        return out

    return run


register("stub", _stub)


def infer(df: DataFrame, prompt: str, model: str = "stub", attempt: int = 0, out: str = "reply") -> DataFrame:
    """Adds the replies of a registered model, batch by batch; the model is loaded once per worker."""
    loader = _models[model]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = loader()
        for b in batches:
            yield pd.Series(m([x or "" for x in b], attempt))

    return df.withColumn(out, run(prompt))


def parsed(df: DataFrame, reply: str, schema: str, required: list[str]) -> DataFrame:
    """Adds parsed (a struct) and valid: the reply is JSON with all required parts non-empty and doesn't end in '!'."""
    # The whole-record mode yields a struct of nulls for a broken reply, so parts are tested rather than the struct.
    out = df.withColumn("parsed", F.from_json(reply, schema))
    ok = ~F.trim(reply).endswith("!")
    for r in required:
        c = F.col("parsed")[r]
        ok = ok & ((F.size(c) > 0) if f"{r} array" in schema else (F.trim(c) != ""))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def judged_valid(reply: str):
    """The judge's JSON says valid: true."""
    return F.coalesce(F.lower(F.get_json_object(reply, "$.valid")) == "true", F.lit(False))


def with_retries(df: DataFrame, key: str, prompt: str, store: Callable[[DataFrame, int], DataFrame], model: str = "stub", schema: str = CAPTION, required: list[str] | None = None, attempts: int = 5) -> DataFrame:
    """Replies of all rows after at most so many attempts, each on the failures of those before.

    store writes an attempt and reads it back, so that none is repeated. A row that never succeeds keeps its last reply
    and valid = false. attempt is the number of the last one, from 0.
    """
    required = required or ["thinking", "answer"]
    left, done = df, None
    for k in range(attempts):
        tried = store(parsed(infer(left, prompt, model, k), "reply", schema, required).withColumn("attempt", F.lit(k)), k)
        keep = tried if k == attempts - 1 else tried.filter("valid")
        done = keep if done is None else done.unionByName(keep)
        left = tried.filter("not valid").select(*df.columns)
        if k < attempts - 1 and left.isEmpty():
            break
    return done


def lookup(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """Label ids and names as a table to broadcast: a settings-sized list."""
    return spark.createDataFrame(rows, "id int, name string")
