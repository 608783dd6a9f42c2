"""Systems under test as batch functions over samples; a failing sample is an error row, not a failing run."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Answer = Callable[[str, list[str]], dict]
SCHEMA = "case_uid string, answer string, error string, latency_ms double, n_retrieved int"


def mock(question: str, history: list[str]) -> dict:
    """A fixed reply without a retrieval trace."""
    return {"answer": f"mock: {question}", "latency_ms": 1.0, "n_retrieved": None}


def chat(send: Callable[[dict], dict], model: str) -> Answer:
    """A system that takes a list of messages: earlier turns, then the question. ``send`` posts a request and gives the reply."""

    def ask(question: str, history: list[str]) -> dict:
        began = time.monotonic()
        reply = send({"model": model, "messages": [{"role": "user", "content": t} for t in [*history, question]]})
        choice = (reply.get("choices") or [{}])[0]
        text = reply.get("output") or (choice.get("message") or {}).get("content") or choice.get("text")
        return {"answer": text, "error": None if text is not None else "no answer", "latency_ms": 1000 * (time.monotonic() - began), "n_retrieved": reply.get("n_retrieved")}

    return ask


def asked_turns(cases: DataFrame) -> DataFrame:
    """(case_uid, question, history): the last turn of each case and the questions of the earlier ones that are no key turns."""
    before = F.slice("turns", F.lit(1), F.greatest(F.size("turns") - 1, F.lit(0)))
    told = F.filter(before, lambda t: ~F.coalesce(t["key_turn"], F.lit(False)))
    return cases.select("case_uid", F.element_at("turns", -1)["q"].alias("question"), F.transform(told, lambda t: t["q"]).alias("history"))


REGISTRY: dict[str, Answer] = {"mock": mock}


def answered(samples: DataFrame, name: str = "mock", registry: dict[str, Answer] = REGISTRY) -> DataFrame:
    """Asks the adapter each sample's question, after its earlier turns in order."""
    ask = registry[name]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uid, question, history in zip(b.case_uid, b.question, b.history, strict=True):
                try:
                    r = ask(question, list(history) if history is not None else [])
                    rows.append((uid, r.get("answer"), r.get("error"), r.get("latency_ms"), r.get("n_retrieved")))
                except Exception as e:  # noqa: BLE001  one sample must not end the run
                    rows.append((uid, None, str(e), None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"n_retrieved": "Int32"})

    return samples.select("case_uid", "question", "history").mapInPandas(go, SCHEMA)
