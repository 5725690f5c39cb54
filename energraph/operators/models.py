"""Models as batch functions over DataFrames, and deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The role prefixes that an embedder expects.
ROLES = {"query": "query: ", "passage": "passage: "}


def map_model(df: DataFrame, columns: list[str], name: str, kind: str, make: Callable[[], Callable[[pd.DataFrame], list]]) -> DataFrame:
    """Adds one column by a model that is made once per task and fed Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield b.assign(**{name: model(b[columns])})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{fields}, {name} {kind}")


def hashing_embedder(dim: int = 64) -> Callable[[], Callable[[pd.DataFrame], list]]:
    """Unit vectors from hashed words."""

    def make() -> Callable[[pd.DataFrame], list]:
        @lru_cache(1 << 18)
        def place(w: str) -> tuple[int, int]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            return h % dim, 1 if h >> 63 else -1

        def one(text: str) -> np.ndarray:
            v = np.zeros(dim)
            if words := (text or "").lower().split():
                at, sign = zip(*map(place, words))
                v += np.bincount(at, sign, dim)
            if not v.any():  # no words, or words that cancel out
                v[0] = 1
            return (v / np.linalg.norm(v)).astype(np.float32)

        return lambda b: [one(t) for t in b.iloc[:, 0]]

    return make


def embed(texts: DataFrame, role: str, make=None) -> DataFrame:
    """Adds ``embedding`` to (id, text), each distinct text embedded once."""
    told = texts.withColumn("said", F.concat(F.lit(ROLES[role]), F.coalesce("text", F.lit(""))))
    once = map_model(told.select("said").distinct(), ["said"], "embedding", "array<float>", make or hashing_embedder())
    return told.join(once, "said").drop("said")


def capital_words() -> Callable[[pd.DataFrame], list]:
    """A stand-in for named entities: words of four or more letters with a capital."""
    import re

    return lambda b: [[{"name": w, "label": "MISC"} for w in re.findall(r"\b[A-Z][A-Za-z]{3,}", t or "")] for t in b["text"]]


def recognise(texts: DataFrame, make=capital_words) -> DataFrame:
    """Adds ``found array<struct<name, label>>``."""
    return map_model(texts, ["text"], "found", "array<struct<name:string,label:string>>", make)


def negation_scorer() -> Callable[[pd.DataFrame], list]:
    """A stand-in for contradiction: word overlap of texts of which exactly one is negated."""

    def score(b: pd.DataFrame) -> list[float]:
        out = []
        for p, h in zip(b.premise, b.hypothesis):
            x, y = set(p.lower().split()), set(h.lower().split())
            odd = len({"not", "no", "never"} & x) != len({"not", "no", "never"} & y)
            out.append(len(x & y) / max(1, len(x | y)) if odd else 0.0)
        return out

    return score


def contradiction_scores(pairs: DataFrame, make=negation_scorer) -> DataFrame:
    return map_model(pairs, ["premise", "hypothesis"], "score", "double", make)


def retrying(call: Callable[[str], str], retries: int = 2, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again after growing waits; the last error is raised."""

    def run(prompt: str) -> str:
        for attempt in range(retries + 1):
            try:
                return call(prompt)
            except OSError:
                if attempt == retries:
                    raise
                sleep(backoff * 2**attempt)
        raise AssertionError

    return run


def complete(prompts: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``response`` to (key, prompt)."""
    return map_model(prompts, ["prompt"], "response", "string", lambda: (lambda call: lambda b: [call(p) for p in b["prompt"]])(make()))


def contradiction_label(labels: dict[int, str]) -> int:
    """The number of the label that means contradiction."""
    hits = [i for i, name in labels.items() if "contradict" in name.lower()]
    if len(hits) != 1:
        raise ValueError("the model must have one contradiction label")
    return hits[0]


def prompts(template: str, **columns) -> object:
    """A prompt column: the template with each {name} replaced."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out


TEMPLATES = {
    "decompose": "Split the question into the simple questions it depends on, one per line.\n\n{question}",
    "answer": "Answer from the passage in a few words, or say NONE.\n\nPassage: {passage}\nQuestion: {question}",
    "next": "State in one sentence what is known so far, or say that the answer is reached.\n\n{passages}\n\nQuestion: {question}",
    "propositions": "List the single facts stated in the passage, one per line.\n\n{passage}",
    "entities": "List the names in the passage, one per line.\n\n{passage}",
}
