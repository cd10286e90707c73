"""Models are the user's: any callable from a list of texts to a list of results becomes a vectorised column function.

Results are structs with an ``error``; one bad batch marks its rows, not the job. Calls aren't repeatable, so write what a model returned before branching on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strataspark.functions.text import EMBED_BYTES, truncate_utf8

Embedder = Callable[[list[str]], list[list[float]]]
Completer = Callable[[list[str]], list[str]]
BATCH = 64


def _calls(texts: pd.Series, call) -> tuple[list, list]:
    out, errors = [], []
    for k in range(0, len(texts), BATCH):
        part = texts.iloc[k : k + BATCH].fillna("").tolist()
        try:
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} texts")
            out += got
            errors += [None] * len(part)
        except Exception as e:  # the model is not ours: its failure is a result
            out += [None] * len(part)
            errors += [f"{type(e).__name__}: {e}"] * len(part)
    return out, errors


def embed(text: Column, embedder: Embedder) -> Column:
    """Struct ``(v array<float>, error string)``; texts are cut to 30 KB on a character boundary first."""

    @F.pandas_udf("v array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            v, error = _calls(texts, embedder)
            yield pd.DataFrame({"v": v, "error": error})

    return run(truncate_utf8(text, EMBED_BYTES))


def complete(prompt: Column, completer: Completer) -> Column:
    """Struct ``(text string, error string)``."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            text, error = _calls(texts, completer)
            yield pd.DataFrame({"text": text, "error": error})

    return run(prompt)


def hash_embedder(dims: int = 768) -> Embedder:
    """A deterministic stand-in: a linear congruential sequence started by the text's FNV-1 hash, at unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            s = 2166136261
            for byte in text.encode():
                s = (s * 16777619 & 0xFFFFFFFF) ^ byte
            v = []
            for _ in range(dims):
                s = (s * 1664525 + 1013904223) & 0x7FFFFFFF
                v.append(s % 1000 / 500.0 - 1.0)
            length = sum(x * x for x in v) ** 0.5
            out.append([x / length for x in v] if length else v)
        return out

    return run


def const_completer(text: str) -> Completer:
    """A stand-in that always answers the same."""
    return lambda prompts: [text] * len(prompts)
