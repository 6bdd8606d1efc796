"""Text rewriting behind a provider interface: planning, retries, and an offline provider."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RewriteProvider(Protocol):
    def rewrite(self, text: str, model: str, prompt: str, placement: str = "user") -> str: ...


class QuotaExhausted(RuntimeError):
    """A hard limit: retrying cannot help."""


class OfflineProvider:
    """A deterministic stand-in: contractions written out, spaces collapsed, first letters of sentences raised."""

    FULL = {"don't": "do not", "can't": "cannot", "won't": "will not", "it's": "it is", "i'm": "I am"}

    def rewrite(self, text: str, model: str, prompt: str, placement: str = "user") -> str:
        for a, b in self.FULL.items():
            text = re.sub(rf"\b{a}\b", b, text, flags=re.I)
        text = re.sub(r"\s+", " ", text).strip()
        return re.sub(r"(^|[.!?] )([a-z])", lambda m: m[1] + m[2].upper(), text)


def call_with_retry(call: Callable[[], str], retries: int = 3, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Try again after rate limits, doubling the wait, or waiting as long as the error says and 5 seconds more."""
    for attempt in range(retries + 1):
        try:
            return call()
        except QuotaExhausted:
            raise
        except Exception as e:
            said = str(e)
            if attempt == retries or not ("429" in said or "rate" in said.lower()):
                raise
            m = re.search(r"retry[ -]?(?:after|in)\D*(\d+(?:\.\d+)?)", said, re.I)
            sleep(float(m[1]) + 5 if m else wait * 2**attempt)
    raise AssertionError("unreachable")


def plan_jobs(stories: DataFrame, models: list[str], conditions: list[str], variants: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """(id, text, model, condition, variant) of all combinations that are not done; a dry run is its count()."""
    combos = [F.struct(F.lit(m).alias("model"), F.lit(c).alias("condition"), F.lit(v).alias("variant")) for m in models for c in conditions for v in variants or [""]]
    jobs = stories.select("id", F.col("story").alias("text"), F.explode(F.array(*combos)).alias("j")).select("id", "text", "j.*")
    return jobs if done is None else jobs.join(done.select("id", "model", "condition", "variant").distinct(), ["id", "model", "condition", "variant"], "left_anti")


def rewrite_stories(jobs: DataFrame, provider: Callable[[], RewriteProvider] = OfflineProvider, prompts: dict[str, str] | None = None, placement: str = "user") -> DataFrame:
    """(id, model, condition, variant, text): one provider object for each worker; failures leave a null text."""
    prompts = prompts or {}

    def run(batches):
        p = provider()
        for b in batches:
            out = []
            for text, model, condition in zip(b["text"], b["model"], b["condition"], strict=True):
                try:
                    out.append(call_with_retry(lambda t=text, m=model, c=condition: p.rewrite(t, m, prompts.get(c, "{text}"), placement)) if isinstance(text, str) else None)
                except QuotaExhausted:
                    raise
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"id": b["id"], "model": b["model"], "condition": b["condition"], "variant": b["variant"], "text": out})

    return jobs.mapInPandas(run, "id long, model string, condition string, variant string, text string")
