"""Model calls: token budget, allowed hosts, routing and a cache, around a transport that the caller gives."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def allowed(urls: DataFrame, hosts: list[str], url: str = "url") -> DataFrame:
    """urls with host and the mark allowed."""
    return urls.withColumn("host", host(F.col(url))).withColumn("allowed", F.coalesce(F.col("host").isin(*hosts), F.lit(False)))


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def within_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """rows with their running cost in a group, as far as the budget goes."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("tokens", tokens(F.col(text))).withColumn("spent", F.sum("tokens").over(w)).filter(F.col("spent") <= budget)


class BudgetSpent(RuntimeError):
    """A call would go over the budget."""


class HostNotAllowed(RuntimeError):
    """A call to a host that isn't on the list."""


@dataclass
class Gateway:
    """Routes tasks to providers: functions from (model, prompt) to a reply."""

    providers: dict[str, Callable[[str], str]]
    routes: dict[str, str] = field(default_factory=dict)
    default: str = "default"
    max_tokens: int | None = None
    spent: int = 0
    cache: dict[str, str] = field(default_factory=dict)
    embedder: Callable[[list[str]], list[list[float]]] | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors of texts by the one embedder that is configured."""
        if self.embedder is None:
            raise ValueError("no embedder is configured")
        return self.embedder(texts)

    def complete(self, task: str, prompt: str, temperature: float = 0.0) -> str:
        name = self.routes.get(task, self.default)
        key = hashlib.sha256(json.dumps([name, prompt, temperature]).encode()).hexdigest()
        if temperature == 0 and key in self.cache:
            return self.cache[key]
        cost = max(1, len(prompt) // 4)
        if self.max_tokens is not None and self.spent + cost > self.max_tokens:
            raise BudgetSpent(f"{self.spent + cost} of {self.max_tokens} tokens")
        reply = self.providers[name](prompt)
        self.spent += cost + max(1, len(reply) // 4)
        if temperature == 0:
            self.cache[key] = reply
        return reply
