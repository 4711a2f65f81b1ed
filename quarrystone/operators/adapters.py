"""Providers of models behind a transport that the caller gives: shapes of requests and replies, no network.

A transport takes (url, headers, body) and returns the reply's JSON. Hosts that aren't allowed are refused before
anything is sent.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlsplit

from .gateway import HostNotAllowed

Transport = Callable[[str, dict, dict], dict]
Turns = list[tuple[str, str]]

#: Fixed values of the two interfaces.
MESSAGES_VERSION = "2023-06-01"


class ReplyError(RuntimeError):
    """A reply without what was asked for."""


@dataclass
class Provider:
    """What all providers share; complete() takes turns of (role, text)."""

    name: str
    model: str
    transport: Transport
    base_url: str
    api_key_env: str | None = None
    max_tokens: int = 1024
    temperature: float = 0.0

    def key(self) -> str | None:
        """The key is read when it is needed and kept nowhere."""
        return os.environ.get(self.api_key_env) if self.api_key_env else None

    def body(self, turns: Turns) -> dict:
        return {"model": self.model, "messages": [{"role": r, "content": t} for r, t in turns], "temperature": self.temperature, "max_tokens": self.max_tokens}

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError(f"{self.name} has no embeddings")


class Completions(Provider):
    """Chat completions and embeddings, as many servers offer them, local ones too."""

    def headers(self) -> dict[str, str]:
        key = self.key()
        return {"Authorization": f"Bearer {key}"} if key else {}

    def complete(self, turns: Turns) -> str:
        reply = self.transport(f"{self.base_url}/chat/completions", self.headers(), self.body(turns))
        try:
            return reply["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ReplyError(f"{self.name}: no completion") from e

    def embed(self, texts: list[str]) -> list[list[float]]:
        reply = self.transport(f"{self.base_url}/embeddings", self.headers(), {"model": self.model, "input": texts})
        try:
            return [d["embedding"] for d in sorted(reply["data"], key=lambda d: d.get("index", 0))]
        except (KeyError, TypeError) as e:
            raise ReplyError(f"{self.name}: no embeddings") from e


class Messages(Provider):
    """Messages with the system's text apart, replies in blocks; no embeddings."""

    def headers(self) -> dict[str, str]:
        key = self.key()
        return {"anthropic-version": MESSAGES_VERSION} | ({"x-api-key": key} if key else {})

    def complete(self, turns: Turns) -> str:
        system = [t for r, t in turns if r == "system"]
        body = self.body([(r, t) for r, t in turns if r != "system"]) | ({"system": "\n\n".join(system)} if system else {})
        reply = self.transport(f"{self.base_url}/v1/messages", self.headers(), body)
        try:
            return "".join(b.get("text", "") for b in reply["content"] if b.get("type") == "text")
        except (KeyError, TypeError) as e:
            raise ReplyError(f"{self.name}: no text") from e


def provider(spec: dict, transport: Transport, hosts: list[str] | None = None) -> Provider:
    """The provider of a configured section; with hosts, only these may be called (an air gap)."""
    url = (spec.get("base_url") or "").rstrip("/")
    if not url:
        raise ValueError(f"{spec['name']}: base_url is missing")
    host = (urlsplit(url).hostname or "").lower()
    if hosts is not None and host not in hosts:
        raise HostNotAllowed(host)
    kind = Messages if spec["type"] == "anthropic" else Completions
    return kind(spec["name"], spec["model"], transport, url, spec.get("api_key_env"))
