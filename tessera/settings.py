"""Settings from the environment, and models by name."""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass, fields
from typing import get_type_hints

from tessera.operators.models import EchoModel, LanguageModel

PREFIX = "TESSERA_"


@dataclass(frozen=True)
class Settings:
    """Defaults; each can be set by an environment variable of its name with ``PREFIX``, as TESSERA_TOP_K=8."""

    data_dir: str = "data"
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k: int = 5
    backend: str = "echo"
    model: str = ""
    endpoint: str = "http://localhost:11434/v1"
    api_key: str = ""
    temperature: float = 0.7
    max_tokens: int = 512
    timeout: float = 120.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """ValueError names a variable that is no number where one is needed."""
        env, kinds, given = os.environ if env is None else env, get_type_hints(cls), {}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            if name in env:
                try:
                    given[f.name] = kinds[f.name](env[name])
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
        return cls(**given)


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat model behind an HTTP endpoint of the common ``/chat/completions`` form; it is asked from the executors."""

    endpoint: str
    model: str
    api_key: str = ""
    temperature: float = 0.7
    timeout: float = 120.0

    def complete(self, prompt: str, system: str = "", max_tokens: int = 512) -> str:
        said = [{"role": "system", "content": system}] if system else []
        body = {"model": self.model, "messages": [*said, {"role": "user", "content": prompt}], "max_tokens": max_tokens, "temperature": self.temperature}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        asked = urllib.request.Request(f"{self.endpoint.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""


def model_of(settings: Settings) -> LanguageModel:
    """The model that the settings name; ValueError for an unknown back end or one without a model's name."""
    if settings.backend == "echo":
        return EchoModel()
    if settings.backend == "http":
        if not settings.model:
            raise ValueError(f"{PREFIX}MODEL must name a model")
        return ChatEndpoint(settings.endpoint, settings.model, settings.api_key, settings.temperature, settings.timeout)
    raise ValueError(f"unknown back end {settings.backend!r}; known: echo, http")
