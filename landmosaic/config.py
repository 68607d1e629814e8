"""Settings from the command line, the environment and candidate paths."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from typing import TypeVar

T = TypeVar("T")


def parsed(cls: type[T], args: list[str], env: Mapping[str, str] | None = None, prefix: str = "") -> T:
    """A dataclass filled from ``--name=value`` and ``--name`` (true), else from PREFIX_NAME in the environment, else by its defaults. Unknown names are errors."""
    env = os.environ if env is None else env
    given = dict(a[2:].split("=", 1) if "=" in a else (a[2:], "true") for a in args if a.startswith("--"))
    given = {k.replace("-", "_"): v for k, v in given.items()}
    known = {f.name: f for f in fields(cls)}
    if extra := set(given) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    out = {}
    for name, f in known.items():
        text = given.get(name, env.get(f"{prefix}{name}".upper()))
        if text is not None:
            kind = f.type if isinstance(f.type, str) else f.type.__name__
            out[name] = text.strip().lower() in ("1", "true", "yes") if kind == "bool" else {"int": int, "float": float}.get(kind, str)(text)
    return cls(**out)


@dataclass(frozen=True)
class Paths:
    """Candidate folders by key, the first that exists counts; an environment variable overrides them."""

    candidates: Mapping[str, list[str]]
    prefix: str = "LAND_"

    def get(self, key: str, exists: Callable[[str], bool], env: Mapping[str, str] | None = None) -> str:
        """The path of ``key``; where none exists, the first candidate. ``exists`` is given by the caller, as file systems differ."""
        env = os.environ if env is None else env
        if over := env.get(self.prefix + key.upper()):
            return over
        found = self.candidates.get(key)
        if not found:
            raise KeyError(key)
        return next((p for p in found if exists(p)), found[0])


def waits(tries: int, first: float = 0.5, most: float = 30.0) -> list[float]:
    """Seconds to wait before each further try: doubling, with an upper bound."""
    return [min(most, first * 2**i) for i in range(max(0, tries - 1))]
