"""Request surface: named queries with typed parameters, mapped errors and an identity gate."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class BadRequest(ValueError):
    """All missing and mistyped parameters of one request."""

    def __init__(self, missing: list[str], mistyped: list[str]):
        self.missing, self.mistyped = missing, mistyped
        super().__init__("; ".join(x for x in (f"missing: {', '.join(missing)}" * bool(missing), f"wrong type: {', '.join(mistyped)}" * bool(mistyped)) if x))


class NotIdentified(PermissionError):
    """The query is for identified callers only."""


@dataclass
class Request:
    path: str
    data: dict[str, str] = field(default_factory=dict)
    identity: str | None = None
    time: float = 0.0

    def param(self, name: str) -> str | None:
        """A parameter by its name, or by the names that page variables and form fields have."""
        for key in (name, "var_" + name, "field_" + name):
            if key in self.data:
                return self.data[key]
        return None


def _convert(kind: Any, raw: str) -> Any:
    if isinstance(kind, str):
        kind = {"int": int, "float": float, "str": str, "bool": bool}.get(kind, str)
    if kind is bool:
        if raw.lower() not in ("true", "false", "1", "0"):
            raise ValueError(raw)
        return raw.lower() in ("true", "1")
    return kind(raw) if kind in (int, float, str) else raw


def default_error(e: Exception) -> str:
    logging.getLogger("requests").error("uncaught error: %s", e)
    return f"error: {e}"


class App:
    """Registry of named queries."""

    def __init__(self) -> None:
        self._paths: dict[str, tuple[Callable, bool]] = {}
        self._errors: list[tuple[type, Callable]] = []

    def request(self, *paths: str, identifying_required: bool = False) -> Callable:
        def register(f: Callable) -> Callable:
            for p in paths:
                if p in self._paths:
                    raise ValueError(f"{p} is registered already")
                self._paths[p] = (f, identifying_required)
            return f

        return register

    def exception(self, *kinds: type) -> Callable:
        def register(f: Callable) -> Callable:
            self._errors += [(k, f) for k in kinds]
            return f

        return register

    @classmethod
    def with_defaults(cls) -> App:
        """A registry whose errors without a handler of their own become a logged text."""
        app = cls()
        app.exception(Exception)(default_error)
        return app

    def paths(self) -> list[str]:
        return list(self._paths)

    def arguments(self, f: Callable, r: Request, given: dict[str, Any]) -> dict[str, Any]:
        out, missing, mistyped = {}, [], []
        for name, p in inspect.signature(f).parameters.items():
            if name in given:
                out[name] = given[name]
            elif p.annotation in (Request, "Request"):
                out[name] = r
            elif (raw := r.param(name)) is not None:
                try:
                    out[name] = _convert(p.annotation, raw)
                except ValueError:
                    mistyped.append(name)
            elif p.default is inspect.Parameter.empty:
                missing.append(name)
        if missing or mistyped:
            raise BadRequest(missing, mistyped)
        return out

    def call(self, r: Request, **given: Any) -> Any:
        """The result of a request; errors go to the handler of the nearest class."""
        try:
            if r.path not in self._paths:
                raise LookupError(r.path)
            f, gated = self._paths[r.path]
            if gated and not r.identity:
                raise NotIdentified(r.path)
            return f(**self.arguments(f, r, given))
        except Exception as e:
            # the handler of the nearest class; of equal ones the first
            near = sorted(((type(e).__mro__.index(k), i, h) for i, (k, h) in enumerate(self._errors) if isinstance(e, k)), key=lambda x: x[:2])
            if near:
                return near[0][2](e)
            raise


def pager(page: int, total: int) -> list[int | None]:
    """Page numbers to show: the first, two either side, the last; None for a gap."""
    page = min(max(0, page), max(0, total - 1))
    shown = sorted({0, total - 1, *range(max(0, page - 2), min(total, page + 3))} & set(range(total)))
    out: list[int | None] = []
    for p in shown:
        if out and out[-1] is not None and p - out[-1] > 1:
            out.append(None)
        out.append(p)
    return out
