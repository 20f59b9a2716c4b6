"""Linked tables: catalog rows that name a table elsewhere, and the policy for their paths."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

from granary.errors import StoreError


@dataclass(frozen=True)
class Link:
    name: str
    kind: str  # database, odbc or text
    source: str = ""
    foreign: str = ""
    connection: str = ""

    @property
    def is_odbc(self) -> bool:
        return self.kind == "odbc"

    def to_json(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class LinkPolicy:
    """A relative source that leaves the host's folder needs the validator's approval; with an allow-list, a source must be on it; the validator may veto any."""

    allowed: tuple[str, ...] = ()
    validator: Callable[[str], bool] | None = field(default=None, compare=False)

    def resolve(self, host: str, source: str) -> str:
        if urlparse(source).scheme or source.startswith("/"):
            full, escapes = source, False
        else:
            base, parts, escapes = host.rstrip("/").rsplit("/", 1)[0].split("/"), [], False
            for part in source.replace("\\", "/").split("/"):
                if part == "..":
                    escapes = escapes or not parts
                    if parts:
                        parts.pop()
                    else:
                        base.pop()
                elif part not in ("", "."):
                    parts.append(part)
            full = "/".join(base + parts)
        if escapes and self.validator is None:
            raise StoreError(f"linked source {source} lies outside its host's folder")
        if self.allowed and spelled(full) not in map(spelled, self.allowed):
            raise StoreError(f"linked source {full} isn't on the allow-list")
        if self.validator is not None and not self.validator(full):
            raise StoreError(f"linked source {full} was refused")
        return full


def spelled(path: str) -> str:
    """A path for comparison: without case, closing slashes and the local scheme."""
    return re.sub("^file:/*", "/", path.lower()).rstrip("/")


def odbc_connection(text: str) -> str:
    return text if text.upper().startswith("ODBC;") else f"ODBC;{text}"
