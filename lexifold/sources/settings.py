"""Settings from a file of NAME=value lines, and numbers from the environment."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load(path: str, into: MutableMapping[str, str] | None = None) -> None:
    """Sets what isn't set yet; blank lines, comments and lines without = are left out, quotes around a value go."""
    into = os.environ if into is None else into
    if not Path(path).is_file():
        return
    for line in Path(path).read_text(encoding="utf8").splitlines():
        name, mark, value = line.strip().partition("=")
        if mark and name.strip() and not name.startswith("#"):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            into.setdefault(name.strip(), value)


def number(name: str, default: float, into: MutableMapping[str, str] | None = None) -> float:
    """The number in a variable, of the kind of the default; the default where it is unset, blank or no number."""
    try:
        return type(default)((os.environ if into is None else into).get(name, "").strip())
    except ValueError:
        return default
