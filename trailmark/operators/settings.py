"""Settings: user patterns and backend options as small tables, checked before they are stored."""

from __future__ import annotations

import json
import re
from typing import Any

from trailmark.operators.dlp_catalog import BUILTIN, Group

#: The options of a backend.
DEFAULTS: dict[str, Any] = {
    "dlp_enabled": True,
    "max_tokens_in_a_request": 0,
    "action_for_max_tokens": "block",
    "token_saving": {"shell_compression": False, "ctx_read": False, "search_compression": False, "diff_compression": False, "json_compression": False, "compression_cache": False},
    "dependency_protection": {"block_malicious": False, "inform_updates": False},
}


class Patterns:
    """User patterns beside the built-in ones. Built-in groups can be switched off, not deleted."""

    def __init__(self, groups: tuple[Group, ...] = BUILTIN):
        self.rows = {i: {"group": g, "enabled": True, "builtin": True} for i, g in enumerate(groups, 1)}

    @staticmethod
    def checked(group: Group) -> Group:
        if not group.name.strip() or not any(p.strip() for p in group.patterns):
            raise ValueError("a group needs a name and a pattern")
        for p in (*(() if group.keywords else group.patterns), *(() if group.negatives_are_keywords else group.negatives)):
            try:
                re.compile(p)
            except re.error as error:
                raise ValueError(f"not a regular expression: {p}") from error
        return group

    def add(self, group: Group) -> int:
        number = max(self.rows, default=0) + 1
        self.rows[number] = {"group": self.checked(group), "enabled": True, "builtin": False}
        return number

    def update(self, number: int, enabled: bool | None = None, **fields: Any) -> None:
        row = self.rows[number]
        row["group"] = self.checked(row["group"]._replace(**fields))
        row["enabled"] = row["enabled"] if enabled is None else enabled

    def delete(self, number: int) -> None:
        if self.rows[number]["builtin"]:
            raise ValueError("built-in groups cannot be deleted")
        del self.rows[number]

    def enabled(self) -> tuple[Group, ...]:
        return tuple(r["group"] for r in self.rows.values() if r["enabled"])


def backend_settings(stored: str | None) -> dict[str, Any]:
    """Stored options over the defaults, one level deep; text that is not a JSON object counts as none."""
    try:
        own = json.loads(stored) if stored else {}
    except ValueError:
        own = {}
    own = own if isinstance(own, dict) else {}
    return {k: v | own.get(k, {}) if isinstance(v, dict) and isinstance(own.get(k, {}), dict) else own.get(k, v) for k, v in DEFAULTS.items()}


def updated_backend(name: str, settings: str, known: set[str]) -> str:
    """Settings to store for a known backend; anything but a JSON object is refused."""
    if name not in known:
        raise ValueError(f"no such backend: {name}")
    if not isinstance(json.loads(settings), dict):
        raise ValueError("settings must be a JSON object")
    return settings
