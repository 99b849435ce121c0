"""Job settings: a flat set of named values, each required unless said otherwise."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Options:
    values: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_lines(cls, lines: list[str]) -> Options:
        """Settings from ``key=value`` lines; ``#`` starts a comment line."""
        pairs = (
            line.split("=", 1)
            for line in map(str.strip, lines)
            if line and not line.startswith("#") and "=" in line
        )
        return cls({key.strip(): value.strip() for key, value in pairs})

    def text(self, key: str, allow_empty: bool = False) -> str:
        value = self.values.get(key) or ""
        if not value and not allow_empty:
            raise ValueError(f"setting {key!r} is missing or empty")
        return value

    def integer(self, key: str) -> int:
        return int(self.text(key))
