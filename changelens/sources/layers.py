"""Layer maps: lines ``prefix => layer``."""

from __future__ import annotations

from changelens.errors import EngineError


def read_rules(text: str) -> list[tuple[str, str]]:
    """The rules in their order; blank lines and those that start with # are skipped."""
    rules = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        prefix, arrow, layer = bare.partition("=>")
        if not arrow:
            raise EngineError(f"group rule must look like `prefix => layer`: {line}")
        prefix, layer = prefix.strip().rstrip("/"), layer.strip()
        if not prefix or not layer:
            raise EngineError(f"empty group rule: {line}")
        rules.append((prefix, layer))
    return rules
