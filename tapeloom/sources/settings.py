"""Settings from YAML, with numbers read as numbers."""

from __future__ import annotations

import re

_NUMBER = re.compile(r"^[-+]?(\d+\.?\d*|\.\d+)[eE][-+]?\d+$")


def load(path: str) -> dict:
    """A nested dict. Bare exponents such as 1e-5, which YAML 1.1 readers take for strings, become floats."""
    import yaml

    def fixed(x):
        if isinstance(x, dict):
            return {k: fixed(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fixed(v) for v in x]
        return float(x) if isinstance(x, str) and _NUMBER.match(x) else x

    with open(path, encoding="utf-8") as f:
        return fixed(yaml.safe_load(f) or {})
