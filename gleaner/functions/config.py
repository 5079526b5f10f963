"""Configurations: defaults overridden by name, unknown names refused, nested tables merged."""

from __future__ import annotations


def merged(defaults: dict, overrides: dict, path: str = "") -> dict:
    out = dict(defaults)
    for name, value in overrides.items():
        if name not in defaults:
            raise KeyError(f"unknown setting {path}{name}")
        out[name] = merged(defaults[name], value, f"{path}{name}.") if isinstance(defaults[name], dict) and isinstance(value, dict) and defaults[name] else value
    return out
