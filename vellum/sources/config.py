"""Configuration on the driver: nested groups, dotted overrides, a hash of the whole."""

from __future__ import annotations

import copy
import hashlib
import json

# Settings that an embedding run may override.
EMBED_OVERRIDES = ("window_size", "overlap", "use_zones", "batch_size")


def merged(base: dict, over: dict) -> dict:
    """``over`` on ``base``, groups by groups; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def parsed(text: str):
    """A scalar from text: null, switch, int, float (1e-5 too), else the text."""
    plain = text.strip()
    if plain.lower() in ("null", "none", "~", ""):
        return None
    if plain.lower() in ("true", "false"):
        return plain.lower() == "true"
    for kind in (int, float):
        try:
            return kind(plain)
        except ValueError:
            pass
    return text


def overridden(config: dict, overrides: list[str]) -> dict:
    """Overrides like ``group.key=value``; a path that crosses a plain value is an error."""
    out = copy.deepcopy(config)
    for item in overrides:
        path, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"override without a value: {item}")
        *groups, last = path.split(".")
        at = out
        for g in groups:
            at = at.setdefault(g, {})
            if not isinstance(at, dict):
                raise ValueError(f"{path} crosses a plain value at {g}")
        at[last] = parsed(value)
    return out


def loaded(path: str | None, defaults: dict, overrides: list[str] = ()) -> dict:
    """YAML over the defaults, then the overrides."""
    given = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
    return overridden(merged(defaults, given), list(overrides))


def config_hash(config: dict) -> str:
    """First 12 hex digits of the SHA-256 of the key-sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def embed_settings(meta: dict, overrides: dict) -> dict:
    """Settings of an embedding run; only EMBED_OVERRIDES, with or without ``data.``, may be given."""
    out = dict(meta)
    for k, v in overrides.items():
        name = k.removeprefix("data.")
        if name not in EMBED_OVERRIDES:
            raise ValueError(f"{k} can't be overridden here")
        out[name] = v
    return out
