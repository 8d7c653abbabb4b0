"""Settings from a small YAML file: nested keys by indentation, scalars, and secrets taken from the environment."""

from __future__ import annotations

import os
import re


def _scalar(text: str) -> object:
    text = text.strip()
    if text[:1] in "\"'" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text)
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("", "null", "~"):
        return None
    if low in ("true", "false"):
        return low == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str) -> dict:
    """Mappings and scalars of the text; anything else is an error that names its line."""
    root: dict = {}
    open_ = [(-1, root)]
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.fullmatch(r"( *)([\w.-]+):(?: (.*)|\s*)", line.rstrip())
        if not m:
            raise ValueError(f"line {n}: not a key and a value: {line.strip()[:60]}")
        depth = len(m[1])
        while open_[-1][0] >= depth:
            open_.pop()
        value = _scalar(m[3] or "")
        if value is None and not (m[3] or "").strip():
            value = {}
            open_[-1][1][m[2]] = value
            open_.append((depth, value))
        else:
            open_[-1][1][m[2]] = value
    return root


def resolved(settings: dict, environment: dict[str, str] | None = None) -> dict:
    """Settings with each `NAME_env` replaced by NAME, read from the environment variable it names; a variable that isn't set is an error."""
    env = os.environ if environment is None else environment
    out = {}
    for k, v in settings.items():
        if isinstance(v, dict):
            out[k] = resolved(v, environment)
        elif k.endswith("_env") and v:
            if v not in env:
                raise KeyError(f"environment variable {v} isn't set")
            out[k[: -len("_env")]] = env[v]
        else:
            out[k] = v
    return out
