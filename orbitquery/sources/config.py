"""Settings of a run, as plain values on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    levels: tuple[int, ...] = (0, 1, 2, 3, 4)
    coarse_level: int = 3
    fine_level: int = 2
    cut_size: int = 512
    fine_cut_size: int = 768
    overlap: float = 0.1
    base_resolution: float = 2.0
    drop_last: float = 0.2
    most_windows: int = 10
    sample_seed: int = 42
    least_side: int = 250
    aspect: float = 1.7
    candidate: float = 0.4
    accepted: float = 0.9
    early_stop: float = 0.99
    angle: float = 45.0
    match_threshold: float = 0.2
    temperature: float = 0.1
    border: int = 2
    extensions: tuple[str, ...] = (".tif", ".tiff")
    output_path: str = "result"
    more: dict = field(default_factory=dict)

    @classmethod
    def load(cls, values: dict) -> "Settings":
        """Known keys of a parsed configuration; the others go to `more`."""
        known = {f.name for f in fields(cls)} - {"more"}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known}, more={k: v for k, v in values.items() if k not in known})

    @classmethod
    def read(cls, path: str) -> "Settings":
        """The settings of a YAML file: nested mappings, lists and plain values."""
        with open(path, encoding="utf-8") as source:
            return cls.load(parsed(source.read()))


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parsed(text: str):
    """The part of YAML that settings use: block mappings and lists by indentation, flow lists of plain values, comments."""
    lines = []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if bare.strip():
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, indent: int):
        found: dict | list | None = None
        while at < len(lines) and lines[at][0] >= indent:
            body = lines[at][1]
            if body.startswith("- "):
                found = [] if found is None else found
                found.append(_value(body[2:]))
                at += 1
                continue
            key, _, value = body.partition(":")
            found = {} if found is None else found
            at += 1
            if value.strip():
                found[_value(key)] = _value(value)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                found[_value(key)], at = block(at, lines[at][0])
            else:
                found[_value(key)] = None
            if at < len(lines) and isinstance(found, dict) and lines[at][0] == indent and lines[at][1].startswith("- "):
                break
        return found, at

    return (block(0, lines[0][0])[0] if lines else None) or {}
