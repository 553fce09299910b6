"""Settings that results depend on: defaults, overlaid by a TOML file, and their digest."""

from __future__ import annotations

import copy
import hashlib
import json
import tomllib
from pathlib import Path

from leafmill.operators import sections

DEFAULTS: dict[str, dict[str, int | str]] = {
    "sections": {"tiny": sections.TINY, "giant": sections.GIANT, "part": sections.PART},
    "read": {"budget": 12_000},
    "ids": {"most": 60},
    "tokens": {"ranks": ""},
}


def load(path: str | None = None) -> dict[str, dict[str, int | str]]:
    """The defaults with the file's values; a section or key that isn't known is an error."""
    out = copy.deepcopy(DEFAULTS)
    for section, values in tomllib.loads(Path(path).read_text()).items() if path else ():
        if section not in out or not isinstance(values, dict):
            raise ValueError(f"unknown section {section!r}")
        for key, value in values.items():
            if key not in out[section]:
                raise ValueError(f"unknown key {section}.{key}")
            if type(value) is not type(out[section][key]):
                raise ValueError(f"{section}.{key} is of the wrong type")
            out[section][key] = value
    return out


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
