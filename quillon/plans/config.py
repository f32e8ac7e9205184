"""Pipeline configuration: a line-oriented file of directives to a specification.

`Directive: value` starts a section; indented or following `key value` lines belong to it. Globs expand on the driver.
"""

from __future__ import annotations

import glob
import re
from dataclasses import dataclass, field

_NUMBER = re.compile(r"^-?[0-9]+(\.[0-9]+)?$")
_RANGE = re.compile(r"^([0-9]+)-([0-9]+)$")
LISTS = ("cm-search", "cm-build", "cm-calibrate", "gen-stos", "blast")


@dataclass
class PipelineConfig:
    """directories and databases by name, options by section, and files by section."""

    settings: dict[str, str] = field(default_factory=dict)
    options: dict[str, dict[str, object]] = field(default_factory=dict)
    files: dict[str, list[str]] = field(default_factory=dict)


def read_value(text: str) -> object:
    """A number, a range `a-b` as a list, true or false, or the text."""
    if _NUMBER.match(text):
        return float(text) if "." in text else int(text)
    if m := _RANGE.match(text):
        return list(range(int(m[1]), int(m[2]) + 1))
    return {"true": True, "false": False}.get(text.lower(), text)


def read_options(text: str) -> dict[str, object]:
    """`k v, k v` pairs; a key alone is true."""
    out: dict[str, object] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, _, value = part.partition(" ")
        out[key.lower()] = read_value(value.strip()) if value else True
    return out


def parse_config(text: str, expand: bool = False) -> PipelineConfig:
    config = PipelineConfig()
    section = ""
    for line in text.splitlines():
        line = line.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        directive = re.match(r"^([A-Za-z][\w-]*)\s*:\s*(.*)$", line)
        if directive:
            section, rest = directive[1].lower(), directive[2].strip()
            if section.endswith(("dir", "db")):
                config.settings[section] = rest
            elif rest:
                config.options.setdefault(section, {}).update(read_options(rest))
            else:
                config.options.setdefault(section, {})
            continue
        if not section:
            raise ValueError(f"a line before any directive: {line.strip()!r}")
        item = line.strip()
        if section in LISTS or re.search(r"[*?/]|\.\w+$", item):
            found = sorted(glob.glob(item)) if expand else [item]
            config.files.setdefault(section, []).extend(found)
        else:
            config.options.setdefault(section, {}).update(read_options(item.replace(":", " ")))
    return check_config(config)


def check_config(config: PipelineConfig) -> PipelineConfig:
    """Aggregation of hit tables needs them to be made."""
    csv = config.options.get("gen-csvs", {})
    if csv.get("aggregate") and not csv.get("csv", True):
        raise ValueError("aggregate needs csv")
    return config


def entry_request(text: str) -> tuple[list[str], list[str]]:
    """An rna/taxon request: two lists of lines around a line `;;;`."""
    head, _, tail = text.partition(";;;")
    return tuple([x.strip() for x in part.splitlines() if x.strip()] for part in (head, tail))
