"""Configuration: found, read, checked and filled up with defaults on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from treedex.functions.text import FILE_TYPES

VIEWS = ("file_system", "keyword", "tag", "word", "dependencies", "glossary")
PLACES = ("configs", "config", ".", os.path.expanduser("~/.config"))
SWITCH = ("auto", "on", "off")
#: Folders left out where a configuration says nothing about them.
EXCLUDE = ["**/node_modules/**", "**/.git/**", "**/build/**", "**/__pycache__/**", "**/.venv/**"]
#: All keys. word_index is this library's own.
KEYS = {
    "directories": ("include", "exclude"),
    "keywords": ("files",),
    "output": ("file", "format", "partition_by_domain", "views"),
    "types": ("include", "exclude"),
    "word_index": ("min_frequency",),
}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    include: list[str]
    exclude: list[str] = field(default_factory=list)
    include_types: list[str] = field(default_factory=list)
    exclude_types: list[str] = field(default_factory=list)
    keyword_files: list = field(default_factory=list)
    format: str = "freeplane"
    output: str | None = None
    views: dict[str, str] = field(default_factory=dict)
    min_frequency: int = 2
    partition: str = "auto"

    def view_enabled(self, name: str) -> bool:
        """on, off, or auto: on, but for words."""
        v = self.views.get(name, "auto")
        return v == "on" or v == "auto" and name != "word"


def _strings(value, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise ConfigError(f"{where}: a list of texts that aren't empty is needed")
    return value


def _section(raw: dict, name: str) -> dict:
    """A section, empty if it isn't given; a key that isn't known is an error."""
    found = raw.get(name)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{name}: keys with values are needed")
    if unknown := sorted(set(map(str, found)) - set(KEYS[name])):
        raise ConfigError(f"{name}.{unknown[0]}: not known; known are {', '.join(KEYS[name])}")
    return found


def _switch(value, where: str) -> str:
    """YAML's on, off, yes and no are taken as the words on and off."""
    value = {True: "on", False: "off"}[value] if isinstance(value, bool) else value
    if value not in SWITCH:
        raise ConfigError(f"{where}: {value}; one of {', '.join(SWITCH)} is needed")
    return value


def _keyword_file(entry) -> str | dict:
    """A path, or a path with the domain or domains that it holds for."""
    if isinstance(entry, str):
        return entry
    if not isinstance(entry, dict) or not isinstance(entry.get("path"), str) or set(entry) - {"path", "domain"}:
        raise ConfigError(f"keywords.files: {entry}: a path, or path and domain")
    domain = entry.get("domain")
    if "domain" in entry and not (isinstance(domain, str) or isinstance(domain, list) and domain and all(isinstance(x, str) for x in domain)):
        raise ConfigError(f"keywords.files: {entry['path']}: domain is a name or a list of names")
    return entry


def from_dict(raw: dict) -> Config:
    """Checks keys, types and words."""
    if not isinstance(raw, dict) or not isinstance(raw.get("directories"), dict) or "include" not in raw["directories"]:
        raise ConfigError("directories.include is needed")
    if unknown := sorted(set(map(str, raw)) - set(KEYS)):
        raise ConfigError(f"{unknown[0]}: not known; known are {', '.join(KEYS)}")
    d, kw, out, types, word = (_section(raw, k) for k in KEYS)
    if "include" in types and "exclude" in types:
        raise ConfigError("types: give include or exclude, not both")
    for k, names in types.items():
        if not isinstance(names, list) or (bad := [x for x in names if x not in FILE_TYPES.values()]):
            raise ConfigError(f"types.{k}: {names if not isinstance(names, list) else bad[0]}; a list of {', '.join(sorted(set(FILE_TYPES.values())))} is needed")
    views = out.get("views") or {}
    if not isinstance(views, dict) or (bad := [k for k in views if k not in VIEWS]):
        raise ConfigError(f"output.views: {views if not isinstance(views, dict) else bad[0]}; known are {', '.join(VIEWS)}")
    if out.get("format", "freeplane") not in ("freeplane", "markdown"):
        raise ConfigError(f"output.format: {out['format']}")
    if not isinstance(out.get("file", ""), str):
        raise ConfigError(f"output.file: {out['file']}")
    if not isinstance(kw.get("files") or [], list):
        raise ConfigError("keywords.files: a list is needed")
    include = _strings(d["include"], "directories.include")
    if not include:
        raise ConfigError("directories.include is empty")
    return Config(
        include,
        _strings(EXCLUDE if "exclude" not in d else d["exclude"] or [], "directories.exclude"),
        types.get("include") or [],
        types.get("exclude") or [],
        [_keyword_file(x) for x in kw.get("files") or []],
        out.get("format", "freeplane"),
        out.get("file") or None,
        {k: _switch(v, f"output.views.{k}") for k, v in views.items()},
        int(word.get("min_frequency", 2)),
        _switch(out.get("partition_by_domain", "auto"), "output.partition_by_domain"),
    )


def load(path: str | None = None, name: str = "config") -> Config:
    """The file named, else the first found in PLACES; YAML or JSON."""
    tried = [path] if path else [os.path.join(p, f"{name}{e}") for p in PLACES for e in (".yaml", ".yml", ".json")]
    found = next((p for p in tried if os.path.isfile(p)), None)
    if found is None:
        raise ConfigError(f"no configuration found: {tried}")
    with open(found, encoding="utf-8") as f:
        if found.endswith(".json"):
            raw = json.load(f)
        else:
            import yaml

            raw = yaml.safe_load(f)
    out = from_dict(raw)
    if out.output is None:
        stem = os.path.splitext(os.path.basename(found))[0]
        out.output = f"{stem}.mm" if out.format == "freeplane" else stem
    return out


SAMPLE_CONFIG = {"directories": {"include": ["~/notes"], "exclude": ["**/.git/**"]}, "keywords": {"files": []}, "output": {"format": "markdown", "file": "index", "partition_by_domain": "auto", "views": {"word": "off"}}}
SAMPLE_KEYWORDS = "# one tab is one level; a leaf is a search; ':' finds below\nTopics\n\tplanning\n\tplanning:review\n"


def write_sample(path: str, keywords: bool = False) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(SAMPLE_KEYWORDS if keywords else json.dumps(SAMPLE_CONFIG, indent=2))
