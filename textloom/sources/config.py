"""Settings, templates and secrets: small files read on the driver."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Templates:
    # The wording of the default questions.
    choice: str = 'Qual e o elemento central citado no trecho: "{{trecho}}"?'
    score: str = 'Em uma escala de {{min}} a {{max}}, qual a relevancia do trecho "{{trecho}}" para o tema do documento?'
    noul: str = 'Segundo o documento, a afirmacao "{{afirmacao}}" e verdadeira?'


@dataclass(frozen=True)
class Settings:
    max_words: int = 180
    overlap: int = 30
    max_choice: int = 3
    max_score: int = 2
    max_noul: int = 5
    top_k: int = 3
    threshold: float | None = None
    center: float | None = None
    slope: float | None = None
    extra: dict[str, str] = field(default_factory=dict, compare=False)


# Names of settings in files, by section.
NAMES = {
    ("chunking", "max_words"): "max_words", ("chunking", "tamanho"): "max_words", ("chunking", "overlap"): "overlap", ("chunking", "sobreposicao"): "overlap",
    ("question_gen", "max_choice"): "max_choice", ("question_gen", "max_score"): "max_score", ("question_gen", "max_noul"): "max_noul",
    ("decision_engine", "top_k"): "top_k", ("decision_engine", "limiar_recusa"): "threshold",
    ("decision_engine", "conf_center"): "center", ("decision_engine", "conf_slope"): "slope",
}
_SECRET = re.compile(r"key|secret|token", re.I)


def _put(settings: Settings, section: str, key: str, value: object) -> Settings:
    name = NAMES.get((section, key))
    if not name:
        return settings if _SECRET.search(key) else replace(settings, extra={**settings.extra, f"{section}.{key}": str(value)})
    kind = int if name in ("max_words", "overlap", "max_choice", "max_score", "max_noul", "top_k") else float
    try:
        return replace(settings, **{name: kind(value)})
    except (TypeError, ValueError):
        return settings


def read_yaml(text: str, settings: Settings = Settings()) -> Settings:
    """Sections with ``key: value`` lines; quotes and # comments; what is unknown is kept aside."""
    section = ""
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        m = re.match(r"^(\s*)([\w-]+)\s*:\s*(.*)$", bare)
        if not m:
            continue
        if not m[1] and not m[3]:
            section = m[2]
        else:
            settings = _put(settings, section if m[1] else "", m[2], m[3].strip().strip("'\""))
    return settings


def read_json(text: str, settings: Settings = Settings()) -> Settings:
    """Only keys that are there override; secrets are never read from it."""
    for section, values in json.loads(text).items():
        for key, value in values.items() if isinstance(values, dict) else ():
            settings = _put(settings, section, key, value)
    return settings


def load_config(yaml: str | None = None, overlay: str | None = None, **flags: object) -> Settings:
    """Defaults, then the YAML file, then the JSON file, then flags that aren't None."""
    s = Settings()
    if yaml:
        s = read_yaml(Path(yaml).read_text(encoding="utf-8"), s)
    if overlay:
        s = read_json(Path(overlay).read_text(encoding="utf-8"), s)
    known = {f.name for f in fields(Settings)}
    return replace(s, **{k: v for k, v in flags.items() if v is not None and k in known})


def load_templates(folder: str) -> Templates:
    """question_{choice,score,noul}.tpl: a JSON-like "enunciado" value, or the whole trimmed file; else the default."""
    found = {}
    for kind in ("choice", "score", "noul"):
        p = Path(folder, f"question_{kind}.tpl")
        if p.is_file():
            text = p.read_text(encoding="utf-8")
            m = re.search(r'"enunciado"\s*:\s*"((?:[^"\\]|\\.)*)"', text)
            found[kind] = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[1]) if m else text.strip()
    return Templates(**{k: v for k, v in found.items() if v})


def resolve_secret(flag: str | None, env: str, file: str | None = None, conf: str | None = None) -> str | None:
    """Flag, then environment, then a key file (raw or NAME=value), then a conf file; the last line wins in a file."""
    if flag:
        return flag
    if os.environ.get(env):
        return os.environ[env]
    for path in (file, conf):
        if path and Path(path).is_file():
            found = None
            for line in Path(path).read_text(encoding="utf-8").splitlines():
                line = line.strip()
                if line and not line.startswith("#"):
                    name, sep, value = line.partition("=")
                    if sep and name.strip() == env:
                        found = value.strip().strip("'\"")
                    elif not sep and path == file:
                        found = line
            if found:
                return found
    return None
