"""Rule packs: what each language calls its sinks, decoders and the like, and which paths are in which language."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, fields
from functools import cache
from importlib import resources
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanthorn.functions.text import base_name
from lanthorn.model import RulePackError

# Last parts of names that are too common to stand alone.
COMMON_TAILS = frozenset("call compile constructor decode do exec execute from get import invoke load new open parse post request require run send source spawn start system use".split())


@dataclass(frozen=True)
class Language:
    """One language. Lists that no detector reads are kept, for tools that do."""

    id: str
    extensions: tuple[str, ...]
    dynamic_exec_sinks: tuple[str, ...]
    decoders: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    deserializers: tuple[str, ...] = ()
    network_io: tuple[str, ...] = ()
    secrets_io: tuple[str, ...] = ()
    shell_exec: tuple[str, ...] = ()
    library_load: tuple[str, ...] = ()
    other: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def shell(self) -> bool:
        return self.id == "bash" or "sh" in self.aliases


_REQUIRED = ("id", "extensions", "dynamic_exec_sinks", "decoders")


def language_from(data: object) -> Language | None:
    """A language from parsed JSON; None if a required field is missing or of the wrong kind."""
    if not isinstance(data, dict) or not isinstance(data.get("id"), str) or not all(isinstance(data.get(k), list) for k in _REQUIRED[1:]):
        return None
    known = {f.name for f in fields(Language)} - {"id", "other"}
    lists = {k: tuple(x for x in data[k] if isinstance(x, str)) for k in known if isinstance(data.get(k), list)}
    return Language(id=data["id"], other={k: v for k, v in data.items() if k not in known and k != "id"}, **lists)


class RuleSet:
    """Languages by id, alias, extension and file name."""

    def __init__(self, languages: list[Language], version: str = "") -> None:
        self.languages = languages
        self.by_name = {a: x for x in languages for a in (*x.aliases, x.id)}
        self.by_name |= {x.id: x for x in languages}
        self.by_extension = {e.lower(): x.id for x in reversed(languages) for e in x.extensions}
        self.by_filename = {n: x.id for x in reversed(languages) for n in x.filenames}
        self.version = version or hashlib.sha256(repr(languages).encode()).hexdigest()[:12]

    def config_for(self, name: str | None) -> Language | None:
        return self.by_name.get(name) if name else None

    def detect_language(self, path: Column) -> Column:
        """The language id of a path, null if it has none: by file name, then special names, then the last extension."""
        norm, base = F.replace(path, F.lit("\\"), F.lit("/")), base_name(path)
        extension = F.lower(F.regexp_extract(base, r"(\.[^.]*)\z", 1))
        lookup = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None).cast("string")
        special = (
            F.when(base == "package.json", "json")
            .when((base == "Dockerfile") | base.startswith("Dockerfile."), "dockerfile")
            .when(norm.contains("/.github/workflows/") & norm.rlike(r"\.ya?ml\z"), "yaml")
        )
        return F.coalesce(lookup(self.by_filename, base), special, lookup(self.by_extension, extension))


def load_rule_set(folder: str | Path) -> RuleSet:
    """The valid ``*.json`` files of a folder whose names don't start with an underscore; an error if there is none."""
    found = []
    for file in sorted(Path(folder).glob("*.json")):
        if not file.name.startswith("_"):
            try:
                found.append(language_from(json.loads(file.read_text("utf-8"))))
            except ValueError:
                found.append(None)
    if not any(found):
        raise RulePackError(f"no valid language configuration in {folder}")
    return RuleSet([x for x in found if x])


@cache
def default_rule_set() -> RuleSet:
    with resources.as_file(resources.files("lanthorn") / "rulepack") as folder:
        return load_rule_set(folder)


def call_pattern(names: tuple[str, ...], bare_tails: bool = False) -> str:
    """An alternation of ways to write calls of the named functions, without a boundary on either side.

    A dotted name also matches by its last part alone, unless that is a common word; then by its last two parts, or
    by the last after a dot. Names with white space and PowerShell's ``[Type]::Member`` are taken as they are.
    """
    out: dict[str, None] = {}
    for name in filter(None, names):
        out[re.escape(name)] = None
        parts = re.split(r"\.|::", name)
        if len(parts) == 1 or not parts[-1] or re.search(r"\s|^\[.+\]::", name):
            continue
        if bare_tails or parts[-1].lower() not in COMMON_TAILS:
            out[re.escape(parts[-1])] = None
            continue
        two = re.search(r"[^.:]+(?:\.|::)[^.:]+\Z", name)
        if two:
            out[re.escape(two[0])] = None
        out[r"(?:\.|::)" + re.escape(parts[-1])] = None
    return "|".join(out)


def call_tails(names: tuple[str, ...]) -> list[str]:
    """For each name, a string that every way to write its call contains: its last part."""
    return list(dict.fromkeys(re.split(r"\.|::", n)[-1] or n for n in names if n))


def tail_tokens(names: tuple[str, ...]) -> list[str]:
    """The last words of names, for a cheap test before a regex: three characters or more, each once."""
    words = (re.sub(r"[^A-Za-z0-9_]", "", [p for p in re.split(r"[./:\s]+", n) if p][-1:][0] if re.sub(r"[./:\s]+", "", n) else n) for n in names if n)
    return [w for w in dict.fromkeys(words) if len(w) >= 3]
