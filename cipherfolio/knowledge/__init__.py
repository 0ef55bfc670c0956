"""Loading of the rule packs and lookup tables kept as TOML files.

Everything is checked when it is loaded, so a typo is a load error and not a
rule that silently never fires.
"""

from __future__ import annotations

import datetime as dt
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

HERE = Path(__file__).parent

OPERATORS = frozenset({"eq", "in", "not_in", "min", "max", "present", "contains"})
EFFECT_KEYS = frozenset(
    {"score", "category", "label", "labels", "deadline", "action", "actions", "quantum_status", "type"}
)
EFFECT_TYPES = frozenset({"mosca_urgency"})


class KnowledgeError(ValueError):
    """A pack or table is malformed, uncited or uses an unknown word."""


@dataclass(frozen=True)
class Rule:
    id: str
    pack: str
    when: Mapping[str, Any]
    effect: Mapping[str, Any]
    citation: str
    verified: bool = False
    source: str | None = None

    def texts(self, one: str, many: str) -> list[str]:
        single = [self.effect[one]] if isinstance(self.effect.get(one), str) else []
        return single + [str(v) for v in self.effect.get(many) or []]

    @property
    def deadline(self) -> dt.date | None:
        value = self.effect.get("deadline")
        if isinstance(value, dt.datetime):
            return value.date()
        if isinstance(value, str):
            try:
                return dt.date.fromisoformat(value)
            except ValueError:
                return None
        return value


@dataclass(frozen=True)
class Pack:
    name: str
    version: int
    citation: str
    caps: Mapping[str, int]
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def read_table(path: Path | str) -> dict[str, Any]:
    path = Path(path)
    if path.suffix == ".toml":
        return tomllib.loads(path.read_text(encoding="utf-8"))
    try:
        import yaml
    except ImportError as error:
        raise KnowledgeError(f"{path}: only TOML can be read without a YAML library") from error
    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def make_rule(raw: Mapping[str, Any], pack: str) -> Rule:
    name = raw.get("id")
    if not _text(name):
        raise KnowledgeError(f"{pack}: a rule has no id")

    def refuse(why: str) -> None:
        raise KnowledgeError(f"{pack}: rule {name!r}: {why}")

    when, effect = raw.get("when"), raw.get("effect")
    if not _text(raw.get("citation")):
        refuse("no citation")
    if not isinstance(when, Mapping) or not when:
        refuse("no selector")
    if not isinstance(effect, Mapping):
        refuse("no effect")
    if set(effect) - EFFECT_KEYS:
        refuse(f"unknown effect keys {sorted(set(effect) - EFFECT_KEYS)}")
    if "category" not in effect:
        refuse("effect has no category")
    if "type" in effect:
        if effect["type"] not in EFFECT_TYPES or "score" in effect:
            refuse("a computed effect names a known type and carries no score")
    elif not isinstance(effect.get("score"), int) or isinstance(effect.get("score"), bool):
        refuse("score must be an integer")
    for test in when.values():
        if isinstance(test, Mapping) and set(test) - OPERATORS:
            refuse(f"unknown operators {sorted(set(test) - OPERATORS)}")
    verified, source = raw.get("verified", False), raw.get("source")
    if not isinstance(verified, bool) or not (source is None or isinstance(source, str)):
        refuse("verified is true or false, source is text")
    if verified and not _text(source):
        refuse("verified without a source")
    return Rule(name, pack, dict(when), dict(effect), raw["citation"], verified, source)


def make_pack(document: Mapping[str, Any], where: str = "pack") -> Pack:
    if not isinstance(document, Mapping) or not _text(document.get("pack")):
        raise KnowledgeError(f"{where}: no pack name")
    name = document["pack"]
    if not _text(document.get("citation")):
        raise KnowledgeError(f"{where}: pack {name!r} has no citation")
    if not isinstance(document.get("rules"), list) or not document["rules"]:
        raise KnowledgeError(f"{where}: pack {name!r} has no rules")
    caps = document.get("caps") or {}
    if not isinstance(caps, Mapping):
        raise KnowledgeError(f"{where}: pack {name!r}: caps is a table")
    return Pack(
        name, int(document.get("version", 1)), document["citation"],
        {str(k): int(v) for k, v in caps.items()},
        tuple(make_rule(raw, name) for raw in document["rules"]),
    )


def check_packs(packs: Iterable[Pack]) -> list[Pack]:
    ordered = sorted(packs, key=lambda pack: pack.name)
    seen: set[str] = set()
    for rule in (rule for pack in ordered for rule in pack.rules):
        if rule.id in seen:
            raise KnowledgeError(f"rule id {rule.id!r} is used twice")
        seen.add(rule.id)
    return ordered


def load_packs(folder: Path | str = HERE / "packs") -> list[Pack]:
    files = sorted(p for p in Path(folder).iterdir() if p.suffix in (".toml", ".yaml"))
    return check_packs(make_pack(read_table(path), str(path)) for path in files)


@lru_cache(maxsize=1)
def default_packs() -> tuple[Pack, ...]:
    return tuple(load_packs())


def load_data_classes(path: Path | str = HERE / "data_classes.toml") -> dict[str, tuple[str, int]]:
    """``alias -> (class, years)``, lower-cased."""
    table: dict[str, tuple[str, int]] = {}
    for entry in read_table(path).get("data_classes", []):
        for alias in (entry["name"], *entry.get("aliases", ())):
            table[str(alias).lower()] = (str(entry["name"]), int(entry["x_years"]))
    return table
