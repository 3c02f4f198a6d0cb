"""Projects from YAML and JSON files: rules, user groups, validators. Driver-side; a project is small."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from terravet.functions import geometry as G
from terravet.functions.tags import Rule, Rules, Selector, merged

NAME = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class UserGroup:
    title: str
    polygon: list | None = None
    osm_tags: Rules = field(default_factory=Rules)
    users: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    title: dict
    description: dict
    main_contacts: tuple[str, ...]
    project_tags: tuple[str, ...]
    local_srid: int
    locha_cluster_distance: float
    user_groups: dict[str, UserGroup]
    validators: dict[str, dict]
    rules: Rules
    path: str = ""

    @property
    def polygons(self) -> list | None:
        """All groups' polygons; None if there are none, which is everywhere."""
        found = [p for g in self.user_groups.values() if g.polygon for p in g.polygon]
        return found or None


def rule_of(data: dict, group: str | None = None) -> Rule:
    known = {"select", "interest", "sources", "name", "icon", "duplicate_distance"}
    if strange := set(data) - known:
        raise ValueError(f"unknown keys in a rule: {sorted(strange)}")
    select = data["select"] if isinstance(data["select"], list) else [data["select"]]
    interest = data.get("interest") or {}
    return Rule(
        tuple(Selector.parse(s) for s in select), tuple(interest), tuple(data.get("sources") or ()), (group,) if group else (), data.get("name") or {}, data.get("icon"),
        data.get("duplicate_distance"),
    )


def load_rules(path: str | Path, group: str | None = None) -> Rules:
    return merged(rule_of(r, group) for r in json.loads(Path(path).read_text()))


def load_polygon(path: str | Path) -> list:
    return G.polygons_of(Path(path).read_text())


def _extended(path: Path) -> dict:
    data = yaml.safe_load(path.read_text()) or {}
    if above := data.pop("extends", None):
        data = _extended(path.parent / above) | data
    return data


def load(path: str | Path) -> Config:
    """A project's configuration; raises ValueError for what is missing or strange."""
    path = Path(path)
    data = _extended(path)
    must = ("title", "description", "main_contacts", "local_srid", "locha_cluster_distance", "user_groups", "validators")
    if lacks := [k for k in must if data.get(k) is None]:
        raise ValueError(f"{path}: lacks {', '.join(lacks)}")
    groups, rules = {}, []
    for name, g in data["user_groups"].items():
        files = g.get("osm_tags") or []
        own = [r for f in ([files] if isinstance(files, str) else files) for r in load_rules(path.parent / f, name).rules]
        rules += own
        groups[name] = UserGroup(g.get("title") or name, load_polygon(path.parent / g["polygon"]) if g.get("polygon") else None, Rules(tuple(own)), tuple(g.get("users") or ()))
    validators = {}
    for name, v in data["validators"].items():
        v = dict(v or {})
        if isinstance(v.get("osm_tags"), str):
            v["specific"] = load_rules(path.parent / v.pop("osm_tags"))
        validators[name] = v
    return Config(
        data["title"], data["description"], tuple(data["main_contacts"]), tuple(data.get("project_tags") or ()), int(data["local_srid"]), float(data["locha_cluster_distance"]),
        groups, validators, merged(rules), str(path),
    )


def projects(folder: str | Path) -> dict[str, Path]:
    """Configurations by project name: a folder each, with a plain name."""
    return {p.parent.name: p for p in sorted(Path(folder).glob("*/config.yaml")) if NAME.fullmatch(p.parent.name)}
