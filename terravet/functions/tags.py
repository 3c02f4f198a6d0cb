"""Tag selectors and rules, compiled to columns so that no row is interpreted."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE = re.compile(r"[^\[\]\"'=!~\s]+")
_PLAIN_OUT = re.compile(r"\w+")


class SelectorError(ValueError):
    """Text that isn't a selector."""


@dataclass(frozen=True)
class Filter:
    """One bracket: op is one of '' (the key is there), '!' (it isn't), '=', '!=', '~', '!~'."""

    key: str
    op: str = ""
    value: str = ""

    def text(self) -> str:
        quoted = lambda s: s if _PLAIN_OUT.fullmatch(s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if self.op in ("", "!"):
            return f"[{self.op}{quoted(self.key)}]"
        return f"[{quoted(self.key)}{self.op}{quoted(self.value)}]"

    def column(self, tags: Column) -> Column:
        has = F.coalesce(F.map_contains_key(tags, F.lit(self.key)), F.lit(False))
        value = tags[F.lit(self.key)]
        match self.op:
            case "":
                return has
            case "!":
                return ~has
            case "=":
                return has & F.coalesce(value == self.value, F.lit(False))
            case "!=":
                return ~(has & F.coalesce(value == self.value, F.lit(False)))
            case "~":
                return has & F.coalesce(value.rlike(self.value), F.lit(False))
            case _:
                return ~(has & F.coalesce(value.rlike(self.value), F.lit(False)))


@dataclass(frozen=True)
class Selector:
    """Filters that must all hold."""

    filters: tuple[Filter, ...]

    @staticmethod
    def parse(text: str) -> Selector:
        filters, at = [], 0
        text = text.strip()

        def word() -> str:
            nonlocal at
            if at < len(text) and text[at] in "\"'":
                end, out = text[at], []
                at += 1
                while at < len(text) and text[at] != end:
                    at += text[at] == "\\"
                    out.append(text[at : at + 1])
                    at += 1
                at += 1
                return "".join(out)
            found = _BARE.match(text, at)
            if not found:
                raise SelectorError(f"a key or value is missing at {at} of {text!r}")
            at = found.end()
            return found[0]

        while at < len(text):
            if text[at] != "[":
                raise SelectorError(f"expected [ at {at} of {text!r}")
            at += 1
            absent = text[at : at + 1] == "!"
            at += absent
            key = word()
            op = next((o for o in ("!=", "!~", "=", "~") if text.startswith(o, at)), "")
            at += len(op)
            filters.append(Filter(key, "!" if absent else op, word() if op else ""))
            if text[at : at + 1] != "]" or (absent and op):
                raise SelectorError(f"expected ] at {at} of {text!r}")
            at += 1
        if not filters:
            raise SelectorError("an empty selector")
        return Selector(tuple(filters))

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(f.key for f in self.filters))

    def text(self) -> str:
        """The selector with its filters in the order of their keys."""
        return "".join(f.text() for f in sorted(self.filters, key=lambda f: f.key))

    def column(self, tags: Column) -> Column:
        return reduce(lambda a, b: a & b, [f.column(tags) for f in self.filters])


def _any(columns: Iterable[Column]) -> Column | None:
    found = list(columns)
    return reduce(lambda a, b: a | b, found) if found else None


@dataclass(frozen=True)
class Rule:
    """Selectors, any of which will do, and the keys of interest on what they select."""

    select: tuple[Selector, ...]
    interest: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    user_groups: tuple[str, ...] = ()
    name: dict[str, str] = field(default_factory=dict, hash=False)
    icon: str | None = None
    duplicate_distance: float | None = None

    @staticmethod
    def of(*select: str, **others) -> Rule:
        return Rule(tuple(Selector.parse(s) for s in select), **others)

    @property
    def keys(self) -> list[str]:
        """Keys of interest, then those of the selectors."""
        return list(dict.fromkeys([*self.interest, *[k for s in self.select for k in s.keys]]))

    def predicate(self, tags: Column) -> Column:
        return _any(s.column(tags) for s in self.select)

    def changed(self, before: Column, after: Column) -> Column:
        """Selected before or after, and a key of interest differs."""
        differs = _any(~before[F.lit(k)].eqNullSafe(after[F.lit(k)]) for k in self.keys)
        return _any((s.column(before) | s.column(after)) & differs for s in self.select)


@dataclass(frozen=True)
class Rules:
    rules: tuple[Rule, ...] = ()

    def predicate(self, tags: Column) -> Column:
        """Whether any rule selects; without rules everything is selected. Never null."""
        found = _any(r.predicate(tags) for r in self.rules)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    def changed(self, before: Column, after: Column) -> Column:
        found = _any(r.changed(before, after) for r in self.rules)
        return F.lit(True) if found is None else F.coalesce(found, F.lit(False))

    def matches(self, tags: Column) -> Column:
        """Texts of the selectors that hold, rule by rule."""
        texts = [F.when(s.column(tags), F.lit(s.text())) for r in self.rules for s in r.select]
        return F.filter(F.array(*texts), lambda x: x.isNotNull()) if texts else F.array().cast("array<string>")

    def matches_with_extra(self, tags: Column) -> Column:
        """The selectors that hold and, of their rules, the keys of interest that the tags have."""
        parts = []
        for r in self.rules:
            held = [F.when(s.column(tags), F.lit(s.text())) for s in r.select]
            keys = [F.when(r.predicate(tags) & F.map_contains_key(tags, F.lit(k)), F.lit(k)) for k in r.keys]
            parts += [*held, *keys]
        return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")

    def groups(self, tags: Column) -> Column:
        """User groups of the rules that select."""
        parts = [F.when(r.predicate(tags), F.array(*[F.lit(g) for g in r.user_groups])) for r in self.rules if r.user_groups]
        return F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))) if parts else F.array().cast("array<string>")

    def keys_of_interest(self, tags: Column) -> Column:
        """Keys of the rules that select."""
        parts = [F.when(r.predicate(tags), F.array(*[F.lit(k) for k in r.keys])) for r in self.rules]
        return F.array_distinct(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))) if parts else F.array().cast("array<string>")

    def interests(self, tags: Column) -> Column:
        """(keys, sources) of each rule that selects: its keys that the tags have, and its sources."""
        texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        parts = [F.when(r.predicate(tags), F.struct(F.array_intersect(texts(r.keys), F.map_keys(tags)).alias("keys"), texts(r.sources).alias("sources"))) for r in self.rules]
        return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<struct<keys:array<string>,sources:array<string>>>")

    def first_index(self, tags: Column) -> Column:
        """Place of the first rule that selects; null if none does."""
        out: Column | None = None
        for i, r in enumerate(self.rules):
            out = F.when(r.predicate(tags), i) if out is None else out.when(r.predicate(tags), i)
        return F.lit(None).cast("int") if out is None else out.cast("int")

    def first_distance(self, tags: Column) -> Column:
        """Duplicate distance of the first rule that selects."""
        out: Column | None = None
        for r in self.rules:
            d = F.lit(r.duplicate_distance)
            out = F.when(r.predicate(tags), d) if out is None else out.when(r.predicate(tags), d)
        return F.lit(None).cast("double") if out is None else out.cast("double")

    def __add__(self, other: Rules) -> Rules:
        return Rules(self.rules + other.rules)


def merged(rules: Iterable[Rule]) -> Rules:
    """Rules with the same selectors and interest become one, with the sources and user groups of all."""
    found: dict[tuple, Rule] = {}
    for r in rules:
        key = (r.select, r.interest)
        if key in found:
            o = found[key]
            union = lambda a, b: tuple(dict.fromkeys((*a, *b)))
            r = Rule(o.select, o.interest, union(o.sources, r.sources), union(o.user_groups, r.user_groups), o.name or r.name, o.icon or r.icon, o.duplicate_distance if o.duplicate_distance is not None else r.duplicate_distance)
        found[key] = r
    return Rules(tuple(found.values()))
