"""Names with nested angle brackets: normal forms and owners, as Arrow-batched string functions.

Brackets nest without bound, which regular expressions can't follow. A name is read once into a tree of text and
bracket groups, and each normal form is a way of writing that tree out again. Equal names of a batch are read once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crates of the language itself, the hash at a name's end, a root of a path.
STANDARD = ("core", "alloc", "std", "__rustc")
_HASH = re.compile(r"::h[0-9a-fA-F]{16}$")
_ROOT = re.compile(r"(?<![A-Za-z0-9_:])([A-Za-z_][A-Za-z0-9_]*)::")

_TOKEN = re.compile(r"::<|<|>|:|[^<>:]+")


@dataclass
class Group:
    """What stands between two brackets; mark: '<' or '::<'."""

    mark: str
    parts: list[str | Group] = field(default_factory=list)

    def __str__(self) -> str:
        return f"{self.mark}{inside(self)}>"


class Open(str):
    """A bracket that is never closed."""


def inside(group: Group) -> str:
    return "".join(map(str, group.parts))


def parse(name: str) -> Group:
    """The name as a group without brackets of its own. Brackets that never close, or close nothing, are text."""
    open_ = [Group("")]
    for token in _TOKEN.findall(name):
        if token.endswith("<"):
            open_.append(Group(token))
        elif token == ">" and len(open_) > 1:
            closed = open_.pop()
            open_[-1].parts.append(closed)
        else:
            open_[-1].parts.append(token)
    while len(open_) > 1:
        lost = open_.pop()
        open_[-1].parts += [Open(lost.mark), *lost.parts]
    return open_[0]


class Identities:
    """Writes implementations as '::impl_for=target', or '::impl=type' without a target, up to a '::<' that never closes."""

    def __init__(self):
        self.ended = False

    def write(self, group: Group) -> str:
        return "".join(self.part(p) for p in group.parts)

    def part(self, part: str | Group) -> str:
        self.ended |= isinstance(part, Open) and part == "::<"
        if self.ended or isinstance(part, str):
            return str(part)
        if part.mark == "<":
            return f"<{self.write(part)}>"
        said = inside(part)
        if not said.startswith("impl "):
            return str(part)
        _, for_, target = said.rpartition(" for ")
        return f"::impl_for={target}" if for_ else f"::impl={said.removeprefix('impl ')}"


def bare(group: Group) -> str:
    """The group without generic arguments: of its brackets stay a first one and casts, '<T as U>', bare in turn."""
    out = ""
    for i, part in enumerate(group.parts):
        if isinstance(part, str):
            out += part
        elif part.mark == "<" and (i == 0 or any(" as " in p for p in part.parts if isinstance(p, str))):
            out += f"<{bare(part)}>"
    return out


def canonical(name: str) -> str:
    return bare(parse(Identities().write(parse(_HASH.sub("", name)))))


def owner(name: str) -> str | None:
    """The first path root; of an implementation, the first root that isn't the language's own, or else the first."""
    if "::" not in name:
        return None
    if not name.startswith("<"):
        root = _ROOT.match(name)
        return root and root[1]
    head = parse(name).parts[0]
    roots = _ROOT.findall(inside(head)) if isinstance(head, Group) else []
    foreign = [r for r in roots if r not in STANDARD]
    return (foreign or roots or [None])[0]


def _mapped(names: pd.Series, of) -> pd.Series:
    return names.map({n: of(n) for n in names.dropna().unique()})


def canonical_origin(name: Column) -> Column:
    @F.pandas_udf("string")
    def each(names: pd.Series) -> pd.Series:
        return _mapped(names, canonical)

    return each(name)


def symbol_owner(name: Column) -> Column:
    """The owner, or 'unknown', which agrees with nothing by omission."""

    @F.pandas_udf("string")
    def each(names: pd.Series) -> pd.Series:
        return _mapped(names, lambda n: owner(n) or "unknown")

    return each(name)
