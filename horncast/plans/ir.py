"""What a theory compiles to: relations and flat rules."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Relation:
    """A table of element ids.  A function's last column is its result; a type is a unary relation."""

    name: str
    columns: tuple[str, ...]  # type of each column
    kind: str  # "type", "pred", "func", "ctor", "member"
    model: str | None = None  # for members of a model: the type of the first column

    @property
    def is_function(self) -> bool:
        return self.kind in ("func", "ctor")

    @property
    def width(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class Atom:
    relation: str
    vars: tuple[int, ...]


@dataclass(frozen=True)
class FlatRule:
    """Premise atoms, then one conclusion: an atom to insert, an equality, or a definition."""

    name: str
    premise: tuple[Atom, ...]
    insert: Atom | None = None
    equal: tuple[str, int, int] | None = None  # type, left, right
    define: Atom | None = None  # function and arguments; the result is new

    def used(self) -> set[int]:
        if self.insert:
            return set(self.insert.vars)
        return set(self.equal[1:]) if self.equal else set(self.define.vars)


@dataclass
class EnumInfo:
    name: str
    ctors: tuple[str, ...]


@dataclass
class ModelInfo:
    name: str
    types: list[str] = field(default_factory=list)
    members: list[str] = field(default_factory=list)

    @property
    def snake(self) -> str:
        return snake(self.name)

    @property
    def arrow(self) -> str:
        return f"{self.name}Mor"

    @property
    def dom(self) -> str:
        return f"{self.snake}_mor_dom"

    @property
    def cod(self) -> str:
        return f"{self.snake}_mor_cod"


def snake(name: str) -> str:
    return "".join(("_" if i and c.isupper() and not name[i - 1].isupper() else "") + c.lower() for i, c in enumerate(name))


def member_relation(model: str, member_type: str) -> str:
    return f"{snake(model)}_member_{snake(member_type.rsplit('.', 1)[-1])}"


def apply_relation(member_type: str) -> str:
    """``el_mor_app``, or ``group_el_mor_app`` where the type's name needs its model."""
    return f"{'_'.join(snake(x) for x in member_type.split('.'))}_mor_app"


@dataclass
class Compiled:
    name: str
    relations: dict[str, Relation]
    rules: list[FlatRule]
    enums: dict[str, EnumInfo]
    models: dict[str, ModelInfo]
    member_types: dict[str, str]  # member type -> model
    digest: str = ""

    def relation(self, name: str) -> Relation:
        """By name; ``Model.name`` also stands for a member whose name is unique."""
        model, _, bare = name.rpartition(".")
        found = self.relations.get(name) or (self.relations.get(bare) if model in self.models else None)
        if found is None or (found.name != name and model not in (found.model, self.member_types.get(bare))):
            raise KeyError(name)
        return found
