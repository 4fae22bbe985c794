"""Syntax tree of a theory."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import Span


@dataclass(frozen=True)
class Node:
    span: Span = field(compare=False)


# Terms ------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class Wild(Node):
    pass


@dataclass(frozen=True)
class SymbolRef(Node):
    """A predicate, function or type: ``name`` or ``model.name``."""

    name: str
    model: Node | None = None


@dataclass(frozen=True)
class App(Node):
    func: SymbolRef
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Dom(Node):
    of: Node


@dataclass(frozen=True)
class Cod(Node):
    of: Node


@dataclass(frozen=True)
class MorApp(Node):
    mor: Node
    arg: Node


@dataclass(frozen=True)
class MorType(Node):
    model: str


# Atoms ------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Equal(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Defined(Node):
    term: Node
    var: Node | None = None
    named: bool = False


@dataclass(frozen=True)
class Holds(Node):
    pred: SymbolRef
    args: tuple[Node, ...]


@dataclass(frozen=True)
class HasType(Node):
    term: Node
    type: Node


# Statements -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class If(Node):
    atom: Node


@dataclass(frozen=True)
class Then(Node):
    atom: Node


@dataclass(frozen=True)
class Branch(Node):
    blocks: tuple[tuple[Node, ...], ...]


@dataclass(frozen=True)
class Match(Node):
    term: Node
    cases: tuple[tuple[Node, tuple[Node, ...]], ...]


# Declarations -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class TypeDecl(Node):
    name: str


@dataclass(frozen=True)
class PredDecl(Node):
    name: str
    args: tuple[tuple[str | None, Node], ...]


@dataclass(frozen=True)
class FuncDecl(Node):
    name: str
    args: tuple[tuple[str | None, Node], ...]
    result: Node


@dataclass(frozen=True)
class Ctor(Node):
    name: str
    args: tuple[tuple[str | None, Node], ...]


@dataclass(frozen=True)
class EnumDecl(Node):
    name: str
    ctors: tuple[Ctor, ...]


@dataclass(frozen=True)
class ModelDecl(Node):
    name: str
    decls: tuple[Node, ...]


@dataclass(frozen=True)
class RuleDecl(Node):
    name: str | None
    body: tuple[Node, ...]
