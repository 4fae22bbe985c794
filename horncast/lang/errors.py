"""Diagnostics of theories.

All problems of a theory are collected; the one that ranks first is raised, since later kinds are often
consequences of earlier ones.  Among equals, the one that ends first in the text comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed order of kinds; kinds that are not named rank after these, together.
RANKED = (
    "UndeclaredSymbol",
    "SymbolDeclaredTwice",
    "BadSymbolKind",
    "NonMorphismAppliedAsMorphism",
    "MorphismAppliedToNonMember",
    "UndeterminedTermType",
)


@dataclass(frozen=True)
class Span:
    start: int
    end: int


@dataclass(frozen=True)
class Problem:
    kind: str
    message: str
    span: Span
    related: tuple[Span, ...] = ()

    def rank(self) -> tuple:
        first = RANKED.index(self.kind) if self.kind in RANKED else len(RANKED)
        # Conflicting enums in a match make its terms' types conflict, too.
        second = {"MatchConflictingEnum": 0, "ConflictingTermType": 2}.get(self.kind, 1)
        return first, second if self.kind in ("MatchConflictingEnum", "ConflictingTermType") else 1, self.span.end, self.span.start


class TheoryError(Exception):
    """A theory that does not compile; ``kind``, ``span`` and ``line`` say what and where."""

    def __init__(self, problem: Problem, source: str, name: str = "theory"):
        self.problem, self.kind, self.span = problem, problem.kind, problem.span
        self.line = source.count("\n", 0, problem.span.start) + 1
        super().__init__(render(problem, source, name))


class MorphismCycleError(Exception):
    """Model elements are connected by a cycle of morphisms."""


def render(problem: Problem, source: str, name: str) -> str:
    out = [f"{problem.kind}: {problem.message}"]
    for span in (problem.span, *problem.related):
        line = source.count("\n", 0, span.start)
        begin = source.rfind("\n", 0, span.start) + 1
        stop = source.find("\n", span.start)
        text = source[begin : stop if stop >= 0 else len(source)]
        width = max(1, min(span.end, begin + len(text)) - span.start)
        out += [f"  at {name}:{line + 1}:{span.start - begin + 1}", f"    {text}", "    " + " " * (span.start - begin) + "^" * width]
    return "\n".join(out)
