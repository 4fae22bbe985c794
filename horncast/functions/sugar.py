"""Rule texts for common patterns.

The language has no directed equations; the older surface wrote ``l ~> r`` for: where the arguments of ``l``
and all of ``r`` are defined, ``l = r``.  ``reduction`` writes that rule; ``axiom`` writes the one-premise,
one-conclusion form.
"""

from __future__ import annotations


def axiom(conclusion: str, *premises: str, name: str = "") -> str:
    """``rule name { if premise; ... then conclusion; }``"""
    body = " ".join(f"if {p};" for p in premises)
    return f"rule {name} {{ {body} then {conclusion}; }}"


def reduction(function: str, args: list[str], right: str, *premises: str, name: str = "", both: bool = False) -> str:
    """Rules for ``function(args) ~> right``; with ``both`` also from right to left, if ``right`` is an application ``(f, args)``."""
    bound = [f"if {p};" for p in premises] + [f"if arg_{i} = {a};" for i, a in enumerate(args)] + [f"if value = {right};"]
    names = ", ".join(f"arg_{i}" for i in range(len(args)))
    out = f"rule {name} {{ {' '.join(bound)} then {function}({names}) = value; }}"
    if both:
        head, inner = right.split("(", 1)
        out += "\n" + reduction(head, _split(inner.rstrip().removesuffix(")")), f"{function}({', '.join(args)})", *premises, name=f"{name}_back" if name else "")
    return out


def _split(args: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in args:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def poset(type_name: str, relation: str) -> str:
    """Reflexive, transitive, antisymmetric."""
    return f"""
pred {relation}({type_name}, {type_name});
rule {relation}_reflexive {{ if x: {type_name}; then {relation}(x, x); }}
rule {relation}_transitive {{ if {relation}(x, y); if {relation}(y, z); then {relation}(x, z); }}
rule {relation}_antisymmetric {{ if {relation}(x, y); if {relation}(y, x); then x = y; }}
"""
