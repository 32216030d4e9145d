"""CSS selectors as SQL predicates over a node array.

Covers what the source registry and the field rules use: tag, ``.class``,
``#id``, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]``, descendants and commas.
Predicates are SQL text: one page rule holds dozens of them, and text reaches
Catalyst in a single call.
"""
from __future__ import annotations

import re

_PIECE = re.compile(
    r"""(?P<tag>^[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""",
    re.VERBOSE,
)


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def attr(node: str, name: str) -> str:
    return f"try_element_at({node}.attrs, {quoted(name)})"


def inside(node: str, box: str) -> str:
    """``node`` is a descendant of ``box``."""
    return f"({node}.i > {box}.i AND {node}.i <= {box}.end)"


def _compound(step: str, n: str) -> str:
    tests, at = [], 0
    for m in _PIECE.finditer(step):
        if m.start() != at:
            break
        at = m.end()
        if m["tag"]:
            tests.append(f"{n}.tag = {quoted(m['tag'].lower())}")
        elif m["cls"]:
            tests.append(f"array_contains({n}.classes, {quoted(m['cls'])})")
        elif m["id"]:
            tests.append(f"{n}.id = {quoted(m['id'])}")
        elif m["op"] == "=":
            tests.append(f"({attr(n, m['attr'])} <=> {quoted(m['value'])})")
        elif m["op"] == "*=":
            tests.append(f"coalesce(contains({attr(n, m['attr'])}, {quoted(m['value'])}), false)")
        else:
            tests.append(f"{attr(n, m['attr'])} IS NOT NULL")
    if at != len(step) or not tests:
        raise ValueError(f"selector not supported: {step!r}")
    return " AND ".join(tests)


def predicate(nodes: str, selector: str, n: str = "n") -> str:
    """Condition on lambda variable ``n``; ``nodes`` supplies the ancestors."""
    paths = []
    for path in selector.split(","):
        steps = path.split()
        test = _compound(steps[-1], n)
        inner = n
        # The last step is tested first, so ancestors are searched for few nodes.
        closing = ""
        for step in reversed(steps[:-1]):
            outer = inner + "p"
            test += f" AND exists({nodes}, {outer} -> {inside(inner, outer)} AND {_compound(step, outer)}"
            closing += ")"
            inner = outer
        paths.append(f"({test}{closing})")
    return " OR ".join(paths)


def select(nodes: str, selector: str, ancestors: str | None = None) -> str:
    """All matches in document order."""
    return f"filter({nodes}, n -> {predicate(ancestors or nodes, selector)})"


def first(array: str) -> str:
    return f"get({array}, 0)"


def node_text(node: str) -> str:
    """All text under ``node``; NULL without a node."""
    return f"substring(text, {node}.start + 1, {node}.stop - {node}.start)"
