"""A trie of path rules, walked once for each path (A3, A4)."""

from __future__ import annotations

import re
from collections.abc import Iterable

# The literal text at the front of a name's pattern: plain and quoted characters.
FRONT = r"^((?:\\.|[^\\.\[\]{}()+^$|*?])*)"
# Kinds of a rule's segments: a literal name, a pattern for one name, any number of folders.
LITERAL, GLOB, DEEP = "literal", "glob", "deep"


class Node:
    """What may follow a run of segments, and the rules that end there.

    ``ends`` match the path that ends here, ``below`` also every path beneath. Patterns
    stand under the literal text they begin with.
    """

    __slots__ = ("names", "globs", "deep", "ends", "below")

    def __init__(self):
        self.names: dict[str, Node] = {}
        self.globs: dict[str, dict[str, tuple[re.Pattern, Node]]] = {}
        self.deep: Node | None = None
        self.ends: list[int] = []
        self.below: list[int] = []


class RuleTrie:
    """Rules that start alike share their nodes, so a path meets each common start once.

    A walk follows the literal name of each segment by one look-up and tests those
    patterns at the nodes it reaches that begin as the name does: its cost depends on the path and on
    the rules near it, not on the number of rules or maps.
    """

    def __init__(self):
        self.root = Node()

    def add(self, rule: int, segments: Iterable[tuple[str, str]], whole: bool) -> None:
        """``whole`` rules name a file or folder and match everything beneath it, too."""
        node = self.root
        for kind, text in segments:
            if kind == LITERAL:
                node = node.names.setdefault(text, Node())
            elif kind == GLOB:
                front = re.sub(r"\\(.)", r"\1", re.match(FRONT, text, re.DOTALL)[1], flags=re.DOTALL)
                alike = node.globs.setdefault(front, {})
                if text not in alike:
                    alike[text] = re.compile(text, re.DOTALL), Node()
                node = alike[text][1]
            else:
                node.deep = node.deep or Node()
                node = node.deep
        (node.below if whole else node.ends).append(rule)

    def matches(self, path: str) -> set[int]:
        names = [s for s in path.split("/") if s]
        found: set[int] = set()
        seen: set[tuple[int, int]] = set()
        todo = [(self.root, 0)]
        while todo:
            node, at = todo.pop()
            if (id(node), at) in seen:
                continue
            seen.add((id(node), at))
            found.update(node.below)
            if at == len(names):
                found.update(node.ends)
                continue
            name = names[at]
            if name in node.names:
                todo.append((node.names[name], at + 1))
            if node.globs:
                todo += [(then, at + 1) for n in range(len(name) + 1)
                         for test, then in node.globs.get(name[:n], {}).values() if test.fullmatch(name)]
            if node.deep is not None:
                todo += [(node.deep, i) for i in range(at, len(names))]
        return found
