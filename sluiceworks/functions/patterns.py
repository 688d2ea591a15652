"""What can be told of the allowlist patterns without running them."""

from __future__ import annotations

import re

from . import vocab as V


def heads(pattern: str) -> list[str] | None:
    """Words of which one must stand in the lower-cased text for the pattern to match: those of the first group of each branch. None where
    a branch begins otherwise, or its group holds another one."""
    found = []
    for branch in re.split(r"\|(?=\^)", pattern):
        group = re.match(r"(?:\\b)?\(([^()]*)\)|\^?([a-z ]+)", branch)
        if not group:
            return None
        for word in (group.group(1) or group.group(2)).split("|"):
            literal = re.match(r"[^\\.?*+\[\]]*", word).group()
            found.append(literal[:-1] if word[len(literal) :].startswith(("?", "*")) else literal)
    return sorted(set(found)) if all(found) else None


#: By the name of a pattern; a pattern that is not here has no such words.
HEADS: dict[str, list[str]] = {name: found for name, _, pattern, _ in V.PATTERNS if (found := heads(pattern))}
#: Patterns all of whose branches end in a question mark at the end of the text.
ASKS = {name for name, _, pattern, _ in V.PATTERNS if all(b.endswith(r"\?" + V.END) for b in re.split(r"\|(?=\^)", pattern))}
