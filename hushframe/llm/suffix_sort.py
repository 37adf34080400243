"""Deep-shallow sorting of byte strings with their common prefixes.

Multikey quicksort on digits of eight bytes orders strings down to a shallow depth; groups that still agree there
are ordered by a blind trie: it branches on single bytes, is descended without comparing, and needs one comparison
with one of its strings to find where a new one belongs.
"""

from __future__ import annotations

SHALLOW = 24
DIGIT = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """Inner nodes are [depth, children by byte]; a leaf is a list of the positions of one string; -1 is its end."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = (len(s), None, [i])
            return
        node = self.root
        while node[1] is not None:  # blind: only the branching bytes are looked at
            depth, children, _ = node
            byte = s[depth] if depth < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[2][0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node[2].append(i)
            return
        above, key, node = None, None, self.root
        while node[1] is not None and node[0] < shared:
            above, key = node, s[node[0]]
            node = node[1][key]
        byte = s[shared] if shared < len(s) else -1
        leaf = (len(s), None, [i])
        if node[1] is not None and node[0] == shared:
            node[1][byte] = leaf
            return
        fork = (shared, {(other[shared] if shared < len(other) else -1): node, byte: leaf}, None)
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Positions in order, and each one's common prefix with the one before it."""
        order, shared, stack = [], [], [(self.root, 0)]
        while stack:
            (depth, children, here), before = stack.pop()
            if children is None:
                order += here
                shared += [before] + [depth] * (len(here) - 1)
            else:
                keys = sorted(children)
                stack += [(children[k], depth if k != keys[0] else before) for k in reversed(keys)]
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before it (0 for the first)."""
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if not group:
            continue
        if len(group) == 1:
            found, inner = group, [0]
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            found, inner = trie.ordered()
        else:
            digits = [strings[i][depth:depth + DIGIT] for i in group]
            pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
            less = [i for i, d in zip(group, digits) if d < pivot]
            equal = [i for i, d in zip(group, digits) if d == pivot]
            more = [i for i, d in zip(group, digits) if d > pivot]
            if len(pivot) < DIGIT:  # the strings end here: equal ones are equal whole
                stack += [(more, depth), *[([i], depth) for i in reversed(equal)], (less, depth)]
            else:
                stack += [(more, depth), (equal, depth + DIGIT), (less, depth)]
            continue
        inner[0] = common_prefix(strings[order[-1]], strings[found[0]]) if order else 0
        order += found
        shared += inner
    return order, shared
