"""BK-trees over 64-bit fingerprints, for linking rather than for listing neighbours."""

from __future__ import annotations

from collections.abc import Iterator


class LinkTree:
    """Children are keyed by their integer Hamming distance to the parent.

    A node under the edge e differs from the parent in exactly e bits.  So once a fingerprint is within the radius
    of a node, everything under that node's edges up to the radius is already linked to the node, and so to the
    fingerprint: those subtrees need no visit.  That keeps dense groups of near copies from costing all their pairs.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def neighbours(self, x: int) -> Iterator[int]:
        """Nodes within the radius, enough of them to join ``x`` to every class that it touches."""
        if not self.prints:
            return
        radius, prints, children, stack = self.radius, self.prints, self.children, [0]
        while stack:
            at = stack.pop()
            d = (prints[at] ^ x).bit_count()
            low = d - radius
            if low <= 0:
                yield at
                low = radius + 1
            high = d + radius
            stack += [child for edge, child in children[at].items() if low <= edge <= high]

    def insert(self, x: int) -> int:
        """Position of ``x``, which must not be in the tree yet."""
        new = len(self.prints)
        self.prints.append(x)
        self.children.append({})
        at = 0
        while new:
            edge = (self.prints[at] ^ x).bit_count()
            after = self.children[at].setdefault(edge, new)
            if after == new:
                break
            at = after
        return new


class Classes:
    """Union-find over what one task sees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def shard_links(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join each class among ``members`` and ``queries`` (those between two queries left out)."""
    tree, classes, links = LinkTree(radius), Classes(), []
    for x in members:
        links += [(x, tree.prints[n]) for n in tree.neighbours(x) if classes.join(x, tree.prints[n])]
        tree.insert(x)
    for x in queries:
        links += [(x, tree.prints[n]) for n in tree.neighbours(x) if classes.join(x, tree.prints[n])]
    return links
