"""A compressed trie over byte strings whose terminals hold the least id that was inserted there."""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes) -> int:
    """The number of leading bytes that two strings share, by halving what is still open."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is shared, a[:high] is not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    """Edges by their first byte, each with its whole label; ``least`` and ``items`` where a string ends."""

    __slots__ = ("edges", "items", "least")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.items: list | None = None
        self.least: int | None = None


class RadixTrie:
    """Insert (string, id, item); ``terminals`` gives each distinct string's least id and its items.

    A null id takes part in no minimum. An edge is split where a new string leaves it, so a passage that
    strings share is held once.
    """

    def __init__(self):
        self.root = Node()
        self.size = 0

    def insert(self, text: bytes, key: int | None, item) -> None:
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                leaf = Node()
                node.edges[text[at]] = (text[at:], leaf)
                self.size += len(text) - at
                node, at = leaf, len(text)
                break
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = common_prefix(label, text[at : at + len(label)])
            middle = Node()
            middle.edges[label[shared]] = (label[shared:], child)
            node.edges[text[at]] = (label[:shared], middle)
            node, at = middle, at + shared
        if node.items is None:
            node.items = []
        node.items.append(item)
        if key is not None and (node.least is None or key < node.least):
            node.least = key

    def terminals(self):
        """(string, least id, items) of every distinct string, depth first, without recursion."""
        open_nodes = [(b"", self.root)]
        while open_nodes:
            path, node = open_nodes.pop()
            if node.items is not None:
                yield path, node.least, node.items
            open_nodes += [(path + label, child) for label, child in node.edges.values()]
