"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what is still equal there."""

from __future__ import annotations

from collections.abc import Sequence

#: Bytes beyond the common start that multikey quicksort looks at.
SHALLOW = 12


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix of a and b, which agree in the first start bytes."""
    most = min(len(a), len(b))
    if a[start:most] == b[start:most]:
        return most
    low, high = start, most  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Strings by the bytes at which they branch; a search looks at no others, and one comparison finds the true branch."""

    __slots__ = ("root", "strings")

    def __init__(self, strings: Sequence[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            depth, children = node
            at = s[depth] if depth < len(s) else -1
            node = children[at] if at in children else next(iter(children.values()))
        other = self.strings[node[0]]
        agree = common(s, other)
        if agree == len(s) == len(other):
            node.append(i)
            return
        parent, edge, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < agree:
            at = s[node[0]] if node[0] < len(s) else -1
            parent, edge, node = node, at, node[1][at]
        mine, theirs = s[agree] if agree < len(s) else -1, other[agree] if agree < len(other) else -1
        if isinstance(node, tuple) and node[0] == agree:
            node[1][mine] = [i]
            return
        new = (agree, {theirs: node, mine: [i]})
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def walk(self, order: list[int], shared: list[int], first: int) -> None:
        """Appends the strings in order and what each shares with the one before; first is for the first."""
        stack: list = [(self.root, first)]
        while stack:
            node, before = stack.pop()
            if isinstance(node, list):
                order.extend(node)
                shared.append(before)
                shared.extend([len(self.strings[node[0]])] * (len(node) - 1))
            else:
                depth, children = node
                keys = sorted(children, reverse=True)
                for k in keys:
                    stack.append((children[k], depth if k != keys[-1] else before))


def sort(strings: Sequence[bytes], start: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, shared): indices of strings in order, and the length of the prefix each shares with the one before (0 for the first).

    All strings agree in their first start bytes.
    """
    order: list[int] = []
    shared: list[int] = []
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), start, 0)] if strings else []
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            shared.append(before)
            continue
        if depth >= start + shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            trie.walk(order, shared, before)
            continue
        symbols = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted((symbols[0], symbols[len(symbols) // 2], symbols[-1]))[1]
        less = [i for i, c in zip(group, symbols, strict=True) if c < pivot]
        same = [i for i, c in zip(group, symbols, strict=True) if c == pivot]
        more = [i for i, c in zip(group, symbols, strict=True) if c > pivot]
        if more:
            stack.append((more, depth, depth))
        if same:
            first = depth if less else before
            if pivot < 0:  # ended: equal strings
                stack.extend(([i], depth, depth) for i in reversed(same[1:]))
                stack.append((same[:1], depth, first))
            else:
                stack.append((same, depth + 1, first))
        if less:
            stack.append((less, depth, before))
    return order, shared
