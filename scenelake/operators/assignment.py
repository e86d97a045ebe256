"""One-to-one matching inside a task: a small helper for contested frames and per-sequence identities."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


def best_matching(edges: Iterable[tuple[Hashable, Hashable, float]]) -> dict[Hashable, Hashable]:
    """Left to right pairs of largest total weight; edges need positive weight.

    Grows the matching by the alternating path of largest gain until none gains anything. Ties go to
    the smaller ids, because edges are taken in sorted order and only a larger gain replaces a path.
    """
    graph: dict[Hashable, list[tuple[Hashable, float]]] = {}
    for left, right, weight in sorted(edges):
        graph.setdefault(left, []).append((right, weight))
    weight_of = {(left, right): w for left, out in graph.items() for right, w in out}
    owner: dict[Hashable, Hashable] = {}
    taken: dict[Hashable, Hashable] = {}
    while True:
        gain = {left: 0.0 for left in graph if left not in taken}
        reach: dict[Hashable, tuple[float, Hashable]] = {}
        changed = bool(gain)
        while changed:
            changed = False
            for left in sorted(gain):
                for right, weight in graph[left]:
                    if taken.get(left) == right:
                        continue
                    value = gain[left] + weight
                    if value > reach.get(right, (0.0, None))[0] + 1e-12:
                        reach[right] = (value, left)
                        if right in owner:
                            back = value - weight_of[owner[right], right]
                            if back > gain.get(owner[right], float("-inf")) + 1e-12:
                                gain[owner[right]] = back
                                changed = True
        ends = [(value, right) for right, (value, _) in reach.items() if right not in owner]
        # A path may also end by setting a matched left side free, when what it gives up is worth less.
        frees = [(value, left) for left, value in gain.items() if left in taken]
        best_end = max(ends, key=lambda e: e[0], default=(0.0, None))
        best_free = max(frees, key=lambda e: e[0], default=(0.0, None))
        if max(best_end[0], best_free[0]) <= 1e-12:
            return taken
        if best_end[0] >= best_free[0]:
            right = best_end[1]
        else:
            right = taken.pop(best_free[1])
            owner.pop(right)
        while right is not None:
            left = reach[right][1]
            onward = taken.get(left)
            taken[left], owner[right] = right, left
            right = onward
