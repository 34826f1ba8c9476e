"""The best one-to-one assignment in a sparse table of weights.

Starting from nothing, the assignment is changed along the path of
alternately new and given-up cells that gains most, until none gains. Each
path starts at the rows that are still free and is found by relaxing the
gains of a queue of rows, so empty cells are never looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable

#: Gains below this are rounding.
LEAST_GAIN = 1e-12


def best_assignment(cells: Iterable[tuple[Hashable, Hashable, float]]) -> dict[Hashable, tuple[Hashable, float]]:
    """Row -> (column, weight) of the assignment with the greatest total; cells without weight are left empty."""
    table: dict[Hashable, dict[Hashable, float]] = {}
    for row, column, weight in cells:
        if weight > 0:
            table.setdefault(row, {})[column] = weight
    holder: dict[Hashable, Hashable] = {}
    taken: dict[Hashable, tuple[Hashable, float]] = {}
    while True:
        gain = {row: 0.0 for row in table if row not in taken}
        came_from: dict[Hashable, tuple[Hashable, float]] = {}  # column -> row it would go to, gain there
        queue = deque(gain)
        waiting = set(gain)
        while queue:
            row = queue.popleft()
            waiting.discard(row)
            for column, weight in table[row].items():
                if row in taken and taken[row][0] == column:
                    continue
                now = gain[row] + weight
                if column in came_from and came_from[column][1] >= now - LEAST_GAIN:
                    continue
                came_from[column] = (row, now)
                other = holder.get(column)
                if other is not None:
                    left = now - taken[other][1]
                    if left > gain.get(other, float("-inf")) + LEAST_GAIN:
                        gain[other] = left
                        if other not in waiting:
                            waiting.add(other)
                            queue.append(other)
        ends = [(total, column) for column, (_, total) in came_from.items() if column not in holder]
        if not ends:
            return taken
        total, column = max(ends, key=lambda x: x[0])
        if total <= LEAST_GAIN:
            return taken
        while True:
            row = came_from[column][0]
            given_up = taken.get(row)
            taken[row], holder[column] = (column, table[row][column]), row
            if given_up is None:
                break
            column = given_up[0]


def best_total(cells: Iterable[tuple[Hashable, Hashable, float]]) -> float:
    """The greatest total weight of a one-to-one assignment."""
    return sum(w for _, w in best_assignment(cells).values())
