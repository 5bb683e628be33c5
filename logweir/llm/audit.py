"""Persistent audit DP: the cheapest edits that give a conversation a legal order of roles.

Edits are written K (keep), D (delete), R (give another role) and I (insert).
The roles' initials have to read ``(s?(ua)+)?``, which four states tell. The
cheapest edits up to each row and state are kept as one node of a tree: an edit,
the node before it, and ancestors at doubling distances with hashes of the
whole path, so that paths share their beginnings and an extension costs
O(log n). Of two paths of equal cost the one with the lesser edits wins: their
longest common prefix is found by lifting both while the hashes differ, and the
next edits decide. A prefix that the hashes call common is verified edit by
edit down to the node that both paths share.

A stretch of rows is a table from the state before to the state after, each
cell with its cost and edits, so stretches are solved apart and joined later
in the same way: a long conversation needn't lie in one task. An insertion
counts to the row after it, so no cell's edits are a prefix of another's from
the same state, and comparing stretch by stretch compares the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

STATES = 4
#: After nothing, after s, after u, after a; where u, a and s lead, else None.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ENDS = (0, 3)
RIGHT = ("u", "u", "a", "u")  # the role that is due in each state
FULL = {"u": "user", "a": "assistant"}
KEEP, ROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
MOD, BASE = (1 << 61) - 1, 1_000_003


class Paths:
    """Append-only tree of paths of small integers; node 0 is the empty path."""

    def __init__(self) -> None:
        self.mark, self.depth, self.hash = [-1], [0], [0]
        self.up: list[list[int]] = [[]]

    def add(self, node: int, mark: int) -> int:
        self.mark.append(mark)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + mark + 1) % MOD)
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(ups)
        return len(self.mark) - 1

    def at_depth(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's path comes before b's; of two where one begins the other, the shorter does."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self.at_depth(a, depth), self.at_depth(b, depth)
        first = None  # the marks where the paths part, the earliest found
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            first = self.mark[x], self.mark[y]
            x, y = self.up[x][0], self.up[y][0]
        while x != y:  # equal hashes: verified, as marks may differ all the same
            if self.mark[x] != self.mark[y]:
                first = self.mark[x], self.mark[y]
            x, y = self.up[x][0], self.up[y][0]
        return self.depth[a] < self.depth[b] if first is None else first[0] < first[1]

    def path(self, node: int) -> list[int]:
        marks = []
        while node:
            marks.append(self.mark[node])
            node = self.up[node][0]
        return marks[::-1]


Cell = tuple[int, int]  # cost and node


def _better(paths: Paths, new: Cell, old: Cell | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and paths.less(new[1], old[1])


def _inserted(paths: Paths, cells: list[Cell | None]) -> list[Cell | None]:
    """cells with insertions before the next row. Three in a row lead to no new state."""
    cells = list(cells)
    for _ in range(STATES - 1):
        for s in range(STATES):
            if cells[s]:
                to = AFTER[RIGHT[s]][s]
                cost = cells[s][0] + INSERT
                if cells[to] is None or cost <= cells[to][0]:
                    new = cost, paths.add(cells[s][1], ord("I"))
                    if _better(paths, new, cells[to]):
                        cells[to] = new
    return cells


def _rows(paths: Paths, start: int, rows: Iterable[tuple[str, str]]) -> list[Cell | None]:
    cells: list[Cell | None] = [(0, 0) if s == start else None for s in range(STATES)]
    for initial, fault in rows:
        cells = _inserted(paths, cells)
        new: list[Cell | None] = [None] * STATES
        for s in range(STATES):
            if cells[s] is None:
                continue
            cost, node = cells[s]
            ways = [(s, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                more = CUT if fault == "truncated" else 0
                kept = AFTER[initial][s] if initial in AFTER else None
                if kept is not None:
                    ways.append((kept, KEEP + more, "K"))
                ways.append((AFTER[RIGHT[s]][s], ROLE + more, "R"))
            for to, price, edit in ways:
                if new[to] is None or cost + price <= new[to][0]:
                    cell = cost + price, paths.add(node, ord(edit))
                    if _better(paths, cell, new[to]):
                        new[to] = cell
        cells = new
    return cells


def stretch(rows: Sequence[tuple[str, str]], starts: Iterable[int] = range(STATES)) -> dict[tuple[int, int], tuple[int, str, int]]:
    """(state before, state after) to (cost, edits, rank among the edits from that state) for rows of (initial, fault)."""
    told = {}
    for start in starts:
        paths = Paths()
        cells = _rows(paths, start, rows)
        ends = [(to, *cell) for to, cell in enumerate(cells) if cell]
        edits = {to: "".join(map(chr, paths.path(node))) for to, _, node in ends}
        ranks = {to: sum(paths.less(other, node) for _, _, other in ends) for to, _, node in ends}
        told |= {(start, to): (cost, edits[to], ranks[to]) for to, cost, _ in ends}
    return told


def ending(state: int) -> str:
    """Insertions that bring a conversation to its end."""
    return {0: "", 1: "II", 2: "I", 3: ""}[state]


def joined(stretches: Sequence[dict[tuple[int, int], tuple[int, int]]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of the whole, and each stretch's states before and after, for stretches of (cost, rank) by those states."""
    paths = Paths()
    cells: list[Cell | None] = [(0, 0), None, None, None]
    for table in stretches:
        new: list[Cell | None] = [None] * STATES
        for (before, to), (cost, rank) in table.items():
            if cells[before] and (new[to] is None or cells[before][0] + cost <= new[to][0]):
                cell = cells[before][0] + cost, paths.add(cells[before][1], (rank * STATES + before) * STATES + to)
                if _better(paths, cell, new[to]):
                    new[to] = cell
        cells = new
    best = None
    for state, cell in enumerate(cells):
        if cell and _better(paths, done := (cell[0] + INSERT * len(ending(state)), cell[1]), best):
            best = done
    return best[0], [(mark // STATES % STATES, mark % STATES) for mark in paths.path(best[1])]


def replayed(state: int, roles: Sequence[str], edits: str) -> list[tuple[str, int | None, str | None]]:
    """(edit, row or None, new role or None) of each edit, deleted rows too; the role of a kept row is None."""
    told, k = [], 0
    for edit in edits:
        due = RIGHT[state]
        if edit == "I":
            told.append((edit, None, FULL[due]))
        else:
            told.append((edit, k, FULL[due] if edit == "R" else None))
            k += 1
        if edit != "D":
            state = AFTER[roles[k - 1][:1] if edit == "K" else due][state]
    return told
