"""Cheapest edits that give a conversation legal roles: bidirectional Dijkstra over the edit lattice.

A node is (turns read, state). Legal roles are ``(s?(ua)+)?`` by initials, so four states do:
nothing yet, after s, after u, after a. Letters of an audit and their costs: K keeps a turn, R
gives it the role user or assistant (1), D deletes it (2), I inserts an empty turn (5); a
truncated turn that is not deleted costs 5 more. From each state only one of u and a is legal, so
an audit settles all roles.

Labels are (cost, least audit). Two equally dear audits of one node are never prefixes of each
other (what the longer one has in addition would be inserts, which cost), so the least audit of a
path is made of least audits of its parts. Only K costs nothing, and it moves one turn on: with
the turn as second key of the heaps, a label is final when its node is taken.

Long conversations are cut into blocks of turns. Inserts count to the turn after them; then audits
of one block that end in different states are no prefixes of each other either, and the best end
of a block follows from the costs of what is behind it, before audits are compared.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states, and initials of turns: 0 is any other
FINE, DELETE, TRUNCATED = 0, 4, 8  # added to the initial of a turn
AFTER = {(EMPTY, SYSTEM): SYSTEM, (EMPTY, USER): USER, (SYSTEM, USER): USER, (ASSISTANT, USER): USER, (USER, ASSISTANT): ASSISTANT}
#: The role that an edited or inserted turn takes after each state.
GIVEN = (USER, USER, ASSISTANT, USER)
RELABEL_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
BLOCK_TURNS = 200


def edges_on(codes: bytes, node: tuple[int, int], trailing: bool) -> list[tuple[tuple[int, int], int, str]]:
    """(next node, cost, letter) of the edits after a node. Inserts after the last turn only if ``trailing``."""
    at, state = node
    out = []
    if at < len(codes):
        fault, initial = codes[at] & ~3, codes[at] & 3
        out.append(((at + 1, state), DELETE_COST, "D"))
        if fault != DELETE:
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            if (state, initial) in AFTER:
                out.append(((at + 1, AFTER[state, initial]), extra, "K"))
            out.append(((at + 1, AFTER[state, GIVEN[state]]), RELABEL_COST + extra, "R"))
    if at < len(codes) or trailing:
        out.append(((at, AFTER[state, GIVEN[state]]), INSERT_COST, "I"))
    return out


def edges_back(codes: bytes, node: tuple[int, int], trailing: bool) -> list[tuple[tuple[int, int], int, str]]:
    """(node before, cost, letter) of the edits that end in a node."""
    at, state = node
    before = [(at - 1, s) for s in range(4) if at] + [(at, s) for s in range(4)]
    return [(b, cost, letter) for b in before for n, cost, letter in edges_on(codes, b, trailing) if n == node]


class Side:
    """One of the two searches: its heap, its labels, and the nodes that are settled."""

    def __init__(self, sources: list[tuple[int, int]], forward: bool):
        self.forward, self.labels, self.settled, self.last = forward, {}, set(), 0
        self.heap: list[tuple[int, int, int]] = []
        for node in sources:
            self.offer(node, 0, "")

    def offer(self, node: tuple[int, int], cost: int, audit: str) -> None:
        known = self.labels.get(node)
        if known is None or cost < known[0]:
            heappush(self.heap, (cost, node[0] if self.forward else -node[0], node[1]))
        if known is None or (cost, audit) < known:
            self.labels[node] = (cost, audit)

    def top(self) -> int:
        """Cost of the next node; of the last one, when all are settled."""
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else self.last

    def take(self) -> tuple[int, int]:
        self.last, at, state = heappop(self.heap)
        self.settled.add((abs(at), state))
        return abs(at), state


@lru_cache(maxsize=50_000)
def search(codes: bytes, entry: int, goals: tuple[int, ...], trailing: bool) -> tuple[int, str] | None:
    """Least (cost, audit) from the state ``entry`` before the first turn to one of ``goals`` after the last."""
    ahead, back = Side([(0, entry)], True), Side([(len(codes), g) for g in goals], False)
    best: tuple[int, str] | None = None
    while True:
        tops = ahead.top(), back.top()
        if not ahead.heap and not back.heap:
            return best
        # Beyond this sum no path of the best cost is left that has not been met; at equal cost the search goes on.
        if best is not None and min(tops) > 0 and sum(tops) > best[0]:
            return best
        side, other = (ahead, back) if ahead.heap and (not back.heap or tops[0] <= tops[1]) else (back, ahead)
        node = side.take()
        cost, audit = side.labels[node]
        crossings = [(cost + other.labels[node][0], audit + other.labels[node][1] if side is ahead else other.labels[node][1] + audit)] if node in other.settled else []
        for near, more, letter in (edges_on if side is ahead else edges_back)(codes, node, trailing):
            if near not in side.settled:
                side.offer(near, cost + more, audit + letter if side is ahead else letter + audit)
            if near in other.settled:
                rest, tail = other.labels[near]
                crossings.append((cost + more + rest, audit + letter + tail if side is ahead else tail + letter + audit))
        for found in crossings:
            best = found if best is None else min(best, found)


def cheapest(codes: bytes, block: int = BLOCK_TURNS) -> tuple[int, str]:
    """Cost and least audit of a whole conversation of any length."""
    blocks = [codes[i : i + block] for i in range(0, len(codes), block)] or [b""]
    rest: list[list[int | None]] = [[None] * 4 for _ in blocks]

    def ways(b: int, entry: int) -> list[tuple[int, str, int]]:
        """(cost to the end, audit of the block, its last state) of the ways through block b that can end."""
        if b + 1 == len(blocks):
            found = search(blocks[b], entry, (EMPTY, ASSISTANT), True)
            return [(*found, EMPTY)] if found else []
        ends = ((search(blocks[b], entry, (t,), False), t) for t in range(4) if rest[b + 1][t] is not None)
        return [(found[0] + rest[b + 1][t], found[1], t) for found, t in ends if found]

    for b in reversed(range(len(blocks))):
        rest[b] = [min((w[0] for w in ways(b, entry)), default=None) for entry in range(4)]
    audit, state = [], EMPTY
    for b in range(len(blocks)):
        _, part, state = min(ways(b, state))
        audit.append(part)
    return rest[0][EMPTY], "".join(audit)


def after(state: int, letter: str, initial: int = EMPTY) -> int:
    """The state after an edit of a turn with that initial."""
    return state if letter == "D" else AFTER[state, initial if letter == "K" else GIVEN[state]]
