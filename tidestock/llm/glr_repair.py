"""Weighted repair of role sequences by a generalised LR parser.

A small SLR table is built from the grammar of roles. Stacks of the parser are a graph: a node is a
state on top of a node, and equal stacks are one node, whichever edits led to it. For each row the
parser keeps, deletes or reroles it, and it may insert roles anywhere; each way moves a stack to another. The frontier
holds for every reached node only the least (cost, audit), where the audit is the edits' initials in order.
Costs are compared before audits, and of equal costs no audit is the beginning of another (rows and
edits of equal cost are equally many), so the least at every node gives the least at the end.

A role grammar must keep its stacks shallow (repetition by left recursion, no nesting); it then has few
nodes, and insertions come to an end. The repair of a piece of a conversation is a table from the node
before it to every node after it, and tables of pieces compose. So a long conversation is cut into
pieces that are parsed apart, and only tables are folded.

Terminals are single letters, the initials of roles.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
END = "$"

#: Productions of a conversation: maybe a system row, then pairs of user and assistant; or nothing.
TURNS = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))

# What an edit costs, the roles that rows may be given, and what an untouched fault costs.
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}

#: More stacks than any grammar of roles needs.
MOST_NODES = 1000

Best = tuple[int, str]
Frontier = dict[int, Best]


class Table:
    """SLR(1) actions of a grammar; the first production's left side is the start symbol."""

    def __init__(self, productions: tuple[tuple[str, str], ...]):
        self.rules = [("", productions[0][0]), *productions]
        self.heads = {head for head, _ in productions}
        self.terminals = {s for _, body in productions for s in body} - self.heads
        follow = self._follow()
        states, self.moves = [self._closed({(0, 0)})], {}
        for at, items in enumerate(states):
            for symbol in sorted({self.rules[r][1][dot] for r, dot in items if dot < len(self.rules[r][1])}):
                core = {(r, dot + 1) for r, dot in items if self.rules[r][1][dot : dot + 1] == symbol}
                to = self._closed(core)
                if to not in states:
                    states.append(to)
                self.moves[at, symbol] = states.index(to)
        self.reduces: dict[tuple[int, str], list[int]] = {}
        for at, items in enumerate(states):
            for r, dot in sorted(items):
                if r and dot == len(self.rules[r][1]):
                    for symbol in follow[self.rules[r][0]]:
                        self.reduces.setdefault((at, symbol), []).append(r)
        self.accepting = self.moves[0, productions[0][0]]

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        todo = list(items)
        while todo:
            r, dot = todo.pop()
            head = self.rules[r][1][dot : dot + 1]
            for k, (left, _) in enumerate(self.rules):
                if head and left == head and (k, 0) not in items:
                    items = items | {(k, 0)}
                    todo.append((k, 0))
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        """What may come after each head, by repetition until nothing is added."""
        empty = set()
        while new := {h for h, body in self.rules if h not in empty and all(s in empty for s in body)}:
            empty |= new
        first = {t: {t} for t in self.terminals} | {h: set() for h, _ in self.rules}
        follow = {h: set() for h, _ in self.rules}
        follow[""].add(END)
        size = -1
        while size != (size := sum(map(len, first.values())) + sum(map(len, follow.values()))):
            for head, body in self.rules:
                after = set(follow[head])
                for s in reversed(body):
                    if s in self.heads:
                        follow[s] |= after
                    after = first[s] | (after if s in empty else set())
                for s in body:
                    first[head] |= first[s]
                    if s not in empty:
                        break
        return follow


class Parser:
    """The graph of stacks: node 0 is the empty stack; a node has a state and the node below."""

    def __init__(self, productions: tuple[tuple[str, str], ...] = TURNS, costs: dict[str, int] | None = None, fault: int = TRUNCATED, roles: str = "ua"):
        self.table, self.costs, self.fault, self.roles = Table(productions), costs or COSTS, fault, roles
        self.state, self.below = [0], [-1]
        self._node: dict[tuple[int, int], int] = {}
        self._after: dict[tuple[int, str], tuple[int, ...]] = {}
        self.nodes()  # numbers all nodes in one order, so that tasks agree on them

    def node(self, state: int, below: int) -> int:
        key = state, below
        if key not in self._node:
            self._node[key] = len(self.state)
            self.state.append(state)
            self.below.append(below)
        return self._node[key]

    def _reduced(self, top: int, symbol: str) -> set[int]:
        """The node and all nodes that reductions before `symbol` make of it."""
        found, todo = {top}, [top]
        while todo:
            at = todo.pop()
            for rule in self.table.reduces.get((self.state[at], symbol), ()):
                head, body = self.table.rules[rule]
                low = at
                for _ in body:
                    low = self.below[low]
                new = self.node(self.table.moves[self.state[low], head], low)
                if new not in found:
                    found.add(new)
                    todo.append(new)
        return found

    def after(self, top: int, symbol: str) -> tuple[int, ...]:
        """The nodes that a stack becomes when `symbol` is taken; none if it does not fit."""
        key = top, symbol
        if key not in self._after:
            shifts = self.table.moves
            self._after[key] = tuple(
                self.node(shifts[self.state[n], symbol], n)
                for n in sorted(self._reduced(top, symbol))
                if symbol in self.table.terminals and (self.state[n], symbol) in shifts
            )
        return self._after[key]

    def accepts(self, top: int) -> bool:
        return any(self.state[n] == self.table.accepting and self.below[n] == 0 for n in self._reduced(top, END))

    def nodes(self) -> list[int]:
        """All stacks that any sequence leads to."""
        found = [0]
        for at in found:
            for symbol in sorted(self.table.terminals):
                found += [n for n in self.after(at, symbol) if n not in found]
            if len(found) > MOST_NODES:
                raise ValueError("the stacks of this grammar grow without end")
        return found

    def inserted(self, frontier: Frontier) -> Frontier:
        """The frontier and what insertions make of it, cheapest first."""
        cost, todo = self.costs[INSERT], sorted(frontier)
        while todo:
            more = []
            for at in todo:
                c, audit = frontier[at]
                new = (c + cost, audit + INSERT)
                for symbol in self.roles:
                    for to in self.after(at, symbol):
                        if to not in frontier or new < frontier[to]:
                            frontier[to] = new
                            more.append(to)
            todo = more
        return frontier

    def step(self, frontier: Frontier, initial: str, kind: str) -> Frontier:
        """The frontier after one row of the given initial; kind "x" must go, "t" is truncated."""
        made: Frontier = {}
        gone, rest = self.costs[DELETE], self.fault if kind == "t" else 0
        for at, (c, audit) in frontier.items():
            new = (c + gone, audit + DELETE)
            if at not in made or new < made[at]:
                made[at] = new
            if kind == "x":
                continue
            for to in self.after(at, initial):
                new = (c + rest + self.costs[KEEP], audit + KEEP)
                if to not in made or new < made[to]:
                    made[to] = new
            for symbol in self.roles:
                for to in self.after(at, symbol):
                    new = (c + rest + self.costs[REROLE], audit + REROLE)
                    if to not in made or new < made[to]:
                        made[to] = new
        return self.inserted(made)

    def run(self, frontier: Frontier, rows: Iterable[tuple[str, str]]) -> Frontier:
        for initial, kind in rows:
            frontier = self.step(frontier, initial, kind)
        return frontier

    def best(self, frontier: Frontier) -> tuple[Best, int]:
        """The least (cost, audit) of the complete stacks, and its node."""
        return min((best, at) for at, best in frontier.items() if self.accepts(at))

    def start(self) -> Frontier:
        return self.inserted({0: (0, "")})

    def solve(self, rows: Iterable[tuple[str, str]]) -> Best:
        return self.best(self.run(self.start(), rows))[0]

    def table_of(self, rows: list[tuple[str, str]]) -> dict[int, Frontier]:
        """What a piece does: from each node before it the least way to every node after it.

        Insertions before a piece belong to what is before it, so that ways of pieces join without
        being counted twice.
        """
        return {at: self.run({at: (0, "")}, rows) for at in self.nodes()}

    def expected(self, top: int) -> str:
        """The role that a reroled or inserted row takes on this stack: the one that fits."""
        return next((s for s in self.roles if self.after(top, s)), "")


@lru_cache(maxsize=4)
def parser() -> Parser:
    return Parser()


@lru_cache(maxsize=1 << 16)
def _short(initials: tuple[str, ...], kinds: str) -> Best:
    return parser().solve(zip(initials, kinds))


def solved(initials: tuple[str, ...], kinds: str) -> Best:
    """The repair of a whole conversation; the shapes of short ones recur."""
    return _short(initials, kinds) if len(kinds) <= 32 else parser().solve(zip(initials, kinds))


def fold(frontier: Frontier, table: dict[int, Frontier]) -> tuple[Frontier, dict[int, int]]:
    """The frontier after a piece, and for each node after it the node before it on the least way."""
    made: Frontier = {}
    came: dict[int, int] = {}
    for before, (cost, audit) in frontier.items():
        for at, (c, more) in table[before].items():
            new = (cost + c, audit + more)
            if at not in made or new < made[at]:
                made[at], came[at] = new, before
    return made, came


def applied(rows: Iterable[tuple[str, str]], audit: str, before: int = 0) -> list[tuple[str, str]]:
    """(role, text) of what a repair leaves of (role, text) rows, from the stack `before` them."""
    p, out, at = parser(), [], before
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rows)
        if edit == DELETE:
            continue
        symbol = role[:1] if edit == KEEP else p.expected(at)
        out.append((role if edit == KEEP else ROLES[symbol], text))
        at = p.after(at, symbol)[0]
    return out


def opening(at: int) -> list[tuple[str, str]]:
    """The rows inserted before the first one on the way from the empty stack to `at`."""
    p, ways = parser(), {0: []}
    todo = [0]
    for node in todo:
        for symbol in p.roles:
            for to in p.after(node, symbol):
                if to not in ways:
                    ways[to] = [*ways[node], (ROLES[symbol], "")]
                    todo.append(to)
    return ways[at]
