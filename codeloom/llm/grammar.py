"""A small generalised LL recogniser with a graph-structured stack."""

from __future__ import annotations

from collections.abc import Callable, Sequence

#: A rule's alternatives; each is a row of symbols: names of rules, or tests on one token.
Grammar = dict[str, tuple[tuple[object, ...], ...]]


class Recogniser:
    """All places where a rule can end that begins at a place, for any context-free grammar.

    A node of the stack is a rule begun at a place; its edges are the places to go on at. A rule that
    is called again where it already runs shares the node, and gets the ends found so far.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def ends(self, rule: str, tokens: Sequence[str], at: int = 0) -> set[int]:
        grammar, size = self.grammar, len(tokens)
        root = (rule, at)
        callers: dict[tuple[str, int], list[tuple[tuple, int, tuple[str, int]]]] = {root: []}
        done: dict[tuple[str, int], set[int]] = {root: set()}
        seen: set[tuple] = set()
        todo: list[tuple[tuple, int, tuple[str, int], int]] = [(row, 0, root, at) for row in grammar[rule]]
        while todo:
            item = todo.pop()
            if item in seen:
                continue
            seen.add(item)
            row, dot, node, place = item
            while dot < len(row):
                symbol = row[dot]
                if callable(symbol):
                    if place < size and symbol(tokens[place]):
                        dot += 1
                        place += 1
                        continue
                    break
                if symbol not in grammar:
                    if place < size and tokens[place] == symbol:
                        dot += 1
                        place += 1
                        continue
                    break
                below = (symbol, place)
                if below not in callers:
                    callers[below], done[below] = [], set()
                    todo.extend((r, 0, below, place) for r in grammar[symbol])
                callers[below].append((row, dot + 1, node))
                todo.extend((row, dot + 1, node, end) for end in done[below])
                break
            else:
                if place not in done[node]:
                    done[node].add(place)
                    todo.extend((r, d, n, place) for r, d, n in callers[node])
        return done[root]


def one_of(*words: str) -> Callable[[str], bool]:
    held = frozenset(words)
    return lambda token: token in held


def none_of(*words: str) -> Callable[[str], bool]:
    held = frozenset(words)
    return lambda token: token not in held
