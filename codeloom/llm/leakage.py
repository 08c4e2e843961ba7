"""Evaluation texts leaking into training text.

The method: a generalised suffix automaton over the words of all test items. Training words are
streamed through it and the longest match that ends at each word is tracked; matches of ``n`` words
or more are leaks of every item that holds their last ``n`` words. Before that, a filter over whole
batches drops stretches in which some three words in a row stand in no item, which no match can
cross; it loses nothing.

Words are runs of letters and digits, lower-cased, after invisible characters are removed. Defined
results: null and empty texts leak nothing; items of fewer than ``n`` words cannot leak; repeated
rows and items count once; further columns are not looked at.

The items are read by the driver in blocks of at most ``BLOCK_WORDS`` words; each block makes one
automaton and one pass over the documents, so any number of items will do. A worker process builds the
automaton of a block once and keeps it for its further tasks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.runtime import spread

#: Words of test items that one automaton holds at most.
BLOCK_WORDS = 500_000
WORD = re.compile(r"[^\W_]+")
INVISIBLE = re.compile("[​‌‍­﻿]")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(INVISIBLE.sub("", text).lower()) if text else []


class Automaton:
    """A suffix automaton over several word lists."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.n = n
        self.codes: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        grams: set[int] = set()
        for item, words in items:
            last = 0
            row = [self.codes.setdefault(w, len(self.codes) + 1) for w in words]
            for code in row:
                last = self._extend(last, code, owners)
                owners[last].add(item)
            grams.update((a << 42) | (b << 21) | c for a, b, c in zip(row, row[1:], row[2:]))
        self.triples = np.array(sorted(grams), dtype=np.int64)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            owners[self.link[state]] |= owners[state]
        #: The items that hold the last n words of a match that ends in the state.
        self.items: list[tuple[int, ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            if self.length[state] >= n:
                above = self.link[state]
                self.items[state] = self.items[above] if self.length[above] >= n else tuple(sorted(owners[state]))

    def _extend(self, last: int, code: int, owners: list[set[int]]) -> int:
        step, link, length = self.step, self.link, self.length
        if code in step[last]:
            there = step[last][code]
            return there if length[there] == length[last] + 1 else self._split(last, code, there, owners)
        new = self._state(length[last] + 1, {}, owners)
        at = last
        while at >= 0 and code not in step[at]:
            step[at][code] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            there = step[at][code]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, code, there, owners)
        return new

    def _state(self, length: int, step: dict[int, int], owners: list[set[int]]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        owners.append(set())
        return len(self.link) - 1

    def _split(self, at: int, code: int, there: int, owners: list[set[int]]) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[there]), owners)
        self.link[copy], self.link[there] = self.link[there], copy
        while at >= 0 and self.step[at].get(code) == there:
            self.step[at][code] = copy
            at = self.link[at]
        return copy

    def stream(self, codes) -> Iterator[tuple[int, int, int]]:
        """(place, longest match that ends there, state) of each word of a known vocabulary."""
        state = matched = 0
        for place, code in enumerate(codes):
            while state and code not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            if code in self.step[state]:
                state = self.step[state][code]
                matched += 1
            else:
                matched = 0
            yield place, matched, state

    def stretches(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, end) of the parts in which every three words in a row stand in some item."""
        if len(codes) < self.n or not len(self.triples):
            return
        triple = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        at = np.searchsorted(self.triples, triple)
        at[at == len(self.triples)] = 0
        known = np.concatenate([[False], self.triples[at] == triple, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start + 2 >= self.n:
                yield start, end + 2

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of each match of n words or more that cannot go on."""
        for start, end in self.stretches(codes):
            held = None
            for place, matched, state in self.stream(codes[start:end].tolist()):
                if held and matched <= held[1] - held[0]:
                    yield held
                    held = None
                if matched >= self.n:
                    held = (start + place + 1 - matched, start + place + 1, state)
            if held:
                yield held

    def leaks(self, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The places of the n-word matches of each item, as (start, end)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for start, end in self.stretches(codes):
            for place, matched, state in self.stream(codes[start:end].tolist()):
                if matched >= self.n:
                    stop = start + place + 1
                    for item in self.items[state]:
                        spans = found.setdefault(item, [])
                        if spans and stop - self.n <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], stop)
                        else:
                            spans.append((stop - self.n, stop))
        return found


def _blocks(items: DataFrame, key: str, text: str, n: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.select(key, text).dropna().distinct().orderBy(key).toLocalIterator():
        words = words_of(row[1])
        if len(words) < n:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


_kept: dict[str, Automaton] = {}


def _automaton(mark: str, block: list[tuple[int, list[str]]], n: int) -> Automaton:
    """The automaton of a block, as this process has built it; the one of another block makes room."""
    if mark not in _kept:
        _kept.clear()
        _kept[mark] = Automaton(block, n)
    return _kept[mark]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 13) -> DataFrame:
    """(key, item_key, longest, leaked_words, words): each document with each item that it leaks.

    longest is the longest leaked span in words, leaked_words the words in any span of the item.
    """
    key_type, item_type = docs.schema[key], items.schema[item_key]
    schema = T.StructType([key_type, T.StructField(item_key, item_type.dataType), T.StructField("longest", T.IntegerType()), T.StructField("leaked_words", T.IntegerType()), T.StructField("words", T.IntegerType())])
    session, result = docs.sparkSession, None
    for block in _blocks(items, item_key, item_text, n):
        shared, mark = session.sparkContext.broadcast(block), uuid.uuid4().hex  # bounded by BLOCK_WORDS

        def run(batches: Iterator[pa.RecordBatch], shared=shared, mark=mark) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(mark, shared.value, n)
            code = automaton.codes.get
            for batch in batches:
                keys, items_, longest, covered, sizes = [], [], [], [], []
                lists = [words_of(t) for t in batch.column(1).to_pylist()]
                for at, words in enumerate(lists):
                    if len(words) < n:
                        continue
                    codes = np.fromiter((code(w, 0) for w in words), np.int64, len(words))
                    for item, spans in automaton.leaks(codes).items():
                        keys.append(at)
                        items_.append(item)
                        longest.append(max(b - a for a, b in spans))
                        covered.append(sum(b - a for a, b in spans))
                        sizes.append(len(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(items_), pa.array(longest, pa.int32()), pa.array(covered, pa.int32()), pa.array(sizes, pa.int32())] if keys else [batch.column(0).slice(0, 0), pa.array([], pa.int64()), *[pa.array([], pa.int32())] * 3],
                    names=schema.names,
                )

        part = spread(docs.filter(F.length(text) >= 2 * n - 1).select(key, text)).mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return session.createDataFrame([], schema) if result is None else result.distinct()


def scrub(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", n: int = 13, coverage: float = 0.5) -> DataFrame:
    """Documents without the leaked spans; null text where they cover more than ``coverage`` of the words.

    A null text stays null. Spans are cut from the first character of their first word to the last of their last.
    """
    result = docs
    for block in _blocks(items, item_key, item_text, n):
        shared, mark = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, mark=mark):
            automaton = _automaton(mark, shared.value, n)
            code = automaton.codes.get
            for batch in batches:
                place = batch.schema.get_field_index(text)
                clean = [_without(t, automaton, code, coverage) for t in batch.column(place).to_pylist()]
                yield batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

        result = result.mapInArrow(run, docs.schema)
    return result


#: As WORD, but invisible characters may stand inside; their removal joins what they part.
_LOOSE = re.compile("[^\\W_](?:[​‌‍­﻿]*[^\\W_])*")


def _without(text: str | None, automaton: Automaton, code, coverage: float) -> str | None:
    if not text:
        return text
    at = [m.span() for m in _LOOSE.finditer(text)]
    words = [INVISIBLE.sub("", text[a:b]).lower() for a, b in at]
    codes = np.fromiter((code(w, 0) for w in words), np.int64, len(words))
    drop = sorted(span for spans in automaton.leaks(codes).values() for span in spans)
    if not drop:
        return text
    gone, out, done = 0, [], 0
    merged = [list(drop[0])]
    for a, b in drop[1:]:
        if a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        gone += b - a
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return None if gone > coverage * len(words) else "".join([*out, text[done:]])
