"""Encoding of a whole corpus with a public tokenizer.

The method: a streaming transducer. Text comes in blocks and is cut into pre-tokens; a pre-token is fed to
the transducer byte by byte. The last token of every prefix follows from the one before by the merge list:
it is the longest token that ends there and that the merges leave apart from the last token of what lies
before it. A later token reaches back no further than the longest token is long, which is the merge list's
sufficient lookahead; as soon as all prefixes within it go back through one place, the tokens up to there
are emitted and forgotten. So memory is constant, however long a pre-token or a text. A pre-token that
runs over the end of a block goes on with the next one. Encodings of short pre-tokens, and the pairs of
tokens that merges leave apart, are remembered, in tables that are emptied when full. Decoding feeds token
bytes to an incremental UTF-8 machine. No tokenizer library takes part; the tests compare with one.

Defined results: null, and empty text, give an empty list of ids; ids never contain special tokens;
ties and repeated rows give equal lists; further columns are not looked at.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeloom.runtime import spread

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Characters taken at a time; the longest pre-token that is remembered; entries of a table of what is remembered.
BLOCK, SHORT, REMEMBERED = 1 << 16, 32, 1 << 18
#: Fixed value: the published pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """How far back, in bytes, a later token can reach: the length of the longest token."""
    return max(map(len, ranks))


class Transducer:
    """Encodes a stream of text blocks; keeps only what a later block can still change."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, block: int = BLOCK):
        import regex

        self.pattern, self.pieces = pattern, regex.compile(pattern)
        self.runs = tuple(regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*"))
        self.ranks, self.block, self.short = ranks, max(block, 3), min(block, SHORT)  # no contraction is longer than three
        self.reach = sufficient_lookahead(ranks)
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            sizes.setdefault(token[-2:], set()).add(len(token))
        #: By the two bytes that a token of two bytes or more ends with: how long such tokens are, the longest first.
        self.sizes = {end: sorted(of, reverse=True) for end, of in sizes.items() if len(end) == 2}
        self.known: dict[str, array] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    @cached_property
    def coder(self):
        """A library's encoder of the same vocabulary, for comparison."""
        import tiktoken

        return tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        ids = array("i")
        self.encode_into(text, ids)
        return ids.tolist()

    def encode_into(self, text: str | None, ids: array) -> None:
        """The ids of a text that is here whole: one pre-token after the other."""
        if text:
            self._pieces((m[0] for m in self.pieces.finditer(text)) if len(text) > self.block else self.pieces.findall(text), ids)

    def encode_stream(self, blocks: Iterable[str]) -> list[int]:
        """The ids of a text that comes in blocks."""
        ids = array("i")
        for part in self.encode_blocks(blocks):
            ids.extend(part)
        return ids.tolist()

    def encode_blocks(self, blocks: Iterable[str]) -> Iterator[array]:
        """Ids as soon as they are final.

        A pre-token is final once two characters stand behind it: one ends a run, two decide on a contraction. One that
        is longer than a block is fed to the transducer as it comes.
        """
        held, stream, run = "", None, None
        for block in blocks:
            held, ids = held + block, array("i")
            if stream is not None:
                end = self._run_end(run, held)
                done = end + 2 <= len(held)
                keep = end if done else len(held) - 2
                ids.extend(stream.feed(held[:keep].encode()))
                held = held[keep:]
                if done:
                    ids.extend(stream.close())
                    stream = None
            if stream is None:
                pieces, at = [], 0
                for m in self.pieces.finditer(held):
                    if m.end() + 2 > len(held):
                        break
                    pieces.append(m[0])
                    at = m.end()
                self._pieces(pieces, ids)
                held = held[at:]
                if len(held) > self.block + 2:
                    run = next(r for r in self.runs if r.match(held, len(held) - 2).end() > len(held) - 2)
                    stream = Prefixes(self)
                    ids.extend(stream.feed(held[:-2].encode()))
                    held = held[-2:]
            yield ids
        ids = array("i")
        if stream is not None:
            end = self._run_end(run, held)
            ids.extend(stream.feed(held[:end].encode()))
            ids.extend(stream.close())
            held = held[end:]
        self._pieces(self.pieces.findall(held), ids)
        yield ids

    def _run_end(self, run, text: str) -> int:
        """Where a run that goes on in the text ends; its last blank belongs to a word that follows."""
        end = run.match(text).end()
        return end - 1 if run is self.runs[3] and end < len(text) else end

    def _pieces(self, pieces: Iterable[str], ids: array) -> None:
        known, take = self.known.get, ids.extend
        for piece in pieces:
            got = known(piece)
            if got is None:
                got = array("i")
                for part in self.encode_bytes(piece.encode()):
                    got.extend(part)
                if len(piece) <= self.short:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[piece] = got
            take(got)

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave these two tokens apart when they meet."""
        key = (left, right)
        held = self.fits.get(key)
        if held is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            held = self.fits[key] = self._merged(left + right) == [left, right]
        return held

    def _merged(self, data: bytes) -> list[bytes]:
        """What the merge list makes of a few bytes, one merge after the other, the first in the list first."""
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while any(r is not None for r in pairs):
            best = min(r for r in pairs if r is not None)
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1])
        return parts

    def encode_bytes(self, piece: Iterable[int]) -> Iterator[list[int]]:
        """Ids of one pre-token given as bytes, emitted once no longer token can change them."""
        stream = Prefixes(self)
        for byte in piece:
            if ids := stream.feed((byte,)):
                yield ids
        if ids := stream.close():
            yield ids


class Prefixes:
    """The last token of every prefix of one pre-token that may still change."""

    def __init__(self, of: Transducer):
        self.of, self.window = of, bytearray()  # the bytes not yet emitted
        self.start = self.end = 0  # their places
        self.last: dict[int, bytes] = {}  # the last token of the prefix that ends at a place

    def feed(self, data: Iterable[int]) -> list[int]:
        ids: list[int] = []
        ranks, sizes, apart, last, window, limit = self.of.ranks, self.of.sizes, self.of.apart, self.last, self.window, 4 * self.of.reach
        for byte in data:
            window.append(byte)
            self.end = end = self.end + 1
            start, token = self.start, bytes(window[-1:])
            for size in sizes.get(bytes(window[-2:]), ()) if end - start > 1 else ():
                if size > end - start:
                    continue
                token = bytes(window[end - start - size :])
                if token in ranks and ((before := last.get(end - size)) is None or apart(before, token)):
                    break
                token = b""
            last[end] = token or bytes(window[-1:])
            if end - start >= limit and (stable := self._agreed()) > start:
                ids += self._chain(stable)
                del window[: stable - start]
                for place in range(start, stable):
                    last.pop(place, None)
                self.start = stable
        return ids

    def close(self) -> list[int]:
        return self._chain(self.end) if self.end > self.start else []

    def _agreed(self) -> int:
        """The last place that all prefixes within a longest token's reach go back through."""
        open_ = set(range(self.end - self.of.reach + 1, self.end + 1))
        for place in range(self.end, self.start, -1):
            if len(open_) == 1:
                break
            if place in open_:
                open_.remove(place)
                open_.add(place - len(self.last[place]))
        return min(open_)

    def _chain(self, end: int) -> list[int]:
        ids, at = [], end
        while at > self.start:
            ids.append(self.of.ranks[self.last[at]])
            at -= len(self.last[at])
        return ids[::-1]


def decode(ids: Iterable[int], vocabulary: dict[int, bytes]) -> Iterator[str]:
    """Text pieces as their bytes complete characters."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for token in ids:
        if piece := machine.decode(vocabulary[token]):
            yield piece
    if rest := machine.decode(b"", True):
        yield rest


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, out): the ids of every document, one row for every row."""
    path = f"{folder}/{vocabulary}"
    schema = T.StructType([docs.schema[key], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(load_ranks(path))
        for batch in batches:
            ids, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                transducer.encode_into(text, ids)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    return spread(docs.select(key, text)).mapInArrow(run, schema)
