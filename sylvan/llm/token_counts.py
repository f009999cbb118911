"""Token counts that follow edits (operator 6).

A document is kept as its pre-tokens, in blocks of ``BLOCK`` to 2 ``BLOCK``, under a segment tree of
characters and tokens per block.  An edit re-splits only its surroundings: from the pre-token that
holds the second character before the edit (a pre-token's end depends on two characters after it
at most) until a new border falls on an old one behind the edit; from there on the split is as
before, because the pattern never looks back.  Only those pre-tokens are encoded, and only the sums
above their blocks are updated.

Defined results: a null text is an empty one; edits refer to the given text (code points), sorted and
disjoint; a document without edits keeps its count; repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import Encoder, encoder, forget_tables
from .common import only_tables_of, ship

BLOCK = 64
#: A border is settled once this many characters after it are known.
_AHEAD = 3


class PieceTree:
    """Pre-tokens of one document with the sums of characters and tokens over them."""

    def __init__(self, text: str, coder: Encoder):
        self.coder, self.encoded = coder, 0
        pieces = list(coder._pieces(text))
        self.blocks = [pieces[i:i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.sizes = [self._tokens(b) for b in self.blocks]
        self._build()
        self.encoded = 0  # from here on: pre-tokens encoded for edits

    def _tokens(self, pieces: list[str]) -> list[int]:
        known, word = self.coder.words.get, self.coder.word
        self.encoded += len(pieces)
        return [len(known(p) or word(p)) // 4 for p in pieces]

    def _build(self) -> None:
        n = 1
        while n < len(self.blocks):
            n *= 2
        self.leaves = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (b, s) in enumerate(zip(self.blocks, self.sizes)):
            self.chars[n + i], self.tokens[n + i] = sum(map(len, b)), sum(s)
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _find(self, at: int) -> tuple[int, int, int]:
        """Block, place in the block and first character of the pre-token that holds character ``at`` (the end: behind the last)."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            # empty subtrees and those that end before the character are passed
            if start + self.chars[node] <= at and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        block = node - self.leaves
        for i, p in enumerate(self.blocks[block]):
            if at < start + len(p):
                return block, i, start
            start += len(p)
        return block, len(self.blocks[block]), start

    def _from(self, block: int, place: int) -> Iterator[str]:
        for b in range(block, len(self.blocks)):
            yield from self.blocks[b][place if b == block else 0:]

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``end``."""
        block, place, first = self._find(max(0, start - 2))
        old, text, borders = self._from(block, place), "", []  # borders: ends of old pre-tokens, from ``first``
        ended = False

        def more(until: int) -> None:
            nonlocal text, ended
            parts, n = [text], len(text)
            while n < until and not ended:
                p = next(old, None)
                if p is None:
                    ended = True
                    break
                parts.append(p)
                n += len(p)
                borders.append(n)
            text = "".join(parts)

        a, z, reach = start - first, end - first, end - first + 16
        while True:
            more(reach)
            edited = text[:a] + new + text[z:]
            shift = len(new) - (z - a)
            pieces, at, behind, old_ends = [], 0, a + len(new), set(borders)
            stop = None
            for m in self.coder.split.finditer(edited):
                pieces.append(m[0])
                at = m.end()
                if at >= behind and (at <= len(edited) - _AHEAD or ended) and at - shift in old_ends and at - shift >= z:
                    stop = at - shift
                    break
            if stop is None and ended:
                stop = len(text)
            if stop is not None:
                break
            reach *= 2
        gone = borders.index(stop) + 1 if stop in borders else len(borders)
        self._splice(block, place, gone, pieces)

    def _splice(self, block: int, place: int, gone: int, pieces: list[str]) -> None:
        """Take ``gone`` pre-tokens away from a place on and put ``pieces`` there."""
        sizes, b, changed = self._tokens(pieces), block, [block]
        here = min(gone, len(self.blocks[b]) - place)
        self.blocks[b][place:place + here], self.sizes[b][place:place + here] = pieces, sizes
        gone -= here
        while gone:
            b += 1
            here = min(gone, len(self.blocks[b]))
            del self.blocks[b][:here], self.sizes[b][:here]
            gone -= here
            changed.append(b)
        if len(self.blocks[block]) > 2 * BLOCK:
            big, counts = self.blocks[block], self.sizes[block]
            self.blocks[block:block + 1] = [big[i:i + BLOCK] for i in range(0, len(big), BLOCK)]
            self.sizes[block:block + 1] = [counts[i:i + BLOCK] for i in range(0, len(counts), BLOCK)]
            self._build()
            return
        for b in changed:
            node = self.leaves + b
            self.chars[node], self.tokens[node] = sum(map(len, self.blocks[b])), sum(self.sizes[b])
            while node > 1:
                node //= 2
                self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]


Edits = list[tuple[int, int, str]]
_JUNK = re.compile(r"[#*$%&|<>]{2,}|[ ]{2,}")


def cleaning_edits(text: str) -> Edits:
    """Runs of two or more junk marks go, runs of blanks become one: (start, end, new text)."""
    return [(m.start(), m.end(), " " if m[0][0] == " " else "") for m in _JUNK.finditer(text)]


def edited(text: str, edits: Edits) -> str:
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def counted(docs: DataFrame, path: str, pattern: str, edits_of: Callable[[str], Edits] = cleaning_edits) -> DataFrame:
    """doc_id, n_edits, n_tokens_before, n_tokens_after, n_pretokens and n_reencoded of every document."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    names = ["n_edits", "n_tokens_before", "n_tokens_after", "n_pretokens", "n_reencoded"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("bpe", forget_tables)
        coder = encoder(path, pattern)

        def row(text: str) -> tuple:
            tree, edits = PieceTree(text, coder), edits_of(text)
            before, n = tree.n_tokens, sum(map(len, tree.blocks))
            for a, b, new in reversed(edits):  # from the end, so that earlier places stay
                tree.replace(a, b, new)
            return len(edits), before, tree.n_tokens, n, tree.encoded

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [row(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([f[i] for f in found], pa.int64()) for i in range(5)]], names=["doc_id", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names]]))
