"""Byte-level BPE by a lazily determinised transducer, and streaming decoding (operator 3).

Encoding.  Within one pre-token the tokens of every prefix end in exactly one last token that goes
with the token before it (merging the two tokens' bytes gives the two back).  The segmentations of
the bytes read so far are therefore paths through the vocabulary trie, one per place where a token
may have ended.  The deterministic machine's state holds these paths: the tokens each has chosen
since the paths split, and its trie node.  Tokens that all paths share are emitted, so a token
leaves after a bounded lookahead.  States and transitions are built when first met.  Once ``MAX_STATES`` are
held, new ones serve their pre-token only, and all are dropped when as many transitions have come and
gone: texts of one kind keep their states, texts of another get their own.  So memory is bounded whatever the
texts are; time is linear in the bytes, also for pre-tokens without end.

Decoding.  Token bytes pass through a UTF-8 state machine that carries an unfinished character (up
to 3 bytes) from one token, and from one call, to the next; malformed bytes give U+FFFD.

Defined results: a null text is an empty one and gives no ids; ids that are unknown raise.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import only_tables_of, ship

#: Bounds of the tables that grow with the texts; each is emptied when full.
MAX_STATES, MAX_WORDS, MAX_PAIRS = 250_000, 500_000, 300_000
MAX_SPINES = 20_000
#: Rows that leave a task at once.
ROWS = 500


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Pre-token bytes in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: dict[int, int] = {}  # node -> id
        nodes, parents = 1, set()
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                parents.add(node)
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = nodes
                    nodes += 1
            self.token_at[node] = rank
        self.inner = parents
        # the tokens below a node are neighbours in the order of their bytes
        self.sorted = array("I", [ranks[b] for b in sorted(ranks)])
        self.low, self.high = array("I", [0]) * nodes, array("I", [0]) * nodes
        for place, rank in enumerate(self.sorted):
            node = 0
            for b in self.bytes_of[rank]:
                node = self.child[node << 8 | b]
                if not self.high[node]:  # a node's own token comes first and is not below it
                    self.low[node] = place + (self.token_at.get(node) == rank)
                self.high[node] = place + 1
        self.leading: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple | None] = {}
        # do ranks rise along merges? then one look at the edges decides; else the bytes are merged
        self.rising = all(max(x[1] for x in s[:-1]) <= rank and all(p[1] <= q[1] for p, q in zip(s, s[1:]))
                          for rank in ranks.values() if (both := self._edges(rank)) for s in both if len(s) > 1)
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        # states with other tokens before them have the same paths, which are held once
        self.same_paths: dict[tuple, tuple[int, tuple]] = {}
        self.number: dict[int, int] = {}  # number of the paths and token before them -> state
        # what full tables take in for one pre-token only, and how many moves that has been
        self.passing: list[tuple[dict, int | tuple]] = []
        self.passed = 0
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # state * 256 + byte -> state, tokens
        self.ends: dict[int, tuple[int, ...]] = {}
        self.start = self._state(-1, (((), 0),))

    def _state(self, last: int, paths: tuple) -> int:
        full = len(self.states) > self.max_states
        held = self.same_paths.get(paths)
        if held is None:
            held = self.same_paths[paths] = len(self.same_paths), paths
            if full:
                self.passing.append((self.same_paths, paths))
        key = held[0] << 20 | last + 1
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append((last, held[1]))
            if full:
                self.passing.append((self.number, key))
        return at

    def _let_pass(self) -> None:
        """Full tables keep what they hold and drop what came since; all goes once as many moves have been dropped as are held."""
        if self.passed > len(self.moves):
            self._forget()
            return
        for table, key in self.passing:
            del table[key]
        self.passing.clear()
        for at in range(self.max_states + 1, len(self.states)):
            self.ends.pop(at, None)
        del self.states[self.max_states + 1:]

    def merge(self, data: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank until none are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[tuple, tuple] | None:
        """(bytes, rank at which it is absorbed) of the parts that ever stood at the left and at the right edge of a token.

        None for a token that its own bytes do not merge to.
        """
        data = self.bytes_of[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        left, right = [[parts[0], 1 << 30]], [[parts[-1], 1 << 30]]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                return None
            if at == 0:
                left[-1][1] = rank
                left.append([parts[0] + parts[1], 1 << 30])
            if at == len(parts) - 2:
                right[-1][1] = rank
                right.append([parts[-2] + parts[-1], 1 << 30])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return tuple(map(tuple, left)), tuple(map(tuple, right))

    def _spines(self, token: int) -> tuple[tuple, tuple] | None:
        known = self.spines.get(token, 0)
        if known == 0:
            if len(self.spines) >= MAX_SPINES:
                self.spines.clear()
            known = self.spines[token] = self._edges(token)
        return known

    def fits(self, left: int, right: int) -> bool:
        """Does ``right`` follow ``left`` (-1: nothing) without a merge across their border?

        Ranks rise along every chain of merges, so ranks are points in time: a pair of edge parts
        merges across the border if its rank comes before either part is absorbed on its own side.
        At equal ranks the place further left goes first.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            a, b = left >= 0 and self._spines(left), self._spines(right)
            if b is None or a is None:
                known = False
            elif left < 0:
                known = True
            elif not self.rising:
                known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            else:
                known = self._apart(a[1], b[0])
            self.pairs[key] = known
        return known

    def _apart(self, left_spine: tuple, right_spine: tuple) -> bool:
        rank = self.ranks.get
        for x, x_end in left_spine:
            for y, y_end in right_spine:
                at = rank(x + y)
                if at is not None and at < x_end and at <= y_end:
                    return False
        return True

    def leads(self, left: int, node: int) -> bool:
        """Can a path that stands at an inner ``node`` after the token ``left`` still end in a token?

        Without this test most paths would be dead ends, and states that differ only in them would not coincide.
        """
        if left < 0 or not self.rising:
            return True
        key = left << 20 | node
        known = self.leading.get(key)
        if known is None:
            if len(self.leading) >= MAX_PAIRS:
                self.leading.clear()
            spine, apart = self._spines(left)[1], self._apart
            below = (self._spines(self.sorted[i]) for i in range(self.low[node], self.high[node]))
            known = self.leading[key] = any(apart(spine, s[0]) for s in below if s is not None)
        return known

    def _move(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, paths = self.states[at]
        alive, whole = [], None
        for chosen, node in paths:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at.get(node)
            if whole is None and token is not None and self.fits(chosen[-1] if chosen else last, token):
                whole = (*chosen, token)
            if node in self.inner and self.leads(chosen[-1] if chosen else last, node):
                alive.append((chosen, node))
        if whole is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((whole, 0))
        shared = 0
        for tokens in zip(*(chosen for chosen, _ in alive)):
            if len(set(tokens)) > 1:
                break
            shared += 1
        out = alive[0][0][:shared]
        move = (self._state(out[-1] if out else last, tuple((chosen[shared:], node) for chosen, node in alive)), out)
        self.moves[at << 8 | byte] = move
        if len(self.states) > self.max_states:
            self.passing.append((self.moves, at << 8 | byte))
            self.passed += 1
        return move

    def feed(self, at: int, data: bytes, out: list[int]) -> int:
        """Read bytes from state ``at``; append the tokens that are settled; the new state."""
        moves = self.moves
        for b in data:
            move = moves.get(at << 8 | b) or self._move(at, b)
            at = move[0]
            if move[1]:
                out.extend(move[1])
        return at

    def finish(self, at: int) -> tuple[int, ...]:
        """The tokens that are still open when the pre-token ends in state ``at``."""
        end = self.ends.get(at)
        if end is None:
            end = self.ends[at] = next((chosen for chosen, node in self.states[at][1] if node == 0), ())
        return end

    def encode(self, data: bytes) -> list[int]:
        out: list[int] = []
        at = self.start
        for i in range(0, len(data), 4096):
            if self.passing:
                here = self.states[at]
                self._let_pass()
                at = self._state(*here)
            at = self.feed(at, data[i:i + 4096], out)
        out.extend(self.finish(at))
        if self.passing:
            self._let_pass()
        return out


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern with the classes written out for the first 256 characters, which the standard module matches faster.

    None if the pattern uses classes other than letters, numbers and white space.
    """
    import regex

    members = {c: "".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s")}
    members[r"\S"] = "^" + members[r"\s"]
    # inside brackets a class is its members; alone it needs brackets of its own
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((c for c in members if pattern.startswith(c, i)), None)
        if name:
            if inside and name == r"\S":
                return None
            out.append(members[name] if inside else f"[{members[name]}]")
            i += len(name)
            continue
        if pattern[i] == "\\" and pattern[i + 1:i + 2].isalpha():
            return None
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


class Words(dict):
    """Ids of pre-tokens; those of an unknown one are made when asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        return self.make(word)


class Encoder:
    """Texts to ids; remembers the ids of common pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer, self.split = Transducer(ranks), regex.compile(pattern)
        self.split_latin = latin_pattern(pattern)
        self.words = Words(self.word)

    def word(self, word: str) -> bytes:
        ids = array("I", self.transducer.encode(word.encode("utf-8"))).tobytes()
        if len(word) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self._pieces(text)))

    def _pieces(self, text: str) -> Iterable[str]:
        split = self.split
        try:
            text.encode("latin-1")
            split = self.split_latin or split
        except UnicodeEncodeError:
            pass
        # a list is faster; beyond a million characters the matches are taken one by one
        return split.findall(text) if len(text) <= 1_000_000 else (m[0] for m in split.finditer(text))


#: UTF-8 by ranges: state, first byte, last byte, next state.  States: 0 between characters; 1 to 3 so
#: many plain continuation bytes to come; 4 to 7 after E0, ED, F0 and F4, whose next byte has less room.
UTF8_RULES = [
    (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7),
    (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
]
UTF8 = {(state, byte): to for state, low, high, to in UTF8_RULES for byte in range(low, high + 1)}


def utf8_step(state: int, pending: bytes, data: bytes) -> tuple[int, bytes, str]:
    """Read ``data`` after the unfinished bytes ``pending``; new state, unfinished bytes, finished text."""
    out = []
    for b in data:
        to = UTF8.get((state, b))
        if to is None and state:  # the character breaks off; this byte may begin another
            out.append("�")
            state, pending = 0, b""
            to = UTF8.get((0, b))
        if to is None:
            out.append("�")
        elif to == 0:
            out.append((pending + bytes([b])).decode("utf-8"))
            state, pending = 0, b""
        else:
            state, pending = to, pending + bytes([b])
    return state, pending, "".join(out)


class Decoder:
    """Ids to text, in as many calls as one likes."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.whole: dict[int, str] = {}  # tokens that begin and end between characters
        for i, b in bytes_of.items():
            state, _, text = utf8_step(0, b"", b)
            if state == 0 and "�" not in text:
                self.whole[i] = text
        self.reset()

    def reset(self) -> None:
        self.state, self.pending = 0, b""

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        out, at = [*map(self.whole.get, ids), None], 0
        # only tokens that begin or end inside a character go through the state machine
        while at < len(ids):
            if not self.state:
                at = out.index(None, at)
                if at == len(ids):
                    break
            self.state, self.pending, out[at] = utf8_step(self.state, self.pending, self.bytes_of[ids[at]])
            at += 1
        return "".join(out[:-1])

    def decode(self, raw: bytes) -> str:
        """The whole text of ids as :meth:`Encoder.encode` gives them."""
        self.reset()
        ids = array("I")
        ids.frombytes(raw)
        return self.feed(ids) + self.finish()

    def finish(self) -> str:
        rest = "�" if self.state else ""
        self.reset()
        return rest


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder({i: b for b, i in load_ranks(path).items()})


def forget_tables() -> None:
    encoder.cache_clear()
    decoder.cache_clear()


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with the column ``out`` that ``make()`` computes from ``column``, a few hundred rows at a time."""
    ship(df.sparkSession)
    place = df.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("bpe", forget_tables)
        f = make()
        arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = pa.array([f(x.as_py()) for x in part.column(place)], type=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with their ids as little-endian unsigned 32-bit integers in one binary column."""
    def make():
        own = encoder(path, pattern)
        return lambda t: own.encode(t or "")

    return _mapped(docs, text, out, T.BinaryType(), make)


def decoded(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of a binary id column."""
    def make():
        own = decoder(path)

        return lambda raw: own.decode(raw or b"")

    return _mapped(docs, ids, out, T.StringType(), make)


def digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """The ``keep`` columns, n_tokens, and the digests of the ids and of the bytes decoded from them (and the ids).

    Encoder and decoder share a worker, so the tables are held once and ids and texts need not leave it.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keep, "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("bpe", forget_tables)
        enc, dec = encoder(path, pattern), decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, texts = [], []
                for x in part.column(len(keep)):
                    ids.append(enc.encode(x.as_py() or ""))
                    texts.append(hashlib.sha256(dec.decode(ids[-1]).encode("utf-8")).hexdigest())
                made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(texts, pa.string()), *([pa.array(ids, pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return rows.mapInArrow(run, schema)
