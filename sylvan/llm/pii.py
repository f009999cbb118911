"""Personal data: four exact base patterns and a semi-Markov conditional random field (operator 7).

The base patterns give e-mail addresses, IP addresses, card numbers and phone numbers.  The random
field looks at islands: stretches of text around "@" or digits.  An island is cut into short pieces
(letters, digits, single marks); a candidate segment is a run of at most ``MAX_PIECES`` of them and is
scored as a whole by its features (digits, check digit, number of dots, edges, words before it).
Dynamic programming over piece borders and kinds picks segments and kinds together; entities are
bounded, so the time is linear in the text.

The field is trained on islands of ``SAMPLE_DOCS`` documents of usual length with the base matches as labels, by
stochastic gradient ascent of the conditional log-likelihood (forward-backward over segments).  It
then finds what the patterns miss because they drop a failing match without another try: a card
number next to other digits, an address inside a longer dotted number, a bracketed "[at]".  A found
segment is added if it beats leaving it out by ``MARGIN`` nats and overlaps no base span.

Defined results: a null text is an empty one without spans; a corpus without any island gives a
field that adds nothing; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only_tables_of, ship

KINDS = ("email", "ip", "card", "phone")
#: Bounds of training, and of an entity in pieces.
SAMPLE_DOCS, SAMPLE_ISLANDS, EPOCHS, MAX_PIECES = 1500, 600, 4, 24
SAMPLE_CHARS = 20_000
MARGIN = 3.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that starts inside a run of digits would also have started at its beginning
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start.  Linear in the text."""
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        # a part of very many digits needs no conversion
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_TAIL = re.compile(r"[A-Za-z0-9.-]*(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)*")
_AT = re.compile(r"@| ?[\[(]at[\])] ?")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[0-9 ().+-]*[0-9])?")
_PIECE = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)
_CUES = {"mail": "email", "email": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "tel": "phone", "phone": "phone", "call": "phone", "fax": "phone", "mobile": "phone"}


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that may hold an entity: around "@" or a bracketed "at", and runs of 4 digits or more with separators."""
    if "@" in text or "at]" in text or "at)" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            tail = _TAIL.match(text, m.end())
            if start < m.start() and tail.end() > m.end():
                yield start, tail.end()
                end = tail.end()
    for m in _NUMBERS.finditer(text):
        if len(_DIGIT.findall(m[0])) >= 4:
            yield m.start(), m.end()


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text, start, end)]


def _edge(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else " "
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in ".-+@_%" else "mark"


def features(text: str, start: int, end: int) -> list[str]:
    """What is true of the segment as a whole."""
    s = text[start:end]
    digits = "".join(_DIGIT.findall(s))
    n = len(digits)
    out = [f"left {_edge(text, start - 1)}", f"right {_edge(text, end)}"]
    before = text[max(0, start - 12):start].lower().rstrip(" :=#")
    cue = next((k for w, k in _CUES.items() if before.endswith(w)), None)
    if cue:
        out.append(f"cue {cue}")
    plain = re.sub(r" ?[\[(]dot[\])] ?", ".", re.sub(r" ?[\[(]at[\])] ?", "@", s))
    if "@" in plain:
        host = plain.rpartition("@")[2]
        out.append("address" if plain.count("@") == 1 and re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", plain) else "address broken")
        out.append("host ends in letters" if re.search(r"\.[A-Za-z]{2,}$", host) else "host ends otherwise")
        return out
    if re.search("[A-Za-z]", s):
        return [*out, "letters"]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        out.append("four parts in range" if all(len(p) <= 3 and int(p) <= 255 for p in s.split(".")) else "four parts")
    elif "." in s:
        out.append("dots")
    if re.fullmatch(r"[0-9]([ -]?[0-9])+", s):
        good = 16 <= n <= 19 and luhn(digits)
        out.append("check digit good" if good else "check digit bad" if 16 <= n <= 19 else "plain number")
        if re.fullmatch(r"([0-9]{4}[ -]?){3,4}[0-9]{0,4}", s):
            out.append("groups of four good" if good else "groups of four")
    if s[0] == "+":
        out.append("plus with 8 to 15 digits" if 8 <= n <= 15 and re.fullmatch(r"\+[0-9][ ().0-9-]+[0-9]", s) else "plus")
    out.append(f"digits {min(n, 20) if n < 8 or n > 15 else '8 to 15'}")
    return out


def candidates(text: str, cuts: list[tuple[int, int]]) -> dict[tuple[int, int], list[str]]:
    """Segments (first piece, end piece) that could be an entity, with their features."""
    out = {}
    for i, (start, _) in enumerate(cuts):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        for j in range(i + 1, min(len(cuts), i + MAX_PIECES) + 1):
            end = cuts[j - 1][1]
            if not text[end - 1].isalnum():
                continue
            s = text[start:end]
            if "@" in s or "at" in s or len(_DIGIT.findall(s)) >= 4:
                out[i, j] = features(text, start, end)
    return out


class Field:
    """Weights by (kind, feature) and by (kind before, kind)."""

    def __init__(self, weights: dict | None = None):
        self.w = defaultdict(float, weights or {})

    def score(self, kind: str, found: list[str]) -> float:
        return self.w[kind, "bias"] + sum(self.w[kind, f] for f in found)

    def _by_end(self, spans: dict, n: int) -> list[list[tuple[int, str, float]]]:
        """For each end: (begin, kind, score); a single piece outside all entities scores 0."""
        ends: list[list] = [[] for _ in range(n + 1)]
        for (i, j), found in spans.items():
            for kind in KINDS:
                ends[j].append((i, kind, self.score(kind, found)))
        return ends

    def best(self, spans: dict, n: int) -> list[tuple[int, int, str, float]]:
        """Highest-scoring choice of disjoint segments: (first, end, kind, score).

        An entity must be followed by a piece outside or the end, so kinds need no state of their own.
        """
        ends = self._by_end(spans, n)
        top, back = [0.0] + [0.0] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            top[j], back[j] = top[j - 1], None
            for i, kind, score in ends[j]:
                if top[i] + score > top[j]:
                    top[j], back[j] = top[i] + score, (i, kind, score)
        out, j = [], n
        while j:
            if back[j]:
                i, kind, score = back[j]
                out.append((i, j, kind, score))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, spans: dict, n: int, gold: dict[tuple[int, int], str], rate: float, decay: float) -> None:
        """One gradient step: features of the labelled segments minus their expectation."""
        ends = self._by_end(spans, n)
        forward = [0.0] + [-math.inf] * n
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[i] + s for i, _, s in ends[j])])
        backward = [-math.inf] * n + [0.0]
        begins: list[list] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for i, kind, s in ends[j]:
                begins[i].append((j, s))
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[j] + s for j, s in begins[i])])
        step: dict = defaultdict(float)
        for j in range(n + 1):
            for i, kind, s in ends[j]:
                p = math.exp(forward[i] + s + backward[j] - forward[n])
                delta = (gold.get((i, j)) == kind) - p
                if abs(delta) > 1e-6:
                    step[kind, "bias"] += delta
                    for f in spans[i, j]:
                        step[kind, f] += delta
        for key, g in step.items():
            self.w[key] += rate * (g - decay * self.w[key])


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))


def trained(texts: list[str], most: int = SAMPLE_ISLANDS, epochs: int = EPOCHS) -> Field:
    """A field that tells the base matches in ``texts`` from the rest of their islands."""
    data = []
    for text in texts:
        base = {(a, b): k for k, a, b in base_spans(text)}
        for start, end in islands(text):
            if len(data) >= most:
                break
            cuts = pieces(text, start, end)[:200]
            spans = candidates(text, cuts)
            gold = {(i, j): base[cuts[i][0], cuts[j - 1][1]] for i, j in spans if (cuts[i][0], cuts[j - 1][1]) in base}
            # a phone number and a card number may share a stretch: keep the first in order of kinds
            if spans:
                data.append((spans, len(cuts), gold))
    field = Field()
    for epoch in range(epochs):
        for spans, n, gold in data:
            field.learn(spans, n, gold, 0.3 / (1 + epoch), 1e-3)
    return field


def sample(docs: DataFrame, size: int = SAMPLE_DOCS) -> list[str]:
    """``size`` texts at most of up to ``SAMPLE_CHARS`` characters with an "@" or 8 digits near each other, chosen by a hash of id and text."""
    t = F.col("text")
    usual = docs.filter((t.contains("@") | t.rlike("[0-9][0-9 .()-]{6,}[0-9]")) & (F.length(t) <= SAMPLE_CHARS)).select(t.alias("t"), F.xxhash64("doc_id", t).alias("h"))
    n = usual.count()
    if n > 4 * size:
        # twice the sample by hash first, so that what the tasks return does not grow with their number
        usual = usual.filter(F.col("h") < int(-(1 << 63) + (1 << 64) * (2 * size / n)))
    return [r["t"] for r in usual.orderBy("h", "t").limit(size).collect()]


def fitted(docs: DataFrame) -> Field:
    return trained(sample(docs))


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base plus added spans, both by kind as listed, then start."""
    base = base_spans(text)
    held = sorted((a, b) for _, a, b in base)
    added: list[tuple[str, int, int]] = []
    ends = [b for _, b in held]
    for start, end in islands(text):
        cuts = pieces(text, start, end)
        # the same bytes as a base match: nothing to add
        if any(k[0] <= start and end <= k[1] for k in _near(held, ends, start, end)):
            continue
        for at in range(0, len(cuts), 400 - MAX_PIECES):
            window = cuts[at:at + 400]
            spans = candidates(text, window)
            if not spans:
                continue
            for i, j, kind, score in field.best(spans, len(window)):
                a, b = window[i][0], window[j - 1][1]
                if score >= MARGIN and not any(x < b and a < y for x, y in _near(held, ends, a, b)) and not any(x < b and a < y for _, x, y in added[-3:]):
                    added.append((kind, a, b))
            if at + 400 >= len(cuts):
                break
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(set(base + added), key=lambda s: (order[s[0]], s[1], s[2]))


def _near(held: list, ends: list, start: int, end: int) -> list:
    """Base spans that may touch [start, end)."""
    from bisect import bisect_left

    at = bisect_left(held, (start, -1))
    low = max(0, at - 4)  # at most one base span of each kind covers a place
    out = []
    for span in held[low:]:
        if span[0] >= end:
            break
        out.append(span)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        b = -b
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, masked string"


def found(docs: DataFrame, field: Field, mask: bool = False) -> DataFrame:
    """``docs`` with a struct column ``pii``: counts of base spans, their digest, all spans, and the masked text if asked for."""
    ship(docs.sparkSession)
    place, weights = docs.columns.index("text"), dict(field.w)
    kind = T.StructType.fromDDL(RESULT)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        only_tables_of("pii")
        own = Field(weights)
        arrow = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in kind])

        def row(text: str) -> dict:
            base, every = all_spans(text, own)
            n = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS}
            return {**n, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(every), "n_added": len(every) - len(base), "masked": masked(text, every) if mask else None}

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = pa.array([row(x.as_py() or "") for x in part.column(place)], arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "pii"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", kind)]))
