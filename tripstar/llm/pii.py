"""Personal data: pattern spans, and further spans decoded by a linear-chain conditional random field.

Four kinds are found by pattern (e-mail, IP address, payment card, international phone number). A linear-chain CRF
over word-shape features adds kinds that have no fixed pattern: phone numbers written without a country prefix,
national id numbers and IBANs. It is trained on the small labelled table below (regularised maximum likelihood,
forward-backward in numpy, a few seconds on the driver); its weights are a small fixed table and travel in a
broadcast. Workers decode by Viterbi in numpy, many segments at a time.

The tag lattice is restricted, in training and decoding alike: other tags than O are only possible in runs of words
with digits and of groups of one to four capitals (the bank code of an IBAN printed in fours), at least one word of a
run having a digit. The chain is therefore known to pass through O at every other word, and the best path splits
exactly into the best paths of these runs; no text is cut at an arbitrary place.

Pattern spans always stay. A decoded span is added where it overlaps no pattern span and holds a plausible number of
digits. All scans are linear in the length of a text.

Null text: empty. Null or repeated doc_ids are passed on as they are. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstar.llm.base import map_arrow, spark_schema, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
CRF_KINDS = ("local_phone", "national_id", "iban")
KINDS = BASE_KINDS + CRF_KINDS
#: Digits (for iban: digits and letters) that a decoded span may have.
PLAUSIBLE = {"local_phone": (7, 12), "national_id": (9, 9), "iban": (15, 34)}

# The labelled table. {kind|words} marks an entity, all else is O.
LABELLED = """
call me at {local_phone|555-123-4567} after six
phone {local_phone|(555) 867-5309} or write
tel. {local_phone|020 7946 0958} office hours
my number is {local_phone|415 555 0132} thanks
telephone: {local_phone|(212) 555-0187}
fax {local_phone|312-555-0199} attn sales
mobile {local_phone|0171 2345678} bitte
reach us on {local_phone|800-555-0100} today
Tel {local_phone|01 42 68 53 00} Paris
contact {local_phone|555-0142} or the desk
phone number {local_phone|303.555.0173} ask for Ann
call {local_phone|(020) 7946-0321} now
telefon {local_phone|030 901820} Berlin
whatsapp {local_phone|0612 345 678} anytime
cell: {local_phone|619-555-0144}.
SSN {national_id|078-05-1120} on file
ssn: {national_id|219-09-9999}
social security number {national_id|457-55-5462} was given
his SSN is {national_id|123-45-6789} and more
tax id {national_id|912-34-5678} recorded
social security {national_id|001-23-4567}.
number {national_id|536-90-4399} belongs to her
IBAN {iban|DE89 3704 0044 0532 0130 00} please
pay to {iban|GB29 NWBK 6016 1331 9268 19} by Friday
iban: {iban|FR76 3000 6000 0112 3456 7890 189}
account {iban|DE44500105175407324931} Berlin
konto {iban|AT611904300234573201}
transfer to {iban|ES91 2100 0418 4502 0005 1332} today
IBAN {iban|NL91ABNA0417164300} thanks
remit to {iban|MT67 VALL 2201 3QRS T123 UVWX YZ45 67A} by noon
in 1984 the price was 25 dollars
the year 2021 saw 3 of 12 items
version 3.12.1 was released on 2023-10-02
see pages 120-134 of volume 7
the meeting is at 10:30 on 12/05/2022
it costs 1,299.00 or 1.299,00 each
room 404 on floor 12 of 30
chapter 3 section 2.1 table 14
ISBN 978-3-16-148410-0 was printed in 2004
commit 9f86d081884c7d659a2feaa0c55ad015 fixed it
error 0x80070005 at line 1024
score 3-2 after 90 minutes
from 1939 to 1945 and 1950-1960
order 12345678 shipped with 2 parts
a 4x4 grid of 16 cells and 256 colours
section 12-34 of act 1998
born 1990-01-31 in town 5
the ratio 16:9 at 1920x1080 and 60 fps
model AB-1234 and model X200-500
flight LH 454 gate B12 seat 23A
population 3,664,088 in 2020
temperature -12.5 to 30.2 degrees
total 1000000 rows in 25 files
id 7f3a-22bc-9910 in table t_04
1 2 3 4 5 6 7 8 9 10
10 20 30 40 50 60 70
100 200 300 400 500
2019 2020 2021 2022
12.5 13.7 14.9 15.2
serial 000123456789 lot 77
postcode 75008 and 10115
born 12.03.1985 aged 39
grade 85/100 and 17/20
port 8080 and port 443 open
v1.2 v2.0 v10.4.3
1st 2nd 3rd 21st
call 2 friends at 7
phone 12 sold 300 units in 2015
number 5 of 10
tel 3 chapters later 1812
account 2 of 3 closed
"""


# ---- pattern spans ----------------------------------------------------------------------------------------------

# The patterns of the contract, with possessive repeats where nothing can be given back.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches from left to right: the local part is the whole run before an @, as far as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        # the characters of a failed match hold no other @, so the search goes on behind it
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four base kinds, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


# ---- the conditional random field --------------------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in CRF_KINDS for p in "BI"))
#: Words with a digit, or of one to four capitals; possessive, and anchored at the beginning of a word: linear.
_WORD = re.compile(r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+|[A-Z]{1,4}+[.,;:!?\"']*+(?!\S))")
_SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"},
                         **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_EDGE = ".,;:!?\"'"


@lru_cache(maxsize=100_000)
def shape(word: str) -> tuple[str, str]:
    """A word's shape (555-0142 → ddd-dddd, first 24 characters) and its collapsed shape (d-d)."""
    full = word[:64].strip(_EDGE).translate(_SHAPES)
    return full[:24], re.sub(r"(.)\1+", r"\1", full)[:12]


def _before(text: str, start: int) -> str:
    return (text[max(0, start - 40):start].split() or ["^"])[-1]


def _after(text: str, end: int) -> str:
    return (text[end:end + 40].split(None, 1) or ["$"])[0]


def features(word: str, before: str, after: str) -> list[str]:
    """Word-shape features of a word between two others."""
    full, short = shape(word)
    digits = sum("0" <= ch <= "9" for ch in word[:64])
    return ["bias", "s=" + full, "c=" + short, f"n={min(digits, 20)}", f"l={min(len(word), 30) // 2}",
            "p=" + before[:20].strip(_EDGE).lower(), "pc=" + shape(before[-24:])[1], "ps=" + shape(before[-24:])[0],
            "nc=" + shape(after[:24])[1], "ns=" + shape(after[:24])[0], "f=" + full[:2]]


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words with digits and groups of capitals, with one digit at least: the stretches where
    tags other than O are possible."""
    out: list[list[tuple[int, int]]] = []
    for m in _WORD.finditer(text):
        if out and not text[out[-1][-1][1]:m.start()].strip():
            out[-1].append(m.span())
        else:
            out.append([m.span()])
    return [seg for seg in out if _DIGIT.search(text, seg[0][0], seg[-1][1])]


def _labelled_segments() -> list[tuple[list[list[str]], list[int]]]:
    """The labelled table as (features of each word, tag numbers) of its segments."""
    rows = []
    for line in LABELLED.strip().splitlines():
        text, marks = "", []
        for piece in re.split(r"(\{[^}]*\})", line):
            if piece.startswith("{"):
                kind, words = piece[1:-1].split("|")
                marks.append((len(text), len(text) + len(words), kind))
                text += words
            else:
                text += piece
        for seg in segments(text):
            tags, last = [], None
            for a, b in seg:
                own = next((m for m in marks if a < m[1] and b > m[0]), None)
                tags.append(0 if own is None else TAGS.index(("I-" if own is last else "B-") + own[2]))
                last = own
            rows.append(([features(text[a:b], _before(text, a), _after(text, b)) for a, b in seg], tags))
    return rows


class Crf:
    """Weights of features and tag transitions; the tag before and after a segment is O."""

    def __init__(self, index: dict[str, int], weights, moves):
        self.index, self.weights, self.moves = index, weights, moves

    def emissions(self, words: list[list[str]]):
        """Words' features → (words, tags) scores."""
        import numpy as np

        unknown = len(self.index)
        ids = np.array([[self.index.get(f, unknown) for f in w] for w in words], dtype=np.int64)
        table = np.vstack([self.weights, np.zeros((1, len(TAGS)))])
        return table[ids].sum(axis=1)

    def viterbi(self, scores, lengths):
        """Best tags of many segments at once; scores: all their words one after another."""
        import numpy as np

        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        best = np.zeros(len(scores), dtype=np.int64)
        back = np.zeros((len(scores), len(TAGS)), dtype=np.int64)
        path = self.moves[0] + scores[first]       # the tag before is O
        ends = np.zeros((len(order), len(TAGS)))
        for t in range(1, int(size.max(initial=1)) + 1):
            live = int(np.searchsorted(-size, -t, side="left"))   # segments longer than t
            ends[live:len(path)] = path[live:]
            if not live:
                break
            step = path[:live, :, None] + self.moves[None]
            back[first[:live] + t] = step.argmax(axis=1)
            path = step.max(axis=1) + scores[first[:live] + t]
        tag = (ends + self.moves[:, 0]).argmax(axis=1)            # the tag after is O
        for t in range(int(size.max(initial=1)) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = first[:live] + t
            best[at] = tag[:live]
            tag[:live] = back[at, tag[:live]]
        return best


def train(rounds: int = 300, rate: float = 0.5, penalty: float = 0.05) -> Crf:
    """Regularised maximum likelihood on the labelled table, by AdaGrad; the same weights every time."""
    import numpy as np

    rows = _labelled_segments()
    index: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in w:
                index.setdefault(f, len(index))
    k = len(TAGS)
    ids = [np.array([[index[f] for f in w] for w in words]) for words, _ in rows]
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    seen = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        g_w, g_m = -penalty * weights, -penalty * moves
        for x, (_, tags) in zip(ids, rows):
            e = weights[x].sum(axis=1)
            n = len(tags)
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = moves[0] + e[0]
            for t in range(1, n):
                fwd[t] = lse(fwd[t - 1][:, None] + moves, 0) + e[t]
            bwd[-1] = moves[:, 0]
            for t in range(n - 2, -1, -1):
                bwd[t] = lse(moves + (e[t + 1] + bwd[t + 1])[None], 1)
            z = lse(fwd[-1] + moves[:, 0], 0)
            p = np.exp(fwd + bwd - z)
            want = np.zeros((n, k))
            want[np.arange(n), tags] = 1
            for t in range(n):
                g_w[x[t]] += want[t] - p[t]
            g_m[0] += want[0] - p[0]
            g_m[:, 0] += want[-1] - p[-1]
            for t in range(1, n):
                g_m -= np.exp(fwd[t - 1][:, None] + moves + (e[t] + bwd[t])[None] - z)
                g_m[tags[t - 1], tags[t]] += 1
        for value, g, s in ((weights, g_w, seen[0]), (moves, g_m, seen[1])):
            s += g * g
            value += rate * g / np.sqrt(s)
    # an entity begins with B, and goes on with I of its own kind only
    for a, x in enumerate(TAGS):
        for b, y in enumerate(TAGS):
            if y.startswith("I-") and x[2:] != y[2:]:
                moves[a, b] = -1e4
    return Crf(index, weights, moves)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] == "("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def decoded_spans(crf: Crf, batch: list[str]) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) that the field finds in each text."""
    import numpy as np

    out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    words, where, lengths = [], [], []
    for d, text in enumerate(batch):
        if _DIGIT.search(text) is None:
            continue
        for seg in segments(text):
            lengths.append(len(seg))
            for a, b in seg:
                where.append((d, a, b))
                words.append(features(text[a:b], _before(text, a), _after(text, b)))
    if not words:
        return out
    lengths = np.array(lengths)
    tags = crf.viterbi(crf.emissions(words), lengths)
    opens = np.zeros(len(tags), dtype=bool)
    opens[np.cumsum(lengths) - lengths] = True
    i = 0
    tags, opens = tags.tolist(), opens.tolist()
    while i < len(tags):
        if tags[i] == 0:
            i += 1
            continue
        kind, j = TAGS[tags[i]][2:], i + 1
        while j < len(tags) and not opens[j] and TAGS[tags[j]] == "I-" + kind:
            j += 1
        d = where[i][0]
        a, b = _trimmed(batch[d], where[i][1], where[j - 1][2])
        low, high = PLAUSIBLE[kind]
        inside = batch[d][a:b]
        n = sum(ch.isalnum() for ch in inside) if kind == "iban" else len(_only_digits(inside))
        if low <= n <= high:
            out[d].append((KINDS.index(kind), a, b))
        i = j
    return out


def _added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans and those of the others that overlap none of them, by kind, then start."""
    from bisect import bisect_left

    if not more:
        return base
    taken = sorted((a, b) for _, a, b in base)
    reach, top = [], 0
    for _, b in taken:      # the furthest end of the spans that begin before
        top = max(top, b)
        reach.append(top)
    starts = [a for a, _ in taken]
    free = []
    for k, a, b in more:
        i = bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            free.append((k, a, b))
    return base + sorted(free)


def personal_data(docs: DataFrame, keep: list[str] | None = None, crf: Crf | None = None) -> DataFrame:
    """docs(text) → keep columns (doc_id) and spans array<struct<kind, start, end>> by kind, then start (code
    points, end exclusive)."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(crf or train())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_slices(batch, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                more = decoded_spans(model, texts)
                spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in _added(pattern_spans(t), m)]
                         for t, m in zip(texts, more)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(spans, span)],
                                                 names=[*keep, "spans"])

    return map_arrow(docs.select(*keep, F.col("text").alias("_text")), run,
                     f"{spark_schema(docs, keep)}, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

