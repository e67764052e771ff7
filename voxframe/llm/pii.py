"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans they miss.

The field scores whole candidate segments of a zone of text (its atoms are runs of letters, runs of digits and single
other characters). A segment has one of four kinds and at most MAX_ATOMS atoms; all else is outside, an atom at a
time, with score 0. Dynamic programming picks boundaries and kinds together. Base spans are clamped: no segment
touches them. It is trained by maximum likelihood on sentences made by training_sentences(), which are written in other ways than
the base patterns know (brackets for @, no plus sign, dots between groups of a card) and hold numbers that are no personal data.

Zones are the text about digits, @ and bracketed "at" that base spans leave, as far as a segment reaches: every segment with
one of these in it is a candidate. Elsewhere no segment is, so the best labelling of a text is that of its zones.

Defined cases: null and empty texts have no spans; equal texts have equal spans; repeated rows are searched each; an empty table
gives an empty table; texts of any length are searched whole; columns kept pass through, whatever their names are, but for _vx_spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.batches import map_batches
from voxframe.workspace import small_batches

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, AROUND = 40, 48
Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Fixed patterns of the base kinds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _TWO_DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9][\x20-]?[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\x20?at\x20?[\])}>]", re.I)
_ATOM = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
_ATOMS = re.compile(rf"(?:[^\W\d_]++|[0-9]++|.){{0,{MAX_ATOMS}}}+", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """A match ends its local part at an @, so each @ is tried once with the longest local part before it."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail its test dropped; by kind, then start."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            out += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += (("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15)
    return out


def _left(text: str, at: int) -> int:
    """Where the MAX_ATOMS atoms before at begin, AROUND characters before it at least."""
    size = 8 * AROUND
    while True:
        before = text[max(0, at - size) : at][::-1]
        reach = _ATOMS.match(before).end()
        if reach < len(before) or size >= at:
            return max(0, at - max(reach, AROUND))
        size *= 4


def _right(text: str, at: int) -> int:
    """Where the MAX_ATOMS atoms from at on end, AROUND characters after it at least."""
    return min(len(text), max(_ATOMS.match(text, at).end(), at + AROUND))


def zones(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Spans of text about triggers, cut at base spans."""
    walls = sorted((a, b) for _, a, b in taken)
    start = end = -1
    k, n = 0, len(text)
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        while k < len(walls) and walls[k][1] <= a:
            k += 1
        if k < len(walls) and walls[k][0] < b:
            continue
        left, right = _left(text, a), _right(text, b)
        if start >= 0 and left <= end and not (k and walls[k - 1][1] > start and walls[k - 1][0] >= start):
            end = max(end, min(right, walls[k][0] if k < len(walls) else n))
            continue
        if start >= 0:
            yield start, end
        start = max(left, walls[k - 1][1] if k else 0)
        end = min(right, walls[k][0] if k < len(walls) else n)
    if start >= 0:
        yield start, end


_SHAPES = [
    ("p-us", re.compile(r"(?:\+?1[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")),
    ("p-intl", re.compile(r"(?:\+|00)[1-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}")),
    ("p-trunk", re.compile(r"0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,5}")),
    ("c-4", re.compile(r"[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3}")),
    ("c-amex", re.compile(r"3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5}")),
    ("i-4", re.compile(r"(?:[0-9]{1,3} ?\. ?){3}[0-9]{1,3}")),
    ("i-6", re.compile(r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}")),
    ("e-at", re.compile(r"[A-Za-z0-9._%+-]+ ?[\[({<] ?(?i:at) ?[\])}>] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({<] ?(?i:dot) ?[\])}>]) ?[A-Za-z0-9-]+)+")),
    ("e-space", re.compile(r"[A-Za-z0-9._%+-]+(?: ?@ |@)[A-Za-z0-9-]+(?:(?:\.| ?[\[({<] ?(?i:dot) ?[\])}>] ?)[A-Za-z0-9-]+)+")),
]
_NUMERIC = frozenset("0123456789 ()+./-")


def candidates(atoms: list[str]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """First atom, end, kinds of the segments that may be entities."""
    n, marks = len(atoms), any(a == "@" or a.lower() == "at" for a in atoms)
    colons = atoms.count(":") >= 2
    for i, a in enumerate(atoms):
        if a.isspace() or not (a[0].isalnum() or a in "+(."):
            continue
        digits = letters = runs = dots = 0
        odd = at = False
        for j in range(i, min(n, i + MAX_ATOMS)):
            x = atoms[j]
            if x == "\n":
                break
            if x[0].isdigit():
                digits, runs = digits + len(x), runs + 1
            elif x.isalpha():
                letters += 1
                at = at or x.lower() == "at"
            elif x not in _NUMERIC:
                odd = True
            at, dots = at or x == "@", dots + (x == "." or x.lower() == "dot")
            if letters and not marks and not colons:
                break
            if not x[-1].isalnum():
                continue
            kinds = []
            if at and dots:
                kinds.append("email")
            if not letters and not odd and dots == 3 and runs == 4 or colons and odd and digits and ":" in atoms[i : j + 1]:
                kinds.append("ip")
            if not letters and not odd:
                kinds += ["card"] * (13 <= digits <= 19) + ["phone"] * (7 <= digits <= 15)
            if kinds:
                yield i, j + 1, tuple(kinds)


def _about(c: str) -> str:
    return "d" if c.isdigit() else "w" if c.isalpha() else "s" if c.isspace() else c if c else "end"


def features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Names of what holds for the whole span text[start:end] as an entity of the kind."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    left, right = text[start - 1 : start], text[end : end + 1]
    shapes = [name for name, p in _SHAPES if p.fullmatch(span)]
    out = ["any", f"left {_about(left)}", f"right {_about(right)}", f"right then {_about(right)}{_about(text[end + 1 : end + 2])}", f"digits {len(digits)}", f"luhn {len(digits) > 12 and luhn(digits)}", f"first {_about(span[0])}", f"last {_about(span[-1])}", f"spaces {min(6, span.count(' '))}", f"dots {min(4, span.count('.'))}"]
    out += [f"shape {s}" for s in shapes] or ["no shape"]
    if kind == "ip" and "i-4" in shapes:
        out.append(f"parts {all(int(p) <= 255 for p in re.findall('[0-9]+', span))}")
    if ". " in span:
        out.append("dot space")
    if "  " in span or "--" in span:
        out.append("double")
    return [f"{kind} {x}" for x in out]


@dataclass(frozen=True)
class Model:
    weight: dict[str, float]

    def score(self, text: str, start: int, end: int, kind: str) -> float:
        return sum(self.weight.get(f, 0.0) for f in features(text, start, end, kind))

    def added(self, text: str, taken: list[Span]) -> list[Span]:
        """The spans of the best labelling of all zones."""
        out = []
        for a, b in zones(text, taken):
            atoms, at = _atoms(text[a:b])
            # an atom cut by the zone's edge is no whole run
            segments = [(i, j, k, s) for i, j, ks in candidates(atoms) if _whole(text, a + at[i], a + at[j]) for k in ks if (s := self.score(text, a + at[i], a + at[j], k)) > 0]
            out += [(k, a + at[i], a + at[j]) for i, j, k in viterbi(len(atoms), segments)]
        return out


def _atoms(zone: str) -> tuple[list[str], list[int]]:
    atoms = _ATOM.findall(zone)
    return atoms, np.cumsum([0, *map(len, atoms)]).tolist()


def _whole(text: str, start: int, end: int) -> bool:
    """Neither edge of the span cuts a run of letters or of digits."""
    for k in (start, end):
        if 0 < k < len(text) and (text[k - 1].isdigit() and text[k].isdigit() or text[k - 1].isalpha() and text[k].isalpha()):
            return False
    return True


def viterbi(n: int, segments: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The segments of the best labelling of n atoms; what has no positive score can't be in it. Ties: the first one found."""
    ending: dict[int, list] = {}
    for i, j, k, s in segments:
        ending.setdefault(j, []).append((i, k, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, k = back[j]
            out.append((i, j, k))
            j = i
        else:
            j -= 1
    return out[::-1]


def training_sentences(n: int = 700, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with their personal data; about half of the numbers in them are none."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("aeioulnrstdmkp") for _ in range(r.randint(2, 8)))

    def num(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card(k: int, head: str) -> str:
        body = head + num(k - len(head) - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def groups(s: str, sizes: list[int], sep: str) -> str:
        out = []
        for k in sizes:
            out.append(s[:k])
            s = s[k:]
        return sep.join(out)

    def email() -> str:
        o, c = r.choice(["[]", "()", "{}"])
        at, dot = f" {o}at{c} ", r.choice([".", f" {o}dot{c} "])
        name = word() + r.choice(["", "." + word(), num(2)])
        return r.choice([name + at + word() + dot + r.choice(["com", "org", "net"]), f"{name} @ {word()}.com", f"{name}@ {word()}.{word()}.org"])

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        s = r.choice([".", "-", " "])
        return r.choice([f"({a}) {b}-{c}", f"{a}{s}{b}{s}{c}", f"1{s}{a}{s}{b}{s}{c}", f"00{r.randint(20, 99)} {num(2)} {num(4)} {num(4)}", f"0{r.randint(100, 999)} {num(3)} {num(4)}", f"0{r.randint(20, 99)}/{num(4)}{num(4)}"])

    def cardlike() -> str:
        return r.choice([groups(card(16, "4"), [4] * 4, r.choice([".", "/", "  "])), groups(card(15, "37"), [4, 6, 5], r.choice([" ", "-", "."])), card(15, "34")])

    def ip() -> str:
        h = lambda: f"{r.randrange(65536):x}"
        return r.choice([":".join(h() for _ in range(8)), f"{h()}:{h()}::{h()}:{h()}", " . ".join(str(r.randrange(256)) for _ in range(4))])

    def none() -> str:
        return r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}", f"{r.randint(1, 999)}.{num(2)}", num(r.randint(1, 12)), num(r.randint(13, 30)), f"{r.randint(1, 9)},{num(3)},{num(3)}.{num(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40]))), f"{num(3)}.{num(3)}.{num(3)}.{num(3)}.{num(3)}", f"@{word()}", f"{word()}{num(3)}", f"{num(8)}-{num(4)}-{num(4)}-{num(4)}-{num(12)}", f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(4)} {num(4)} {num(4)} {num(4)}", " ".join(num(r.randint(1, 5)) for _ in range(r.randint(2, 8))), f"{num(5)}/{num(5)}", f"{num(3)}-{num(3)}", f"{num(r.randint(1, 3))} {word()} {num(4)}", f"{word()} (at {word()}) {num(2)}", f"#{num(6)}", f"0x{num(8)}", f"ISO {num(4)}:{num(4)}"])

    makers, out = {"email": email, "phone": phone, "card": cardlike, "ip": ip}, []
    while len(out) < n:
        text, spans = " ".join(word() for _ in range(r.randint(1, 6))) + " ", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice([None, None, None, *KINDS])
            item = makers[kind]() if kind else none()
            start = len(text)
            text += item
            if kind:
                spans.append((kind, start, len(text)))
            text += r.choice([" ", ". ", ", ", "; ", "\n"]) + " ".join(word() for _ in range(r.randint(1, 6))) + r.choice([" ", ", ", ": "])
        if not base_spans(text):
            out.append((text, spans))
    return out


def fit(sentences: list[tuple[str, list[Span]]] | None = None, steps: int = 60, l2: float = 1e-3) -> Model:
    """Weights by full-batch gradient ascent on the likelihood of the true labellings, in the driver, all zones side by side; the sentences are few."""
    names: dict[str, int] = {}
    zone, start, end, gold, found, zones_seen = [], [], [], [], [], 0
    for text, spans in training_sentences() if sentences is None else sentences:
        for a, b in zones(text, []):
            atoms, at = _atoms(text[a:b])
            before = len(zone)
            for i, j, kinds in candidates(atoms):
                for kind in kinds if _whole(text, a + at[i], a + at[j]) else ():
                    found.append([names.setdefault(f, len(names)) for f in features(text, a + at[i], a + at[j], kind)])
                    gold.append((kind, a + at[i], a + at[j]) in spans)
                    zone.append(zones_seen)
                    start.append(i)
                    end.append(j)
            zones_seen += len(zone) > before
    zone, start, end, gold = (np.array(x) for x in (zone, start, end, gold))
    w, m1, m2 = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    flat, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    for t in range(1, steps + 1):
        s = np.bincount(of, w[flat], len(found))
        g = np.bincount(flat, (gold - marginals(zone, start, end, s))[of], len(names)) / zones_seen - l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w + 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model({f: float(w[i]) for f, i in names.items()})


def marginals(zone: np.ndarray, start: np.ndarray, end: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The probability of each candidate segment in its zone, by forward and backward sums, a column a zone."""
    n, z = int(end.max()) + 1, int(zone.max()) + 1
    alpha, beta = np.zeros((n, z)), np.zeros((n, z))
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    ends, starts = np.searchsorted(end[by_end], np.arange(n + 1)), np.searchsorted(start[by_start], np.arange(n + 1))
    for j in range(1, n):
        alpha[j] = alpha[j - 1]
        k = by_end[ends[j] : ends[j + 1]]
        np.logaddexp.at(alpha[j], zone[k], alpha[start[k], zone[k]] + s[k])
    for i in range(n - 2, -1, -1):
        beta[i] = beta[i + 1]
        k = by_start[starts[i] : starts[i + 1]]
        np.logaddexp.at(beta[i], zone[k], beta[end[k], zone[k]] + s[k])
    return np.exp(alpha[start, zone] + s + beta[end, zone] - alpha[-1, zone])


@cache
def fitted() -> Model:
    """The model of the made-up sentences, fitted once in a process."""
    return fit()


def find(docs: DataFrame, model: Model, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in keep (default: all) and _vx_spans: kind, start, end (code points, end exclusive), and whether a base pattern found it."""
    spark = docs.sparkSession
    small_batches(spark, 1000)
    keep = docs.columns if keep is None else keep
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1):
                text = t.as_py() or ""
                base = base_spans(text)
                both = [(*x, True) for x in base] + [(*x, False) for x in shared.value.added(text, base)]
                rows.append([dict(zip(("kind", "start", "end", "base"), x)) for x in sorted(both, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, kind)], [*b.schema.names[:-1], "_vx_spans"])

    spans = T.StructType.fromDDL(f"_vx_spans {SPANS}")
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_vx_text")), run, T.StructType([*kept.schema.fields, *spans.fields]))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, base spans of each kind, base_sha256 and spans (kind:start:end, comma-joined)."""

    def line(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_vx_spans", lambda s: s["base"])
    counts = [count(k) for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("_vx_spans")).alias("spans"))
