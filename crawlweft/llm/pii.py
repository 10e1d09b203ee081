"""Personal data by exact base patterns and a semi-Markov conditional random field.

The field scores whole candidate spans of up to LONGEST tokens (their shape, digit counts, checksums, words around) and
label transitions; a bounded-entity dynamic programme chooses boundaries and types jointly. It runs where a text holds
a digit, an @ or a spelt-out "dot": elsewhere no span can score. It is trained here, on sentences that sentences() makes
from a seed. Its spans are added where they overlap no base span; base spans always stay.

Kinds: email, ip, card, phone (base and learnt), secret and ssn (learnt only).

Defined cases: null text counts as empty; no spans give empty strings; repeated rows are searched each; columns beside
doc_id and text are not read. Offsets are code points, ends exclusive. A window of any length is decoded in pieces of
PIECE tokens with MARGIN more on both sides, so that no span is cut and all see the words around; a span belongs to the
piece in which it starts, and the earlier one stays where two pieces disagree.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import chunks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS, "secret", "ssn")
LONGEST, PIECE, AROUND = 14, 400, 48
MARGIN = 4 * LONGEST
_RANK = {k: i for i, k in enumerate(LABELS)}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run's later starts fail where its first does, so a look-behind and possessive runs keep this linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]| dot |[\[(]dot[\])]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|\n|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind as listed."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]]))


def _shape(word: str) -> str:
    if word.isdigit():
        return f"d{min(len(word), 20)}"
    if len(word) >= 16 and not word.isalpha():
        return "H"
    return "a" if word.isalpha() else "x" if word.isalnum() else word


def _bucket(n: int) -> int:
    return n if n < 20 else 20


class Window:
    """Tokens of a piece of text, its candidate spans and their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.at = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.text = text
        words = [text[a:b] for a, b in self.at]
        low = [w.lower() for w in words]
        shapes = [_shape(w) for w in words]
        n = len(words)
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        key = [any(c.isdigit() for c in w) or w == "@" or l == "dot" for w, l in zip(words, low, strict=True)]
        for i in range(n):
            self.spans.append((i, 1))
            self.features.append([f"o:{shapes[i]}", "o"])
            first = words[i]
            if not (key[i] or first in "+(" or (first.isalpha() and i + 1 < n and (low[i + 1] in ("@", ".", "at", "_", "-", "+", "%", "(", "[")))):
                continue
            body, digits, ok = "", "", False
            for size in range(1, min(LONGEST, n - i) + 1):
                w = words[i + size - 1]
                if w == "\n":
                    break
                if size > 1 and self.at[i + size - 1][0] - self.at[i + size - 2][1] > 1:
                    break
                body += ("_" if size > 1 and self.at[i + size - 1][0] > self.at[i + size - 2][1] else "") + (w if low[i + size - 1] in ("at", "dot") else shapes[i + size - 1])
                ok = ok or key[i + size - 1]
                digits += w if w.isdigit() else ""
                if not ok or w in "(+[@.-":
                    continue
                j = i + size
                a, b = self.at[i][0], self.at[j - 1][1]
                f = [f"s:{body}", f"n:{size}", f"d:{_bucket(len(digits))}", f"b:{shapes[i]}", f"e:{shapes[j - 1]}"]
                f.append(f"p:{low[i - 1] if i else '^'}")
                f.append(f"q:{low[i - 2] if i > 1 else '^'}_{low[i - 1] if i else '^'}")
                f.append(f"gl:{i > 0 and self.at[i - 1][1] == a and not (words[i - 1] in '(\"<:=,;')}")
                f.append(f"gr:{j < n and self.at[j][0] == b and words[j] not in '.,;:!?)\">' + chr(10)}")
                f.append(f"dotnext:{j + 1 < n and self.at[j][0] == b and words[j] in '.@-' and self.at[j + 1][0] == self.at[j][1]}")
                f.append(f"at:{body.count('@')}{body.count('at')}{min(body.count('.'), 4)}{min(body.count('dot'), 2)}")
                if 13 <= len(digits) <= 19:
                    f.append(f"luhn:{luhn(digits)}")
                if re.fullmatch(r"d\d+(\.d\d+){3}", body):
                    f.append(f"octets:{all(len(x) < 4 and int(x) < 256 for x in re.findall(r'[0-9]+', text[a:b]))}")
                if "H" in body:
                    f.append(f"hex:{size}")
                self.spans.append((i, size))
                self.features.append(f)


class Field:
    """Weights of the semi-Markov field: span features by label and label transitions."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((1, len(LABELS)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))

    def _scores(self, w: Window) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(w.at)
        s = np.full((n, LONGEST, len(LABELS)), -np.inf)
        used = []
        for (i, size), names in zip(w.spans, w.features, strict=True):
            of = np.array([k for f in names if (k := self.ids.get(f, 0))], np.int64)
            used.append(of)
            v = self.weights[of].sum(axis=0)
            if names[-1] == "o":
                s[i, 0, 0] = v[0]
            else:
                s[i, size - 1, 1:] = v[1:]
        return s, used

    def _forward(self, s: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """alpha[j, y]: all (or the best) ways to cover j tokens whose last segment is y; entry[i, y]: before a segment y at i."""
        n, back = len(s), []
        alpha, entry = np.full((n + 1, len(LABELS)), -np.inf), np.full((n + 1, len(LABELS)), -np.inf)
        alpha[0, 0] = 0
        for j in range(n + 1):
            if j:
                size = np.arange(min(LONGEST, j))
                v = s[j - 1 - size, size] + entry[j - 1 - size]
                if best:
                    back.append((v.argmax(axis=0), None))
                    alpha[j] = v.max(axis=0)
                else:
                    alpha[j] = _lse(v, 0)
            v = alpha[j][:, None] + self.moves
            if best:
                back.append((None, v.argmax(axis=0)))
                entry[j] = v.max(axis=0)
            else:
                entry[j] = _lse(v, 0)
        return alpha, entry, back

    def decode(self, w: Window) -> list[tuple[int, int, str]]:
        n = len(w.at)
        if n == 0 or len(w.spans) == n:
            return []
        s, _ = self._scores(w)
        alpha, _, back = self._forward(s, True)
        sizes, before = [b[0] for b in back if b[0] is not None], [b[1] for b in back if b[1] is not None]
        out, j, y = [], n, int(alpha[n].argmax())
        while j > 0:
            size = int(sizes[j - 1][y]) + 1
            if y:
                out.append((w.at[j - size][0], w.at[j - 1][1], LABELS[y]))
            j -= size
            y = int(before[j][y])
        return out[::-1]

    def train(self, data: list[tuple[Window, dict[tuple[int, int], int]]], rounds: int = 6, rate: float = 0.5) -> None:
        """Gradient steps (adaptive rates) on the log-likelihood of the true segmentations."""
        for w, _ in data:
            for names in w.features:
                for f in names:
                    self.ids.setdefault(f, len(self.ids) + 1)
        self.weights = np.zeros((len(self.ids) + 1, len(LABELS)))
        seen, seen_moves = np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2)
        for _ in range(rounds):
            for w, truth in data:
                s, used = self._scores(w)
                n = len(s)
                alpha, entry, _ = self._forward(s, False)
                after = np.full((n + 1, len(LABELS)), -np.inf)  # all ways on from i, given the label before
                onward = np.full((n + 1, len(LABELS)), -np.inf)  # all ways on from i with a segment y there
                after[n] = 0
                for i in range(n - 1, -1, -1):
                    size = np.arange(min(LONGEST, n - i))
                    onward[i] = _lse(s[i, size] + after[i + 1 + size], 0)
                    after[i] = _lse(self.moves + onward[i], 1)
                total = _lse(alpha[n], 0)
                g, gm = {}, -np.exp(np.clip(alpha[:n, :, None] + self.moves + onward[:n, None, :] - total, -60, 0)).sum(axis=0)
                last = 0
                labels = {i: y for (i, size), y in truth.items()}
                for i in sorted(labels):
                    gm[last, labels[i]] += 1
                    last = labels[i]
                for (i, size), of, names in zip(w.spans, used, w.features, strict=True):
                    p = -np.exp(np.clip(s[i, size - 1] + entry[i] + after[i + size] - total, -60, 0))
                    p = np.where(np.arange(len(LABELS)) == 0, p, 0) if names[-1] == "o" else np.where(np.arange(len(LABELS)) == 0, 0, p)
                    y = truth.get((i, size))
                    if y is not None and (y == 0) == (names[-1] == "o"):
                        p[y] += 1
                    for k in of.tolist():
                        g[k] = g.get(k, 0) + p
                at = np.fromiter(g, np.int64, len(g))
                step = np.array(list(g.values())) - 1e-3 * self.weights[at]
                seen[at] += step * step
                self.weights[at] += rate * step / np.sqrt(seen[at])
                seen_moves += gm * gm
                self.moves += rate * gm / np.sqrt(seen_moves)


def _lse(v: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(v.max(axis=axis, keepdims=True), -1e300)
    return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis) + 1e-300)


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up lines with personal data and with look-alikes (dates, versions, prices, counts, failing card numbers)."""
    r = random.Random(seed)
    pick, num = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick(("an", "er", "lo", "mi", "ta", "re", "on", "de", "su", "vi")) for _ in range(r.randint(1, 3)))

    def card() -> str:
        d = pick("3456") + num(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def four(d: str) -> str:
        return pick(("", " ", "-")).join(d[i : i + 4] for i in range(0, 16, 4))

    made = {
        "email": (lambda: f"{word()}{pick(('.', '_', ''))}{pick((word(), num(2)))}@{word()}{pick(('', num(1)))}.{pick(('com', 'org', 'example.com', 'net'))}", lambda: f"{word()} {pick(('at', '(at)', '[at]'))} {word()} {pick(('dot', '(dot)', '[dot]'))} {pick(('com', 'org'))}"),
        "ip": (lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),),
        "card": (lambda: four(card()),),
        "phone": (lambda: f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}"),
        "secret": (lambda: "".join(pick("0123456789abcdef") for _ in range(40)), lambda: "sk" + "".join(pick("ABCDEFGHJKabcdefghjk0123456789") for _ in range(24))),
        "ssn": (lambda: f"{num(3)}-{num(2)}-{num(4)}",),
    }
    lead = {"secret": ('token = "', 'key: ', 'secret = "', ""), "ssn": ("ssn ", "SSN: ", ""), "phone": ("call ", "tel: ", "", ""), "card": ("card ", "", ""), "email": ("mail ", "", ""), "ip": ("from ", "", "")}
    plain = (
        lambda: num(r.randint(1, 9)), lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(1)},{num(3)}",
        lambda: f"CC BY-NC {r.randint(1, 4)}.0", lambda: f"{r.randint(10, 23)}:{num(2)}", lambda: f"{num(2)}%", lambda: f"{num(4)}-{num(4)}", lambda: f"@{word()}", lambda: next(d for d in iter(lambda: num(16), "") if not luhn(d)), lambda: f"{r.randint(256, 999)}.{num(3)}.{num(2)}.{num(1)}", lambda: f"{word()} dot {word()}",
        lambda: f"{num(3)}.{num(3)}.{num(3)}", lambda: f"{word()}-{num(3)}",
    )
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 2)):
            text += " " if text else ""
            if r.random() < 0.5:
                kind = pick(LABELS[1:])
                before = pick(lead[kind])
                body = pick(made[kind])()
                text += before
                spans.append((len(text), len(text) + len(body), kind))
                text += body + ('"' if before.endswith('"') else "")
            else:
                text += pick(plain)()
            text += pick((" ", ". ", ", ", " ")) + " ".join(word() for _ in range(r.randint(1, 3)))
        yield text, spans


@lru_cache(maxsize=2)
def trained(n: int = 500, seed: int = 5) -> Field:
    data = []
    for text, spans in sentences(n, seed):
        w = Window(text, 0, len(text))
        first, last = {a: i for i, (a, _) in enumerate(w.at)}, {b: i for i, (_, b) in enumerate(w.at)}
        truth, inside = {}, set()
        for a, b, kind in spans:
            i, j = first[a], last[b]
            if (i, j - i + 1) in w.spans[: len(w.spans)]:
                truth[i, j - i + 1] = _RANK[kind]
                inside |= set(range(i, j + 1))
        truth |= {(i, 1): 0 for i in range(len(w.at)) if i not in inside}
        data.append((w, truth))
    field = Field()
    field.train(data)
    return field


def windows(text: str) -> Iterator[Window]:
    """Merged surroundings of all triggers, cut at white space, in overlapping pieces; `own` holds the starts that are a piece's own."""
    n, end = len(text), -1
    spans: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = max(m.start() - AROUND, 0), min(m.end() + AROUND, n)
        while a > 0 and m.start() - a < 4 * AROUND and not text[a - 1].isspace():
            a -= 1
        while b < n and b - m.end() < 4 * AROUND and not text[b].isspace():
            b += 1
        end = b - AROUND
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in spans:
        at = [m.start() for m in _TOKEN.finditer(text, a, b)]
        for k in range(0, len(at), PIECE):
            ends = k + PIECE + MARGIN
            piece = Window(text, at[max(k - MARGIN, 0)], at[ends] if ends < len(at) else b)
            piece.own = (at[k], at[k + PIECE] if k + PIECE < len(at) else b)
            yield piece


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and learnt spans), each by start, then kind."""
    base = base_spans(text)
    extra, end = [], 0
    for w in windows(text):
        for s in sorted(field.decode(w)):
            if w.own[0] <= s[0] < w.own[1] and s[0] >= end:
                end = s[1]
                if not any(s[0] < b and a < end for a, b, _ in base):
                    extra.append(s)
    return base, sorted(base + extra, key=lambda s: (s[0], _RANK[s[2]]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added, n_spans (all)."""
    field = docs.sparkSession.sparkContext.broadcast(trained())
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            for text in batch["text"].to_pylist():
                base, every = all_spans(text or "", field.value)
                count = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((*count, hashlib.sha256(show(base).encode()).hexdigest(), show(every), len(every) - len(base), len(every)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
