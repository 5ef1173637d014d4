"""Personal data by patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns, found in linear time.  Around digits, @ signs and bracketed "at" or "dot" a semi-Markov
CRF reads the text as segments: single tokens of no kind, and candidate entities of at most LONGEST tokens, each
scored by features of the whole span (digit counts and groups, separators, checksums, octets, neighbours).  A dynamic
program over segment ends chooses boundaries and kinds jointly; forward and backward sums give each chosen segment's
probability, and those of SURE or more that touch no base span are added.  Weights are fitted by maximum likelihood on generated
examples (seeded), never on the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import spread_documents

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
REACH = 48
SURE = 0.5
EXAMPLES = 480
#: The base patterns. Possessive where the plain form could not match otherwise either.
MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|dot|AT|DOT)\b")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, failing ones dropped; by kind, then start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        host = MAIL_HOST.match(text, at)
        if host:
            start = at
            while start > end and text[start - 1] in MAIL_NAME:
                start -= 1
            if start < at:
                end = host.end()
                found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        for m in IP.finditer(text):
            if all(small(p) for p in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


N_FEATURES = 22


def span_features(text: str, s: int, e: int) -> np.ndarray:
    """Features of the whole span text[s:e]."""
    t = text[s:e]
    d = digits_of(t)
    groups = re.findall(r"[0-9]+", t)
    before, after = text[s - 1 : s] if s else " ", text[e : e + 1] or " "
    letters = any(c.isalpha() for c in t)
    parts = re.split(r"\s*(?:@|[\[({] ?(?:at|AT) ?[\])}])\s*", t)
    host = re.split(r"\s*(?:\.|[\[({] ?(?:dot|DOT) ?[\])}])\s*", parts[1]) if len(parts) == 2 else []
    mail = len(parts) == 2 and bool(re.fullmatch(r"[\w.%+-]+", parts[0])) and len(host) > 1 and all(re.fullmatch(r"[A-Za-z0-9-]+", h) for h in host) and host[-1].isalpha() and len(host[-1]) > 1
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)
    separators = set(re.sub(r"[0-9]", "", t))
    even = len({len(g) for g in groups[:-1]}) <= 1
    return np.array([
        1.0, not letters and bool(d), mail, mail and "@" not in t, len(parts) != 2,
        octets and separators == {"."}, octets and separators <= set("[](). ") and "." in t, len(groups) == 4 and not octets,
        16 <= len(d) <= 19 and luhn(d), 16 <= len(d) <= 19 and not luhn(d), even and len(groups) in (1, 4, 5) and separators <= set(" -.") and not letters,
        8 <= len(d) <= 15, len(d) == 10, t[:1] == "+" or t[:2] == "00", "(" in t and ")" in t,
        [len(g) for g in groups][-2:] == [3, 4] and 3 <= len(groups) <= 5, separators <= set(" ().+-") and not letters,
        len(groups) == 1, before.isalnum() or before in "#$€£%/:=\"'", after.isalnum() or after in "%/:=\"'",
        bool(re.fullmatch(r"[12][0-9]{3}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", t)), len(t) / 20,
    ], float)


class SemiCrf:
    """Segments of one island of text; weights: kinds x features. A token of no kind scores 0."""

    def __init__(self, weights: np.ndarray):
        self.w = weights

    @staticmethod
    def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Token ranges that may be entities: bounded length, no line break, sensible first and last token."""
        found = []
        for i, (s, _) in enumerate(tokens):
            if not (text[s].isalnum() or text[s] in "+("):
                continue
            for j in range(i, min(i + LONGEST, len(tokens))):
                a, b = tokens[j]
                if "\n" in text[a:b]:
                    break
                span = text[s:b]
                if text[b - 1].isalnum() and (sum(map(str.isdigit, span)) >= 4 or "@" in span or " at" in span.lower() or "[at" in span.lower() or "(at" in span.lower()):
                    found.append((i, j + 1))
        return found

    def sums(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
        """Probability of every (span, kind), from sums over all segmentations before and after it, in logarithms."""
        top = scores.max(1)
        total = (top + np.log(np.exp(scores - top[:, None]).sum(1))).tolist()

        def plus(values: list[float]) -> float:
            most = max(values)
            return most + math.log(sum(math.exp(v - most) for v in values))

        fwd, bwd, at = [0.0] * (n + 1), [0.0] * (n + 1), 0
        by_end = sorted(range(len(spans)), key=lambda k: spans[k][1])
        for j in range(1, n + 1):
            ways = [fwd[j - 1]]
            while at < len(by_end) and spans[by_end[at]][1] == j:
                ways.append(fwd[spans[by_end[at]][0]] + total[by_end[at]])
                at += 1
            fwd[j] = plus(ways) if len(ways) > 1 else ways[0]
        at = len(spans) - 1  # spans ascend by their first token
        for i in range(n - 1, -1, -1):
            ways = [bwd[i + 1]]
            while at >= 0 and spans[at][0] == i:
                ways.append(bwd[spans[at][1]] + total[at])
                at -= 1
            bwd[i] = plus(ways) if len(ways) > 1 else ways[0]
        share = np.array([fwd[i] + bwd[j] - fwd[n] for i, j in spans])
        return np.exp(np.minimum(scores + share[:, None], 0.0))

    def best(self, n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
        """(span, kind) of the best segmentation, left to right."""
        kind = scores.argmax(1).tolist()
        top = scores.max(1).tolist()
        value, back, at = [0.0] * (n + 1), [None] * (n + 1), 0
        by_end = sorted(range(len(spans)), key=lambda k: spans[k][1])
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            while at < len(by_end) and spans[by_end[at]][1] == j:
                k = by_end[at]
                if value[spans[k][0]] + top[k] > value[j]:
                    value[j], back[j] = value[spans[k][0]] + top[k], k
                at += 1
        path, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                path.append((back[j], kind[back[j]]))
                j = spans[back[j]][0]
        return path[::-1]

    def decode(self, text: str) -> list[tuple[str, int, int, float]]:
        tokens = tokens_of(text)
        spans = self.candidates(text, tokens)
        if not spans:
            return []
        x = np.array([span_features(text, tokens[i][0], tokens[j - 1][1]) for i, j in spans])
        scores = x @ self.w.T
        p, path = self.sums(len(tokens), spans, scores), self.best(len(tokens), spans, scores)
        return [(KINDS[c], tokens[spans[k][0]][0], tokens[spans[k][1] - 1][1], float(p[k, c])) for k, c in path]


def examples(seed: int = 5, n: int = EXAMPLES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with entities of all kinds in several forms, and with numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 7)))

    def card() -> str:
        body = num(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")])
            return kind, f"{word()}{r.choice(['', '.' + num(2), '_' + word()])}{at}{word()}{r.choice(['', num(1)])}{dot}{r.choice(['com', 'org', 'net', 'example'])}"
        if kind == "ip":
            return kind, r.choice([".", ".", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return kind, card()
        a, b, c = num(3), num(3), num(4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b} {c}"])

    def other() -> str:
        return r.choice([
            lambda: num(r.choice([4, 5, 6, 7, 8, 9, 12, 14])), lambda: f"{r.randint(1900, 2030)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
            lambda: f"v{num(1)}.{num(2)}.{num(1)}", lambda: f"${num(3)}.{num(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{r.randint(256, 999)}.{num(3)}.{num(3)}.{r.randint(300, 999)}", lambda: f"{num(3)},{num(3)}", lambda: f"{num(4)}-{num(4)}",
            lambda: (lambda b: b + next(c for c in "0123456789" if not luhn(b + c)))(num(15)), lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{word()}{num(5)}", lambda: f"{num(20)}",
        ])()

    made = []
    for _ in range(n):
        text, gold = word(), []
        for _ in range(r.randint(1, 3)):
            text += " " + " ".join(word() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.55:
                kind, t = entity()
                gold.append((kind, len(text), len(text) + len(t)))
            else:
                t = other()
            text += t + r.choice(["", "", ".", ","])
        made.append((text + " " + word(), gold))
    return made


def fit(data: list | None = None, epochs: int = 100, rate: float = 0.7, penalty: float = 1e-3) -> np.ndarray:
    """Maximum likelihood by gradient ascent (Adagrad) on the exact segment probabilities."""
    data = examples() if data is None else data
    prepared = []
    for text, gold in data:
        tokens = tokens_of(text)
        spans = SemiCrf.candidates(text, tokens)
        x = np.array([span_features(text, tokens[i][0], tokens[j - 1][1]) for i, j in spans]).reshape(len(spans), N_FEATURES)
        y = np.zeros((len(spans), len(KINDS)))
        want = {(s, e): KINDS.index(k) for k, s, e in gold}
        for k, (i, j) in enumerate(spans):
            c = want.get((tokens[i][0], tokens[j - 1][1]))
            if c is not None:
                y[k, c] = 1
        if len(spans):
            prepared.append((len(tokens), spans, x, y))
    w, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    w[:, 0] = -3.0
    crf = SemiCrf(w)
    for _ in range(epochs):
        g = -penalty * len(prepared) * w
        for n, spans, x, y in prepared:
            p = crf.sums(n, spans, x @ w.T)
            g += (y - p).T @ x
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return w


@functools.lru_cache(1)
def default_weights() -> str:
    return json.dumps(fit().tolist())


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, joined where they meet."""
    found: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if found and s <= found[-1][1]:
            found[-1][1] = e
        else:
            found.append([s, e])
    return [(s, e) for s, e in found]


def find_pii(text: str, crf: SemiCrf) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    spans = list(base)
    for s, e in islands(text):
        part = text[s:e]
        if len(digits_of(part)) < 4 and "@" not in part and "at" not in part.lower():
            continue
        for kind, a, b, p in crf.decode(part):
            a, b = a + s, b + s
            if p >= SURE and not any(x < b and a < y for _, x, y in base):
                spans.append((kind, a, b))
    spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, spans


def detect(docs: DataFrame, weights: str | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all of them).

    Whole texts; null and empty texts have no spans.  Null or repeated ids pass through; other columns are ignored.
    """
    weights = weights or default_weights()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def found(batches):
        crf = SemiCrf(np.array(json.loads(weights)))
        told = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for b in batches:
            rows = [find_pii(t or "", crf) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in rows], pa.string()), pa.array([told(a) for _, a in rows], pa.string()), pa.array([len(a) for _, a in rows], pa.int64())],
                names=names,
            )

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(found, f"doc_id long, {columns}, base_sha256 string, spans string, n_spans long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spread_documents(spark, sf_dir))
