"""Operator 3: personal data. Fixed patterns give the base spans; a semi-Markov conditional random field
adds spans that the patterns miss (spelled-out addresses, phone numbers without a plus sign).

The field scores whole candidate spans: features see a span's digits, groups, separators and ends at
once. Dynamic programming over segments of at most ``LONGEST`` tokens chooses boundaries and kinds
together; forward and backward sums over the same segments train the weights on the sentences below.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm.common import ship, slices, table, text_of

KINDS = ("email", "ip", "card", "phone")
LONGEST = 14  # tokens of an entity at most
MARGIN = 8  # tokens around a trigger that the field looks at
ROUNDS, STEP, DECAY = 80, 0.4, 0.002

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is matched from its start: one that starts inside fails in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then by start; work grows with the text."""
    out = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        at = done = m.end() if m else at + 1
        if not m:
            done = min(done, at)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# the field

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_NUMBER = r"(?<![\w.,])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?!\w)"
_SPELLED = r"(?i:(?<!\w)(?:at|\(at\)|\[at\]|arobase|arroba|klammeraffe)\s+[\w-]+\s+[\[(]?(?:dot|point|punto|punkt)[\])]?(?!\w)|[\[(](?:at|dot)[\])])"
_NUMBERS, _BOTH = re.compile(_NUMBER), re.compile(f"{_NUMBER}|{_SPELLED}")
_RUN = re.compile(r"[0-9](?:[^0-9\n]{0,6}[0-9])+")
_ANY_AT = re.compile(r"(?i)(?<!\w)(?:at|arobase|arroba|klammeraffe)(?!\w)|@")
_ANY_DOT = re.compile(r"(?i)(?<!\w)(?:dot|point|punto|punkt)(?!\w)|\.")
_MAY_SPELL = re.compile(r"(?i)\b(?:dot|point|punto|punkt)\b|[\[(](?:at|dot)[\])]")
_AT, _DOT = frozenset(("at", "arobase", "arroba", "klammeraffe", "@")), frozenset(("dot", "point", "punto", "punkt", "."))
_CUES = {
    "email": frozenset("mail email e-mail write contact correo courriel reach".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon telefono ring dial".split()),
    "card": frozenset("card visa mastercard credit amex karte tarjeta carte".split()),
    "ip": frozenset("ip host address server adresse addr".split()),
}

# sentences with marked spans; {kind:text}
LABELLED = (
    "please write to {email:john dot smith at example dot com} for more",
    "contact {email:anna [at] mail [dot] org} today",
    "reach me , {email:info (at) firm (dot) net} , any time",
    "my mail is {email:peter at uni-bonn punkt de}",
    "correo {email:luis arroba correo punto es} gracias",
    "send it to {email:sales at shop dot co dot uk}",
    "he looked at the dot on the wall and at the clock",
    "we met at noon at the dot of twelve",
    "they arrived at point three of the list",
    "call {phone:(555) 123-4567} now",
    "phone : {phone:555-123-4567}",
    "tel {phone:030 1234 5678} oder",
    "fax {phone:(030) 12345-678} bitte",
    "my cell is {phone:555.867.5309} ok",
    "ring {phone:0044 20 7946 0958} at home",
    "mobile {phone:07700 900123}",
    "the number {phone:(212) 555-0199} is ours",
    "invoice 20231104 was paid",
    "order 123456789 shipped on 2024-01-31",
    "in 1999-2004 we sold 1000000 units",
    "on 12.05.2021 and 13.06.2022 they met",
    "isbn 978-3-16-148410-0 is a book",
    "pages 100-200 and 300-400 of 5000",
    "version 10.4.2.11 of the tool 4.0.1",
    "serial 4486733645976649 of the device",
    "the sum of 3,200,450 and 1.250.000 euro",
    "code 8400 1177 2231 9 expired",
    "at 10:45:30 on 2020-02-02 it was 12.50",
    "total 1234567 and 7654321",
    "card {card:4111 1111 1111 1111} expires",
    "visa {card:4000-0566-5566-5556} charged",
    "host {ip:192 . 168 . 0 . 12} is down",
    "server {ip:10 [.] 0 [.] 4 [.] 7} answers",
)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def candidate(text: str, span: list[tuple[int, int]]) -> bool:
    """A segment that may be an entity: enough digits, or a sign or word for ``@`` with one for a dot."""
    part = text[span[0][0] : span[-1][1]]
    d = sum("0" <= c <= "9" for c in part)
    if "\n" in part or part[-1] in ".,;:-([" or part[0] in ".,;:-)]":
        return False
    if d >= 7:
        return d >= 0.5 * len(part)
    low = {text[a:z].lower() for a, z in span}
    if d >= 4 and sum(text[a:z] == "." for a, z in span) >= 3:
        return d + sum(c in " .[]()" for c in part) == len(part)
    return len(span) >= 4 and not low.isdisjoint(_AT) and not low.isdisjoint(_DOT) and text[span[-1][0]].isalnum()


def _parts(text: str, toks: list[tuple[int, int]], i: int, j: int) -> tuple:
    """What the features of all kinds are made of."""
    part = text[toks[i][0] : toks[j - 1][1]]
    digits = _digits(part)
    groups = re.findall("[0-9]+", part)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "0", re.sub(r"\s+", " ", part)))
    low = [text[a:z].lower() for a, z in toks[i:j]]
    before = [text[a:z].lower() for a, z in toks[max(i - 3, 0) : i]]
    return part, digits, groups, shape, low, before, any(c.isalpha() for c in part)


def features(text: str, toks: list[tuple[int, int]], i: int, j: int, kind: str, parts: tuple | None = None) -> list[str]:
    """Features of the segment of tokens i..j-1 as an entity of a kind."""
    part, digits, groups, shape, low, before, letters = parts or _parts(text, toks, i, j)
    out = [kind, f"{kind}|letters={letters}", f"{kind}|n={min(len(digits), 20)}", f"{kind}|groups={min(len(groups), 6)}", f"{kind}|shape={shape if len(shape) < 24 else 'long'}"]
    out.append(f"{kind}|cue={not _CUES[kind].isdisjoint(before)}")
    if kind == "email":
        ats = [k for k, w in enumerate(low) if w in _AT]
        dots = [k for k, w in enumerate(low) if w in _DOT]
        out += [f"email|ats={min(len(ats), 3)}", f"email|order={bool(ats) and bool(dots) and ats[0] < dots[-1]}", f"email|last={2 <= len(low[-1]) <= 4 and low[-1].isalpha()}", f"email|first={len(low[0]) > 1 or len(ats) == 0}"]
        plain = [w for w in low if w.isalpha() and w not in _AT and w not in _DOT]
        out.append(f"email|words={min(len(plain), 7)}|marks={min(len(ats) + len(dots), 5)}")
        out.append(f"email|tight={all(w in _AT or w in _DOT or low[k + 1] in _AT | _DOT | set('[]()-') for k, w in enumerate(low[:-1]) if w.isalpha())}")
    elif kind == "ip":
        out.append(f"ip|parts={len(groups) == 4 and all(int(g[:4]) <= 255 for g in groups)}")
        out.append(f"ip|spaced={' . ' in part or '[.]' in part}")
    elif kind == "card":
        out += [f"card|luhn={16 <= len(digits) <= 19 and luhn(digits)}", f"card|fours={all(len(g) == 4 for g in groups)}"]
    else:
        out += [f"phone|pattern={'-'.join(str(len(g)) for g in groups)}" if len(groups) < 6 else "phone|many", f"phone|paren={part[0] == '('}", f"phone|size={9 <= len(digits) <= 14 and len(groups) > 1}"]
        out.append(f"phone|date={bool(re.fullmatch(r'(?:19|20)[0-9]{2}[-.][0-9]{1,2}[-.][0-9]{1,2}|[0-9]{1,2}[-.][0-9]{1,2}[-.](?:19|20)[0-9]{2}', part))}")
    return out


def _segments(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    digits, ats, dots = [0], [0], [0]  # before each token; a candidate has digits, or a sign for ``@`` and one for a dot
    for a, z in toks:
        w = text[a:z].lower()
        digits.append(digits[-1] + (z - a if "0" <= w[0] <= "9" else 0))
        ats.append(ats[-1] + (w in _AT))
        dots.append(dots[-1] + (w in _DOT))
    if digits[-1] < 4 and not (ats[-1] and dots[-1]):
        return []
    return [
        (i, j)
        for j in range(1, len(toks) + 1)
        for i in range(max(0, j - LONGEST), j)
        if (digits[j] - digits[i] >= 4 or j - i >= 4 and ats[j] > ats[i] and dots[j] > dots[i]) and candidate(text, toks[i:j])
    ]


def _parse(marked: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(\w+):([^}]*)\}", marked):
        text += marked[at : m.start()]
        spans.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + marked[at:], spans


def train() -> dict[str, float]:
    """Weights of the features: gradient ascent on the log likelihood of the labelled segmentations."""
    index: dict[str, int] = {}
    data = []
    for marked in LABELLED:
        text, spans = _parse(marked)
        toks = tokens(text)
        gold = {(a, z): k for k, a, z in spans}
        edges = []  # (from, to, feature numbers, is gold)
        for i, j in _segments(text, toks):
            for kind in KINDS:
                f = [index.setdefault(x, len(index)) for x in features(text, toks, i, j, kind)]
                edges.append((i, j, f, gold.get((toks[i][0], toks[j - 1][1])) == kind))
        covered = {k for k, (a, z) in enumerate(toks) for (x, y) in gold if x <= a and z <= y}
        outside = [(k, k + 1, [], k not in covered) for k in range(len(toks))]
        data.append((len(toks), edges + outside))
    w = np.zeros(len(index))
    for r in range(ROUNDS):
        gradient = -DECAY * w * len(data)
        for n, edges in data:
            score = np.array([w[f].sum() if f else 0.0 for _, _, f, _ in edges])
            into, from_ = defaultdict(list), defaultdict(list)
            for e, (i, j, _, _) in enumerate(edges):
                into[j].append((e, i))
                from_[i].append((e, j))
            forward, backward = np.full(n + 1, -math.inf), np.full(n + 1, -math.inf)
            forward[0] = backward[n] = 0.0
            for j in range(1, n + 1):
                forward[j] = np.logaddexp.reduce([forward[i] + score[e] for e, i in into[j]])
            for i in range(n - 1, -1, -1):
                backward[i] = np.logaddexp.reduce([backward[j] + score[e] for e, j in from_[i]])
            for e, (i, j, f, gold) in enumerate(edges):
                if f:
                    p = math.exp(min(forward[i] + score[e] + backward[j] - forward[n], 0.0))
                    np.add.at(gradient, f, gold - p)
        w += STEP / (1 + r / 20) * gradient
    return {f: float(w[k]) for f, k in index.items()}


def decode(text: str, toks: list[tuple[int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Best segmentation: boundaries and kinds together. Ties go to fewer entities, then to the kind
    that KINDS lists first."""
    best, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
    into = defaultdict(list)
    for i, j in _segments(text, toks):
        into[j].append(i)
    for j in range(1, len(toks) + 1):
        best[j] = best[j - 1]
        for i in into[j]:
            parts = _parts(text, toks, i, j)
            for kind in KINDS:
                s = best[i] + sum(weights.get(f, 0.0) for f in features(text, toks, i, j, kind, parts))
                if s > best[j] + 1e-9:
                    best[j], back[j] = s, (kind, i)
    out, j = [], len(toks)
    while j:
        if back[j]:
            kind, i = back[j]
            out.append((kind, toks[i][0], toks[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def triggers(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Places outside base spans where a segment that ``candidate`` takes may lie: numbers and spelled
    addresses, then runs of digits parted by up to six characters with seven digits, or four and three
    dots, and signs or words for ``@`` with one for a dot on the same line nearby."""

    def free(m) -> bool:
        return not any(a < m.end() and m.start() < z for _, a, z in base)

    first = [m.span() for m in (_BOTH if _MAY_SPELL.search(text) else _NUMBERS).finditer(text) if free(m)]
    more = []
    for m in _RUN.finditer(text):
        d = len(_digits(m[0]))
        if d >= 7 or d >= 4 and m[0].count(".") >= 3:
            at = m.start()  # what lies between the base spans
            for a, z in [*sorted((a, z) for _, a, z in base if a < m.end() and m.start() < z), (m.end(), m.end())]:
                part = text[at:a]
                d = len(_digits(part))
                if d >= 7 or d >= 4 and part.count(".") >= 3:
                    more.append((at, a))
                at = max(at, z)
    for m in _ANY_AT.finditer(text):
        low, high = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 12 * MARGIN), m.end() + 12 * MARGIN
        line = text.find("\n", m.end(), high)
        if free(m) and _ANY_DOT.search(text, low, line if line >= 0 else min(high, len(text))):
            more.append(m.span())
    out, reach = [], -1
    known = set(first)
    for a, z in sorted(known.union(more), key=lambda s: (s[0], -s[1])):
        if (a, z) in known or z > reach:
            out.append((a, z))
            reach = max(reach, z)
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans of the field that touch no base span. Only the surroundings of triggers are segmented."""
    out = []
    last = -1
    for start, stop in triggers(text, base):
        low, high = max(last, start - 12 * MARGIN, 0), min(stop + 12 * MARGIN, len(text))
        while low > 0 and low > last and text[low - 1].isalnum():
            low -= 1
        region = text[low:high]
        toks = tokens(region)
        first = next((k for k, t in enumerate(toks) if t[1] > start - low), 0)
        end = next((k for k, t in enumerate(toks) if t[0] >= stop - low), len(toks))
        toks = toks[max(first - MARGIN, 0) : end + MARGIN]
        for kind, a, z in decode(region, toks, weights):
            if low + a >= last and not any(x < low + z and low + a < y for _, x, y in base):
                out.append((kind, low + a, low + z))
                last = low + z
    return out


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added spans), one
    row per row of ``docs``.

    Null and empty texts have no spans. Spans of one kind don't overlap, leftmost first; those of
    several kinds may, and all base spans stay. Repeated rows and rows with a null doc_id are searched
    like others, whole texts however long; other columns are not looked at.
    """
    ship(docs.sparkSession)
    weights = train()
    kind_ = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, "_text"):
            counts, hashes, joined = [], [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                hashes.append(hashlib.sha256(_join(base).encode()).hexdigest())
                joined.append(_join(base + added_spans(t, base, weights)))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(joined, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    narrow = docs.select("doc_id", text_of().alias("_text"))
    return narrow.mapInArrow(run, f"doc_id {kind_}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
