"""Personal data: candidate spans scored by boosted trees, beside exact base patterns."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Calibration
from .common import per_batch

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base patterns. The look-behind only spares restarts inside a run of digits.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Texts that carry planted examples for the fit, and characters taken from each; the only data fitted on.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 2000
#: Planted examples in the fit: half train, a quarter calibrates, a quarter is held out to measure.
EXAMPLES = 8000
#: Calibrated probability from which a span is taken.
PRECISION = 0.95


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of local part, ``@``, domain; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind as listed, then start. Matches that fail their check are dropped."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) < 4 and int(x) <= 255 or int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# High-recall generators. Each proposes spans for one kind; they overlap each other and the base spans.
_AT = r"(?:@|[\[({]\x20?at\x20?[\])}]|\x20at\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
GENERATORS = (
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?{_AT}\x20?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z.:])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{2,6}(?:[\x20._/-]{0,2}[0-9]{2,7}){2,5}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-][0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])(?:\+|00)?\(?[0-9]{1,5}\)?(?:[\x20()./-]{0,3}[0-9]{2,5}){2,5}(?![0-9A-Za-z])")),
)
#: Part of each e-mail the generator proposes, so a text without it has none.
EMAIL_AT = re.compile(_AT, re.I)
#: Last labels of common domains. Fixed values.
DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "us"}
#: Words that often stand before a kind. Fixed values.
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "addr", "address"),
    "card": ("card", "visa", "credit", "pay", "tarjeta", "carte", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "sms", "telefon"),
    "other": ("version", "isbn", "order", "invoice", "date", "id", "no", "ref", "page", "build"),
}


def candidates(text: str) -> list[Span]:
    """Spans that some generator proposes; a text without a digit and without an ``@`` or its spelling has none."""
    out: list[Span] = []
    digits = DIGIT.search(text) is not None
    some_at = EMAIL_AT.search(text) is not None
    for kind, pattern in GENERATORS:
        if some_at if kind == "email" else digits:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    kind, a, b = span
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 8]
    near = set(re.findall(r"[a-z]+", before))
    octets = [int(g) for g in groups if len(g) < 4]
    separators = re.sub(r"[0-9A-Za-z]", "", s)
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[0]) if groups else 0,
        len(groups[-1]) if groups else 0,
        sum(c.isalpha() for c in s),
        len(separators),
        len(set(separators)),
        s.count("."),
        s.count("-"),
        s.count(" "),
        s.count(":"),
        s.count("/"),
        "(" in s or "[" in s,
        s.startswith("+"),
        s.startswith("00"),
        digits.startswith("0"),
        "@" in s,
        re.split(r"[^a-z]+", s.lower())[-1] in DOMAINS,
        s[-1:].isalpha(),
        bool(re.search(r"\bdot\b", s, re.I)),
        bool(re.search(r"\bat\b", s, re.I)),
        13 <= len(digits) <= 19 and luhn(digits),
        len(groups) == 4 and len(octets) == 4 and max(octets) <= 255,
        len(groups) == 3 and len(groups[0]) == 4 and len(groups[1]) == 2 == len(groups[2]),
        len(groups) == 3 and max(map(len, groups)) <= 4 and len(digits) <= 8,
        before[-1:].isalnum(),
        before[-1:] in tuple("$€£#=/v") if before else False,
        after[:1].isalnum(),
        after[:1] in tuple("%€=/") if after else False,
        bool(DIGIT.search(before[-3:])),
        *(any(w.startswith(c) for w in near for c in cues) for k, cues in CUES.items() if k != "other"),
        any(w in near for w in CUES["other"]),
    ]


def _planted(rnd: random.Random) -> tuple[str | None, str, str]:
    """(kind or None, cue before, span text) of one planted example; None marks a look-alike."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(3, 9)))
    octet = lambda: str(rnd.randint(1, 255))
    pick = rnd.choice
    kind = pick(["email", "ip", "card", "phone", None, None, None, None])
    cue = pick(CUES[kind]) + pick(["", ":"]) + " " if kind and rnd.random() < 0.5 else ""
    if kind == "email":
        at, dot = pick([("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", ".")])
        return kind, cue, f"{w()}{pick(['', '.' + w(), d(2)])}{at}{w()}{dot}{pick(['com', 'org', 'net', 'de', 'fr', 'es'])}"
    if kind == "ip":
        part = lambda n: ":".join(f"{rnd.getrandbits(16):x}" for _ in range(n))
        if rnd.random() < 0.2:
            return kind, cue, part(8)
        if rnd.random() < 0.25:
            head = rnd.randint(1, 4)
            return kind, cue, f"{pick(['fe80', '2001:db8', part(head)])}::{part(rnd.randint(1, 4))}"
        return kind, cue, pick([".", "[.]", "(.)", " . "]).join(octet() for _ in range(4))
    if kind == "card":
        body = pick("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, cue, pick(["", " ", "-", ".", "/", "_"]).join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        if rnd.random() < 0.4:
            # National forms: without a cue few of them could be told from other numbers.
            lead, pair = pick("1234679"), lambda: d(2)
            form = pick([
                pick([" ", ".", "-"]).join([f"0{lead}", pair(), pair(), pair(), pair()]), f"0{pick('1236789')}{d(pick([1, 2, 3]))}{pick([' / ', '/', ' ', '-'])}{d(rnd.randint(5, 8))}",
                f"{pick('69')}{d(2)} {d(3)} {d(3)}", f"0{pick('17')}{d(3)} {d(6)}", f"020 {d(4)} {d(4)}", f"{pick('23456789')}{d(9)}",
            ])
            return kind, pick(CUES["phone"]) + pick([" ", ": ", " is ", " no. "]), form
        area, x, y = d(3), d(3), d(4)
        form = pick(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "+1 ({}) {}-{}", "001 {} {} {}", "({}){}-{}"])
        plain = "(" not in form and not form.startswith(("+", "00"))
        return kind, (cue or pick(CUES["phone"]) + " ") if plain else cue, form.format(area, x, y)
    cue = pick(CUES["other"]) + " " if rnd.random() < 0.5 else ""
    card = d(15)
    bad_luhn = card + next(c for c in "0123456789" if not luhn(card + c))
    return None, cue, pick([
        f"{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 40)}", f"{rnd.randint(1990, 2030)}-{d(1)}{d(1)}-{d(2)}",
        f"{rnd.randint(1, 28):02d}/{rnd.randint(1, 12):02d}/{rnd.randint(1990, 2030)}", f"{d(3)},{d(3)}.{d(2)}", d(rnd.randint(5, 12)),
        bad_luhn, " ".join(bad_luhn[i : i + 4] for i in range(0, 16, 4)), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(4)}", f"{rnd.randint(256, 999)}.{d(3)}.{d(3)}.{rnd.randint(300, 999)}", f"{d(6)}-{d(6)}-{d(2)}",
        d(10), f"{d(3)} {d(3)} {d(3)}", ":".join(d(2) for _ in range(3)), ":".join(f"{rnd.getrandbits(8):02x}" for _ in range(6)), f"{w()}::{w()}", f"{pick(['add', 'bad', 'face', 'cafe', 'dec'])}::{w()}",
        " ".join(f"{rnd.randint(1, 49):02d}" for _ in range(5)), f"{d(4)} / {d(5)}", f"{d(2)}/{d(4)}",
        f"{w()} at {w()} dot {w()}", f"{w()} at {w()}.{w()}", f"{w()} at {w()}", f"{w()} at {d(rnd.randint(1, 4))}.{d(2)}", f"{rnd.randint(1, 12)} {rnd.randint(10, 60)} {rnd.randint(100, 999)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
    ])


def may_be_personal(text: str, span: Span) -> bool:
    """Whether a candidate that nobody has labelled may well be personal data, so that it teaches nothing."""
    kind, a, b = span
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    if kind == "email":
        return re.split(r"[^a-z]+", s.lower())[-1] in DOMAINS
    if kind == "ip":
        return ":" in s or (len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    near = set(re.findall(r"[a-z]+", text[max(0, a - 24) : a].lower()))
    return s.startswith(("+", "00", "(")) or any(w.startswith(c) for w in near for c in CUES["phone"])


@dataclass
class Detector:
    """Boosted trees with a calibration for each kind, and (precision, recall) on held-out examples."""

    trees: BoostedTrees
    calibrations: dict[str, Calibration]
    precision: float
    held_out: dict[str, tuple[float, float]]

    def probabilities(self, text: str, proposed: list[Span]) -> np.ndarray:
        """Calibrated probability that each candidate is personal data of its kind."""
        score = self.trees.probability(np.array([features(text, c) for c in proposed], float))
        kinds, out = np.array([c[0] for c in proposed]), np.zeros(len(proposed))
        for k in set(kinds.tolist()):
            out[kinds == k] = self.calibrations[k].probability(score[kinds == k])
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans). Added spans overlap neither base ones nor each other; better scores go first, then longer ones."""
        base = base_spans(text)
        proposed = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
        if not proposed:
            return base, base
        p = self.probabilities(text, proposed)
        taken: list[Span] = []
        for i in sorted(range(len(p)), key=lambda i: (-p[i], proposed[i][1] - proposed[i][2], proposed[i])):
            kind, a, b = proposed[i]
            if p[i] >= self.precision and not any(x < b and a < y for _, x, y in taken):
                taken.append(proposed[i])
        return base, sorted(base + taken, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def fit_detector(carriers: list[str], examples: int = EXAMPLES, precision: float = PRECISION, seed: int = 7) -> Detector:
    """Fit on ``examples`` planted into ``carriers``: a candidate is positive when it is a planted span of its kind.

    What the carriers themselves propose is negative only if its format tells
    that it is no personal data (``may_be_personal``); nobody has labelled the
    rest, so it is left out. Of four examples two train the trees, one
    calibrates the scores of each kind, and one is held out. Held-out recall
    is over all planted spans; one that no candidate equals is missed.
    """
    rnd = random.Random(seed)
    carriers = [c for c in carriers if c] or ["and of the in to"]
    x, y, part, kinds, example = [], [], [], [], []
    planted = dict.fromkeys(KINDS, 0)

    def add(text: str, span: Span, hit: bool, at: int, source: int) -> None:
        x.append(features(text, span))
        y.append(hit)
        part.append(at % 4)
        kinds.append(span[0])
        example.append(source)

    for i in range(examples):
        kind, cue, span = _planted(rnd)
        if kind and i % 4 == 3:
            planted[kind] += 1
        text = rnd.choice(carriers)
        at = rnd.randrange(len(text))
        left, right = text[max(0, at - 60) : at], text[at : at + 40]
        whole = f"{left} {cue}{span} {right}"
        start = len(left) + 1 + len(cue)
        for c in candidates(whole):
            if c[1] < start + len(span) and start < c[2]:
                add(whole, c, c[0] == kind and c[1:] == (start, start + len(span)), i, i)
    for i, text in enumerate(carriers):
        base = base_spans(text)
        for c in candidates(text):
            if not any(a < c[2] and c[1] < b for _, a, b in base) and not may_be_personal(text, c):
                add(text, c, False, i, -1)
    x, y, part, kinds, example = np.array(x, float), np.array(y, float), np.array(part), np.array(kinds), np.array(example)
    trees = BoostedTrees().fit(x[part < 2], y[part < 2])
    score = trees.probability(x)
    calibrations, held_out = {}, {}
    for k in KINDS:
        own, rest = (kinds == k) & (part == 2), (kinds == k) & (part == 3)
        calibrations[k] = Calibration(score[own], y[own])
        got = calibrations[k].probability(score[rest]) >= precision
        found = np.unique(example[rest][got & (y[rest] > 0)])
        held_out[k] = (float(y[rest][got].mean()) if got.any() else 1.0, len(found) / max(1, planted[k]))
    return Detector(trees, calibrations, precision, held_out)


def fitted(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Detector:
    """A detector whose carriers are the beginnings of at most ``sample_docs`` documents, picked by a hash of doc_id."""
    # A hash threshold passes about four times the sample, so no task sends more than it has to.
    share = min(1.0, 4 * sample_docs / max(1, docs.count()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    some = (
        docs.filter(F.col("text").isNotNull() & (h <= int(share * (1 << 20))))
        .select(h.alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t"))
        .orderBy("h", "t")
        .limit(sample_docs)
    )
    return fit_detector([r["t"] for r in some.collect()])


def find_personal_data(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Spans of every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base spans; ``spans`` has the detector's
    too. Offsets are code points, ends exclusive. A null text is empty;
    repeated rows give repeated results; other columns are ignored; an empty
    table gives no rows. One narrow pass; the fit uses a bounded sample.
    """
    detector = detector or fitted(docs)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans, added = [], [], [], []
        for text in rows.column("text").to_pylist():
            base, every = detector.spans(text or "")
            counts.append([sum(s[0] == k for s in base) for k in KINDS])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
            added.append(len(every) - len(base))
        columns = list(zip(*counts)) or [()] * len(KINDS)
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id")]
            + [pa.array(c, pa.int64()) for c in columns]
            + [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"n_{k} long" for k in KINDS)
    return per_batch(
        docs.select("doc_id", "text"),
        batch,
        f"doc_id {kind}, {longs}, base_sha256 string, spans string, n_added long",
    )


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, done, last = [], 0, 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < last:
            last = done = max(last, b)
            continue
        out += [text[done:a], f"<{kind.upper()}>"]
        done = last = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` redacted and ``n_chars`` following.

    Null and empty texts, and columns of any other name, stay as they are;
    repeated rows give repeated results; an empty table stays empty.
    """
    detector = detector or fitted(docs)
    columns = docs.columns

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t and redacted(t, detector.spans(t)[1]) for t in rows.column("text").to_pylist()]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            sizes = zip(texts, rows.column("n_chars").to_pylist())
            new["n_chars"] = pa.array([n if t is None else len(t) for t, n in sizes], rows.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in columns], names=columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return per_batch(docs, batch, fields)
