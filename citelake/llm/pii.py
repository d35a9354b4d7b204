"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: the four base patterns and looser ones (local
phone numbers, spelled-out e-mail addresses, social security numbers, account numbers, colon
addresses). A valid base span is always reported. Every other candidate is described by its format
and its context and judged by boosted trees; each kind has a calibrated threshold, the lowest that
keeps PRECISION on held-out examples. Among accepted added spans that overlap, the likelier wins;
an added span that a base span overlaps is left out.

The trees are fitted on generated, seeded examples, TRAINING_EXAMPLES / 4 of each label for each loose kind (real formats
and look-alikes such as part numbers, versions, sums and plain digits, in neutral and in telling
contexts), so they never depend on the corpus. The model is a few KB and is broadcast.

Kinds in their fixed order: email, ip, card, phone, then ssn, iban, ipv6. Added spans may have the
kinds email and phone too, so the base spans are also given by themselves; only they are counted and
digested by the query. Spans count code points, ends exclusive. Every whole text is read once; nothing is shuffled.

Defined cases: a null text counts as empty (and redacts to null); an empty text has no spans;
repeated rows give repeated rows; an empty table gives an empty table; columns other than those
named are ignored by pii_spans and kept by redact.
"""

from __future__ import annotations

import bisect
import ipaddress
import random
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm.boosting import BoostedTrees
from citelake.llm.common import map_texts, read_table, slices
from citelake.llm.secrets import SPANS, joined, of_kind

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "ipv6")
PRECISION = 0.97
TRAINING_EXAMPLES = 2000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never begins inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser generators, by kind.
_LOOSE = {
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20-]?|0[0-9]{1,4}[\x20/-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    "email": re.compile(r"[A-Za-z0-9._-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(
        r"(?<![A-Za-z0-9:])(?:(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){1,7}:"
        r"|:(?::[0-9A-Fa-f]{1,4}){1,7}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![A-Za-z0-9:])"
    ),
}
#: Fixed cue words in the 40 characters before a candidate, by kind.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"),
    "email": ("mail", "contact", "write", "reach"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ipv6": ("ip", "address", "host", "server"),
    "not": ("version", "part", "isbn", "order", "item", "model", "invoice", "price", "page", "ratio", "serial"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_checks(text: str) -> bool:
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def ipv6_parses(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The valid base spans by kind, then start; matches are leftmost and don't overlap."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in _LOOSE.items() for m in pattern.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = [c for c in span if "0" <= c <= "9"]
    left, right = text[start - 1 : start], text[end : end + 1]
    area = "".join(digits)[:3]
    return [
        KINDS.index(kind), len(span), len(digits), len(digits) / len(span),
        span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["), span.count(":"),
        len(set(digits)), float(span[0] == "("), float(span[0] == "0"),
        float(bool(left) and left.isalnum()), float(bool(right) and right.isalnum()), float(left in {"#", "$", "€", "/", "="}) * bool(left),
        float(any(c in before for c in CUES.get(kind, ()))), float(any(c in before for c in CUES["not"])),
        float(area in {"000", "666"} or area >= "900") if kind == "ssn" else 0.0,
        float((kind == "iban" and iban_checks(span)) or (kind == "ipv6" and ipv6_parses(span))), float("dot" in span.lower()), len(set(span)) / len(span),
    ]


# -- training ----------------------------------------------------------------------------------


def _examples(kind: str, wanted: int, rng: random.Random) -> tuple[list, list]:
    """Feature rows and labels of generated texts in which a candidate of the kind is found."""
    word = lambda n=6: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, n)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def iban(valid: bool) -> str:
        body = d(18)
        check = 98 - int(body + "1314" + "00") % 97  # country DE
        flat = f"DE{check if valid else (check + 7) % 97:02d}{body}"
        return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if rng.random() < 0.5 else flat

    def compressed() -> str:
        head = [rng.choice(["2001", "2001:db8", "2a02", "fe80", "fd00", f"{rng.randint(8192, 16383):x}"])] + [f"{rng.randint(0, 65535):x}" for _ in range(rng.randint(0, 2))]
        return ":".join(head) + "::" + ":".join(f"{rng.choice([rng.randint(0, 255), rng.randint(0, 65535)]):x}" for _ in range(rng.randint(1, 4)))

    real = {
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(4)}"]),
        "email": lambda: f"{word()}.{word()} [at] {word(9)} [dot] {rng.choice(['com', 'org', 'net'])}" if rng.random() < 0.6 else f"{word()}(at){word(9)}.com",
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{d(2)}-{d(4)}",
        "iban": lambda: iban(True),
        "ipv6": lambda: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)) if rng.random() < 0.5 else compressed(),
    }[kind]
    fake = {
        "phone": lambda: rng.choice([f"{d(3)} {d(3)} {d(3)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(4)} {d(4)}", f"0{d(1)}/{d(3)}-{d(3)}", f"000-{d(3)}-0000"]),
        "email": lambda: f"{word()} (at) {word()} . {word()}",
        "ssn": lambda: f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}",
        "iban": lambda: iban(False),
        "ipv6": lambda: ":".join(d(2) for _ in range(rng.randint(4, 6))) if rng.random() < 0.7 else "::".join(rng.choice(["a", "be", "ad", "add", "face", "dead", "feed", "cafe"]) for _ in range(2)),
    }[kind]
    x, y = [], []
    for n in range(wanted * 2):
        label = n % 2
        cue = rng.random()
        lead = f"{rng.choice(CUES[kind])} " if cue < (0.6 if label else 0.1) else f"{rng.choice(CUES['not'])} " if cue > (0.97 if label else 0.5) else ""
        text = f"{word()} {word()} {lead}{rng.choice(['', ': ', 'is ']) if lead else ''}{(real if label else fake)()}{rng.choice([' ', '. ', ', '])}{word()}"
        if not label and not lead.strip() and rng.random() < 0.3:
            text = text.replace(" ", " #", 1)
        for k, s, e in candidates(text):
            if k == kind:
                x.append(features(text, k, s, e))
                y.append(label)
    return x, y


class Model:
    def __init__(self, seed: int = 4):
        rng = random.Random(seed)
        fitted: tuple[list, list] = ([], [])
        held: dict[str, tuple] = {}
        for kind in _LOOSE:
            x, y = _examples(kind, TRAINING_EXAMPLES // 4, rng)
            cut = len(x) * 2 // 3
            fitted[0].extend(x[:cut])
            fitted[1].extend(y[:cut])
            held[kind] = np.array(x[cut:]), np.array(y[cut:])
        self.trees = BoostedTrees().fit(np.array(fitted[0]), np.array(fitted[1], dtype=float))
        self.trees.calibrate(np.vstack([h[0] for h in held.values()]), np.concatenate([h[1] for h in held.values()]))
        self.thresholds = {kind: _threshold(self.trees.predict(x), y) for kind, (x, y) in held.items()}

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Base spans and accepted additions, by kind, then start."""
        return self.both(text)[1]

    def both(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """The base spans alone, and with the accepted additions; each by kind, then start."""
        if not text:
            return [], []
        base = alone = base_spans(text)
        taken = _Stretches(base)
        loose = [c for c in candidates(text) if not taken.meets(c)]
        if loose:
            p = self.trees.predict(np.array([features(text, *c) for c in loose]))
            added, chosen = [], _Stretches([])
            for _, c in sorted(((-v, c) for v, c in zip(p, loose, strict=True) if v >= self.thresholds[c[0]]), key=lambda t: (t[0], t[1][1], KINDS.index(t[1][0]))):
                if not chosen.meets(c):
                    chosen.add(c)
                    added.append(c)
            base = base + added
        return alone, sorted(base, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


class _Stretches:
    """Stretches of a text that are apart from each other, sorted, so that a span is held against its neighbours only."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: tuple[str, int, int]) -> bool:
        k = bisect.bisect_left(self.starts, span[2]) - 1  # the last that begins before the span ends
        return k >= 0 and self.ends[k] > span[1]

    def add(self, span: tuple[str, int, int]) -> None:
        k = bisect.bisect_left(self.starts, span[1])
        self.starts.insert(k, span[1])
        self.ends.insert(k, span[2])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold whose accepted held-out rows keep PRECISION; 1.1 (none) without one."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= PRECISION) & np.append(p[order][1:] < p[order][:-1], True))
    return float(p[order][last[-1]]) if len(last) else 1.1


@cache
def trained() -> Model:
    return Model()


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """text with every span replaced by its kind; spans that overlap become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, pii_spans, the spans of each whole text, and base_spans, those of the base patterns."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def make() -> Callable[[list], dict[str, list]]:
        model = shared.value

        def spans(texts: list) -> dict[str, list]:
            base, every = zip(*map(model.both, texts), strict=True) if texts else ((), ())
            return {name: [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found] for name, found in (("pii_spans", every), ("base_spans", base))}

        return spans

    return map_texts(docs, id_column, text_column, f"pii_spans {SPANS}, base_spans {SPANS}", make)


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the personal data in text_column replaced; the other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = [redacted(t, model.spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(read_table(spark, sf_dir, "documents"))
    spans, base = F.col("pii_spans"), F.col("base_spans")
    return found.select(
        "doc_id",
        *(F.size(of_kind(base, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
