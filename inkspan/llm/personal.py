"""Personal data: base patterns, and further spans chosen by boosted trees.

High-recall generators propose overlapping candidates of each kind: spelt-out or broken mail addresses,
dotted numbers, and runs of digits with separators, each as a card and as a phone number. Boosted
trees score a candidate by its format and the words before it. They are trained on a bounded sample
of documents, where candidates that are base spans of their kind are right and candidates apart from
every base span of their kind are wrong; what the base rules test outright (a plus sign, a check sum, the
signs and part sizes of addresses) is kept from the trees, so that they learn how such data look and where they
stand. An address that is only written in another way (see ``plain``) is neither right nor wrong. Scores are
calibrated on documents not fitted on, and the threshold of each kind is the least one with the wanted precision
there. Candidates that reach it and touch no base span are added; base spans always stay.

Defined cases: null and empty texts have no spans; repeated rows are read one by one. Without a sample
of both kinds nothing is added. Computed columns replace columns of their name. Spans count code
points, end exclusive.
"""

from __future__ import annotations

import bisect
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm import boosting
from inkspan.llm.frames import append_columns, bounded_batches, column, fresh_name

KINDS = ("email", "ip", "card", "phone")
MAX_FIT_DOCUMENTS = 8_000
MAX_FIT_CANDIDATES = 50_000
PRECISION = 0.95
LEAST_SEEN = 5  # right and wrong candidates a kind needs for a threshold of its own
BEFORE = 40  # characters of context

# Fixed patterns of the base rules. The part of an address before the @ is looked up backwards, and a
# dotted number starts where its digits start: the same matches without trying every character.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Candidate generators.
SPELT = re.compile(
    r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64} ?(?:@|[\[(]at[\])]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}"
)
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9])+")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9])")
WANTED = re.compile(r"[0-9@]|\bat\b")

AT = re.compile(r" ?(?:@|[\[(]at[\])]) ?")
DOT = re.compile(r" ?[\[(]dot[\])] ?| dot ")

HINTS = (
    re.compile(r"(?i)mail|contact|write|@"),
    re.compile(r"(?i)\bip\b|host|server|addr|ping|client"),
    re.compile(r"(?i)card|visa|credit|pay|master|account"),
    re.compile(r"(?i)phone|\btel|call|mobile|fax|cell"),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind (place in KINDS), start, end."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed spans; they may overlap."""
    found = [(0, *m.span()) for m in SPELT.finditer(text)]
    found += [(1, *m.span()) for m in DOTTED.finditer(text)]
    for m in NUMBER.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        if 7 <= digits <= 19:
            found.append((2, *m.span()))
            found.append((3, *m.span()))
    return found


def plain(kind: int, span: str) -> str:
    """An address as the base patterns have it: signs for [at] and [dot], dots for commas.

    A bare 'at' is a sign only where a 'dot' is spelt out too, since it stands in other sentences.
    """
    if kind == 1:
        return span.replace(",", ".")
    if kind:
        return span
    spelt = AT.sub("@", DOT.sub(".", span), count=1)
    return spelt.replace(" at ", "@", 1) if "@" not in spelt and DOT.search(span) else spelt


def unsettled(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a candidate that is no base span may be one written in another way.

    Numbers with commas may be a list as well; they are left open only after words that tell of an address.
    """
    if kind > 1 or (kind == 1 and not HINTS[1].search(text[max(0, start - BEFORE) : start])):
        return False
    span = plain(kind, text[start:end])
    return (kind, 0, len(span)) in base_spans(span)


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span, before = plain(kind, text[start:end]), text[max(0, start - BEFORE) : start]
    groups = [g for g in NOT_DIGIT.split(span) if g]
    sizes = [len(g) for g in groups] or [0]
    digits = sum(sizes)
    after = text[end : end + 1]
    return [
        *[float(kind == k) for k in range(4)],
        float(len(span)), float(digits), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[-1]),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("(")), float(span.count("/")),
        float(sum(c.isalpha() for c in span)),
        float(kind > 1 and max((int(g[:6]) for g in groups), default=0) <= 255),
        float(before[-1:].isalnum()), float(after.isalnum()),
        *[float(bool(h.search(before))) for h in HINTS],
    ]


class _Taken:
    """Spans that may overlap each other, asked for overlaps with a further one by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        # Joined where they overlap, so that starts and ends both rise.
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        """A span that overlaps none."""
        k = bisect.bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def learnable(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a document's candidates that the base rules settle."""
    base = base_spans(text)
    own = [[(x, y) for k, x, y in base if k == kind] for kind in range(len(KINDS))]
    # A generator may take in one sign more, e.g. an opening bracket.
    near = [{(x + d, y) for x, y in spans for d in (-1, 0, 1)} for spans in own]
    taken = [_Taken(spans) for spans in own]
    rows, labels = [], []
    for kind, a, b in candidates(text):
        right = (a, b) in near[kind]
        if right or not (taken[kind].overlaps(a, b) or unsettled(text, kind, a, b)):
            rows.append(features(text, kind, a, b))
            labels.append(int(right))
    return rows, labels


def _threshold(model: boosting.Trees, x: np.ndarray, y: np.ndarray, kind: int, precision: float) -> float:
    """That of the kind's own candidates; of all candidates if too few of them were seen right and wrong."""
    own = x[:, kind] > 0
    if min(y[own].sum(), (1 - y[own]).sum()) < LEAST_SEEN:
        return model.threshold
    return boosting.least_threshold(model.probability(x[own]), y[own], precision, 2.0)


def fit(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_documents: int = MAX_FIT_DOCUMENTS,
    max_candidates: int = MAX_FIT_CANDIDATES, precision: float = PRECISION,
) -> bytes:
    """The model, from at most ``max_documents`` documents (smallest id hash) and ``max_candidates`` candidates.

    Every fifth of these documents, by another hash, calibrates.
    """
    bounded_batches(docs.sparkSession)
    sample = (
        docs.select(F.col(id_column).alias("_id")).filter(F.col("_id").isNotNull()).distinct()
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_documents)
    )
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(
        F.broadcast(sample), "_id"  # bounded by max_documents
    ).filter(F.col("_text").rlike("[0-9@]"))

    def extract(batches):
        for batch in batches:
            out = [learnable(t) for t in batch.column("_text").to_pylist()]
            orders = batch.column("_order").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o for o, (x, _) in zip(orders, out, strict=True) for _ in x], pa.int64()),
                    pa.array([r for x, _ in out for r in x], pa.list_(pa.float64())),
                    pa.array([v for _, y in out for v in y], pa.int32()),
                ],
                ["rank", "x", "y"],
            )

    found = rows.mapInArrow(extract, "rank long, x array<double>, y int").orderBy("rank", "x", "y").limit(max_candidates)

    def learn(batches):
        parts = [b for b in batches if len(b)]
        model = None
        if parts:
            taken = pa.Table.from_batches(parts).sort_by([("rank", "ascending")])
            x = np.array(taken["x"].to_pylist())
            y = taken["y"].to_numpy().astype(float)
            apart = taken["rank"].to_numpy() // 7 % 5 == 0
            if y[~apart].min(initial=1) != y[~apart].max(initial=0):
                model = boosting.fit(x[~apart], y[~apart])
                boosting.calibrate(model, x[apart], y[apart], precision)
                model.thresholds = [_threshold(model, x[apart], y[apart], k, precision) for k in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    learned = found.repartition(1).mapInArrow(learn, "model binary").first()
    return bytes(learned["model"]) if learned else pickle.dumps(None)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
_KIND = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]
)


def detect(docs: DataFrame, model: bytes, text_column: str = "text") -> DataFrame:
    """``docs`` with personal: spans with kind, start, end, base (else chosen by the trees) and score, in span order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the trees

    def make():
        trees = pickle.loads(shared.value)

        def compute(batch):
            texts = [t or "" for t in column(batch, text_column).to_pylist()]
            base = [base_spans(t) if WANTED.search(t) else [] for t in texts]
            spans = [[(k, a, b, True, 1.0) for k, a, b in s] for s in base]
            if trees is not None and min(trees.thresholds, default=2) <= 1:
                proposed = []
                for i, t in enumerate(texts):
                    if WANTED.search(t):
                        taken = _Taken([(a, b) for _, a, b in base[i]])
                        proposed += [(i, *c) for c in candidates(t) if not taken.overlaps(c[1], c[2])]
                if proposed:
                    x = np.array([features(texts[i], k, a, b) for i, k, a, b in proposed])
                    p = trees.probability(x)
                    # The best of overlapping candidates, whatever their kind.
                    chosen: dict[int, _Taken] = {}
                    for j in np.argsort(-p, kind="stable"):
                        i, k, a, b = proposed[j]
                        if p[j] >= trees.thresholds[k] and not chosen.setdefault(i, _Taken([])).overlaps(a, b):
                            chosen[i].add(a, b)
                            spans[i].append((k, a, b, False, float(p[j])))
            out = [
                [
                    {"kind": KINDS[k], "start": a, "end": b, "base": known, "score": s}
                    for k, a, b, known, s in sorted(row, key=lambda v: (v[1], v[0]))
                ]
                for row in spans
            ]
            return [pa.array(out, pa.list_(_KIND))]

        return compute

    return append_columns(docs, make, f"personal {SPANS}")


def redact(docs: DataFrame, model: bytes, text_column: str = "text", mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (``{}`` stands for its kind; overlapping spans are one, of the first's kind),
    and the spans found, which count in the text as it was. Texts without a span, null ones too, stay as they are."""
    clean = fresh_name(docs, "_clean")

    def make():
        def compute(batch):
            out = []
            for text, spans in zip(column(batch, text_column).to_pylist(), column(batch, "personal").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], mask.format(s["kind"])]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]) if parts else None)
            return [pa.array(out, pa.string())]

        return compute

    found = append_columns(detect(docs, model, text_column), make, f"{clean} string")
    text = F.coalesce(clean, F.col(text_column)).alias(text_column)
    return found.select(*[text if c == text_column else c for c in found.columns if c != clean])


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
