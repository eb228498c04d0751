"""Personal data by weak supervision.

Candidate spans are judged by labelers of three sorts: patterns (form and check
digits), gazetteers (names, hosts, codes) and context (words beside the span). Each
votes for, against or not at all. Expectation-maximisation over the counts of
all vote patterns estimates how reliable each labeler is and how likely each
candidate is personal data; with those likelihoods as labels a logistic
classifier of the spans' own form and context is trained, and it decides. Spans of the
base kinds that pass their check always stay.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_spelled", "phone_local", "national_id", "iban", "account", "hardware", "birth_date", "person")
KINDS = BASE + ADDED
SPAN = "struct<kind:string,nth:int,start:int,end:int,added:boolean>"
FOUND = "base array<struct<kind:int,start:int,end:int>>, candidates array<struct<kind:int,start:int,end:int,votes:int,features:array<int>>>"

# Fixed values of the gazetteers.
GIVEN = frozenset(
    """Ahmed Alice Alexander Andrea Andrew Angela Anna Anthony Antonio Barbara Benjamin Brian Carlos Carmen Catherine Charles Christian Christine
    Claire Daniel David Deborah Diego Donald Elena Elisabeth Elizabeth Emily Emma Fatima Francisco Frank François George Hannah Hans Heinrich Helen
    Isabel Jacques James Jan Javier Jean Jennifer Jessica João Johann John Jorge José Joseph Juan Julia Jürgen Karen Karl Kenji Kevin Klaus Laura
    Li Linda Lisa Louis Lucia Luis Manuel Marco Margaret Maria María Marie Mark Martin Mary Matthew Michael Michel Miguel Mohammed Monika Nancy
    Nicolas Olga Olivier Pablo Patricia Patrick Paul Pedro Peter Philippe Pierre Priya Rachel Richard Robert Roberto Sandra Sarah Sofia Sophie Stefan
    Stephen Steven Susan Thomas Ursula Victor Wei William Wolfgang Yuki""".split()
)
HONORIFICS = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Sir".split())
NO_PERSON = frozenset("university street avenue road institute hospital school college license licence public foundation act award theorem company inc ltd gmbh airport bridge river".split())
MAIL_HOSTS = frozenset("gmail yahoo hotmail outlook icloud aol gmx web protonmail mail live msn orange free".split())
IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LT LU LV MT NL NO PL PT RO SE SI SK".split())
CUES = {
    "email": "email mail e contact write reach correo courriel",
    "ip": "ip address host server from client login",
    "card": "card visa mastercard amex credit debit karte tarjeta carte payment",
    "phone": "phone tel telephone call mobile cell fax telefon teléfono téléphone whatsapp",
    "national_id": "ssn social security number tax id",
    "iban": "iban account bank konto cuenta compte transfer",
    "account": "account card number no konto cuenta compte acct",
    "hardware": "mac hardware device address ethernet",
    "birth_date": "born birth dob birthday geboren né née nacido nacida geburtsdatum",
    "person": "name named contact dear sincerely regards by signed ask attn",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()} | {"email_spelled": frozenset(CUES["email"].split()), "phone_local": frozenset(CUES["phone"].split())}
COUNTER_CUES = frozenset(
    "version v release build isbn issn doi order invoice total section sec chapter figure fig page pp price sku serial ref reference ticket commit hash token rev revision published updated".split()
)

LABELERS = ("form", "check", "gazetteer", "names", "cue", "counter_cue", "embedded")
BUCKETS = 1 << 12
#: Different candidates, with their counts, that the classifier is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Reliabilities stay between these, so that a labeler is never taken for its opposite.
SURE, UNSURE = 0.99, 0.55
#: Bytes of text after which a task hands its rows on.
OUT_TEXT = 1 << 22

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]+ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,}(?!\w)")
_DIGIT_KINDS = {
    "phone_local": re.compile(r"(?<![\w+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "hardware": re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])"),
    "birth_date": re.compile(r"(?<![\w./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./](?:19|20)[0-9]{2})(?![\w/-])"),
}
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+\.?(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++\.?)++")
_CAPITAL = re.compile(r"[^ .]+")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(span: str) -> str:
    return span.replace(" ", "").replace("-", "").replace(".", "").replace("(", "").replace(")", "").replace("+", "")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches in time linear in the text: a local part can't hold an @, so none is read twice."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (host := _HOST.match(text, free)):
            yield start, host.end()
            free = host.end()
        at = free


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of the leftmost non-overlapping matches of each base kind; those that fail their check too."""
    for start, end in _emails(text):
        yield "email", start, end, True
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        for m in _CARD.finditer(text):
            digits = _digits(m[0])
            yield "card", *m.span(), 12 <= len(digits) <= 19 and luhn(digits)
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= len(_digits(m[0])) <= 15


def _people(text: str) -> Iterator[tuple[int, int]]:
    """Capitalised words after a title, or from a given name on."""
    for m in _CAPITALS.finditer(text):
        words = [(m.start() + w.start(), m.start() + w.end()) for w in _CAPITAL.finditer(m[0])]
        i = int(text[max(0, m.start() - 1) : m.start()].isalnum())
        while i < len(words) - 1:
            word = text[slice(*words[i])]
            titled = word in HONORIFICS
            if titled or word in GIVEN:
                first, last = i + titled, min(i + 1 + titled, len(words) - 1)
                yield words[first][0], words[last][1]
                i = last
            i += 1


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans beyond the base kinds that may be personal data."""
    for m in _AT.finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        left = max(0, end - 64)
        start = left + len(text[left:end].rstrip(_LOCAL))
        if start < end:
            yield "email_spelled", start, m.end()
    if _DIGIT.search(text):
        for kind, pattern in _DIGIT_KINDS.items():
            for m in pattern.finditer(text):
                yield kind, *m.span()
    for start, end in _people(text):
        yield "person", start, end


def _beside(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """Up to four words before a span, the nearest last, and two after it."""
    return _WORD.findall(text[max(0, start - 40) : start].lower())[-4:], _WORD.findall(text[end : end + 24].lower())[:2]


def _check(kind: str, span: str, passes: bool) -> int:
    digits = _digits(span)
    if kind == "iban":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind in ("phone_local", "national_id"):
        return -1 if digits[:3] in ("000", "666") or digits[0] == "0" or digits[-4:] == "0000" else 0
    if kind == "account":
        return 1 if luhn(digits) else -1
    return (1 if passes else -1) if kind in BASE else 0


def votes(text: str, kind: str, start: int, end: int, passes: bool = True) -> list[int]:
    """One vote of each labeler: 1 personal, -1 not, 0 none."""
    span = text[start : min(end, start + 80)]
    before, after = _beside(text, start, end)
    inside = set(_WORD.findall(span))
    outer = text[max(0, start - 1) : start] + text[end : end + 1]
    form = {
        "email": "." in span.partition("@")[2], "email_spelled": "[" in span or "(" in span, "phone": "(" in span or " " in span, "phone_local": span[0] == "(" or "-" in span,
        "card": bool(re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", span)), "account": bool(re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", span)),
        "national_id": True, "iban": " " in span, "hardware": ":" in span,
    }.get(kind, False)
    listed = {
        "email": bool({w.lower() for w in inside} & MAIL_HOSTS), "email_spelled": bool({w.lower() for w in inside} & MAIL_HOSTS), "iban": span[:2] in IBAN_COUNTRIES,
    }.get(kind, False)
    reserved = kind == "ip" and span.startswith(("0.", "127.", "255."))
    named = kind == "person" and bool(inside & GIVEN)
    unnamed = kind == "person" and any(w.lower() in NO_PERSON for w in [*inside, *after[:1]])
    title = kind == "person" and any(w.capitalize() in HONORIFICS for w in before[-1:])
    return [
        int(form), _check(kind, span, passes), int(listed) - int(reserved), -1 if unnamed else int(named),
        int(title or bool(CUES[kind] & set(before))), -int(bool(COUNTER_CUES & set(before[-2:]))), -int(any(c.isalnum() or c == "_" for c in outer)),
    ]


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Buckets of a span's kind, form and neighbouring words."""
    span = text[start : min(end, start + 40)]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", span)))
    before, after = _beside(text, start, end)
    sides = text[max(0, start - 1) : start], text[end : end + 1]
    facts = [kind, f"{kind} {shape}", f"size {kind} {min(end - start, 80) // 4}", *(f"left {c!r}" for c in sides[:1] if not c.isalnum()), f"alnum {any(c.isalnum() for c in sides)}"]
    facts += [f"before {w}" for w in before[-2:]] + [f"after {w}" for w in after[:1]]
    facts += [f"cue {kind} {bool(CUES[kind] & set(before))}", f"listed {kind} {bool(set(_WORD.findall(span)) & GIVEN)}"]
    if kind in ("card", "account", "ip", "phone"):
        digits = _digits(span)
        facts.append(f"digits {kind} {len(digits)} {kind in ('card', 'account') and luhn(digits)}")
    return sorted({zlib.crc32(f.encode()) % BUCKETS for f in facts})


def pattern_of(votes: list[int]) -> int:
    """A row of votes as one number, three values a place."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


def spans_in(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans, and candidates with votes and features: the base matches, failing ones too, and all others.

    In a failing card match each number of 12 to 19 digits is a candidate for an account.
    """
    base, found, others = [], [], list(candidates(text))
    for kind, start, end, passes in matches(text):
        if passes:
            base.append({"kind": KINDS.index(kind), "start": start, "end": end})
        if kind == "card" and not passes:
            # numbers that run into each other are taken apart
            others.extend(("account", *m.span()) for m in _NUMBER.finditer(text, start, end))
        else:
            found.append((kind, start, end, passes))
    base.sort(key=lambda b: (b["start"], b["kind"]))
    starts = [b["start"] for b in base]
    # spans of different kinds may overlap: the farthest end so far
    ends = list(accumulate((b["end"] for b in base), max))
    for kind, start, end in others:
        i = bisect_left(starts, end) - 1
        if i < 0 or ends[i] <= start:
            found.append((kind, start, end, True))
    judged = [
        {"kind": KINDS.index(k), "start": s, "end": e, "votes": pattern_of(votes(text, k, s, e, passes)), "features": features(text, k, s, e)} for k, s, e, passes in found
    ]
    return base, judged


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    base_kind, found_kind = pa.list_(pa.struct(place)), pa.list_(pa.struct([*place, ("votes", pa.int32()), ("features", pa.list_(pa.int32()))]))
    for batch in batches:
        texts, first, size = batch.column("text"), 0, 0
        base: list[list[dict]] = []
        found: list[list[dict]] = []
        for i in range(len(batch)):
            text = texts[i].as_py() or ""
            b, f = spans_in(text)
            base.append(b)
            found.append(f)
            size += len(text)
            if size >= OUT_TEXT or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(base)), pa.array(base, base_kind), pa.array(found, found_kind)], ["id", "base", "candidates"])
                base, found, first, size = [], [], i + 1, 0


@dataclass
class LabelModel:
    """Reliability of each labeler, and how common personal data is among the candidates of each kind."""

    reliability: np.ndarray
    prior: dict[int, float]

    def likelihood(self, kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Likelihood of personal data for rows of votes."""
        weight = np.log(self.reliability / (1 - self.reliability))
        prior = np.array([self.prior.get(int(k), 0.5) for k in kind])
        return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + votes @ weight)))


def estimate(kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    A labeler that votes is right with its reliability, whatever the other labelers
    say; it may stay silent. A few pseudo-votes keep rare labelers and kinds near 0.8 and one half.
    """
    votes, count = votes.astype(float), count.astype(float)
    model = LabelModel(np.full(votes.shape[1], 0.8), {int(k): 0.5 for k in np.unique(kind)})
    for _ in range(rounds):
        p = model.likelihood(kind, votes)
        right = (count[:, None] * (p[:, None] * (votes > 0) + (1 - p[:, None]) * (votes < 0))).sum(0)
        said = (count[:, None] * (votes != 0)).sum(0)
        reliability = np.clip((right + 8) / (said + 10), UNSURE, SURE)
        prior = {k: float((count[kind == k] @ p[kind == k] + 2) / (count[kind == k].sum() + 4)) for k in model.prior}
        step = np.abs(reliability - model.reliability).max(initial=0)
        model = LabelModel(reliability, prior)
        if step < 1e-7:
            break
    return model


def fit(rows: list[list[int]], target: np.ndarray, weight: np.ndarray, rounds: int = 500, ridge: float = 1e-5) -> np.ndarray:
    """Weights of the buckets, and at the end a constant, of a logistic classifier on soft labels, by accelerated gradient steps."""
    size = np.array([len(r) for r in rows], int)
    at = np.repeat(np.arange(len(rows)), size)
    bucket = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    weight = weight / max(weight.sum(), 1e-300)
    w = ahead = np.zeros(BUCKETS + 1)
    rate = 4 / (size.max(initial=0) + 1)
    for i in range(rounds):
        z = np.bincount(at, ahead[bucket], minlength=len(rows)) + ahead[-1]
        error = weight * (1 / (1 + np.exp(-z)) - target)
        slope = ridge * ahead
        slope[:-1] += np.bincount(bucket, error[at], minlength=BUCKETS)
        slope[-1] = error.sum()
        new = ahead - rate * slope
        ahead, w = new + i / (i + 3) * (new - w), new
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray

    def likelihood(self, rows: list[list[int]]) -> np.ndarray:
        z = np.array([self.weights[r].sum() for r in rows]) + self.weights[-1]
        return 1 / (1 + np.exp(-z))


def train(found: DataFrame, sample: int = SAMPLE) -> Model:
    """Reliabilities from the counts of all candidates' vote patterns, and a classifier fitted on ``sample`` different candidates, weighted by their counts.

    Both reach the driver: at most a row for each kind and pattern, and ``sample`` rows.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    alike = materialize(each.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")))
    got = alike.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).orderBy("kind", "votes").collect()
    kind, count = np.array([r.kind for r in got], int), np.array([r.n for r in got], float)
    table = np.array([votes_of(r.votes) for r in got], int).reshape(len(got), len(LABELERS))
    labels = estimate(kind, table, count)
    share = min(1.0, 1.1 * sample / max(1, sum(r.different for r in got)))
    place = F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 30))
    rows = alike.where(place < math.ceil(share * (1 << 30))).orderBy(place, "kind", "votes", "features").limit(sample).collect()
    discard(alike)
    target = labels.likelihood(np.array([r.kind for r in rows], int), np.array([votes_of(r.votes) for r in rows], int).reshape(len(rows), len(LABELERS)))
    return Model(labels, fit([list(r.features) for r in rows], target, np.array([r.n for r in rows], float)))


def choose(base: list[dict], found: list[dict], score: np.ndarray, threshold: float = THRESHOLD) -> list[dict]:
    """Base spans and the candidates of other kinds that reach the threshold, by start, then kind; of overlapping candidates the likelier stays, then the first."""
    out = [{**b, "added": False} for b in base]
    likely = [(-float(p), c["start"], c["end"], c["kind"]) for p, c in zip(score, found) if p >= threshold and c["kind"] >= len(BASE)]
    taken: set[int] = set()
    # candidates are short, so their places can be listed; none overlaps a base span
    for _, start, end, kind in sorted(likely):
        places = range(start, end)
        if taken.isdisjoint(places):
            taken.update(places)
            out.append({"kind": kind, "start": start, "end": end, "added": True})
    out.sort(key=lambda s: (s["start"], s["kind"]))
    return [{"kind": KINDS[s["kind"]], "nth": s["kind"], "start": s["start"], "end": s["end"], "added": s["added"]} for s in out]


def _decide(model: Model):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("nth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = batch.column("base"), batch.column("candidates")
            spans = []
            for i in range(len(batch)):
                f = found[i].as_py()
                spans.append(choose(base[i].as_py(), f, model.likelihood([c["features"] for c in f]) if f else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], ["id", "spans"])

    return decide


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, candidates) of every row, written once: texts are read through once."""
    kind = docs.schema[key].dataType.simpleString()
    return materialize(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_find, f"id {kind}, {FOUND}"))


def decide(found: DataFrame, model: Model) -> DataFrame:
    """(id, spans) of rows of :func:`find` by a trained model."""
    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(_decide(model), f"id {kind}, spans array<{SPAN}>")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, spans (kind, nth, start, end in code points, added), trained on the rows themselves.

    A null or empty text has no spans; a null key stays null; repeated rows give
    repeated results; an empty table gives an empty result; other columns are
    ignored. Texts are read whole, in time linear in their length, with memory of a few times the longest one. Spans tie by
    start in the order of ``KINDS``; of equally likely candidates that overlap the first stays.
    """
    found = find(docs, key, text)
    return decide(found, train(found)).withColumnRenamed("id", key)
