"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Batches, table, texts
from litmill.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
SLICE = 512
THRESHOLD = 0.5
NEAR = 48  # characters before and after a candidate that the context labelers read

# --- What always counts -----------------------------------------------------

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from any other, so only first digits are tried.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_digits = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    last, at = 0, t.find("@")
    while at >= 0:
        m = next(_domain(t, at), None)
        if m is None:
            return
        start = m.start()
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()
            at = t.find("@", last)
        else:
            at = t.find("@", m.start() + 1)


def ips(t: str) -> Iterator[tuple[int, int]]:
    for m in _ip(t):
        # Parts may be very long runs of digits; leading zeros do not count.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(t: str) -> Iterator[tuple[int, int]]:
    for m in _digits(t):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                yield m.span()


def phones(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("+")
    while at >= 0:
        m = next(_phone(t, at), None)
        if m is None:
            return
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()
        at = t.find("+", m.end())


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """What the patterns and checks find, by start and then kind."""
    out = [("email", *s) for s in emails(t)] if "@" in t else []
    if "." in t:
        out += [("ip", *s) for s in ips(t)]
    out += [("card", *s) for s in cards(t)]
    if "+" in t:
        out += [("phone", *s) for s in phones(t)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- Candidates beyond the base, and the labelers ---------------------------

_WIDE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?: ?(?:\(at\)|\[at\]|\{at\}) ?)"
        r"[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?)[A-Za-z0-9-]+)+"
    ),
    "phone": re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    "card": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z-])"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
_NEEDS = {"email": re.compile(r"[(\[{]at[)\]}]"), "phone": re.compile(r"[0-9]{3}[ .-][0-9]{4}"),
          "card": re.compile(r"[0-9]{4}[ -]?[0-9]{4}"), "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")}

# Words that tell of a kind nearby, in the four languages.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "address", "host", "server", "client", "login", "adresse", "direccion"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "telefono", "portable"),
}
# Words before a number that is no personal one.
COUNTER_CUES = ("version", "release", "section", "chapter", "isbn", "order", "invoice", "token", "hash", "id", "no", "page")
# Common top-level domains; first digits of card issuers.
TOP_DOMAINS = frozenset("com org net edu gov info io co de fr es uk eu".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")

_word = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?").findall


def _votes(t: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Votes of the labelers: 1 personal, -1 not, 0 no opinion."""
    span = t[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    before = [w.lower() for w in _word(t[max(0, start - NEAR) : start])][-5:]
    after = [w.lower() for w in _word(t[end : end + NEAR // 2])][:2]
    cues = CUES[kind]
    pattern = 1 if strict else 0
    if kind == "email":
        check = 1 if re.sub(r".*[. )\]}]", "", span.lower()) in TOP_DOMAINS else -1
        gazetteer = 0
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        check = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if strict or digits[0] not in "01" else -1
    else:
        check = 1 if strict or ":" in span else -1
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 0
    context = 1 if any(w in cues for w in (*before, *after)) else 0
    counter = -1 if before and before[-1] in COUNTER_CUES else 0
    edge = -1 if (start and t[start - 1] in "#$=_/") or (end < len(t) and t[end] in "=_/") else 0
    return pattern, check, gazetteer, context, counter, edge


def _looks(t: str, start: int, end: int) -> tuple[int, ...]:
    """What the classifier sees of a span itself: steps of length, separators within, characters on either side."""
    span = t[start:end]
    size = 0 if end - start < 12 else 1 if end - start < 16 else 2 if end - start < 24 else 3
    split = 1 if " " in span else 2 if "-" in span else 0
    side = sum(1 for c in (t[start - 1 : start], t[end : end + 1]) if c and not (c.isspace() or c in ".,;:!?()"))
    return size, split, side


def candidates(t: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, tuple[int, ...]]]:
    """Base spans and wider ones that do not overlap one of their kind, with votes and looks."""
    for kind, a, b in base:
        yield kind, a, b, (*_votes(t, kind, a, b, True), *_looks(t, a, b))
    for kind, wide in _WIDE.items():
        if not _NEEDS[kind].search(t):
            continue
        own = [(a, b) for k, a, b in base if k == kind]
        i = 0
        for m in wide.finditer(t):
            a, b = m.span()
            while i < len(own) and own[i][1] <= a:
                i += 1
            if i == len(own) or own[i][0] >= b:
                yield kind, a, b, (*_votes(t, kind, a, b, False), *_looks(t, a, b))


def _slices(batches: Batches) -> Batches:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


# --- Training: counts of vote patterns are all that leaves the tasks --------


def vote_counts(docs: DataFrame, text: str = "text") -> list[tuple[str, int]]:
    """How often each pattern of kind, votes and looks occurs among all candidates of all texts.

    There are at most 4 * 3^6 * 4 * 3 * 3 patterns, whatever the table's size.
    """

    def run(batches: Batches) -> Batches:
        counts: Counter = Counter()
        for batch in _slices(batches):
            for t in texts(batch, "text"):
                for kind, _, _, votes in candidates(t, base_spans(t)):
                    counts[kind + "," + ",".join(map(str, votes))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["p", "n"]
        )

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "p string, n long")
    return [tuple(r) for r in rows.groupBy("p").agg(F.sum("n")).orderBy("p").collect()]


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: posterior of each pattern, accuracy of each labeler, prior.

    A labeler that votes is right with its own probability; votes are taken as
    independent given the truth.  Counts are smoothed, and accuracy starts at
    0.8, so that labels cannot swap.
    """
    accuracy, prior = np.full(votes.shape[1], 0.8), 0.5
    posterior = np.full(len(votes), prior)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        logit = votes @ odds + np.log(prior / (1 - prior))
        posterior = 1 / (1 + np.exp(-logit))
        weight = counts[:, None] * (votes != 0)
        right = np.where(votes > 0, posterior[:, None], 1 - posterior[:, None])
        accuracy = ((weight * right).sum(0) + 4) / (weight.sum(0) + 5)
        accuracy = np.clip(accuracy, 0.55, 0.99)
        prior = float(np.clip((counts * posterior).sum() / max(counts.sum(), 1), 0.05, 0.95))
    return posterior, accuracy, prior


LABELERS = 6
_LOOKS = (4, 3, 3)  # values of each look


def span_features(kinds: list[str], seen: np.ndarray) -> np.ndarray:
    """Kind, votes for, votes against, and the looks by value: one row for each pattern."""
    votes = seen[:, :LABELERS]
    looks = [np.eye(n)[seen[:, LABELERS + k]] for k, n in enumerate(_LOOKS)]
    return np.hstack([np.array([[k == own for own in KINDS] for k in kinds], float).reshape(-1, len(KINDS)), votes > 0, votes < 0, *looks])


# Where the fit starts and what it is held to: a vote counts one for, one against.
START = np.r_[np.zeros(len(KINDS)), np.ones(LABELERS), -np.ones(LABELERS), np.zeros(sum(_LOOKS))]


class SpanClassifier:
    """Logistic model over what is seen of a span; any pattern gets a probability, whether it was met in training or not."""

    def __init__(self, weights: np.ndarray = START) -> None:
        self.weights = weights
        self.known: dict[tuple, float] = {}

    def probability(self, kind: str, seen: tuple[int, ...]) -> float:
        p = self.known.get((kind, seen))
        if p is None:
            x = span_features([kind], np.array([seen]))[0]
            p = self.known[kind, seen] = float(1 / (1 + np.exp(-(x @ self.weights))))
        return p


def train_spans(patterns: list[tuple[str, int]], steps: int = 300) -> SpanClassifier:
    """The span classifier fitted to the labels that the weighed votes give.

    The fit is weighted by how often a pattern occurs, on the driver over a
    bounded number of patterns; without any the classifier counts votes.
    """
    if not patterns:
        return SpanClassifier()
    kinds = [p.split(",")[0] for p, _ in patterns]
    seen = np.array([[int(x) for x in p.split(",")[1:]] for p, _ in patterns])
    counts = np.array([n for _, n in patterns], float)
    target, _, _ = reliabilities(seen[:, :LABELERS].astype(float), counts)
    x = span_features(kinds, seen)
    weight = np.sqrt(counts) / np.sqrt(counts).sum()
    w = START.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (w - START)
        hess = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return SpanClassifier(w)


def all_spans(t: str, model: SpanClassifier) -> tuple[list, list]:
    """(base spans, base and added spans)."""
    base = base_spans(t)
    added = [
        (kind, a, b) for kind, a, b, seen in candidates(t, base) if seen[0] <= 0 and model.probability(kind, seen) >= THRESHOLD
    ]
    return base, ordered(base + added)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: SpanClassifier | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts of base spans by kind, base_sha256, spans), one row per input row.

    Base spans always stand; the classifier, trained on the votes over the
    whole table unless given, adds wider candidates.  Null texts are empty; an
    empty text has no spans and the digest of the empty string.  Spans are in
    code points, end exclusive.  Only the two named columns are read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    learned = train_spans(vote_counts(own)) if model is None else model
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in _slices(batches):
            found = [all_spans(t, learned) for t in texts(batch, "text")]
            counts = [Counter(k for k, _, _ in base) for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]),
                    pa.array([joined(spans) for _, spans in found], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return own.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(t: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [t[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + t[at:]


def redact(docs: DataFrame, model: SpanClassifier | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the personal spans of the text masked; other columns and null texts stay as they are."""
    learned = train_spans(vote_counts(docs, text)) if model is None else model

    @F.pandas_udf("string")
    def mask(series):
        return series.map(lambda t: masked(t, all_spans(t, learned)[1]), na_action="ignore")

    return docs.withColumn(text, mask(F.col(text)))


@query("op10_personal_spans")
def personal_spans(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
