"""Personal data by weak supervision.

Exact patterns find base spans, which always stay. Looser patterns propose more.
Five labelers vote on every proposal: shape, validity, gazetteer, context words
and borders. Expectation-maximisation over the counts of vote patterns of the
whole corpus estimates how reliable each labeler is; its posteriors train a
logistic span classifier on the counts of feature patterns, which decides on the
proposals. The driver sees pattern counts only, whose number is fixed by the
features.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.llm.common import over_batches, stored, text_column

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "valid", "gazetteer", "context", "border")
ACCEPT = 0.9
#: Code points in front of a span in which context words count.
NEAR = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starts and repeats are written so that no text takes quadratic time; the spans are those of the plain patterns.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
LONG_IP = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
SPACED_CARD = re.compile(r"(?<![\w.])[0-9]{4}(?:[. /_]|  )[0-9]{4}(?:[. /_]|  )[0-9]{4}(?:[. /_]|  )[0-9]{1,7}(?![\w.])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])")
#: A spelled address whose mark for @ or for a dot can't be prose.
MARKED = re.compile(r"[(\[{](?:at|dot)[)\]}]| dot ", re.I)

#: Endings of mail domains, first digits of cards, words that go before each kind.
DOMAIN_ENDS = frozenset("com org net edu gov int mil info io co de fr es it uk us eu ch at nl be pt br mx ca au jp in".split())
CARD_STARTS = ("4", "34", "37", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "36", "38", "6011", "62", "65")
CUES = {
    "email": "mail email e-mail contact write reach correo courriel adresse".split(),
    "ip": "ip ipv6 host server address addr login adresse".split(),
    "card": "card visa mastercard amex credit debit karte carte tarjeta".split(),
    "phone": "phone tel telephone call mobile cell fax fon telefon telefono téléphone".split(),
}
AGAINST = frozenset("version isbn issn order sku page pages section license licence chapter doi http https".split())


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: each @ with the local part that ends there and the domain behind it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """[start, end) in code points of the exact patterns that pass their checks."""
    out: dict[str, list[tuple[int, int]]] = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if not re.search("[0-9]", text):
        return out
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def written_out(span: str) -> bool:
    """Whether a spelled address has a mark that prose has not, or else a plain domain with a known end, in lower case and without blanks."""
    domain = re.split(" at ", span, flags=re.I)[-1].strip(" ")
    return bool(MARKED.search(span)) or (" " not in domain and domain.rpartition(".")[2] in DOMAIN_ENDS)


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Looser spans that may be personal data too."""
    out = []
    low = text.lower()
    if any(at in low for at in (" at ", "(at)", "[at]", "{at}")):  # one of them is in every match
        out += [("email", *m.span()) for m in SPELLED.finditer(text) if written_out(m[0])]
    if re.search("[0-9]", text):
        if text.count(":") >= 7:
            out += [("ip", *m.span()) for m in LONG_IP.finditer(text)]
        out += [("card", *m.span()) for m in SPACED_CARD.finditer(text)]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= sum("0" <= c <= "9" for c in m[0]) <= 19]
        out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    return out


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1, -1, or 0 for no opinion."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - NEAR) : start].lower())[-5:]
    if kind == "email":
        ends = re.split(r"[^A-Za-z0-9-]+", span.lower().rstrip(".)]}"))
        shape = 1 if "@" in span or re.search(r"[(\[{]at[)\]}]", span, re.I) else -1
        valid = 1 if ends[-1] in DOMAIN_ENDS else -1
        known = 1 if ends[-1] in DOMAIN_ENDS and "dot" not in ends[:1] else 0
    elif kind == "ip":
        parts = span.split(".")
        shape = 1
        valid = 1 if ":" in span or all(int(p[-9:]) <= 255 and len(p) <= 3 for p in parts) else -1
        known = -1 if span.startswith(("0.", "255.")) else 0
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", span) else 0
        valid = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(CARD_STARTS) else -1
    else:
        shape = 1 if re.fullmatch(r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}", span) else 0
        valid = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if span.startswith(("+", "(", "00")) else 0
    context = -1 if any(w in AGAINST for w in before[-2:]) else 1 if any(w in CUES[kind] for w in before) else 0
    beside = text[start - 1 : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() for c in beside) else 1
    return shape, valid, known, context, border


def _features(kind: str, text: str, start: int, end: int) -> str:
    """A span's feature pattern: kind, votes, digits in steps of four, kind of separators."""
    span = text[start:end]
    digits = sum("0" <= c <= "9" for c in span)
    marks = "".join(c for c in " -.(@:" if c in span)
    return ":".join([kind, ",".join(map(str, votes(kind, text, start, end))), str(min(digits // 4, 5)), marks.replace(":", ";")])


class Cover:
    """Whether a stretch lies inside one of the spans, or overlaps one; found by their order."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    base, more = [], []
    for t in batch.column(1):
        text = t.as_py().decode(errors="replace")
        spans = [(k, a, b) for k, found in base_spans(text).items() for a, b in found]
        taken = Cover([(a, b) for _, a, b in spans])  # what lies inside a base span, of whatever kind, is that span
        loose = dict.fromkeys(s for s in proposals(text) if not taken.holds(*s[1:]))
        base.append([{"kind": k, "first": a, "last": b, "pattern": _features(k, text, a, b)} for k, a, b in spans])
        more.append([{"kind": k, "first": a, "last": b, "pattern": _features(k, text, a, b)} for k, a, b in loose])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("pattern", pa.string())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "more"])


SPANS = "array<struct<kind:string,first:long,last:long,pattern:string>>"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and more (spans with their feature patterns). Null is empty."""
    return docs.select(F.col("doc_id").cast("long"), text_column(text)).mapInArrow(over_batches(_found), f"doc_id long, base {SPANS}, more {SPANS}")


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (-1, 0, 1) with counts: posterior of each pattern; P(vote | personal or not) per labeler.

    Votes are taken as independent given the truth; it starts from the mean vote.
    """
    truth = 1 / (1 + np.exp(-2 * patterns.sum(axis=1)))
    chance = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, share in enumerate((1 - truth, truth)):
            for v in (-1, 0, 1):
                chance[c, :, v + 1] = ((share * counts)[:, None] * (patterns == v)).sum(axis=0) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        prior = (truth @ counts + 1) / (counts.sum() + 2)
        logs = [np.log(p) + np.log(chance[c][np.arange(patterns.shape[1]), patterns + 1]).sum(axis=1) for c, p in enumerate((1 - prior, prior))]
        truth = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return truth, chance


def _vector(pattern: str) -> np.ndarray:
    kind, vote, digits, marks = pattern.split(":")
    v = [int(x) for x in vote.split(",")]
    return np.array([1, *[kind == k for k in KINDS], *v, *[x == 0 for x in v], *[int(digits) == k for k in range(6)], *[m in marks for m in " -.(@;"]], float)


def train(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each feature pattern by the span classifier, trained on EM's posteriors per kind."""
    if not counts:
        return {}
    names = sorted(counts)
    weight = np.array([counts[n] for n in names], float)
    vote = np.array([[int(x) for x in n.split(":")[1].split(",")] for n in names])
    truth = np.zeros(len(names))
    for kind in KINDS:
        own = np.array([n.startswith(kind + ":") for n in names])
        if own.any():
            truth[own] = reliabilities(vote[own], weight[own])[0]
    x = np.stack([_vector(n) for n in names])
    w = np.zeros(x.shape[1])
    scaled = weight / weight.sum() * len(names) + 1
    for _ in range(30):  # Newton's method, a weak ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (scaled * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (scaled * (truth - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _told(shared, batch: pa.RecordBatch) -> pa.RecordBatch:
    accepted = shared.value
    rank = {k: i for i, k in enumerate(KINDS)}
    columns: list[list] = [[] for _ in range(6)]
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))
    for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        spans = [(s["kind"], s["first"], s["last"]) for s in base]
        added: list[tuple[str, int, int]] = []
        own = {k: Cover([(a, b) for kind, a, b in spans if kind == k]) for k in {s["kind"] for s in more}}
        for s in sorted(more, key=lambda s: (s["kind"], s["first"], -s["last"])):
            new = (s["kind"], s["first"], s["last"])
            if s["pattern"] in accepted and not own[new[0]].meets(*new[1:]) and not any(k == new[0] and a < new[2] and new[1] < b for k, a, b in added[-1:]):
                added.append(new)
        for column, value in zip(columns, [*(sum(k == s[0] for s in spans) for k in KINDS), hashlib.sha256(join(spans).encode()).hexdigest(), join([*spans, *added])]):
            column.append(value)
    arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4]), pa.array(columns[5])]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans; spans also has the proposals that the
    classifier gives at least `accept`, that lie in no base span of any kind and
    overlap no span of their own.
    Positions are code points. Null and empty texts have none. Repeated rows are
    each listed. Other columns are not read. No rows: no rows.
    """
    found = stored(find(docs, text), "personal-data")
    each = found.select(F.explode(F.concat("base", "more")).alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count()
    counts = {r["pattern"]: r["count"] for r in each.collect()}  # as many rows as feature patterns at most
    accepted = frozenset(p for p, chance in train(counts).items() if chance >= accept)
    shared = docs.sparkSession.sparkContext.broadcast(accepted)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return found.mapInArrow(over_batches(partial(_told, shared)), schema)
