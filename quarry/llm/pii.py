"""Personal data by weak supervision.

Fixed patterns give the base spans (email, ip, card, phone). Candidates are all
other tokens with a digit, what is assigned to a word like password, capital
words after a title or a word like name, and street addresses: regex,
gazetteer and context labelers vote on each (for, against, or not at all). Votes are counted over the whole corpus by
their pattern; expectation-maximisation over the pattern counts estimates each
labeler's reliability and the chance that a candidate is personal; a logistic
span classifier is then fitted to those chances on span features and decides
every candidate. Only pattern counts reach the driver: at most as many rows as
there are patterns of VOTES three-way votes and FEATURES bits.

Defined results
    null or empty text: no span. Candidates that touch a base span: dropped.
    repeated rows: a row each. null doc_id: as any other. Extra columns are
    not read. No candidate in the corpus: only base spans. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

KINDS = ["email", "ip", "card", "phone", "secret", "number", "name", "address"]
_host = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_token = re.compile(r"[A-Za-z0-9_+/-]+")

# Words before a secret or a personal number, prefixes of issued keys, words after a plain quantity.
KEY_WORDS = ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "ssn", "passport", "iban", "account", "licence", "license", "tax", "id"]
KEY_PREFIXES = ("sk_", "sk-", "pk_", "ghp_", "gho_", "AKIA", "ASIA", "xoxb-", "xoxp-", "glpat-", "eyJ")
UNITS = ["percent", "km", "kg", "cm", "mm", "ms", "years", "year", "days", "hours", "minutes", "seconds", "usd", "eur", "mb", "gb", "pages", "times"]
_key_before = re.compile(r"(?i)(?:%s)[\"']?\s*(?:is|no\.?|number|#)?\s*[:=]?\s*[\"']?$" % "|".join(KEY_WORDS))
_unit_after = re.compile(r"(?i)\s?(?:%%|(?:%s)\b)" % "|".join(UNITS))
_assigned = re.compile(r"[:=]\s*[\"']?$")

# Given names, what stands before a name, and kinds of streets.
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna peter paul laura marie hans klaus julia carlos juan jose maria luis ahmed ali fatima muhammad omar sara pierre jean sophie".split())
_named = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|[Nn]ame|[Cc]ontact|[Ss]igned|[Bb]orn)\b[.:]?[ ]{1,3}([A-Z][a-zà-ÿ]++(?:[ ][A-Z][a-zà-ÿ]++)*+)")
_street = re.compile(r"(?<![0-9])[0-9]{1,5}[A-Za-z]?[ ](?:[A-Z][a-zà-ÿ]++[ ])+(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Square)\b")
_set_to = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|bearer|credential)\b[\"']?[ ]?[:=][ ]?[\"']?([A-Za-z_+/-]{6,}+)(?![A-Za-z0-9_+/-])")

VOTES, FEATURES = 11, 12
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards: no run is read twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        host = _host.match(text, at + 1)
        if host:
            start = at
            while start > end and text[start - 1] in _local:
                start -= 1
            if start < at:
                end = host.end()
                yield start, end
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of 255 at most: a chain of dotted numbers gives each four in turn."""
    for m in _dotted.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, at + size
                at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; a match that fails its test is dropped and not retried."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _digit.search(text):
        if text.count(".") >= 3:
            out += [(a, 1, b) for a, b in ips(text)]
        for m in _card.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def votes(token: str, before: str, after: str, kind: int = 4) -> int:
    """The labelers' votes as digits of base 3: 0 none, 1 for, 2 against."""
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    words = token.split(" ")
    cast = [
        1 if n >= 24 and re.fullmatch(r"[0-9a-fA-F]+", token) else 0,
        1 if n >= 16 and digits >= 3 and re.search(r"[A-Za-z]", token) else 2 if n < 8 else 0,
        1 if digits >= 9 else 2 if token.isdigit() and digits <= 6 else 0,
        1 if _key_before.search(before) else 0,
        1 if token.startswith(KEY_PREFIXES) else 0,
        2 if _unit_after.match(after) or re.fullmatch(r"(?:1[89]|20)[0-9][0-9]", token) else 0,
        1 if _assigned.search(before) else 0,
        1 if before[-1:] in "\"'`" and before and after[:1] == before[-1] else 0,
        1 if kind == 6 and words[0].lower() in GIVEN else 2 if kind == 6 and len(words) == 1 else 0,
        1 if kind == 7 else 0,
        1 if kind == 4 and not digits and (re.search(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[_+/-]", token) or n >= 16) else 2 if kind == 4 and token.isalpha() and (token.islower() or token.istitle()) else 0,
    ]
    return sum(v * 3**k for k, v in enumerate(cast))


def features(token: str, before: str, after: str, kind: int = 4) -> int:
    digits = sum(c.isdigit() for c in token)
    n = len(token)
    bits = [n >= 8, n >= 16, n >= 24, digits >= 4, digits >= 9, token.isdigit(), bool(re.fullmatch(r"[0-9a-fA-F]+", token)), bool(before.strip()) and before.rstrip()[-1] in "=:\"'`", bool(_key_before.search(before)), kind == 6, kind == 7, token.split(" ")[0].lower() in GIVEN]
    return sum(int(b) << k for k, b in enumerate(bits))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, votes, features) of what may be personal beside the base spans, none over another."""
    found = [(m.start(1), m.end(1), 6) for m in _named.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), 4) for m in _set_to.finditer(text)]
    if _digit.search(text):
        found += [(m.start(), m.end(), 7) for m in _street.finditer(text)]
        at = 0
        for d in _digit.finditer(text):
            if d.start() < at:
                continue
            start = d.start()
            while start > at and _token.match(text[start - 1]):
                start -= 1
            at = _token.match(text, start).end()
            found.append((start, at, 5 if text[start:at].isdigit() else 4))
    out, taken, k, end = [], sorted((a, b) for a, _, b in base), 0, 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a < end or any(p < b and a < q for p, q in taken[k : k + 4]):
            continue
        end = b
        token, before, after = text[a:b], text[max(0, a - 32) : a], text[b : b + 12]
        out.append((a, b, kind, votes(token, before, after, kind), features(token, before, after, kind)))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, candidates) for each row; offsets in code points."""
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    more_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "kind", "votes", "features")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            base, more = [], []
            for t in batch.column(1):
                t = t.as_py()
                found = base_spans(t)
                base.append([dict(zip(("start", "kind", "end"), x)) for x in found])
                more.append([dict(zip(("start", "end", "kind", "votes", "features"), x)) for x in candidates(t, found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(more, more_type)], names=["id", "base", "candidates"])

    schema = f"id {kind}, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,kind:int,votes:int,features:int>>"
    return source.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, labelers' vote chances by class, each pattern's chance) by expectation-maximisation.

    ``patterns`` has a row of votes (0, 1, 2) for each pattern.
    """
    n = patterns.shape[1] if len(patterns) else VOTES
    lean = (patterns == 1).sum(1) - (patterns == 2).sum(1)
    p = np.clip(0.5 + 0.2 * lean, 0.05, 0.95)
    prior, chance = 0.5, np.full((2, n, 3), 1 / 3)
    for _ in range(rounds):
        prior = float((counts * p).sum() / max(counts.sum(), 1))
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        for c, w in ((0, counts * (1 - p)), (1, counts * p)):
            for v in range(3):
                chance[c, :, v] = ((patterns == v) * w[:, None]).sum(0) + 0.5
            chance[c] /= chance[c].sum(1, keepdims=True)
        log = [np.log(q) + np.log(chance[c])[np.arange(n), patterns].sum(1) for c, q in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            p = new
            break
        p = new
    return prior, chance, p


def fit(x: np.ndarray, p: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights (the last is the intercept) for soft labels ``p`` with weights ``w``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = w / max(w.mean(), 1e-12)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (q - p)) + ridge * 0.01 * beta
        hess = (x * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge * 0.01 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def bits_of(features: np.ndarray) -> np.ndarray:
    return (features[:, None] >> np.arange(FEATURES) & 1).astype(float)


def train(scanned: DataFrame) -> list[int]:
    """The feature patterns that the span classifier accepts."""
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "features").collect()
    if not rows:
        return []
    v, f, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    _, _, p = reliabilities(v[:, None] // 3 ** np.arange(VOTES) % 3, n.astype(float))
    beta = fit(bits_of(f), p, n.astype(float))
    seen = np.unique(f)
    q = 1 / (1 + np.exp(-(bits_of(seen) @ beta[:-1] + beta[-1])))
    return [int(x) for x in seen[q > THRESHOLD]]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans, each (start, kind, end) in order."""
    scanned = materialize(scan(docs, doc_id, text), "spans")
    accepted = train(scanned)
    hit = F.filter("candidates", lambda c: F.array_contains(F.array(*map(F.lit, accepted)).cast("array<int>"), c["features"]))
    added = F.transform(hit, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return scanned.select(doc_id, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def redact(docs: DataFrame, accepted: list[int], text: str = "text") -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in brackets; ``accepted`` comes from train()."""
    columns, at, chosen = docs.columns, docs.columns.index(text), frozenset(accepted)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        spans = sorted([(a, b, k) for a, k, b in base] + [(c[0], c[1], c[2]) for c in candidates(t, base) if c[4] in chosen])
        out, end = [], 0
        for a, b, k in spans:
            if a >= end:
                out += [t[end:a], f"[{KINDS[k]}]"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            new = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([new if j == at else c for j, c in enumerate(batch.columns)], names=batch.schema.names)

    plain = docs.select(*(F.col(c).alias(f"c{j}") for j, c in enumerate(columns)))
    return plain.mapInArrow(run, plain.schema).select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(columns)))
