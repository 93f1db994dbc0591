"""Secret scans: base patterns, and a randomness test battery with length-aware false-discovery control.

Every run of key characters is cut at ``=``, and each part is a candidate, whose encoding (digits, letters of one case, hex, base32, base36, base64)
is inferred from the characters in it. A part that mixes ``/`` or ``+`` with ``-`` or ``_`` fits no alphabet: it is cut at either pair and at all four, and
every piece is a candidate. Three tests hold it against independent, uniform draws from that alphabet:

* chi-squared: how evenly the alphabet is used (a text repeats its frequent letters);
* runs: how often the upper and the lower half of the alphabet alternate (Wald-Wolfowitz);
* serial correlation of neighbouring characters at lag one.

A candidate is random-looking if none of the three rejects (Bonferroni). It is a discovery only if structured text would hardly look so. Structured text comes in
three kinds, one for each test: its letters are uneven (a stated chance that two of its characters are equal, for each encoding), it stays in one half of its alphabet, or it runs
along its alphabet. For each kind the p-value is the probability that a text of that kind, encoding and length gives a statistic as close to a random one's
as the candidate's; the candidate's p-value is the largest of the three, as it has to be unlike all kinds. It goes through Benjamini-Hochberg over
all candidates of the corpus. The statistics of structured text grow with length and those of a random one do not, so
short candidates need more company to count than long ones, and letters of one case or digits, whose unevenness is slight, have to be long. The cut comes from a histogram of p-values with a
fixed number of bins, summed by Spark: no candidate is brought to the driver.

Base spans (kinds assign, access, hex) always stay; discoveries are kind ``random``. Offsets are code points, ends exclusive.
Null and empty texts have no span; repeated rows and null doc_ids are scanned like any other.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written

#: The base patterns and least lengths of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")

LONG_HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BINS = 2048


@dataclass(frozen=True)
class Params:
    level: float = 0.01  # of the three tests together
    discovery_rate: float = 0.05
    sticky: float = 0.6  # of structured text: how much likelier than not a character stays in its neighbour's half
    ordered: float = 0.6  # its serial correlation


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


#: An alphabet in its natural order, and what a token needs to be taken for it.
ALPHABETS = {
    "digits": "0123456789",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
PLACES = {k: {c: i for i, c in enumerate(v)} for k, v in ALPHABETS.items()}


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; None if none does, or if it is all punctuation."""
    chars = set(token)
    if not any(map(str.isalnum, chars)):
        return None
    return next((k for k, v in PLACES.items() if chars <= v.keys()), None)


def normal_tail(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


#: The chance that two characters of structured text are equal, in each encoding: fixed values, 0.066 among the letters of running text,
#: less where other characters are mixed in, and 0.14 among numbers, which is also what structured text in a hex alphabet is made of.
EQUAL = {"digits": 0.14, "lower": 0.066, "upper": 0.066, "hex": 0.14, "HEX": 0.14, "base32": 0.063, "base36": 0.06, "BASE36": 0.06, "base64": 0.058, "base64url": 0.058}


def battery(token: str, name: str) -> tuple[float, float, float]:
    """Chi-squared, runs and serial correlation, each less its mean and over its deviation under independent uniform draws."""
    place, size, n = PLACES[name], len(ALPHABETS[name]), len(token)
    x = np.fromiter((place[c] for c in token), float, n)
    expected = n / size
    chi = sum((k - expected) ** 2 for k in Counter(token).values()) / expected + (size - len(set(token))) * expected
    # Exact mean and variance for any n, also where most cells are expected empty.
    z_chi = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        return z_chi, -math.inf, math.inf
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / (d * d).sum())
    return z_chi, (runs - mean) / math.sqrt(var) if var > 0 else 0.0, (r + 1 / n) * math.sqrt(n)


def passes(z: tuple[float, float, float], p: Params) -> bool:
    """Whether no test rejects independent uniform draws; only too uneven a token is structured, not too even a one."""
    chi = normal_tail(z[0]) / 2 if z[0] > 0 else 1 - normal_tail(z[0]) / 2
    return 3 * min(chi, normal_tail(z[1]), normal_tail(z[2])) > p.level


def below(z: float, mean: float, deviation: float) -> float:
    """P(Z <= z) of a normal Z."""
    return math.erfc((mean - z) / deviation / math.sqrt(2)) / 2


def structured(z: tuple[float, float, float], name: str, n: int, p: Params) -> float:
    """The largest probability, over the three kinds of structured text, of a statistic as near to a random one's."""
    size = len(ALPHABETS[name])
    # Chi-squared of uneven draws: its mean rises by ``more``, and its variance with it, as a noncentral one's does.
    unit, more = math.sqrt(2 * (size - 1) * (n - 1) / n), (n - 1) * (size * EQUAL[name] - 1)
    uneven = below(z[0], more / unit, math.sqrt(2 * (size - 1 + 2 * more)) / unit)
    root = math.sqrt(n)
    sticky = below(abs(z[1]), p.sticky * root, math.sqrt(1 - p.sticky**2))
    ordered = below(abs(z[2]), p.ordered * root, math.sqrt(1 - p.ordered**2))
    return max(uneven, sticky, ordered)


PART = re.compile(r"[^=]{20,}")
PIECES = tuple(re.compile(x) for x in (r"[^/+=]{20,}", r"[^=_-]{20,}", r"[^/+=_-]{20,}"))


def parts(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of everything to be tested."""
    for m in CANDIDATE.finditer(text):
        for part in PART.finditer(text, *m.span()):
            if name := encoding(part[0]):
                yield *part.span(), name
            else:
                for start, end in sorted({x.span() for r in PIECES for x in r.finditer(text, *part.span())}):
                    if name := encoding(text[start:end]):
                        yield start, end, name


def candidates(text: str, p: Params) -> list[tuple[int, int, float]]:
    """(start, end, p-value under structured text) of the random-looking candidates; 1 for one that a test rejected."""
    out = []
    for start, end, name in parts(text):
        z = battery(text[start:end], name)
        out.append((start, end, max(structured(z, name, end - start, p), 1e-300) if passes(z, p) else 1.0))
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("p", pa.float64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])
SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string,p:double>>"


def scanned(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id and all base spans and candidates, with p-values (0 for base spans), before false-discovery control."""

    def of(text: str | None) -> list[dict]:
        if not text:
            return []
        spans = [(*s, 0.0) for s in base_spans(text)] + [(a, b, "random", q) for a, b, q in candidates(text, p)]
        return [dict(zip(("start", "end", "kind", "p"), s, strict=True)) for s in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield batch(FOUND, b.column(0), [of(x) for x in b.column(1).to_pylist()])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def cut(found: DataFrame, p: Params) -> float:
    """The largest p-value that Benjamini-Hochberg accepts, from a histogram of -log p over all candidates outside of base spans: those inside are found already, and would let weaker ones pass."""
    known = lambda s: F.exists("spans", lambda t: (t.kind != "random") & (t.start <= s.start) & (s.end <= t.end))
    q = F.explode(F.filter("spans", lambda s: (s.kind == "random") & ~known(s))).alias("s")
    binned = found.select(q).select(F.least(F.floor(-F.log("s.p") * 8), F.lit(BINS - 1)).cast("int").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    rows = sorted(((r.k, r.n) for r in binned.collect()), reverse=True)
    total, seen, best = sum(n for _, n in rows), 0, 0.0
    for k, n in rows:
        seen += n
        most = math.exp(-k / 8)  # no p-value of the bin is above it
        if most <= p.discovery_rate * seen / total:
            best = most
    return best


def confirmed(found: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id and its spans in order of start, then kind; discoveries that lie within a base span or a longer discovery are part of it."""
    most = cut(found, p)
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.filter("spans", lambda s: s.kind != "random")
    taken = F.filter("spans", lambda s: (s.kind != "random") | (s.p <= F.lit(most)))
    within = lambda s, t: (t.start <= s.start) & (s.end <= t.end) & ((t.kind != "random") | (t.start < s.start) | (s.end < t.end))
    fresh = F.filter(taken, lambda s: (s.kind == "random") & ~F.exists(taken, lambda t: within(s, t)))
    ordered = F.array_sort(F.transform(F.concat(base, fresh), lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("k"), s.end.alias("end"), s.kind.alias("kind"))))
    return found.select("doc_id", ordered.alias("spans"))


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(docs: DataFrame, p: Params = Params(), mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by mark, overlapping spans by one; all rows and columns stay.

    A text is scanned and rewritten in the same pass; only the cut of the corpus comes before, from a first pass over the texts.
    n_chars follows where it was the text's length.
    """
    found = scanned(docs.select("doc_id", "text"), p)
    most = cut(found, p)
    cols = docs.columns
    schema = docs.schema
    at = cols.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = sorted([s[:2] for s in base_spans(text)] + [(a, b) for a, b, q in candidates(text, p) if q <= most])
        out, last = [], 0
        for a, b in spans:
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join([*out, text[last:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            new = [clean(x) for x in texts]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in cols:
                k = cols.index("n_chars")
                old = b.column(k).to_pylist()
                columns[k] = pa.array([len(y) if y is not None and x != y and n == len(x) else n for x, y, n in zip(texts, new, old, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return map_batches(docs, run, schema)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = written(scanned(table(spark, sf_dir, "documents")), "secrets")
    out = confirmed(found)
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s.kind != "random"))
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n("random"))


def digest(spans: list[tuple[int, int, str]]) -> tuple[str, str]:
    """(joined spans, their sha256), for brute-force checks."""
    text = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
    return text, hashlib.sha256(text.encode()).hexdigest()
