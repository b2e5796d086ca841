"""Secret scans: fixed patterns, plus character Markov models for strings that look random.

Two first-order character models, one of random strings and one of ordinary words, identifiers and
numbers, are trained from labelled samples. Along a run of key characters each step has a
log-likelihood ratio; the stretch with the largest sum of what exceeds a threshold is a secret if it is
long enough and its sum is large enough, and what stands on either side of it is searched
again. So words joined to a key don't dilute it. What fixed patterns cover is left out first,
and the rest of such a run is searched. The models are two small tables.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, rows_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Characters of a run, of the best stretch in it and of that with the letters and digits around it, at least; runs whose stretches a worker remembers.
SHORTEST_RUN, SHORTEST_CORE, SHORTEST_STRETCH, MEMO = 12, 5, 10, 100_000
#: Documents whose words train the model of identifiers, and how many distinct words at most.
SAMPLE_DOCS, SAMPLE_WORDS = 400, 20_000


class Markov:
    """log P(character | previous one) over ASCII, 0 standing for the start; add-one smoothing over printable characters."""

    def __init__(self, samples: list[str]):
        n = np.full((128, 128), 0.5)
        for s in samples:
            b = np.frombuffer(b"\0" + s.encode("ascii", "ignore"), np.uint8)
            np.add.at(n, (b[:-1], b[1:]), 1)
        self.log = np.log(n / n.sum(axis=1, keepdims=True))


class Detector:
    """threshold: log-likelihood ratio that a character of a random stretch exceeds in the mean; evidence: the least sum beyond it."""

    def __init__(self, random_strings: list[str], identifiers: list[str], threshold: float = 0.0, evidence: float = 5.0):
        self.ratio = Markov(random_strings).log - Markov(identifiers).log
        self.threshold, self.evidence = threshold, evidence
        self.memo: dict[str, list[tuple[int, int]]] = {}

    def gains(self, s: str) -> np.ndarray:
        b = np.frombuffer(b"\0" + s.encode("ascii", "replace"), np.uint8)
        return self.ratio[b[:-1], b[1:]] - self.threshold

    def stretches(self, s: str) -> list[tuple[int, int]]:
        """Random-looking (start, end) in a run of key characters, out to the letters and digits around them."""
        if s in self.memo:
            return self.memo[s]
        gains, out, open_parts = self.gains(s), [], [(0, len(s))]
        while open_parts:
            i, j = open_parts.pop()
            if j - i < SHORTEST_CORE:
                continue
            sums = np.concatenate([[0.0], np.cumsum(gains[i:j])])
            rise = sums - np.minimum.accumulate(sums)
            end = int(rise.argmax())
            if rise[end] < self.evidence:
                continue
            begin, end = i + int(sums[: end + 1].argmin()), i + end
            open_parts += [(i, begin), (end, j)]
            if end - begin < SHORTEST_CORE:
                continue
            while begin > 0 and s[begin - 1].isalnum():
                begin -= 1
            while end < len(s) and s[end].isalnum():
                end += 1
            if end - begin >= SHORTEST_STRETCH:
                out.append((begin, end))
        merged: list[tuple[int, int]] = []
        for i, j in sorted(out):
            if merged and i < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(j, merged[-1][1]))
            else:
                merged.append((i, j))
        if len(self.memo) < MEMO and len(s) <= 64:
            self.memo[s] = merged
        return merged

    def is_random(self, s: str) -> bool:
        return bool(self.stretches(s))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}


def random_samples(n: int, seed: int) -> list[str]:
    """Labelled 1: keys over the usual alphabets."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (digits + "abcdef", digits + "ABCDEF", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "_-")
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=rng.randint(12, 64))) for k in range(n)]


def identifier_samples(words: list[str], n: int, seed: int) -> list[str]:
    """Labelled 0: words as they stand and joined as identifiers and paths are, some with a number; dates, times and other numbers."""
    rng = random.Random(seed)
    words = [w for w in words if w] or ["name"]
    number = lambda most: str(rng.randrange(10 ** rng.randint(1, most)))
    out = []
    for k in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(1, 5))]
        joined = ("_".join(w), "".join(x.capitalize() for x in w), "-".join(w), "/".join(w), "".join(w), "_".join(w).upper())[k % 6]
        out.append(joined + (rng.choice(("", "_", "-", "/")) + number(4) if k % 5 == 0 else ""))
        if k % 4 == 0:
            out.append(rng.choice(("-", "/", "", "+", "_")).join(number(6) for _ in range(rng.randint(1, 5))))
    return out


def sample_words(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> list[str]:
    """Distinct ASCII words of the whole texts of the sample_docs documents with the smallest hash of their id, at most `words` of them, again by hash: the same ones for any partitioning."""
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    if not ids:
        return []
    every = docs.where(F.col("doc_id").isin(ids)).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct()
    return sorted(r[0] for r in every.orderBy(F.xxhash64("w"), "w").limit(words).collect())


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, n: int = 6000, seed: int = 7) -> Detector:
    return Detector(random_samples(n, seed), identifier_samples(sample_words(docs, sample_docs), n, seed + 1))


def find_spans(text: str, detector: Detector | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind. What a pattern's span covers is not searched for random stretches."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:
        spans += [(*m.span(), 2) for m in HEX.finditer(text)]
    if detector and longest >= SHORTEST_RUN:
        base = sorted((a, b) for a, b, _ in spans)
        for m in RUN.finditer(text):
            i, end = m.span()
            for a, b in [s for s in base if s[0] < end and i < s[1]] + [(end, end)]:
                if a - i >= SHORTEST_RUN:
                    spans += [(i + x, i + y, 3) for x, y in detector.stretches(text[i:a])]
                i = max(i, b)
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, j, k in spans)


def scan(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row of docs(doc_id, text).

    A null or empty text has no spans. Null and repeated ids are kept, a row each; other columns, of
    whatever names, are ignored; an empty table gives no rows. A very long text is searched whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, all_spans = [], [], []
            for _, text in rows_of(batch):
                spans = find_spans(text.decode("utf-8", "replace"), detector)
                kinds = [k for _, _, k in spans]
                counts.append([kinds.count(k) for k in range(4)])
                digests.append(hashlib.sha256(told([s for s in spans if s[2] < 3]).encode()).hexdigest())
                all_spans.append(told(spans))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in n.T), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return as_bytes(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def mask_text(text: str, detector: Detector | None) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, at, open_until, kind = [], 0, -1, 0
    merged: list[list[int]] = []
    for i, j, k in find_spans(text, detector):
        if merged and i < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], j)
        else:
            merged.append([i, j, k])
    for i, j, k in merged:
        out += [text[at:i], f"[{KINDS[k]}]"]
        at = j
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, detector: Detector | None) -> DataFrame:
    """docs with the secrets in `text` masked and `n_chars`, where there is one, counted again. A null text stays null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def hide(texts):  # a Series each
        return texts.map(lambda t: None if t is None else mask_text(t, detector))

    out = bounded_batches(docs).withColumn("text", hide("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
