"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger is stored: what was measured, and one
long whose bit k says that rule k failed. A policy is a named, versioned mask over those
bits, applied to the stored ledger by one bitwise AND; ablations (what would come back without a
rule) are sums over the distinct masks, of which there are 2**rules at most however many the
documents are. Another policy, or another version of one, reads the ledger again and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_bytes, bounded_batches, lean, materialize, rows_of, shared_dir

#: Bit k of `failed` belongs to RULES[k]. Only append: stored ledgers keep their meaning.
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length", "shouting", "no_letters")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_letter_words")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed long"


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeats"))
DEFAULT = Policy("default", 1, RULES)
#: Versions stay as they are once documents have been told by them; a change is a new version.
POLICIES = {(p.name, p.version): p for p in (BASE, Policy("text", 1, ("few_words", "repeats", "dup_lines")), DEFAULT)}

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    a = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    v = len(known)
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)[1]
        key = pair * v + a[2:]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(len(a), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n,
        len(text.translate(None, _NOT_COUNTED)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        sum(w.strip(b".,;:!?\"'()").isalpha() or max(w) >= 0x80 for w in words),
    )


def failed_bits(m: np.ndarray) -> np.ndarray:
    """m: one column per measure."""
    n, chars, symbols, dups, repeats, lines, upper, letters = m.T
    some = n > 0
    rules = (
        n < 50,
        100 * repeats > 50 * n,
        some & (10 * symbols > n),
        10 * dups > 6 * lines,
        some & ((chars < 2 * n) | (chars > 14 * n)),
        some & (10 * upper > 4 * n),
        some & (10 * letters < 6 * n),
    )
    return sum(r.astype(np.int64) << k for k, r in enumerate(rules))


def _measured(texts: list[bytes]) -> list[pa.Array]:
    m = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
    return [*(pa.array(c) for c in m.T), pa.array(failed_bits(m))]


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): the measures and the failure bits.

    A null or empty text has no words and fails `few_words`; null and repeated ids are kept
    as they are; other columns, of whatever names, are ignored; an empty table gives an empty ledger. A
    very long text is measured whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = _measured([t for _, t in rows_of(batch)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *MEASURES, "failed"])

    return as_bytes(docs).mapInArrow(lean(run), LEDGER)


def stored_ledger(docs: DataFrame, uri: str | None = None) -> DataFrame:
    """The ledger as a table in the shared folder, from which policies and ablations are read."""
    return materialize(ledger(docs), uri or f"{shared_dir(docs.sparkSession, 'quality')}/ledger")


def passes(policy: Policy) -> F.Column:
    return F.col("failed").bitwiseAND(policy.mask) == 0


def apply_policy(found: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with base_failed and kept. kept is false wherever the base fails."""
    return found.withColumn("base_failed", ~passes(BASE)).withColumn("kept", passes(BASE) & passes(policy))


def told_with_ablations(found: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """apply_policy() of a stored ledger with the policy's name and version, and for what fails one rule of it alone: that rule, and how many documents come back without it."""
    back = ablations(found, policy).select("rule", "bit", "n_only")  # a row per rule
    judged = apply_policy(found, policy).withColumn("policy", F.lit(f"{policy.name}/{policy.version}"))
    own = judged.withColumn("only", F.col("failed").bitwiseAND(policy.mask))
    joined = own.join(F.broadcast(back), F.col("only") == F.col("bit"), "left")
    return joined.withColumnRenamed("rule", "sole_rule").withColumnRenamed("n_only", "n_back_without")


#: Name of the column that keeps the ledger beside stored documents.
BESIDE = "quality ledger"


def with_ledger(docs: DataFrame) -> DataFrame:
    """docs with their ledger as one more column, a struct, so that both are stored by one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = _measured([(t or "").encode() for t in batch.column("text").to_pylist()])
                beside = pa.StructArray.from_arrays(columns, names=[*MEASURES, "failed"])
                yield pa.RecordBatch.from_arrays([*batch.columns, beside], names=[*batch.schema.names, BESIDE])

    beside = StructField(BESIDE, StructType([StructField(m, LongType()) for m in (*MEASURES, "failed")]))
    return bounded_batches(docs).mapInArrow(lean(run), StructType([*docs.schema.fields, beside]))


def accepted(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base and the policy.

    The documents are stored with their ledger; the policy and its ablations, which are stored too
    (ablations.parquet beside them), read the ledger's columns alone. A null or empty text fails `few_words`
    and goes; null ids and repeated rows are judged row by row; an empty table stays empty; columns may have any
    names but the ledger's own.
    """
    uri = shared_dir(docs.sparkSession, "quality")
    marked = materialize(with_ledger(docs), f"{uri}/documents")
    bits = marked.select(marked[BESIDE]["failed"].alias("failed"))
    materialize(ablations(bits, policy), f"{uri}/ablations.parquet")
    return marked.where(marked[BESIDE]["failed"].bitwiseAND(BASE.mask | policy.mask) == 0).select(*(marked[f"`{c}`"] for c in docs.columns))


def ablations(found: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: how many documents fail it, fail only it (they return without it), and how many are left."""
    masks = found.select(F.col("failed").bitwiseAND(policy.mask).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules))
    each = masks.select("m", "n", F.explode(rules).alias("r")).select("m", "n", "r.rule", "r.bit")
    with_bit = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(with_bit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
