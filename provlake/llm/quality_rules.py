"""Quality rules as a bitmask ledger: every rule is evaluated once, failures are bits, measurements stay.

The ledger has one row for each document: its measurements and ``fail_mask``, bit i set where rule i fails.
A policy is a version with the rules that count; applying it is ``fail_mask & policy_mask``, and every
ablation (what would be kept without a rule, what one rule alone removes) comes from the histogram of
masks, of at most 2^rules rows, without another look at a text.

Words and lines are numbered by hash and the numbers confirmed byte by byte, so that counts are of equal texts.

Words are runs of characters other than \\x20 and \\x09-\\x0D. Cases: a null or empty text has no words and
fails min_words; measurements that divide by a count of none are 0; repeated rows are measured each for
itself; an empty table gives an empty ledger; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textprims import NONSPACE, doc_of, identities, mix64, pieces, prefix_hash, word_spans

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks"]
LEDGER_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Rules in bit order: name and the SQL condition under which a document fails. Fixed: a new rule takes a new bit.
RULES: list[tuple[str, str]] = [
    ("min_words", "n_words < 10"),
    ("repeat_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("upper_case", "n_letters >= 40 and 2 * n_upper > n_letters"),
    ("marks", "n_marks * 4 > n_words and n_words >= 10"),
    ("word_length", "n_words >= 10 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
]


@dataclass(frozen=True)
class Policy:
    """A version of the rules that decide."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {name: i for i, (name, _) in enumerate(RULES)}
        return sum(1 << at[r] for r in self.rules)


#: The base rules alone, and all rules.
POLICIES = {p.version: p for p in (Policy("base-1", ("min_words", "repeat_words")), Policy("full-1", tuple(n for n, _ in RULES)))}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?#*$%&|<>=~^"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _alike(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row of the columns occurs again; rows are grouped by hash and then compared."""
    h = columns[0].astype(np.uint64)
    for c in columns[1:]:
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + c.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    near = h[order][1:] == h[order][:-1]
    same = near.copy()
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    if (same != near).any():  # equal hashes of different rows
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _repeated(first: np.ndarray, number: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word whether a window that starts at one of first and occurs again in its document covers it."""
    covered = np.zeros(len(number) + WINDOW, np.int32)
    if len(first):
        hit = _alike([owner[first], *(number[first + k] for k in range(WINDOW))])
        np.add.at(covered, first[hit], 1)
        np.add.at(covered, first[hit] + WINDOW, -1)
    return np.cumsum(covered)[: len(number)] > 0


def measure(column: pa.Array) -> np.ndarray:
    """The MEASURES of each text, one row each."""
    out = np.zeros((len(column), len(MEASURES)), np.int64)
    for lo, hi, buf, docs in pieces(column):
        n = hi - lo
        starts, ends = word_spans(buf, NONSPACE)
        owner = doc_of(starts, docs)
        prefix = prefix_hash(buf)
        r = out[lo:hi]
        r[:, 0] = np.bincount(owner, minlength=n)
        lead = _LEAD[buf] & NONSPACE[buf]

        def per_doc(flag: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
            return total[docs[1:]] - total[docs[:-1]]

        r[:, 1] = per_doc(lead)
        r[:, 2], r[:, 6], r[:, 7], r[:, 8] = (per_doc(t[buf]) for t in (_SYMBOL, _LETTER, _UPPER, _MARK))
        if len(starts) >= WINDOW:
            first = np.flatnonzero(owner[: len(owner) - WINDOW + 1] == owner[WINDOW - 1 :])
            words, _ = identities(buf, starts, ends, prefix)
            covered = _repeated(first, words, owner)
            r[:, 4] = np.bincount(owner, weights=covered, minlength=n).astype(np.int64)
        # lines: every document's last line ends at the \n that pieces() puts after it
        nl = np.flatnonzero(buf == 10)
        ls = np.concatenate(([0], nl[:-1] + 1))
        seen = np.concatenate(([0], np.cumsum(NONSPACE[buf], dtype=np.int64)))
        worded = seen[nl] > seen[ls]
        ls, le = ls[worded], nl[worded]
        if len(ls):
            lo_of = doc_of(ls, docs)
            line, _ = identities(buf, ls, le, prefix)
            _, at = np.unique(line + lo_of * (int(line.max()) + 1), return_index=True)
            dup = np.ones(len(line), bool)
            dup[at] = False
            r[:, 3] = np.bincount(lo_of, weights=dup, minlength=n).astype(np.int64)
            r[:, 5] = np.bincount(lo_of, minlength=n)
    return out


def _measurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = measure(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])


def rule_ledger(documents: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_mask, for each row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, fails) in enumerate(RULES)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return docs.mapInArrow(_measurer, LEDGER_SCHEMA).withColumn("fail_mask", mask.cast("long"))


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy (its version), failed (the bits that count) and kept."""
    failed = F.col("fail_mask").bitwiseAND(F.lit(policy.mask))
    return ledger.withColumn("policy", F.lit(policy.version)).withColumn("failed", failed).withColumn("kept", failed == 0)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (kept but for this rule), kept_without; bitwise over the histogram of masks."""
    masks = ledger.groupBy("fail_mask").agg(F.count("*").alias("n"))
    at = {name: i for i, (name, _) in enumerate(RULES)}
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << at[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    x = masks.select("n", F.col("fail_mask").bitwiseAND(F.lit(policy.mask)).alias("m"), rules).select("n", "m", "r.rule", "r.bit")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(
        n(F.col("m").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        n(F.col("m") == F.col("bit")).alias("n_only"),
        n((F.col("m") == 0) | (F.col("m") == F.col("bit"))).alias("kept_without"),
    )
