"""Quality rules with host-level verdicts.

Every document is measured by a few rules. Failures are summed by host and rule; the
host's failure rates are shrunk towards the rate of all hosts by a beta prior that is
fitted to the hosts themselves, so a host of few documents is not judged by chance. A
host whose shrunk rate is above ``HOST_CUT`` in any rule is rejected, and the verdict is
joined back to its documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_small
from .common import cut_lineage, small_batches

#: A host is rejected if more than this share of its documents is expected to fail a rule.
HOST_CUT = 0.5
#: Fixed values of the base rule: fewest words, and largest share of repeated words in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
#: The rules, as SQL over the counts of a document.
RULES = {
    "base": f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
#: Fixed pattern of a word and fixed list of symbols.
WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first included.

    Words, then pairs, then triples get numbers, so equal windows are equal numbers.
    """
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n, v = len(words), len(numbers)
    if n < 4 or v == n:
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, which, times = np.unique(pairs[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)
    )


def _count(batches):
    for batch in batches:
        texts = (x.as_py() or "" for x in batch.column("text"))
        rows = np.array([text_counts(x) for x in texts], np.int64).reshape(-1, len(COUNTS))
        columns = [pa.array(rows[:, i]) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], names=["doc_id", "host", *COUNTS])


def host_of(source: Column) -> Column:
    """Host of a URL, or a plain source name as it is; A-Z lower-cased, null if there is none."""
    lower = F.translate(source.cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.nullif(F.regexp_extract(lower, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host and the COUNTS of every row of ``docs``."""
    small_batches(docs.sparkSession)
    schema = T.StructType().add("doc_id", "long").add("host", "string")
    for name in COUNTS:
        schema = schema.add(name, "long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), host_of(docs["source"]).alias("host"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_count, schema)


def host_failures(counted: DataFrame) -> DataFrame:
    """host, ``docs`` and per rule the number of documents that fail it."""
    failed = [F.expr(f"count_if({test}) AS {rule}") for rule, test in RULES.items()]
    return counted.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("docs"), *failed)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength (alpha + beta) of each rule's prior, by moments over the hosts.

    The spread of host rates beyond chance gives the correlation within a host,
    1 / (strength + 1). No such spread, or a single host, gives the full strength of all
    documents; the strength is at least one document.
    """
    sums = [F.sum(r).alias(r) for r in RULES] + [F.sum(F.col(r) * F.col(r) / F.col("docs")).alias(f"{r}_squares") for r in RULES]
    row = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("docs")).alias("squares"), *sums).first()
    out = {}
    for rule in RULES if row.hosts else ():
        n, mean = row.docs, row[rule] / row.docs
        chance, room = mean * (1 - mean) * (row.hosts - 1), mean * (1 - mean) * (n - row.squares / n - (row.hosts - 1))
        spread = row[f"{rule}_squares"] - n * mean * mean - chance
        within = spread / room if room > 0 else 0.0
        out[rule] = (mean, min(max(1 / within - 1, 1.0), float(n)) if within > 0 else float(n))
    return out


def rejected_hosts(hosts: DataFrame, cut: float = HOST_CUT) -> DataFrame:
    """Hosts with a shrunk failure rate above ``cut`` in any rule."""
    verdict = F.lit(False)
    for rule, (mean, strength) in beta_priors(hosts).items():
        verdict = verdict | ((F.col(rule) + F.lit(strength * mean)) / (F.col("docs") + F.lit(strength)) > cut)
    return hosts.where(verdict).select("host", F.lit(True).alias("host_rejected"))


def rule_report(docs: DataFrame, cut: float = HOST_CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, kept, host, host_rejected.

    A document is kept if it passes the base rule and its host is not rejected. A null
    text is empty, fails the base rule and counts for its host. A document without a host
    (null or empty source) is judged alone. Rows that repeat a doc_id are judged one by
    one. An empty table gives an empty result. Other columns are not read.
    """
    # Written, so that texts are read once and the join below only joins.
    counted = cut_lineage(document_counts(docs), "rule-counts")
    rejected = cut_lineage(rejected_hosts(cut_lineage(host_failures(counted), "host-failures"), cut), "rejected-hosts")
    judged = counted.join(F.broadcast(rejected) if is_small(rejected) else rejected, "host", "left")
    failed, gone = F.expr(RULES["base"]), F.coalesce("host_rejected", F.lit(False))
    return judged.select(
        "doc_id", *COUNTS[:-1], failed.alias("base_failed"), (~failed & ~gone).alias("kept"), "host", gone.alias("host_rejected")
    )
