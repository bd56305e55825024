"""Line dedup: a suffix array over line names, built by distributed prefix doubling.

Lines become integers. Round k ranks the line positions by their first 2**k lines: the
rank pairs (rank of i, rank of i + 2**(k-1)) of the round before are sorted. Positions
of one rank form a longest-common-prefix interval, a run of 2**k lines that repeats. A
position alone in its rank is settled and leaves, so rounds shrink and end with the
longest repeated run. All but the first position of an interval are later copies.

A maximal repeated run of m lines, 2**k <= m < 2**(k+1), is covered by its first and its
last 2**k lines, and both are later copies in round k; so without a bound on words the
intervals of all rounds together cover exactly the later copies of all maximal runs. With
one, a maximal run stays where its runs of 2**k lines have too few words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, PLAIN, cut_lineage, join_key, keyed, plain_key, wrapped
from .naming import key_sql, proven_keys, sorted_names

#: A repeated run of 2**k lines is deleted if it has at least so many words.
MIN_WORDS = 5
#: Characters of texts that a task holds at a time when it removes lines.
PIECE = 1 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def later_copies(texts: DataFrame, min_words: int = MIN_WORDS, bits: int = 64) -> DataFrame:
    """Document key, ``at`` and ``length`` of runs of 2**k lines that occurred before.

    ``texts`` are keyed documents. They come in the order of doc_id (null last) and,
    where it repeats, of the text's hash; lines in the order of the text. ``bits`` are
    those of a hash of a line; results do not hang on them.
    """
    width, keys = proven_keys(texts.select(F.explode(_lines(F.col("text"))).alias("x")), "line-keys", bits)
    # A line that occurs once is settled before the first round.
    names = sorted_names(keys.filter("n > 1").select("key"), ["key"], "rank", "line-names")
    order = sorted_names(
        texts.select(F.col("_doc").isNull().alias("last"), *KEY).distinct(), ["last", *KEY], "doc", "document-order"
    )
    words = f"regexp_count(x, '[^ \\\\t-\\\\r]+')"
    entries = F.expr(f"transform(split(text, '\\\\n', -1), x -> struct({key_sql(width, bits=bits)} as key, {words} as words))")
    listed = cut_lineage(texts.select(*KEY, entries.alias("lines")), "line-rows")
    listed = join_key(listed, order.drop("last")).dropDuplicates(["doc"])
    rows = listed.select("doc", F.posexplode("lines").alias("at", "line")).select("doc", "at", "line.key", "line.words")
    rows = rows.join(names, "key").select("doc", "at", "words", "rank")
    # Written, so that the joins by rank only join and Spark may split a very common line.
    rows = cut_lineage(rows, "line-ranks")
    first = cut_lineage(rows.groupBy("rank").agg(F.min(F.struct("doc", "at")).alias("first")), "first-lines")
    rows = cut_lineage(rows.join(first, "rank").select("doc", "at", "words", "rank", "first"), "ranks-1")

    length, cuts = 1, None
    while not rows.isEmpty():
        later = (F.struct("doc", "at") > F.col("first")) & (F.col("words") >= min_words)
        found = rows.filter(later).select("doc", "at", F.lit(length).alias("length"))
        cuts = found if cuts is None else cuts.union(found)
        left = rows.select("doc", "at", "words", F.col("rank").alias("a"))
        right = rows.select("doc", (F.col("at") - length).alias("at"), F.col("words").alias("more"), F.col("rank").alias("b"))
        pairs = left.join(right, ["doc", "at"]).select("doc", "at", (F.col("words") + F.col("more")).alias("words"), "a", "b")
        pairs = cut_lineage(pairs, "rank-pairs")
        groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"))
        ranks = sorted_names(groups.filter("n > 1").drop("n"), ["a", "b"], "rank", "pair-ranks")
        length *= 2
        rows = cut_lineage(pairs.join(ranks, ["a", "b"]).select("doc", "at", "words", "rank", "first"), f"ranks-{length}")
    if cuts is None:
        cuts = rows.select("doc", "at", F.lit(0).alias("length"))
    return cuts.join(order.select("doc", *KEY), "doc").select(*KEY, "at", "length")


def _stay(text: str, runs: list[dict] | None) -> tuple[int, int, str, str]:
    """Lines, lines removed, the text that is left and its hash."""
    count, gone = text.count("\n") + 1, 0
    if runs:
        steps = np.zeros(count + 1, np.int64)
        for r in runs:
            steps[r["at"]] += 1
            steps[r["at"] + r["length"]] -= 1
        stay = np.cumsum(steps)[:-1] == 0
        gone, text = count - int(stay.sum()), "\n".join(compress(text.split("\n"), stay.tolist()))
    return count, gone, text, hashlib.sha256(text.encode()).hexdigest()


def _drop_lines(passed: list[str]):
    """Texts without the lines of their runs; the ``passed`` columns go along.

    Rows leave in pieces of about PIECE characters or one longer text.
    """

    def run(batches):
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs")
            found, size, low = [], 0, 0
            for i in range(batch.num_rows):
                found.append(_stay(texts[i].as_py(), runs[i].as_py()))
                size += len(found[-1][2])
                if size >= PIECE or i + 1 == batch.num_rows:
                    counts, removed, kept, sums = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(low, len(found)) for c in passed), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sums, pa.string())],
                        names=[*passed, *(f.name for f in RESULT)])
                    found, size, low = [], 0, i + 1

    return run


RESULT = T.StructType().add("n_lines", "long").add("n_removed", "long").add("kept_text", "string").add("kept_sha256", "string")


def _without_copies(rows: DataFrame, passed: list[str]) -> DataFrame:
    schema = T.StructType([*(rows.schema[c] for c in passed), *RESULT.fields])
    return rows.select(*passed, "text", "runs").mapInArrow(_drop_lines(passed), schema)


def _runs(texts: DataFrame, min_words: int) -> DataFrame:
    """Document key and ``runs``, the lines to delete, of documents that have any."""
    cuts = later_copies(texts, min_words).groupBy(*KEY).agg(F.collect_list(F.struct("at", "length")).alias("runs"))
    return cut_lineage(cuts, "line-cuts")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text, kept_sha256 for every row.

    Lines end at a line feed. Removed is each line in a run of 2**k lines, with at least
    ``min_words`` words, that occurred earlier. A null or empty text is one empty line and
    keeps it. Rows that repeat doc_id and text are one document and each get its result.
    A null doc_id comes last. An empty table gives an empty result. Other columns are not
    read.
    """
    texts = keyed(docs)
    found = _without_copies(join_key(texts, _runs(texts, min_words), "left"), ["_doc"])
    return found.withColumnRenamed("_doc", "doc_id")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of lines: text and n_chars are changed, all columns stay.

    A row that loses every line goes. Of rows that repeat doc_id and text one stays. Rows
    that lose nothing are unchanged, a null text stays null.
    """
    runs = plain_key(_runs(keyed(docs), min_words))
    # One shuffle of the rows serves the join and the removal of repeated rows.
    rows = plain_key(wrapped(docs)).join(runs, list(PLAIN), "left").dropDuplicates(list(PLAIN))
    text = F.coalesce(F.col("row").getField("text").cast("string"), F.lit("")).alias("text")
    found = _without_copies(rows.select("row", text, "runs"), ["row"]).filter("n_removed < n_lines")
    new = {c: F.col("row").getField(c) for c in docs.columns}
    changed = F.col("n_removed") > 0
    new["text"] = F.when(changed, F.col("kept_text")).otherwise(new["text"].cast("string"))
    if "n_chars" in new:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(new["n_chars"])
    return found.select(*(value.alias(c) for c, value in new.items()))
