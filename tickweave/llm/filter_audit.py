"""Filter interaction audit by incremental retraction over a stream of files.

All files of a table are read as available-now micro-batches. A task gives each document
the mask of filters its own text fails (A to D) and a digest of the text. Filter E (an
equal text under a smaller id) depends on the whole table: the stream keeps, as keyed state,
every distinct text's smallest id so far with its documents. When a smaller id
arrives, the earlier mask of the former holder is retracted (-1) and given anew with E
(+1). The signed changes are joined with the labels and summed into part counters per
micro-batch, one folder each, written over when a micro-batch is repeated; so the counters
are exact after a lost executor or a restarted stream.

State keys are buckets of about ``TEXTS_PER_KEY`` texts. Only a task's smallest id of a text
competes for the state; larger ids fail E whatever else arrives and pass by under scattered
keys. A text that a third of all rows share thus sends one row per task to its bucket.
The state store is the session's; for state beyond memory set the RocksDB provider there.

Texts are equal if their 128-bit BLAKE2b digests are. Defined results: a null text is empty,
and equal to other empty ones. A null id is neither smaller nor larger than any other, so it
never fails E. Rows with the same id and text are each a row and do not fail E by one another.
A null part is the empty string. A document is good or toxic if any of its label
rows says so. An empty table has no parts and no rows. Further columns are not kept.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir
from .common import col

LETTERS = "ABCDE"
E_BIT = 1 << LETTERS.index("E")
TEXTS_PER_KEY = 256
DIGEST = 16
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"


def text_mask(raw: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails; ``raw`` is its UTF-8."""
    words = raw.split()
    n_upper = len(raw) - len(raw.translate(None, UPPER))
    has_mark = len(raw) != len(raw.translate(None, MARKS))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * n_upper > 3 * n_chars) << 2
        | has_mark << 3
    )


def open_stream(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """The Parquet files of ``path`` as a stream of about ``batches`` micro-batches."""
    still = spark.read.parquet(path)
    per_batch = max(1, math.ceil(len(still.inputFiles()) / batches))
    reader = spark.readStream.schema(still.schema).option("maxFilesPerTrigger", per_batch)
    # By default files a week older than the newest would be left out after the first batch.
    # As a pattern, the path may name one file as well as a folder of files.
    path = path.rstrip("/")
    return reader.option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")


CONTENDER = "bucket long, digest binary, mask int, has_id boolean, doc_id long, part string, n long"


def contenders(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, part) as rows of the keyed state, or past it.

    Negative buckets hold rows that are decided: ids above another one of their text, and null ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        out: list = []

        def past(digest, mask, doc_id, part, n) -> None:
            spread = int.from_bytes(digest[8:12], "big") + len(out)
            out.append((-1 - spread % buckets, digest, mask, doc_id is not None, doc_id or 0, part, n))

        def flush() -> pa.RecordBatch:
            for digest, (mask, doc_id, parts) in least.items():
                bucket = int.from_bytes(digest[:8], "big") % buckets
                out.extend((bucket, digest, mask, True, doc_id, part, n) for part, n in parts.items())
            least.clear()
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out)) or [[]] * len(kinds)
            out.clear()
            names = ["bucket", "digest", "mask", "has_id", "doc_id", "part", "n"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py() or ""
                raw = text.encode()
                digest = hashlib.blake2b(raw, digest_size=DIGEST).digest()
                held = least.get(digest)
                mask = held[0] if held else text_mask(raw, len(text))
                if doc_id is None:
                    past(digest, mask, None, part, 1)
                elif held is None or doc_id < held[1]:
                    if held:
                        for p, n in held[2].items():
                            past(digest, mask | E_BIT, held[1], p, n)
                    least[digest] = (mask, doc_id, Counter([part]))
                elif doc_id == held[1]:
                    held[2][part] += 1
                else:
                    past(digest, mask | E_BIT, doc_id, part, 1)
            if len(least) + len(out) > 100_000:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, CONTENDER)


CHANGE = "has_id boolean, doc_id long, part string, mask int, n long"
STATE = "digests binary, ids array<bigint>, parts array<string>, counts array<bigint>"


def fold_texts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed changes of one bucket of texts; its state is every text's smallest id so far."""
    if key[0] < 0:
        for frame in frames:
            yield frame[["has_id", "doc_id", "part", "mask", "n"]]
        return
    held: dict = {}
    if state.exists:
        digests, ids, parts, counts = state.get
        for k, (doc_id, part, n) in enumerate(zip(ids, parts, counts)):
            held.setdefault(bytes(digests[k * DIGEST : (k + 1) * DIGEST]), (doc_id, Counter()))[1][part] += n
    changes: Counter = Counter()
    for frame in frames:
        rows = (frame[c].tolist() for c in ("digest", "mask", "doc_id", "part", "n"))
        for digest, mask, doc_id, part, n in zip(*rows):
            former = held.get(digest)
            if former is not None and former[0] < doc_id:
                changes[doc_id, part, mask | E_BIT] += n
                continue
            if former is not None and former[0] > doc_id:
                for p, m in former[1].items():  # retract, and count anew as a copy
                    changes[former[0], p, mask] -= m
                    changes[former[0], p, mask | E_BIT] += m
                former = None
            if former is None:
                former = held[digest] = (doc_id, Counter())
            former[1][part] += n
            changes[doc_id, part, mask] += n
    flat = [(digest, doc_id, part, n) for digest, (doc_id, parts) in held.items() for part, n in parts.items()]
    digests, ids, parts, counts = (list(c) for c in zip(*flat))
    state.update((b"".join(digests), ids, parts, counts))
    rows = [(True, *change, n) for change, n in changes.items() if n]
    yield pd.DataFrame(rows, columns=["has_id", "doc_id", "part", "mask", "n"])


def part_counters(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """part, mask, good, toxic, n for a stream of (doc_id, text, part), run until all files are read.

    ``labels`` has (doc_id, good, toxic), at most one row per document.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    changes = (
        contenders(docs, buckets)
        .groupBy("bucket")
        .applyInPandasWithState(fold_texts, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    )

    def add_up(batch: DataFrame, number: int) -> None:
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
        named = batch.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id")))
        sums = named.join(labels, "doc_id", "left").groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    stream = changes.writeStream.foreachBatch(add_up).option("checkpointLocation", f"{folder}/checkpoint")
    running = stream.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    kept = spark.read.schema("part string, mask int, good boolean, toxic boolean, n long, batch int")
    parts = kept.parquet(f"{folder}/counters").groupBy("part", "mask", "good", "toxic")
    return parts.agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def order_report(counters: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: what the step's filter keeps and removes."""
    steps = [
        f"{''.join(order)}{k + 1}|{1 << LETTERS.index(order[k])}|{sum(1 << LETTERS.index(x) for x in order[:k])}"
        for order in permutations(LETTERS)
        for k in range(len(LETTERS))
    ]  # 600 fixed strings: order and step, bit of the filter, bits of those before
    cell = F.split(F.col("cell"), r"\|")
    rows = counters.withColumn("cell", F.explode(F.lit(steps))).select(
        "part", "mask", "good", "toxic", "n",
        F.substring("cell", 1, 5).alias("filter_order"),
        F.substring("cell", 6, 1).cast("int").alias("step"),
        cell[1].cast("int").alias("bit"),
        cell[2].cast("int").alias("before"),
    )
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("long")

    # A filter comes first among the filters a document fails in 120 / their number of the orders.
    first_in = F.expr("n * 120 div greatest(bit_count(mask), 1)")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails & F.col("good")).alias("good_lost"),
        total(~gone & fails & F.col("toxic")).alias("toxic_lost"),
        total(fails, first_in).alias("shapley"),
    )


def audit_filters(
    spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", batches: int = 4
) -> DataFrame:
    """The whole audit for the Parquet files of ``path``; ``labels`` has (key, quality, toxic)."""
    flags = labels.groupBy(col(key).cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    buckets = max(1, spark.read.parquet(path).count() // TEXTS_PER_KEY)
    docs = open_stream(spark, path, batches).select(
        col(key).cast("long").alias("doc_id"), col(text).alias("text"), F.coalesce(col(part), F.lit("")).alias("part")
    )
    return order_report(part_counters(docs, flags, buckets))
