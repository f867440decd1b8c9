"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class). The class factor is a
softmax over ``CLASSES`` classes whose logits are sums of weight rows, one row per
feature of the history, hashed into ``ROWS`` rows: the last token, the last two, and
the skip to the second last. The most frequent words and the end of a text are classes of
their own; other words fall in classes by their last two bytes, which carry endings,
punctuation and, through them, language. The token factor follows a path of two branches of
``WAYS`` ways by the word's hash, each a softmax of the last token and the last two,
hashed together with the place on the path. Words that share a leaf (of 256 in a
class) share its probability by their counts, smoothed like the base model (half a count
for every token and for an unknown one), so any vocabulary has probabilities that sum to one.

Counts come from all training texts by grouped sums. Weights are trained by distributed
updates: in each round every task takes its texts' gradient steps from the same weights,
and the steps of a weight row are averaged over the tasks that took any. Rounds split the
training texts, so each is seen once. Arrow cuts texts into words, some megabytes at a time, and
each word that differs is hashed and looked up once for all its tokens there. Scoring goes
through chunks of tokens in numpy, and gathers only the weight rows that their features name.

Defined results: null and empty texts are one end token. A token is known if training
texts hold it. Without training texts every token is unknown. Repeated rows count and
score separately. Further columns are not needed and not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import col

CLASSES, OWN = 32, 15
END = OWN  # classes 0 to OWN - 1: the most frequent words; then the end; then endings
ENDINGS = CLASSES - OWN - 1
#: Weight rows: one for the bias, then one part of the table per kind of feature. Sizes are powers of two.
PARTS = ((1, 1), (1 << 13, 0x9E3779B1), (1 << 14, 0x85EBCA6B), (1 << 13, 0xC2B2AE35))
ROWS = sum(n for n, _ in PARTS)
FIRST = [sum(n for n, _ in PARTS[:k]) for k in range(len(PARTS))]
#: Branches below a class: two, each of WAYS ways, with rows of their own, two in one row of the class weights.
WAYS, LEAF_SHIFT = 16, 8
LEAVES = WAYS * WAYS
NODES = ENDINGS * (1 + WAYS)
BRANCH_PARTS = ((NODES, 1), (1 << 15, 0x9E3779B1), (1 << 15, 0x85EBCA6B))
BRANCH_FIRST = [sum(n for n, _ in BRANCH_PARTS[:k]) for k in range(len(BRANCH_PARTS))]
ALL_ROWS = ROWS + sum(n for n, _ in BRANCH_PARTS) * WAYS // CLASSES
BLOCK = 8_192
#: Tokens whose logits are worked out together; rows of a run that are added run by run from here on.
CHUNK, TAIL = 1_024, 48
HEAD = 65_536
BOS, EOS = 0x1234567, 0x7654321


def ending_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-2:]) % ENDINGS


@dataclass(frozen=True)
class Counts:
    """What the tasks need of the corpus: all of bounded size."""

    n_tokens: int
    n_distinct: int
    n_texts: int
    own: tuple[bytes, ...]
    head: dict[bytes, int]
    class_tokens: tuple[int, ...]
    class_distinct: tuple[int, ...]
    leaf_tokens: np.ndarray
    leaf_distinct: np.ndarray

    def leaf_log(self) -> np.ndarray:
        """log10 of the smoothed size by class and leaf; a class of one word has its size at every leaf."""
        sizes = np.array(self.class_tokens) + 0.5 * (np.array(self.class_distinct) + 1)
        found = np.repeat(np.log10(sizes)[:, None], LEAVES, axis=1)
        found[OWN + 1 :] = np.log10(self.leaf_tokens + 0.5 * (self.leaf_distinct + 1))
        return found


#: One step of CRC-32 for each byte, and bytes of a word that numpy takes before zlib takes the rest.
CRC = np.array([zlib.crc32(bytes([255 ^ k])) ^ 0xFF000000 for k in range(256)], dtype=np.uint32)
CRC_MOST = 48


def _crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the runs of bytes of these starts and sizes, a byte of all of them at a time."""
    by_size = np.argsort(CRC_MOST - np.minimum(sizes, CRC_MOST).astype(np.uint16), kind="stable")  # longest first
    first, sizes = starts[by_size], sizes[by_size]
    longer = len(sizes) - np.searchsorted(sizes.clip(max=CRC_MOST)[::-1], np.arange(CRC_MOST), side="right")
    crc = np.full(len(sizes), 0xFFFFFFFF, dtype=np.uint32)
    for k, n in enumerate(longer.tolist()):
        if not n:
            break
        some = crc[:n]
        some[:] = CRC.take((some ^ data.take(first[:n] + k)) & 255) ^ (some >> 8)
    crc ^= 0xFFFFFFFF
    for k in np.flatnonzero(sizes > CRC_MOST).tolist():
        crc[k] = zlib.crc32(data[first[k] + CRC_MOST : first[k] + sizes[k]], int(crc[k]))
    found = np.empty_like(crc)
    found[by_size] = crc
    return found


class Codes:
    """Codes of words, hash * CLASSES + class; and slots, which number the head words from 1 (0: another word)."""

    def __init__(self, own: tuple[bytes, ...], head: tuple[bytes, ...] = ()) -> None:
        self.own, self.head = pa.array(own, pa.binary()), pa.array(head, pa.binary())

    def of(self, words: pa.BinaryArray) -> np.ndarray:
        ends = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        starts, ends = ends[:-1], ends[1:]
        tails = np.maximum(ends - 2, starts)
        classes = OWN + 1 + (_crc32(data, tails, ends - tails) % ENDINGS).astype(np.int64)
        own = pc.index_in(words, value_set=self.own).fill_null(-1).to_numpy(zero_copy_only=False)
        return _crc32(data, starts, ends - starts).astype(np.int64) * CLASSES + np.where(own < 0, classes, own)

    def slots(self, words: pa.BinaryArray) -> np.ndarray:
        return pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy(zero_copy_only=False) + 1


def _features(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Weight rows of each kind of feature for the tokens at ``at``."""
    one, two = hashes[at - 1], hashes[at - 2]
    mixed = (None, one, one * 31 + two * 0x10001, two)
    rows = [np.zeros(len(at), dtype=np.int64)]
    for (size, factor), first, value in list(zip(PARTS, FIRST, mixed))[1:]:
        rows.append(first + ((value * factor & 0xFFFFFFFFFFFF) >> 17 & size - 1))
    return rows


def _words(texts: pa.StringArray) -> pa.ListArray:
    """The words of each text. Arrow's ASCII functions lower A-Z only and cut at exactly \\x20 and \\x09-\\x0D."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.not_equal(words, "")  # white space at the ends of a text has empty words beside it
    kept = np.cumsum(np.r_[0, filled.to_numpy(zero_copy_only=False)], dtype=np.int32)
    offsets = kept[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(offsets), words.filter(filled).cast(pa.binary()))


def _word_lists(texts: pa.StringArray, most: int = 2_000_000) -> Iterator[pa.ListArray]:
    """The words of as many texts at a time as have ``most`` bytes (of one, if it is larger)."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + most, side="right")))
        yield _words(texts[k:stop])
        k = stop


def _coded(lists: pa.ListArray, codes: Codes):
    """The texts' words (each once), the tokens' places among them, all token codes with two marks before
    each text and its end behind, where the words stand in those, and the number of tokens by text."""
    words = lists.flatten().dictionary_encode()
    distinct, which = words.dictionary, words.indices.to_numpy()
    sizes = lists.value_lengths().to_numpy().astype(np.int64) + 1
    ends = np.cumsum(sizes + 2) - 1
    code = np.full(len(which) + 3 * len(sizes), BOS * CLASSES, dtype=np.int64)
    code[ends] = EOS * CLASSES + END
    at = np.arange(len(which)) + np.repeat(3 * np.arange(len(sizes)) + 2, sizes - 1)
    code[at] = codes.of(distinct)[which]
    return distinct, which, code, at, sizes


def _blocks(word_lists: Iterator[pa.ListArray | list[bytes]], codes: Codes, most: int = 200_000):
    """Token codes of some texts behind one another, with the number of tokens by text. ``word_lists``:
    the words of many texts as an Arrow array, or those of one as a plain list."""
    parts, counts, held = [], [], 0
    for lists in word_lists:
        lists = lists if isinstance(lists, pa.Array) else pa.array([lists], pa.list_(pa.binary()))
        _, _, code, _, sizes = _coded(lists, codes)
        upto, done = np.cumsum(sizes + 2), 0
        while done < len(sizes):
            before = int(upto[done - 1]) if done else 0
            stop = min(int(np.searchsorted(upto, before + most - held, side="right")) + 1, len(sizes))
            parts.append(code[before : upto[stop - 1]])
            counts.append(sizes[done:stop])
            held += len(parts[-1])
            done = stop
            if held > most:
                yield np.concatenate(parts), np.concatenate(counts)
                parts, counts, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(counts)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Positions of the tokens proper in a block of texts with two marks before each."""
    return np.arange(sizes.sum()) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)


def _branches(hashes: np.ndarray, classes: np.ndarray, at: np.ndarray):
    """Of the tokens at ``at``: which have a path, the way taken at its two branches, and the weight
    rows of both, those of the first branch before those of the second."""
    has = np.flatnonzero(classes[at] > END)
    at = at[has]
    leaf = hashes[at] >> LEAF_SHIFT & LEAVES - 1
    top = classes[at] - END - 1
    ways = np.concatenate([leaf // WAYS, leaf & WAYS - 1])
    node = np.concatenate([top, ENDINGS + top * WAYS + leaf // WAYS])
    one, two = hashes[at - 1], hashes[at - 2]
    rows, mark = [node], node * 0x9E3779B97F
    for (size, factor), first, value in zip(BRANCH_PARTS[1:], BRANCH_FIRST[1:], (one, one * 31 + two * 0x10001)):
        rows.append(first + (((np.concatenate([value, value]) + mark) * factor & 0xFFFFFFFFFFFF) >> 17 & size - 1))
    return has, ways, rows


def _branch_part(weights: np.ndarray) -> np.ndarray:
    """The rows of the branches, a view."""
    return weights[ROWS:].reshape(-1, WAYS)


def _chunks(weights: np.ndarray, rows: list[np.ndarray], out: np.ndarray | None = None):
    """Chunks of tokens that stay in a core's cache: where each begins, e to the logits (summed weight
    rows) and their sums per token. The logits lie in ``out``, or in one array for all chunks."""
    n, width = len(rows[0]), weights.shape[1]
    mine, spare = np.empty((2, min(n, CHUNK), width), dtype=np.float32)
    ones, same = np.ones(width, dtype=np.float32), not rows[0].any()
    for k in range(0, n, CHUNK):
        logits = mine[: n - k] if out is None else out[k : k + CHUNK]
        more = spare[: len(logits)]
        # "clip" writes straight to the array; all rows are in range.
        weights.take(rows[1][k : k + CHUNK], axis=0, out=logits, mode="clip")
        for r in rows[2:]:
            logits += weights.take(r[k : k + CHUNK], axis=0, out=more, mode="clip")
        logits += weights[0] if same else weights.take(rows[0][k : k + CHUNK], axis=0, out=more, mode="clip")
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        yield k, logits, logits @ ones


def _shares(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """P(class), or P(way), per token: the softmax of summed weight rows."""
    found = np.empty((len(rows[0]), weights.shape[1]), dtype=np.float32)
    for _, part, sums in _chunks(weights, rows, found):
        part /= sums[:, None]
    return found


def _shares_of(weights: np.ndarray, rows: list[np.ndarray], taken: np.ndarray) -> np.ndarray:
    """The share of one class, or way, per token."""
    found = np.empty(len(taken), dtype=np.float32)
    for k, part, sums in _chunks(weights, rows):
        found[k : k + CHUNK] = part[np.arange(len(part)), taken[k : k + CHUNK]] / sums
    return found


def _group_sums(values: np.ndarray, starts: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``, of the rows taken in this order."""
    order = np.arange(len(values)) if order is None else order
    sizes = np.diff(starts, append=len(order))
    by_size = np.argsort((len(order) - sizes).astype(np.uint16), kind="stable")  # longest first
    first, sizes = starts[by_size], sizes[by_size]
    longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(TAIL + 1), side="right")  # runs of over k rows
    sums = values.take(order[first], axis=0)
    for k in range(1, 8):
        sums[: longer[k]] += values.take(order[first[: longer[k]] + k], axis=0)
    tails = values.take(order[first[: longer[8]] + 8], axis=0)
    for k in range(9, TAIL):
        if not longer[k]:
            break
        tails[: longer[k]] += values.take(order[first[: longer[k]] + k], axis=0)
    for run in range(longer[TAIL]):
        more = values.take(order[first[run] + TAIL - 1 : first[run] + sizes[run]], axis=0)
        more[0] = tails[run]
        more.sum(axis=0, out=tails[run])
    sums[: len(tails)] += tails
    found = np.empty_like(sums)
    _whole(found)[by_size] = _whole(sums)
    return found


def _whole(table: np.ndarray) -> np.ndarray:
    """A view of a table whose items are whole rows, which are put in place faster."""
    return table.view(np.dtype((np.void, table.shape[1] * table.itemsize)))[:, 0]


def train_block(weights: np.ndarray, squares: np.ndarray, codes: np.ndarray, sizes: np.ndarray, rate: float) -> None:
    """Adaptive gradient steps in place, one per ``BLOCK`` tokens."""

    def step(weights, squares, hit, sums) -> None:
        moved = sums * sums
        seen = squares.take(hit, axis=0)
        seen += moved
        _whole(squares)[hit] = _whole(seen)
        seen += 1
        np.sqrt(seen, out=seen)
        np.divide(sums, seen, out=seen)
        seen *= rate
        weights.take(hit, axis=0, out=moved, mode="clip")
        moved -= seen
        _whole(weights)[hit] = _whole(moved)

    def steps(weights, squares, grad, rows, firsts) -> None:
        for r, first in zip(rows, firsts):
            order = np.argsort((r - first).astype(np.uint16), kind="stable")
            sorted_rows = r[order]
            starts = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]])
            step(weights, squares, sorted_rows[starts], _group_sums(grad, starts, order))

    hashes, classes = codes // CLASSES, codes & CLASSES - 1
    places = _places(sizes)
    below, below_squares = _branch_part(weights), _branch_part(squares)
    for k in range(0, len(places), BLOCK):
        at = places[k : k + BLOCK]
        rows = _features(hashes, at)
        grad = _shares(weights, rows)
        grad[np.arange(len(at)), classes[at]] -= 1
        step(weights, squares, np.zeros(1, dtype=np.int64), grad.sum(axis=0)[None, :])
        steps(weights, squares, grad, rows[1:], FIRST[1:])
        _, ways, rows = _branches(hashes, classes, at)
        if len(ways):
            grad = _shares(below, rows)
            grad[np.arange(len(ways)), ways] -= 1
            steps(below, below_squares, grad, rows, BRANCH_FIRST)


def class_logs(weights: np.ndarray, codes: np.ndarray, sizes: np.ndarray, leaf_log: np.ndarray) -> np.ndarray:
    """Per text: sum of log10 P(class) and log10 P(leaf | class), less the log10 size of the leaf."""
    below = _branch_part(weights)
    hashes, classes = codes // CLASSES, codes & CLASSES - 1
    places = _places(sizes)
    worth = np.empty(len(places))
    for k in range(0, len(places), BLOCK):
        at = places[k : k + BLOCK]
        shares = _shares_of(weights, _features(hashes, at), classes[at])
        mine = worth[k : k + BLOCK]
        mine[:] = np.log10(np.maximum(shares, 1e-30)) - leaf_log[classes[at], hashes[at] >> LEAF_SHIFT & LEAVES - 1]
        has, ways, rows = _branches(hashes, classes, at)
        if len(has):
            taken = _shares_of(below, rows, ways).reshape(2, -1)
            mine[has] += np.log10(np.maximum(taken, 1e-30)).sum(axis=0)
    return np.add.reduceat(worth, np.cumsum(sizes) - sizes)


def count_words(texts: DataFrame) -> DataFrame:
    """token, n for the one text column of ``texts``; tasks add up some texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _word_lists(batch.column(0), 8_000_000):
                tokens, n = lists.flatten().value_counts().flatten()
                yield pa.record_batch([tokens.cast(pa.string()), n], ["token", "n"])

    return texts.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_threshold(vocabulary: DataFrame, most: int = HEAD) -> int:
    """The least count that at most ``most`` words reach, from a histogram of counts."""
    # Counts above 4096 in steps of a sixteenth of a doubling: a few hundred rows.
    step = F.when(F.col("n") <= 4096, F.col("n")).otherwise(
        F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n") * 16) / 16))
    )
    rows = vocabulary.groupBy(step.cast("long").alias("least")).count().collect()
    reached, threshold = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r.least):
        reached += row["count"]
        if reached > most:
            break
        threshold = row.least
    return threshold


def corpus_counts(texts: DataFrame) -> tuple[Counts, DataFrame]:
    """The bounded counts, and the stored vocabulary (token, n)."""
    vocabulary = stage(count_words(texts))
    n_texts = texts.count()
    threshold = head_threshold(vocabulary)
    head = {r.token.encode(): r.n for r in vocabulary.where(F.col("n") >= threshold).collect()}
    own = tuple(sorted(head, key=lambda w: (-head[w], w))[:OWN])
    tail = F.crc32(F.expr("substring(cast(token as binary), greatest(octet_length(token) - 1, 1), 2)")) % ENDINGS
    leaf = F.pmod(F.shiftright(F.crc32(F.col("token").cast("binary")), LEAF_SHIFT), F.lit(LEAVES))
    leaf_tokens, leaf_distinct = np.zeros((2, ENDINGS, LEAVES), dtype=np.int64)
    places = vocabulary.groupBy(tail.cast("int").alias("e"), leaf.cast("int").alias("leaf"))
    for r in places.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # ENDINGS * LEAVES rows at most
        leaf_tokens[r.e, r.leaf], leaf_distinct[r.e, r.leaf] = r.n, r.v
    for word in own:
        place = ending_class(word) - OWN - 1, zlib.crc32(word) >> LEAF_SHIFT & LEAVES - 1
        leaf_tokens[place] -= head[word]
        leaf_distinct[place] -= 1
    tokens = [*(head[w] for w in own), *[0] * (OWN + 1 - len(own)), *leaf_tokens.sum(axis=1).tolist()]
    distinct = [*(1 for _ in own), *[0] * (OWN + 1 - len(own)), *leaf_distinct.sum(axis=1).tolist()]
    tokens[END], distinct[END] = n_texts, int(n_texts > 0)
    counts = Counts(sum(tokens), sum(distinct), n_texts, own, head, tuple(tokens), tuple(distinct), leaf_tokens, leaf_distinct)
    return counts, vocabulary


def train(
    texts: DataFrame, counts: Counts, part: Column, rounds: int = 2, rate: float = 0.3, tokens_per_task: int = 8_000_000
) -> np.ndarray:
    """Weights, ALL_ROWS x CLASSES: those of the classes, then those of the branches. ``part`` (a number per text) deals the texts to rounds."""
    spark = texts.sparkSession
    weights = np.zeros((ALL_ROWS, CLASSES), dtype=np.float32)
    own = counts.own
    tasks = max(12, -(-counts.n_tokens // (tokens_per_task * rounds)))
    names = [f"w{k}" for k in range(CLASSES)]

    for k in range(rounds):
        sent = spark.sparkContext.broadcast(weights)  # ALL_ROWS x CLASSES numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, squares = sent.value.copy(), np.zeros((ALL_ROWS, CLASSES), dtype=np.float32)
            codes = Codes(own)
            lists = (x for batch in batches for x in _word_lists(batch.column(0)))
            for block, sizes in _blocks(lists, codes):
                train_block(mine, squares, block, sizes, rate)
            hit = np.flatnonzero(squares.any(axis=1))
            steps = mine[hit] - sent.value[hit]
            weigh = np.sqrt(squares[hit].sum(axis=1, dtype=np.float64))
            columns = [pa.array(hit), pa.array(weigh)]
            columns += [pa.array(np.ascontiguousarray(steps[:, c]) * weigh) for c in range(CLASSES)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "weigh", *names])

        schema = "row long, weigh double, " + ", ".join(f"{n} double" for n in names)
        taken = texts.where(F.pmod(part, F.lit(rounds)) == k).coalesce(tasks).mapInArrow(run, schema)
        mixed = taken.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("weigh", *names)))
        # At most ALL_ROWS rows, whatever the input.
        found = mixed.toPandas().sort_values("row")
        weights = weights.copy()
        steps = found[names].to_numpy() / found[["weigh"]].to_numpy()
        weights[found["row"].to_numpy(dtype=np.int64)] += steps.astype(np.float32)
        weights = np.round(weights * 4096) / np.float32(4096)
    return weights


def score(rows: DataFrame, counts: Counts, vocabulary: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for ``rows`` (doc_id, text).

    Words of the head are looked up in the task. The others are joined with the
    vocabulary: each is rarer than every word of the head, so no join key is hot.
    """
    sent = rows.sparkSession.sparkContext.broadcast((counts, weights))
    half = float(np.log10(0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = sent.value
        codes = Codes(counts.own, tuple(counts.head))
        leaf_log = counts.leaf_log()
        slot_log = np.log10(np.array([0.5, *counts.head.values()]) + 0.5)  # slot 0 counts nothing
        end_log, end_known = np.log10(counts.n_texts + 0.5), int(counts.n_texts > 0)
        for batch in batches:
            done = 0
            for lists in _word_lists(batch.column(2)):
                part = batch.slice(done, len(lists))
                done += len(lists)
                distinct, which, code, at, sizes = _coded(lists, codes)
                slots = np.zeros(len(code), dtype=np.int64)
                slots[at] = codes.slots(distinct)[which]
                starts = np.cumsum(sizes + 2) - sizes - 2
                known = np.add.reduceat(slots > 0, starts, dtype=np.int64) + end_known
                head_sum = np.add.reduceat(slot_log.take(slots), starts) + end_log
                others = np.flatnonzero(slots[at] == 0)
                text = np.repeat(np.arange(len(sizes)), sizes - 1)[others]
                pairs, times = np.unique(text * len(distinct) + which[others], return_counts=True)
                text, word = np.divmod(pairs, max(1, len(distinct)))
                offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)).astype(np.int32))
                tokens = distinct.take(pa.array(word)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(sizes), pa.array(known), pa.array(head_sum),
                        pa.array(class_logs(weights, code, sizes, leaf_log)),
                        pa.ListArray.from_arrays(offsets, tokens), pa.ListArray.from_arrays(offsets, pa.array(times)),
                    ],
                    ["row_id", "doc_id", "n_tokens", "head_known", "head_sum", "class_sum", "words", "times"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    done = stage(
        numbered.mapInArrow(
            run,
            "row_id long, doc_id long, n_tokens long, head_known long, head_sum double, class_sum double, "
            "words array<string>, times array<long>",
        )
    )
    rare = done.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row_id", F.col("x.words").alias("token"), F.col("x.times").alias("times")
    )
    found = rare.join(vocabulary, "token").groupBy("row_id").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more_sum")
    )
    base_log = float(np.log10(counts.n_tokens + 0.5 * (counts.n_distinct + 1)))
    n_known = F.col("head_known") + F.coalesce("more", F.lit(0))
    end_unknown = 0 if counts.n_texts else 1
    word_sum = (
        F.col("head_sum")
        + F.coalesce("more_sum", F.lit(0.0))
        + (F.col("n_tokens") - n_known - end_unknown) * half
    )
    return done.join(found, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        n_known.alias("n_known"),
        (word_sum - F.col("n_tokens") * base_log).alias("base_score"),
        (word_sum + F.col("class_sum")).alias("score"),
    )


def score_texts(docs: DataFrame, may_learn: Column, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, Counts]:
    """Scores of all rows of ``docs``, learnt from those for which ``may_learn`` holds."""
    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"), may_learn.alias("learn"))
    learn = rows.where("learn")
    counts, vocabulary = corpus_counts(learn.select("text"))
    part = F.xxhash64(F.lit("round"), F.col("doc_id"))
    weights = train(learn.select("text", "doc_id"), counts, part)
    return score(rows.select("doc_id", "text"), counts, vocabulary, weights), counts
