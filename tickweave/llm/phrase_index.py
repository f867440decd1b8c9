"""A distributed positional inverted index, with exact phrase and proximity search.

Index: tasks cut their documents into blocks of about ``BLOCK_WORDS`` words. Within a block
every word has a place; one place between documents stays empty, so no run of
places crosses a document. A stored block is one row: its terms, how often each occurs, their
ascending places behind one another as 32-bit numbers, and its documents.

Search: the query phrases go to the blocks in chunks of about ``CHUNK_BYTES``, so what is
broadcast is bounded and the index never moves. For each chunk the terms are counted over all
blocks, without reading places; each phrase puts its terms in order from the rarest on. The
places of a term less its offset in the phrase are possible starts: within a block these lists are
intersected from the rarest term on until none is left. A block bounds every list.

Proximity: in blocks that hold all terms of the query, these must lie, repeats counted and in
any order, within as many words as the query has plus ``slop``.

Defined results: words are lower-cased in A-Z only. A null or empty text has no words and no
hits. Equal query texts and repeated rows are each found; an item is counted once per
document. A null item id is the empty string. An empty index or query set gives no matches.
Clashing names do no harm: only the named columns are read and others are not kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir, stage
from .common import col

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 1 << 18
CHUNK_BYTES = 16 << 20
#: ASCII letters lower-cased, other ASCII but digits to spaces; bytes of other characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
INDEX = "block long, terms binary, counts binary, places binary, doc_ids array<bigint>, sizes array<bigint>"
NAMES = [part.split()[0] for part in INDEX.split(", ")]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def word_array(text: Column) -> Column:
    """The same words as an array column."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The index of ``docs``; store it before searching."""
    numbers = pa.list_(pa.int64())
    kinds = [pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]

    def block_row(first: int, ids: list, sizes: list[int], codes: list, terms: dict) -> pa.RecordBatch:
        code = np.concatenate(codes)
        places = np.arange(len(code)) + np.repeat(np.arange(len(sizes)), sizes)
        places = places[np.argsort(code, kind="stable")].astype("<u4").tobytes()
        counts = np.bincount(code, minlength=len(terms)).astype("<u4").tobytes()
        row = (first, b"\n".join(terms), counts, places, ids, sizes)
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, sizes, codes, held = None, [], [], [], 0
        terms: defaultdict = defaultdict()
        terms.default_factory = terms.__len__
        for batch in batches:
            for row_id, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                first = row_id if first is None else first
                ids.append(doc_id)
                sizes.append(len(words))
                codes.append(np.fromiter(map(terms.__getitem__, words), dtype=np.int32, count=len(words)))
                held += len(words) + 1
                if held >= block_words:
                    yield block_row(first, ids, sizes, codes, terms)
                    first, ids, sizes, codes, held = None, [], [], [], 0
                    terms.clear()
        if ids:
            yield block_row(first, ids, sizes, codes, terms)

    rows = docs.select(F.monotonically_increasing_id(), col(key).cast("long"), col(text))
    return rows.mapInArrow(run, INDEX)


def store_index(index: DataFrame) -> DataFrame:
    """Write an index to the shared folder; its rows are large, so sizes are looked at after every row."""
    path = shared_dir(index.sparkSession)
    checks = {f"parquet.{part}.size.row.check.min": 1 for part in ("page", "block")}
    index.write.options(**checks).parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """phrase, item: every run of ``size`` words of an item, or all words of a shorter one."""
    words = items.select(col(key).cast("string").alias("item"), word_array(col(text)).alias("words"))
    last = F.greatest(F.size("words") - size, F.lit(0))
    starts = words.where(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    phrase = F.array_join(F.slice("words", F.col("at") + 1, F.lit(size)), " ")
    return starts.select(phrase.alias("phrase"), F.coalesce("item", F.lit("")).alias("item")).distinct()


def _numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4").astype(np.int64)


def _common(some: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Numbers in both ascending lists; the shorter is looked up in the longer."""
    if len(some) > len(other):
        some, other = other, some
    if not len(some):
        return some
    spot = np.searchsorted(other, some)
    spot[spot == len(other)] = 0
    return some[other[spot] == some]


def chunks(phrases: DataFrame, most: int = CHUNK_BYTES) -> Iterator[list[list[str]]]:
    """The distinct ``phrases`` (phrase) as lists of words, some ``most`` bytes at a time."""
    distinct = stage(phrases.select("phrase").distinct())
    total = distinct.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = -(-total // most)
    for k in range(parts):
        mine = distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        yield [row.phrase.split(" ") for row in mine.collect()]


def count_terms(index: DataFrame, terms: set[str]) -> dict[str, int]:
    """How often each of ``terms`` occurs in all documents."""
    sent = index.sparkSession.sparkContext.broadcast({t.encode() for t in terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for names, counts in zip(batch.column(0), batch.column(1)):
                numbers = np.frombuffer(counts.as_py(), dtype="<u4")
                for k, term in enumerate(names.as_py().split(b"\n")):
                    if term in sent.value:
                        found[term.decode()] += int(numbers[k])
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {row.term: row.n for row in counted.collect()}  # at most the terms of a chunk


def ranked(phrases: list[list[str]], counts: dict[str, int]) -> list[list[tuple[bytes, int]]]:
    """(term, offset) from the rarest on, for every phrase whose terms all occur."""
    return [
        [(words[k].encode(), k) for k in sorted(range(len(words)), key=lambda k: (counts[words[k]], k))]
        for words in phrases
        if all(w in counts for w in words)
    ]


class Block:
    """The places of the ``wanted`` terms in one row of the index, unpacked when asked for."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes, wanted: set[bytes]) -> None:
        self.ends = np.r_[0, np.cumsum(np.frombuffer(counts, dtype="<u4"), dtype=np.int64)]
        self.places = np.frombuffer(places, dtype="<u4")
        self.at = {t: k for k, t in enumerate(terms.split(b"\n")) if t in wanted}
        self.held: dict[bytes, np.ndarray] = {}

    def __getitem__(self, term: bytes) -> np.ndarray:
        if term not in self.held:
            k = self.at[term]
            self.held[term] = self.places[self.ends[k] : self.ends[k + 1]].astype(np.int64)
        return self.held[term]

    def starts(self, phrase: list[tuple[bytes, int]]) -> np.ndarray | None:
        """Where the phrase begins: lists less their offsets, intersected from the rarest term on."""
        if any(term not in self.at for term, _ in phrase):
            return None
        term, offset = phrase[0]
        left = self[term] - offset
        left = left[left >= 0]
        for term, offset in phrase[1:]:
            if not len(left):
                return None
            left = _common(left, self[term] - offset)
        return left if len(left) else None


MATCH = "phrase string, size int, block long, starts binary"


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase, size, block, starts: where the words of ``phrases`` (phrase) stand in a row."""

    def matches(chunk: list[list[str]]) -> DataFrame:
        known = ranked(chunk, count_terms(index, {w for words in chunk for w in words}))
        sent = index.sparkSession.sparkContext.broadcast((known, {t for p in known for t, _ in p}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases, wanted = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    first, terms, counts, places = (c[row].as_py() for c in batch.columns)
                    block, out = Block(terms, counts, places, wanted), []
                    for phrase in phrases:
                        starts = block.starts(phrase)
                        if starts is not None:
                            words = b" ".join(t for t, _ in sorted(phrase, key=lambda x: x[1])).decode()
                            out.append((words, len(phrase), first, starts.astype("<u4").tobytes()))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                    columns = list(zip(*out)) or [[]] * len(kinds)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["phrase", "size", "block", "starts"])

        return stage(index.select("block", "terms", "counts", "places").mapInArrow(run, MATCH))

    return _union([matches(chunk) for chunk in chunks(phrases)], index.sparkSession, MATCH)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    whole = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def doc_places(sizes: list[int]) -> np.ndarray:
    """First places of a block's documents."""
    return np.cumsum([0] + [n + 1 for n in sizes[:-1]])


def covering_spans(lists: dict, width: int) -> list[tuple[int, int]]:
    """Least spans (first, last) of at most ``width`` places that hold ``lists``: term -> (places, times)."""
    merged = sorted((int(p), t) for t, (places, _) in lists.items() for p in places)
    missing, held, left, spans = sum(n for _, n in lists.values()), Counter(), 0, []
    for last, term in merged:
        held[term] += 1
        missing -= held[term] <= lists[term][1]
        while missing <= 0:
            first, gone = merged[left]
            if held[gone] <= lists[gone][1]:  # the span ends to be whole without this one
                if last - first < width and not (spans and spans[-1][0] >= first):
                    spans.append((first, last))
                missing += 1
            held[gone] -= 1
            left += 1
    return spans


NEAR = "phrase string, doc_id long, first long, last long"


def near_matches(index: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """phrase, doc_id, first, last: least spans of a document (words from 0) that hold all words of a phrase.

    Words may come in any order, with at most ``slop`` others between them.
    """

    def matches(chunk: list[list[str]]) -> DataFrame:
        known = ranked(chunk, count_terms(index, {w for words in chunk for w in words}))
        sent = index.sparkSession.sparkContext.broadcast((known, {t for p in known for t, _ in p}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases, wanted = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    terms, counts, places, ids, sizes = (c[row].as_py() for c in batch.columns)
                    block, firsts, out = Block(terms, counts, places, wanted), doc_places(sizes), []
                    for phrase in phrases:
                        if any(t not in block.at for t, _ in phrase):
                            continue
                        words = b" ".join(t for t, _ in sorted(phrase, key=lambda x: x[1])).decode()
                        width, times = len(phrase) + slop, Counter(t for t, _ in phrase)
                        around = block[phrase[0][0]]  # the rarest term
                        lists = {t: (_near(block[t], around, width), n) for t, n in times.items()}
                        for first, last in covering_spans(lists, width):
                            doc = int(np.searchsorted(firsts, first, side="right")) - 1
                            if last < firsts[doc] + sizes[doc]:
                                out.append((words, ids[doc], first - int(firsts[doc]), last - int(firsts[doc])))
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                    columns = list(zip(*out)) or [[]] * len(kinds)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["phrase", "doc_id", "first", "last"])

        return stage(index.select("terms", "counts", "places", "doc_ids", "sizes").mapInArrow(run, NEAR))

    return _union([matches(chunk) for chunk in chunks(phrases)], index.sparkSession, NEAR)


def _near(places: np.ndarray, around: np.ndarray, width: int) -> np.ndarray:
    """The places less than ``width`` from some place of ``around``, both ascending."""
    after = np.searchsorted(around, places - width, side="right")
    before = np.searchsorted(around, places + width, side="left")
    return places[before > after]


def hits_by_document(index: DataFrame, matches: DataFrame) -> DataFrame:
    """block, at, doc_id, n_words, n_hit, phrases for every indexed document.

    ``at`` numbers a block's documents; ``n_hit`` counts words inside any match.
    """
    schema = "block long, at int, doc_id long, n_words long, n_hit long, phrases array<string>"

    def run(found: pa.Table, docs: pa.Table) -> pa.Table:
        sizes = np.array(docs.column("sizes")[0].as_py(), dtype=np.int64)
        ids, firsts = docs.column("doc_ids")[0].as_py(), doc_places(sizes.tolist())
        edges = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int32)
        phrases: list[list[str]] = [[] for _ in ids]
        columns = [found.column(c).to_pylist() for c in ("phrase", "size", "starts")]
        for phrase, size, starts in zip(*columns):
            at = _numbers(starts)
            edges[at] += 1  # starts of one phrase differ
            edges[at + size] -= 1
            for doc in np.unique(np.searchsorted(firsts, at, side="right") - 1):
                phrases[doc].append(phrase)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges) > 0)])
        n_hit = hit[firsts + sizes] - hit[firsts]
        data = [
            [docs.column("doc_block")[0].as_py()] * len(ids), range(len(ids)), ids, sizes, n_hit, phrases,
        ]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        names = ["block", "at", "doc_id", "n_words", "n_hit", "phrases"]
        return pa.table([pa.array(d, k) for d, k in zip(data, kinds)], names)

    docs = index.select(F.col("block").alias("doc_block"), "doc_ids", "sizes")
    grouped = matches.select("block", "phrase", "size", "starts").groupBy("block")
    return grouped.cogroup(docs.groupBy("doc_block")).applyInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, and the items of which a window of ``size`` words occurs in it."""
    index = store_index(build_index(docs, key, text))
    phrases = stage(windows(items, size=size))
    found = phrase_matches(index, phrases)
    by_doc = stage(hits_by_document(index, found))
    named = by_doc.where("n_hit > 0").select("block", "at", F.explode("phrases").alias("phrase")).join(phrases, "phrase")
    listed = named.groupBy("block", "at").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return by_doc.join(listed, ["block", "at"], "left").select(
        F.col("doc_id").alias(key),
        "n_words",
        "n_hit",
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        items_.alias("items"),
    )
