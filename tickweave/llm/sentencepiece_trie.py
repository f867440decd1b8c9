"""SentencePiece encoding and decoding by a forward search with shared prefixes.

A text is marked (one mark in front, one for every space) and cut where no piece can
cross. The distinct marked words of a block are sorted, which lays them out as a trie
in depth-first order: the forward states of the prefix that a word shares with the one
before it are kept, and only the rest is computed.

What a forward state holds depends on the model file. For a unigram model it is the
greatest sum of piece scores up to a position (Viterbi); of equal sums, the one with the
longest last piece wins. The scores of a BPE model are merge ranks, and the greatest sum
is not what its merges give. There the state is the last piece of the merges' result for
the prefix, which exists once per position: the piece before it and the piece itself,
merged on their own, must stay as they are. Either way, ids equal those of the library.

A character without a piece becomes its UTF-8 bytes. Decoding joins the bytes of the
pieces, so ``decode(encode(t)) == t`` for every text.

The model file is read on the driver and sent to the tasks, so executors need no copy.
No tokenizer is trained.

Defined results: a null text has null ids and decodes to null; an empty text has no ids.
A mark character in the text itself is written as bytes, so that it comes back (the
library would turn it into a space). Words of any length are searched whole, at a cost in
proportion to their length. Repeated rows and further columns are kept as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark character of the text itself; half a surrogate, so no text has it.
OWN_MARK = "\udc81"
_UNITS = re.compile(f"{MARK}*[^{MARK}\\x00-\\x1f{OWN_MARK}]+|{MARK}+|[\\x00-\\x1f]|{OWN_MARK}+")
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")
#: Score of a character written as bytes, below that of every piece.
BYTES_PENALTY = -2e9


@dataclass(frozen=True)
class Pieces:
    """The searchable pieces with ids and scores, the byte pieces, and the bytes of every id."""

    scored: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]
    merges: bool
    name: str

    def trie(self) -> dict:
        """Nested dicts by character; the key "" holds (id, score)."""
        root: dict = {}
        for piece, found in self.scored.items():
            node = root
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = found
        return root


def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored, byte_ids, surface = {}, [0] * 256, []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[1:-1], 16)] = k
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            surface.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {k} has a mark inside, words cannot be cut there")
            scored[piece] = (k, model.get_score(k))
            surface.append(piece.replace(MARK, " ").encode())
    # BPE models number their pieces by rank: scores 0, -1, -2, ... in the order of ids.
    worth = [score for _, score in scored.values() if score > -1e8]
    merges = all(x == int(x) for x in worth) and worth == sorted(worth, reverse=True)
    return Pieces(scored, tuple(byte_ids), tuple(surface), merges, path)


def as_bytes(ch: str, byte_ids: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(byte_ids[b] for b in (MARK if ch == OWN_MARK else ch).encode())


class Merges:
    """Whether two pieces stay apart under the merges of a BPE model; answers are kept."""

    def __init__(self, scored: dict[str, tuple[int, float]], most_answers: int = 200_000) -> None:
        self.scored, self.most = scored, most_answers
        #: Every ending of every piece: a walk leftwards stops where no piece goes on.
        self.tails = {p[k:] for p in scored for k in range(len(p))}
        self.answers: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the best neighbours, the leftmost of equals first, until none merge."""
        parts = list(text)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                found = self.scored.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, first: str, second: str) -> bool:
        if len(self.answers) >= self.most:
            self.answers.clear()
        answer = self.merged(first + second) == [p for p in (first, second) if p]
        self.answers[first, second] = answer
        return answer


def _shared(word: str, before: str) -> int:
    """Length of the common prefix."""
    same = 0
    for a, b in zip(word, before):
        if a != b:
            break
        same += 1
    return same


def encode_sorted(words: Iterable[str], pieces: Pieces, merges: Merges | None = None) -> Iterator[tuple[int, ...]]:
    """Ids of each word; ``words`` must be sorted."""
    ends = _last_merged(words, pieces, merges) if merges else _last_best(words, pieces)
    scored = pieces.scored
    for word, last in ends:
        ids, at = [], len(word)
        while at:
            start, piece = last[at]
            if piece:
                ids.append(scored[piece][0])
            else:
                ids += as_bytes(word[start:at], pieces.byte_ids)[::-1]
            at = start
        ids.reverse()
        yield tuple(ids)


def _last_best(words: Iterable[str], pieces: Pieces) -> Iterator[tuple[str, list]]:
    """Unigram models: start and text of the last piece of the best path to each position.

    Kept per position: the best sum, that piece ("" for bytes), and the trie nodes of the
    pieces under way.
    """
    root, before = pieces.trie(), ""
    best, last, under_way = [0.0], [(0, "")], [[]]
    for word in words:
        same = _shared(word, before)
        del best[same + 1 :], last[same + 1 :], under_way[same + 1 :]
        for end in range(same, len(word)):
            ch = word[end]
            score, how, going = None, (end, ""), []
            for start, node in (*under_way[end], (end, root)):
                if (node := node.get(ch)) is None:
                    continue
                going.append((start, node))
                found = node.get("")
                if found is not None and (score is None or best[start] + found[1] > score):
                    score, how = best[start] + found[1], (start, word[start : end + 1])
            if "" not in root.get(ch, ()) and (score is None or best[end] + BYTES_PENALTY > score):
                score, how = best[end] + BYTES_PENALTY, (end, "")
            best.append(score)
            last.append(how)
            under_way.append(going)
        before = word
        yield word, last


def _last_merged(words: Iterable[str], pieces: Pieces, merges: Merges) -> Iterator[tuple[str, list]]:
    """BPE models: start and text of the last piece of the merges' result for each prefix.

    Only prefixes that an answer needs are filled in; for words longer than 100
    characters all are, from left to right, so that the search never goes deep. The
    text is empty where nothing can merge: at the start and after bytes.
    """
    scored, apart, before = pieces.scored, merges.apart, ""
    answers, tails = merges.answers, merges.tails
    last: list[tuple[int, str] | None] = [(0, "")]

    def fill(word: str, end: int) -> None:
        starts, start = [], end - 1
        while start >= 0 and (tail := word[start:end]) in tails:
            if tail in scored:
                starts.append((start, tail))
            start -= 1
        for start, piece in reversed(starts):
            if last[start] is None:
                fill(word, start)
            first = last[start][1]
            answer = answers.get((first, piece))
            if answer or (answer is None and apart(first, piece)):
                last[end] = (start, piece)
                return
        if last[end - 1] is None:
            fill(word, end - 1)
        last[end] = (end - 1, "")

    for word in words:
        same = _shared(word, before)
        last[same + 1 :] = [None] * (len(word) - same)
        for end in range(same + 1, len(word) + 1) if len(word) > 100 else (len(word),):
            if last[end] is None:
                fill(word, end)
        before = word
        yield word, last


def marked_words(text: str) -> list[str]:
    """The marked words of a text, in order: each starts at the first of a run of marks."""
    if not text:
        return []
    text = text.replace(MARK, OWN_MARK) if MARK in text else text
    if "  " in text or text[0] == " ":
        return _RUNS.findall(MARK + text.replace(" ", MARK))
    words = text.split(" ")
    return [MARK + w for w in words]


class Encoder:
    """Encodes blocks of texts; keeps the ids of at most ``most_words`` words between blocks."""

    def __init__(self, pieces: Pieces, most_words: int = 300_000) -> None:
        self.pieces, self.most = pieces, most_words
        self.merges = Merges(pieces.scored) if pieces.merges else None
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The ids of each text as packed 32-bit numbers."""
        words = [None if t is None else marked_words(t) for t in texts]
        distinct = set(chain.from_iterable(w for w in words if w))
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > self.most:  # words of this block are likely to come again
            self.known = {w: self.known[w] for w in distinct.difference(new)}
        cut = {w: _UNITS.findall(w) for w in new if not w.isprintable()}
        order = sorted(new.difference(cut).union(*cut.values()))
        ids = {u: array("i", found).tobytes() for u, found in zip(order, encode_sorted(order, self.pieces, self.merges))}
        self.known.update((w, b"".join([ids[u] for u in us])) for w, us in cut.items())
        self.known.update((w, ids[w]) for w in new.difference(cut))
        find = self.known.__getitem__
        return [None if w is None else b"".join(map(find, w)) for w in words]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(pieces: Pieces) -> Encoder:
    """One encoder per Python worker, so that tasks after the first find known words."""
    if pieces.name not in _ENCODERS:
        _ENCODERS[pieces.name] = Encoder(pieces)
    return _ENCODERS[pieces.name]


def decode_ids(ids, surface: tuple[bytes, ...]) -> str:
    """The text of ids; the space of the first mark is dropped."""
    text = b"".join(map(surface.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _blocks(column: pa.Array, most_chars: int = 2_000_000) -> Iterator[list[str | None]]:
    block, held = [], 0
    for k in range(len(column)):
        text = column[k].as_py()
        block.append(text)
        held += len(text or "")
        if held > most_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _list_array(rows: list[bytes | None]) -> pa.Array:
    sizes = np.array([0] + [len(r or b"") // 4 for r in rows], dtype=np.int32)
    flat = np.frombuffer(b"".join(r for r in rows if r), dtype=np.int32)
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat), mask=missing)


def _appended(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*df.schema.fields, StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids (array of int) of ``text`` in the column ``out``, in place of one so named."""
    docs = without(docs, out)
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model))  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value)
        for batch in batches:
            done = 0
            for block in _blocks(batch.column(at)):
                part = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _list_array(encoder.encode(block))], [*batch.schema.names, out]
                )

    return docs.mapInArrow(run, _appended(docs, out, ArrayType(IntegerType())))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of ``ids`` in the column ``out``, in place of one so named."""
    rows = without(rows, out)
    at = rows.columns.index(ids)
    sent = rows.sparkSession.sparkContext.broadcast(load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = sent.value.surface
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                column = part.column(at)
                ends = column.offsets.to_numpy()
                flat, valid = column.values.to_numpy(zero_copy_only=False), column.is_valid().to_pylist()
                texts = [
                    decode_ids(flat[a:b].tolist(), surface) if there else None
                    for a, b, there in zip(ends, ends[1:], valid)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, out]
                )

    return rows.mapInArrow(run, _appended(rows, out, StringType()))
