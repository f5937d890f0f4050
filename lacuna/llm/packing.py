"""Order-preserving packing of documents into token sequences by dynamic programming over cut points.

The tokens of a task's documents form one stream in the order of the rows.  Cut points are the ends of documents and of
sentences, and places inside very long sentences.  The least cost of ending a sequence at cut point j is

    f(j) = penalty(j) + min over i, with at most ``length`` tokens between, of f(i) + padding(i, j)

and as the padding is ``length - (position(j) - position(i))``, the minimum is that of f(i) + position(i) over a sliding
window, which a monotone queue gives in constant time per cut point.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import ship_by_value, worker_state

ship_by_value(__name__)

LENGTH = 4096
#: What a cut costs, in tokens of padding: after a sentence, and inside one.
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 64
#: Inside a sentence there is a cut point every so many tokens.
STRIDE = 256
#: The stream is cut block by block; the last, still open sequence of a block starts the next.
BLOCK_TOKENS = 1 << 20
#: A worker remembers the ids of so many distinct chunks, and forgets them all beyond.
REMEMBERED = 600_000
LONG_CHUNK = 64
#: A letter and the punctuation that ends its word; a blank between them changes no token.
LETTER_TAIL = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])"
#: Texts are encoded so many bytes at a time.
ENCODE_BYTES = 8_000_000
#: Texts that tell whether a tokenizer works chunk by chunk.
PROBE = ["The quick brown fox, isn't it?  Yes!", " leading", "two  blanks\nand\tothers ", "ÉCOLE naïve Straße", "a.b@c.org 3.14 x_y don't", "漢字かな", "(one) [two] {three}", "UPPER lower", "", "end."]
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class ChunkEncoder:
    """Token ids of texts, computed chunk by chunk between white space and remembered.

    Valid for tokenizers that drop white space, close every word with a piece in ``</w>`` and never put letters and
    punctuation in one word.  A few texts are encoded both ways at the start; if any differs, whole texts are encoded.  A chunk of letters with ASCII punctuation behind it is looked up as two.  ASCII texts are
    lower-cased first, as these tokenizers do themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.sentence_ends = self.closes.copy()
        for piece, i in self.tokenizer.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
            self.sentence_ends[i] = self.closes[i] and piece[:-4].endswith((".", "!", "?"))
        self.known: dict[bytes, bytes] = {}
        self.whole = False
        want = [e.ids for e in self.tokenizer.encode_batch_fast(PROBE, add_special_tokens=False)]
        try:
            tokens, counts = self.encode(pa.array(PROBE))
            self.whole = [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])] != want
        except (KeyError, ValueError, IndexError):
            self.whole = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, chunks: list[bytes]) -> None:
        """Words of letters alone go through the tokenizer many at a time, split again where a piece closes a word."""
        width = np.dtype(self.dtype).itemsize
        letters = pc.utf8_is_alpha(pa.array(chunks, pa.binary()).cast(pa.string(), safe=False)).to_pylist()
        words = [c for c, pure in zip(chunks, letters) if pure and len(c) <= LONG_CHUNK]
        others = [c for c, pure in zip(chunks, letters) if not pure or len(c) > LONG_CHUNK]
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for group, raw in zip(groups, self._ids([b" ".join(g).decode() for g in groups])):
            at = [0, *((np.flatnonzero(self.closes[np.frombuffer(raw, self.dtype)]) + 1) * width).tolist()]
            if len(at) == len(group) + 1:
                self.known.update(zip(group, map(raw.__getitem__, map(slice, at, at[1:]))))
            else:  # lower-casing made something else of a letter
                others += group
        self.known.update(zip(others, self._ids([c.decode("utf-8", "replace") for c in others])))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if self.whole:
            found = [np.frombuffer(x, self.dtype) for x in self._ids(texts.to_pylist())]
            return np.concatenate([np.zeros(0, self.dtype), *found]), np.array([len(x) for x in found], np.int64)
        plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_TAIL, r"\1 \2"))
        coded = parts.flatten().cast(pa.binary()).dictionary_encode()
        chunks, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = [c for c, ids in zip(chunks, map(self.known.get, chunks)) if ids is None]
        if missing:
            self._learn(missing)
        ids = [self.known[c] for c in chunks]
        for c in missing:
            if len(c) > LONG_CHUNK:
                del self.known[c]
        pool = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.dtype).itemsize
        first = np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        tokens = pool[np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1])]
        return tokens, np.diff(ends[parts.offsets.to_numpy()])


def cut_points(tokens: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 first, the stream's end last) and the penalty of cutting there.

    ``doc_ends`` are the stream positions just after the documents' last tokens.
    """
    sentence = np.flatnonzero(ends_sentence[tokens]) + 1
    outer = np.unique(np.concatenate([[0, len(tokens)], doc_ends, sentence]))
    gaps = np.diff(outer)
    wide = np.flatnonzero(gaps > stride)
    inner = [np.arange(outer[i] + stride, outer[i + 1], stride) for i in wide]
    points = np.union1d(outer, np.concatenate(inner)) if inner else outer
    penalty = np.full(len(points), INSIDE_PENALTY, np.int64)
    penalty[np.isin(points, sentence)] = SENTENCE_PENALTY
    penalty[np.isin(points, doc_ends)] = 0
    penalty[[0, -1]] = 0
    return points, penalty


def best_cuts(points: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Positions of the cheapest cuts, the first and last point included; no gap of ``points`` exceeds ``length``."""
    at, cost = points.tolist(), penalty.tolist()
    base = [0] * len(at)  # f(i) + position(i)
    back = [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        value = base[j] = base[i] + length + cost[j]  # f(j) + here, as f(j) = base(i) + length - here + cost(j)
        while queue and base[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [at[-1]], len(at) - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def without_padding(start: int, stop: int, length: int) -> list[int]:
    """Cuts that split a last, short sequence into powers of two, which need no padding, if that costs less."""
    rest, cuts = stop - start, [start]
    powers = [1 << p for p in range(rest.bit_length() - 1, -1, -1) if rest >> p & 1]
    if len(powers) > 1 and (len(powers) - 1) * INSIDE_PENALTY < length - rest:
        for p in powers[:-1]:
            cuts.append(cuts[-1] + p)
    return cuts


class Stream:
    """The documents of one task, fed in order; gives the columns of the pieces block by block."""

    def __init__(self, first_id: int, ends_sentence: np.ndarray, length: int, block: int):
        self.next_id, self.ends, self.length, self.block = first_id, ends_sentence, length, block
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # document, ids before, tokens in all, ids
        self.size = 0

    def feed(self, doc: object, ids: np.ndarray):
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.parts.append((doc, at, len(ids), part))
            self.size += len(part)
            if self.size >= self.block:
                yield self.cut(last=False)

    def cut(self, last: bool) -> list:
        """Columns of the block's pieces; but for the last block, the sequence at the end stays open."""
        tokens = np.concatenate([p[3] for p in self.parts]).astype(np.uint32)
        bounds = np.cumsum([0] + [len(p[3]) for p in self.parts])
        closes = np.array([at + len(part) == total for _, at, total, part in self.parts])
        cuts = best_cuts(*cut_points(tokens, bounds[1:][closes], self.ends, min(STRIDE, self.length)), self.length)
        if last:
            cuts = cuts[:-2] + without_padding(cuts[-2], cuts[-1], self.length) + cuts[-1:]
        else:
            cuts.pop()
        cuts = np.array(cuts)
        stop = cuts[-1]
        starts = np.unique(np.concatenate([cuts[:-1], bounds[:-1][bounds[:-1] < stop]]))
        stops = np.append(starts[1:], stop)
        part = np.searchsorted(bounds, starts, "right") - 1
        sequence = np.searchsorted(cuts, starts, "right") - 1
        raw = tokens.astype("<u4")
        columns = [
            [self.parts[k][0] for k in part.tolist()],
            starts - bounds[part] + np.array([p[1] for p in self.parts])[part],
            stops - starts,
            pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((4 * np.append(starts, stop)).astype(np.int32)), pa.py_buffer(raw[:stop])]),
            np.array([p[2] for p in self.parts])[part],
            self.next_id + sequence,
            starts - cuts[sequence],
        ]
        self.next_id += len(cuts) - 1
        self.parts = [(d, at + max(0, stop - b), n, ids[max(0, stop - b) :]) for (d, at, n, ids), b in zip(self.parts, bounds.tolist()) if b + len(ids) > stop]
        self.size = int(bounds[-1] - stop)
        return columns


def pack(docs: DataFrame, tokenizer: str, end_id: int, id: str = "doc_id", text: str = "text", length: int = LENGTH, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: ``id``, ``start``, ``length``, ``ids``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``ids`` are the piece's token ids, 4 bytes each, the least first; the pieces of a sequence in the order of ``offset``
    are its ids.  ``length`` and ``ids_crc32`` are those of ``ids``.
    A document is its text's ids, without special ones, then ``end_id``; a null or empty text is ``end_id`` alone.  Every
    id lies in one piece.  The pieces of a sequence are consecutive, in the order of the rows, and its offsets gapless
    from 0.  Rows with repeated or null ids are packed each for itself; an empty table gives no pieces.  ``sequence_id``
    is unique: the input partition and a count.  ``tokenizer`` is the path of a file on every worker, or the name of a
    file of the installed ``public_tokenizers``.

    Nothing is shuffled.  Memory is bounded by the Arrow batch, the block and the longest text.
    """
    kept = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(batches):
        import os

        if os.path.isabs(tokenizer):
            path = tokenizer
        else:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_state().setdefault(("encoder", path), None) or ChunkEncoder(path)
        worker_state()["encoder", path] = encoder
        stream = Stream(TaskContext.get().partitionId() << 40, encoder.sentence_ends, length, block)

        def rows(columns):
            docs, start, length, ids, *numbers = columns
            arrays = [pa.array(docs, names.field(0).type), pa.array(start), pa.array(length), ids]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(np.asarray(c, np.int64)) for c in numbers]], schema=names)

        names = None
        for batch in batches:
            if names is None:
                names = pa.schema([("id", batch.schema.field(0).type), *[(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECES.split(", ")]])
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            size = np.cumsum(pc.binary_length(texts).to_numpy()) // ENCODE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                tokens, counts = encoder.encode(pa.concat_arrays([texts.slice(a, b - a)]))
                for doc, own in zip(ids[a:b], np.split(tokens, np.cumsum(counts)[:-1])):
                    for columns in stream.feed(doc, np.append(own, own.dtype.type(end_id))):
                        yield rows(columns)
        if stream.size:
            yield rows(stream.cut(last=True))

    pieces = kept.mapInArrow(run, f"id {id_type}, {PIECES}")
    return pieces.select(F.col("id").alias(id), "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
