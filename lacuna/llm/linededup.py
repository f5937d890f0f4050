"""Removal of repeated passages by content-defined chunks of lines.

A text is cut into logical lines: at line breaks, after sentences, and inside a long sentence after words that a hash of
the word and the one before picks, so that the lines of a passage are the same wherever it stands.  A rolling hash over the
hashes of two neighbouring lines picks the boundaries: those places where it is no greater than at a neighbouring place.
So one of two neighbouring places is a boundary, and any passage of five lines holds two, whatever stands around it.  A chunk
reaches from one boundary to the next, the lines that the rolling hash saw at both included, so it has three or four lines.

Chunks whose hash occurs more than once in the corpus are compared by their bytes.  Every occurrence but the first is a seed.
It grows to a side by the line there if the first occurrence has the same; as boundaries lie that close, this reaches the
ends of the passage.  Overlapping seeds join, and a run that is long enough goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lacuna.llm.common import hash_filter, materialise, ship_by_value

ship_by_value(__name__)

#: A run of repeated lines is removed if it has so many words and lines at least.
MIN_WORDS = 30
MIN_LINES = 2
#: A sentence of more words is wrapped: after one in so many words by their hash, and where that picks none, after so many.
LONG_SENTENCE = 16
WRAP = 6
LONGEST = 32
#: Texts are cut so many bytes at a time.
SLICE_BYTES = 1_000_000
#: A chunk with more occurrences, and more than one in so many of all, is hot.
HOT_ROWS = 50_000
HOT_SHARE = 1_000_000
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WEIGHT = np.random.default_rng(4).integers(1, 1 << 20, 256).astype(np.uint64)
STOP = np.isin(np.arange(256), list(b".!?"))
#: Factors of the rolling hashes, odd so that they have inverses.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def line_table(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with a word: where it starts, where its last word ends, its words.  A line break ends every line."""
    code = np.frombuffer(raw, np.uint8)
    blank = SPACE[code]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return first, last, first
    row = np.searchsorted(np.flatnonzero(code == 10), first)
    new = np.ones(len(first), bool)
    new[1:] = (row[1:] != row[:-1]) | STOP[code[last[:-1] - 1]]
    place = np.arange(len(first))
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(first))) > LONG_SENTENCE
    if many.any():
        between = np.stack([first, last], axis=1).ravel()
        between = between[:-1] if between[-1] == len(code) else between
        word = np.add.reduceat(WEIGHT[code], between)[::2] * np.uint64(31) + code[first] * np.uint64(7) + code[last - 1]
        word = (word[1:] + word[:-1] * np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)
        picked = (word >> np.uint64(40)) % np.uint64(WRAP) == 0
        picked &= ~new[1:]  # the two words are of one sentence
        long = np.repeat(many, np.diff(np.append(start, len(first))))
        new[2:] |= picked[:-1] & long[2:]
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % LONGEST == 0
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:], len(first)) - 1], np.diff(np.append(at, len(first)))


def chunks(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, stop, lines, words) of every line; the bytes between are white space."""
    start, stop, words = line_table(text)
    return list(zip(start.tolist(), stop.tolist(), [1] * len(start), words.tolist()))


class Lines:
    """The lines of several texts, their hashes, and the chunks that they make."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.start, self.stop, self.words = line_table(self.raw)
        self.owner = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))  # each text's first line
        cut = list(map(self.raw.__getitem__, map(slice, self.start.tolist(), self.stop.tolist())))
        self.own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, cut)), np.uint64).reshape(-1, 2)
        self.cut = cut

    def _rolled(self, a: np.ndarray, b: np.ndarray, half: int) -> np.ndarray:
        """Hashes of the lines a to b, both included: of powers of a factor times the lines' hashes, shifted to a."""
        factor = FACTORS[half]
        power = np.cumprod(np.full(len(self.own), factor, np.uint64))
        undo = np.cumprod(np.full(len(self.own), pow(factor, -1, 1 << 64), np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.own[:, half] * power, dtype=np.uint64)])
        x = (total[b + 1] - total[a]) * undo[a]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))

    def boundaries(self) -> np.ndarray:
        """Lines at which a chunk starts: where the rolling hash of the line and the next is not above both neighbours."""
        n = len(self.start)
        if n < 3:
            return np.zeros(0, np.int64)
        at = np.arange(n - 1)
        value = self._rolled(at, at + 1, 0)
        inside = self.owner[1:] == self.owner[:-1]
        near = inside[1:] & inside[:-1]  # two neighbouring places in one text
        low = value[:-1] <= value[1:]
        picked = np.zeros(n - 1, bool)
        picked[:-1] |= near & low
        picked[1:] |= near & (value[1:] <= value[:-1])
        return np.flatnonzero(picked)

    def chunk_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last line of every chunk.  Before the first boundary of a text and behind its last there is one more."""
        at = self.boundaries()
        same = self.owner[at[1:]] == self.owner[at[:-1]] if len(at) else np.zeros(0, bool)
        a, b = at[:-1][same], at[1:][same] + 1
        some = np.flatnonzero(np.diff(self.first) >= 2)
        head, tail = self.first[some], self.first[some + 1] - 1
        low = np.searchsorted(at, head)
        high = np.searchsorted(at, tail) - 1
        has = high >= low
        bound = np.append(at, 0)
        before, behind = has & (bound[low] > head), has & (bound[high] + 1 < tail)
        a = np.concatenate([a, head[before], bound[high][behind], head[~has]])
        b = np.concatenate([b, bound[low][before] + 1, tail[behind], tail[~has]])
        return a, b

    def near(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """31 bits of the hash of the lines ``at``, or -1 where the text of the lines ``own`` has no such line."""
        inside = (at >= 0) & (at < len(self.owner))
        at = np.where(inside, at, 0)
        return np.where(inside & (self.owner[at] == self.owner[own]), (self.own[at, 1] >> np.uint64(33)).astype(np.int64), -1).astype(np.int32)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of every chunk."""
        return self._rolled(a, b, 0).view(np.int64), (self._rolled(a, b, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def contents(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The bytes of the lines a to b of each chunk; the white space between is left out, as it is of the hash."""
        plain = b"\n".join(self.cut)
        size = self.stop - self.start
        at = np.cumsum(size + 1) - size - 1
        return list(map(plain.__getitem__, map(slice, at[a].tolist(), (at[b] + size[b]).tolist())))


def removed_spans(parts: list[tuple[int, int, int, int]], repeated: set[int], size: int, min_words: int, min_lines: int) -> list[tuple[int, int]]:
    """Byte spans that go: runs of repeated lines that are long enough, up to the next line or the end of the text."""
    out, k = [], 0
    while k < len(parts):
        to = k
        while to < len(parts) and to in repeated:
            to += 1
        if to > k and sum(p[3] for p in parts[k:to]) >= min_words and sum(p[2] for p in parts[k:to]) >= min_lines:
            out.append((parts[k][0], parts[to][0] if to < len(parts) else size))
        k = max(to, k + 1)
    return out


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of some ``SLICE_BYTES`` of text, or one row, and their texts."""
    if not batch.num_rows:
        return
    group = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]


def _hash_counts(docs: DataFrame) -> DataFrame:
    """(h1, n): the leading halves of the chunks' hashes, equal ones of a slice counted together."""

    def run(batches):
        for batch in batches:
            for _, texts in _slices(batch, 2):
                lines = Lines(texts)
                own, n = np.unique(lines.hashes(*lines.chunk_lines())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["h1", "n"])

    return docs.mapInArrow(run, "h1 long, n long")


def _occurrences(docs: DataFrame, repeated) -> DataFrame:
    """(id, mark, h1, h2, a, b, pre, post, content) of the chunks that the filter lets through; mark tells texts with one id apart.

    Each content of a slice stands in one of its rows, the others have none.
    """
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in _slices(batch, 2):
                lines = Lines(texts)
                a, b = lines.chunk_lines()
                h1, h2 = lines.hashes(a, b)
                keep = repeated.value(h1)
                a, b, h1, h2 = a[keep], b[keep], h1[keep], h2[keep]
                owner = lines.owner[a]
                first = lines.first[owner]
                at = pa.array(owner)
                numbers = [h1, h2, (a - first).astype(np.int32), (b - first).astype(np.int32), lines.near(a - 1, a), lines.near(b + 1, b)]
                contents = lines.contents(a, b)
                found = {key: k for k, key in enumerate(zip(h1.tolist(), h2.tolist(), contents))}
                told = np.ones(len(a), bool)
                told[list(found.values())] = False
                content = pa.array(contents, pa.binary(), mask=told)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *map(pa.array, numbers), content], names=["id", "mark", "h1", "h2", "a", "b", "pre", "post", "content"])

    return docs.mapInArrow(run, f"id {id_type}, mark long, h1 long, h2 int, a int, b int, pre int, post int, content binary")


def _later(rows: DataFrame, many: DataFrame) -> DataFrame:
    """(id, mark, h1, h2, a, b) of every occurrence but the first, grown by the line before and behind that the first has too.

    Hot chunks, of which there are few, meet their first occurrence by broadcast; all others in the task of their hash.
    """
    where = ["id", "mark", "a"]
    hashes = ["h1", "h2"]
    limit = max(HOT_ROWS, (many.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = many.where(F.col("n") > limit).select("h1")
    order = Window.partitionBy(*hashes).orderBy(*where)
    ends = F.struct("pre", "post")
    if hot.isEmpty():
        later = rows.withColumns({"first": F.first(ends).over(order), "rank": F.rank().over(order)}).where("rank > 1")
    else:
        cold = rows.join(F.broadcast(hot), "h1", "left_anti")
        later = cold.withColumns({"first": F.first(ends).over(order), "rank": F.rank().over(order)}).where("rank > 1").drop("rank")
        warm = rows.join(F.broadcast(hot), "h1", "left_semi")
        least = warm.groupBy(*hashes).agg(F.min(F.struct(*where, "pre", "post")).alias("least"))  # combined in each task
        met = warm.join(F.broadcast(least), hashes).where(F.struct(*where) != F.struct(*[F.col(f"least.{c}") for c in where]))
        later = later.unionByName(met.withColumn("first", F.struct("least.pre", "least.post")).drop("least"))
    left = F.when((F.col("pre") >= 0) & (F.col("pre") == F.col("first.pre")), 1).otherwise(0)
    right = F.when((F.col("post") >= 0) & (F.col("post") == F.col("first.post")), 1).otherwise(0)
    return later.select("id", "mark", *hashes, (F.col("a") - left).alias("a"), (F.col("b") + right).alias("b"))


def remove_repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_lines: int = MIN_LINES) -> DataFrame:
    """All rows and columns with repeated passages taken out of ``text``; ``removed`` has their byte spans in the original.

    The first occurrence of a chunk, by id, then by a hash of the text and by place, stays; the lines of later ones, in
    the same text too, go if they are part of a run of such lines with ``min_words`` words and ``min_lines`` logical lines at
    least.  Rows equal in id and text count as one document and get one result.  Null texts stay null, empty ones empty;
    a text of repeated passages only becomes empty.  Null ids come first.  A ``removed`` of the input is replaced, every
    other column comes out as it went in.  An empty table gives none.

    The chunks' hashes are counted; a filter of those that repeat, sized by their number, keeps all others from being
    shuffled again.  What it lets through is written to the shared folder once, so that texts are cut into lines twice, and
    once more where they change.  Texts are shuffled once, to meet their decisions.  Bytes are compared with equal ones combined
    before.  A hash that turns out to stand for different bytes, which 96 bits make unlikely, removes nothing.
    """
    spark = docs.sparkSession
    base = docs.drop("removed")
    key = F.xxhash64(F.col(f"`{text}`").cast("binary"))
    bare = base.select(F.col(f"`{id}`").alias("id"), key.alias("mark"), F.col(f"`{text}`").cast("binary").alias("text"))
    many = materialise(_hash_counts(bare).groupBy("h1").agg(F.sum("n").alias("n")).where("n > 1"), "line-repeated")
    repeated = spark.sparkContext.broadcast(hash_filter(many.select("h1")))
    hashes = ["h1", "h2"]
    rows = materialise(_occurrences(bare, repeated), "line-occurrences")
    told = rows.where("content IS NOT NULL").select(*hashes, "content")
    wrong = materialise(told.distinct().groupBy(*hashes).count().where("count > 1").select(*hashes), "line-collisions")
    later = _later(rows.drop("content"), many)
    if not wrong.isEmpty():
        later = later.join(wrong, hashes, "left_anti")
    marked = later.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("_ranges"))
    row = base.select(F.struct(*[f"`{c}`" for c in base.columns]).alias("_row"), F.col(f"`{id}`").alias("_id"), key.alias("_mark"))
    joined = row.join(marked.withColumnsRenamed({"id": "_id2", "mark": "_mark2"}), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_mark") == F.col("_mark2")), "left")
    return _without(joined.select("_row", "_ranges"), base, text, min_words, min_lines)


def _without(joined: DataFrame, base: DataFrame, text: str, min_words: int, min_lines: int) -> DataFrame:
    """Take the marked runs out of the texts of the rows, and give their columns back."""
    at, n = base.columns.index(text), len(base.columns)
    flat = joined.select(*[F.col("_row").getField(c).alias(f"c{k}") for k, c in enumerate(base.columns)], F.col("_ranges").alias("ranges"))
    spans = T.ArrayType(T.ArrayType(T.LongType()))
    own = [T.StructField(f"c{k}", f.dataType) for k, f in enumerate(base.schema.fields)]
    schema = T.StructType([*own, T.StructField("removed", spans)])

    def run(batches):
        for batch in batches:
            marked = np.flatnonzero(pc.is_valid(batch.column(n)).to_numpy(zero_copy_only=False))
            texts, gone = batch.column(at).to_pylist() if len(marked) else [], [[]] * batch.num_rows
            for part, some in _slices(batch.take(pa.array(marked)).append_column("at", pa.array(marked)), at):
                ranges = part.column(n)
                edge, both = ranges.offsets.to_numpy(), ranges.flatten()
                owner = np.repeat(np.arange(len(some)), np.diff(edge))
                found = cut_runs(some, owner, *(pc.struct_field(both, c).to_numpy() for c in ("a", "b")), min_words, min_lines)
                for k, raw, spans in zip(part.column(n + 1).to_pylist(), some, found):
                    if spans:
                        edges = [0, *[x for span in spans for x in span], len(raw)]
                        texts[k] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
                        gone[k] = spans
            changed = pa.array(texts, batch.column(at).type) if len(marked) else batch.column(at)
            columns = [changed if i == at else c for i, c in enumerate(batch.columns[:n])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.list_(pa.int64())))], names=schema.names)

    return flat.mapInArrow(run, schema).toDF(*base.columns, "removed")


def cut_runs(texts: list[bytes], owner: np.ndarray, a: np.ndarray, b: np.ndarray, min_words: int, min_lines: int) -> list[list[tuple[int, int]]]:
    """``removed_spans`` of several texts at once: the lines a to b of the text ``owner`` are repeated."""
    raw = b"\n".join(texts)
    stops = np.cumsum([len(t) + 1 for t in texts])
    start, _, words = line_table(raw)
    of = np.searchsorted(stops, start, side="right")
    first = np.searchsorted(of, np.arange(len(texts)))
    step = np.zeros(len(start) + 1, np.int64)
    np.add.at(step, first[owner] + a, 1)
    np.add.at(step, first[owner] + b + 1, -1)
    late = np.cumsum(step)[:-1] > 0
    edge = np.ones(len(late), bool)
    edge[1:] = (late[1:] != late[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(edge)
    tail = np.append(head[1:], len(late))
    total = np.add.reduceat(words, head) if len(head) else head
    good = late[head] & (total >= min_words) & (tail - head >= min_lines)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    begin = stops - [len(t) + 1 for t in texts]
    for h, t in zip(head[good].tolist(), tail[good].tolist()):
        k = int(of[h])
        end = int(start[t]) if t < len(of) and of[t] == k else int(stops[k]) - 1
        out[k].append((int(start[h] - begin[k]), end - int(begin[k])))
    return out
