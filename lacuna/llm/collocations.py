"""Phrase collocations by vertical partitioning of the corpus' suffixes.

1. Every word occurrence begins a suffix, cut after ``max_words`` words and at the end of its piece.  A first scan counts the
   suffixes by prefix: by the hash bucket of the first word, and by that of the first two.
2. Prefixes are grouped until a group reaches the memory budget.  A prefix over the budget is extended by its next word, and
   one that is over it with two words too has its suffixes spread by the hash of all their words.
3. A second scan sends each suffix, equal ones of a task combined, to its group.  A group is sorted on its own, which is its
   subtree: leaf totals give the count of every node above them.  Only nodes above a group boundary are added up again.
4. Candidates are cut in two, and their parts looked up among the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import materialise, ship_by_value
from lacuna.sources.sizing import lookup_join

ship_by_value(__name__)

#: A group holds so many suffixes of the corpus, or one bucket of prefixes.
BUDGET = 1 << 21
BUCKETS = 1 << 17
#: So many bytes of text become suffixes at once, cut at the end of a piece.
FLUSH_BYTES = 8_000_000
#: Tables of counts are added up so many at a time, in so many blocks.
FAN_IN = 64
COUNT_BLOCKS = 8
#: Parts in which a language is ranked first.
RANK_PARTS = 64
#: What separates words, and what ends a piece.
BLANK, END = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANK)] = 1
KIND[list(END)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def segments(raw: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut behind ends of pieces; a longer piece stays whole."""
    code = np.frombuffer(raw, np.uint8)
    at = 0
    while len(raw) - at > size:
        step, cut = size, None
        while cut is None:
            found = np.flatnonzero(KIND[code[at : at + step]] == 2)
            cut = at + int(found[-1]) + 1 if len(found) else len(raw) if at + step >= len(raw) else None
            step *= 2
        yield raw[at:cut]
        at = cut
    if at < len(raw):
        yield raw[at:]


def suffixes(raw: bytes, max_words: int) -> tuple[list[bytes], list[np.ndarray]]:
    """The words, the empty one first, and for each word occurrence the numbers of the words from there, 0 behind its piece."""
    code = LOWER[np.frombuffer(raw, np.uint8)]
    kind = KIND[code]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(code[inside])]).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    own = words.indices.to_numpy().astype(np.int64) + 1
    columns = [own]
    for k in range(1, max_words):
        next_word = np.zeros(len(own), np.int64)
        if len(own) > k:
            next_word[:-k] = np.where(piece[k:] == piece[:-k], own[k:], 0)
        columns.append(next_word)
    return [b"", *words.dictionary.to_pylist()], columns


def joined(columns: list[np.ndarray], base: int) -> np.ndarray:
    """One number a row that sorts like the row; all entries are below ``base``."""
    key = columns[0]
    for column in columns[1:]:
        if len(key) and (int(key.max()) + 1) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + column
    return key


def leaves(columns: list[np.ndarray], base: int, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, and how often each occurs: the leaves of a subtree and their totals."""
    key = joined(columns, base)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    weight = np.ones(len(key), np.int64) if weight is None else weight[order]
    total = np.add.reduceat(weight, start) if len(start) else np.zeros(0, np.int64)
    return [c[order][start] for c in columns], total


def prefix_hashes(words: list[bytes], columns: list[np.ndarray], lang: str) -> list[np.ndarray]:
    """Of each row, the hash of its first word, of its first two, and of all."""
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    held = mix(own[columns[0]] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    out = [held]
    for column in columns[1:]:
        held = mix(held * np.uint64(0x9E3779B97F4A7C15) + own[column])
        out.append(held)
    return [out[0], out[min(1, len(out) - 1)], out[-1]]


class Plan:
    """Which group a suffix belongs to, from the counts of the buckets of one word and of two."""

    def __init__(self, one: np.ndarray, two: np.ndarray, budget: int):
        self.extended = one > budget
        self.one = np.cumsum(np.where(self.extended, 0, one)) // budget
        self.parts = np.where(two > budget, -(-two // budget), 1)
        base = int(self.one[-1]) + 1
        whole = np.cumsum(np.where(self.parts > 1, 0, two)) // budget
        spread = np.cumsum(np.where(self.parts > 1, self.parts, 0)) - self.parts
        self.two = base + np.where(self.parts > 1, int(whole[-1]) + 1 + spread, whole)

    def group(self, hashes: list[np.ndarray]) -> np.ndarray:
        one, two = (bucket(h) for h in hashes[:2])
        deep = self.two[two] + (hashes[2] % self.parts[two].astype(np.uint64)).astype(np.int64)
        return np.where(self.extended[one], deep, self.one[one])

    def is_whole(self, hashes: list[np.ndarray], size: int, max_words: int) -> np.ndarray:
        """Whether all suffixes below a node of so many words are in its group."""
        one, two = (bucket(h) for h in hashes[:2])
        if size == max_words:
            return np.ones(len(one), bool)
        return ~self.extended[one] | (self.parts[two] == 1 if size > 1 else False)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language joined by line ends, some ``FLUSH_BYTES`` at a time."""
    held, size = {}, 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text) + 1
            if size >= FLUSH_BYTES:
                for name, texts in held.items():
                    yield from ((name, part) for part in segments(b"\n".join(texts), FLUSH_BYTES))
                held, size = {}, 0
    for name, texts in held.items():
        yield from ((name, part) for part in segments(b"\n".join(texts), FLUSH_BYTES))


def _prefix_counts(docs: DataFrame, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """How many suffixes there are by bucket of one word and of two."""

    def count(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for lang, raw in _by_language(batches):
            words, columns = suffixes(raw, max_words)
            if len(columns[0]):
                one, two, _ = prefix_hashes(words, columns, lang)
                total[:BUCKETS] += np.bincount(bucket(one), minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(bucket(two), minlength=BUCKETS)
        parts = [zstandard.compress(p.tobytes(), 1) for p in np.split(total, COUNT_BLOCKS)]
        columns = [pa.array(range(COUNT_BLOCKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * COUNT_BLOCKS, pa.int64()), pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "task", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        return pa.table({"block": table.column("block")[:1], "task": table.column("task")[:1], "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    counts = materialise(docs.mapInArrow(count, "block int, task long, counts binary"), "phrase-counts")
    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        by = counts.withColumn("task", F.floor(F.col("task") / FAN_IN))
        counts = by.groupBy("block", "task").applyInArrow(add, "block int, task long, counts binary")
        tasks = -(-tasks // FAN_IN)
    rows = {r["block"]: np.frombuffer(zstandard.decompress(bytes(r["counts"])), np.int64) for r in counts.select("block", "counts").collect()}
    total = np.concatenate([rows[k] for k in range(COUNT_BLOCKS)]) if rows else np.zeros(2 * BUCKETS, np.int64)
    return total[:BUCKETS], total[BUCKETS:]


BLOCK = "group long, lang string, words binary, codes binary, counts binary"


def _blocks(docs: DataFrame, max_words: int, plan) -> DataFrame:
    """The suffixes of the corpus in compressed blocks, each of one group, language and flush."""

    def send(batches):
        packer = zstandard.ZstdCompressor(3)
        for lang, raw in _by_language(batches):
            words, columns = suffixes(raw, max_words)
            if not len(columns[0]):
                continue
            columns, total = leaves(columns, len(words))
            group = plan.value.group(prefix_hashes(words, columns, lang))
            order = np.argsort(group, kind="stable")
            columns, total, group = [c[order] for c in columns], total[order], group[order]
            edges = [*np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist(), len(group)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                used, local = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
                local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                parts = (b"\n".join([words[k] for k in used.tolist()]), local.dtype.char.encode() + local.tobytes(), total[a:b].astype(np.uint32).tobytes())
                rows.append((int(group[a]), lang, *[packer.compress(p) for p in parts]))
                if len(rows) == 1_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["group", "lang", "words", "codes", "counts"])

    return docs.mapInArrow(send, BLOCK)


def subtree(blocks: pa.Table, max_words: int, plan: Plan, min_count: int) -> pa.Table:
    """(lang, phrase, size, f) of the nodes of one group's subtrees: those with ``min_count`` suffixes and those that are parts.

    The root, of size 0, counts the words of its language.
    """
    opener = zstandard.ZstdDecompressor()
    out = []
    langs = blocks.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        rows = [k for k, x in enumerate(langs) if x == lang]
        held, codes, weight, start = [], [], [], 0
        for k in rows:
            words = opener.decompress(blocks.column("words")[k].as_py()).split(b"\n")
            raw = opener.decompress(blocks.column("codes")[k].as_py())
            codes.append(np.frombuffer(raw, raw[:1].decode(), offset=1).reshape(max_words, -1).astype(np.int64) + start)
            weight.append(np.frombuffer(opener.decompress(blocks.column("counts")[k].as_py()), np.uint32).astype(np.int64))
            held.append(pa.array(words, pa.large_binary()))
            start += len(words)
        named = pa.concat_arrays(held).dictionary_encode()
        words, number = named.dictionary.to_pylist(), named.indices.to_numpy().astype(np.int64)
        columns, total = leaves([number[c] for c in np.concatenate(codes, axis=1)], len(words), np.concatenate(weight))
        out.append((lang, "", 0, int(total.sum())))
        none = words.index(b"") if b"" in words else -1
        new = np.zeros(len(total), bool)
        new[:1] = True
        for size in range(1, max_words + 1):
            own = columns[size - 1]
            new[1:] |= own[1:] != own[:-1]
            first = np.flatnonzero(new)
            count = np.add.reduceat(total, first)
            own_hashes = prefix_hashes(words, [c[first] for c in columns], lang)
            keep = (own[first] != none) & ((count >= min_count) | ~plan.is_whole(own_hashes, size, max_words))
            for k, n in zip(first[keep].tolist(), count[keep].tolist()):
                out.append((lang, b" ".join([words[c[k]] for c in columns[:size]]).decode(), size, n))
    types = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["lang", "phrase", "size", "f"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, size, f) of every phrase of up to ``max_words`` words with ``min_count`` occurrences at least.

    The phrase of size 0 counts all words of a language.  A phrase never crosses the end of a piece.
    """
    bare = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    plan = docs.sparkSession.sparkContext.broadcast(Plan(*_prefix_counts(bare, max_words), budget))
    blocks = _blocks(bare, max_words, plan)
    nodes = blocks.groupBy("group").applyInArrow(lambda t: subtree(t, max_words, plan.value, min_count), "lang string, phrase string, size int, f long")
    nodes = nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return materialise(nodes.where((F.col("size") == 0) | (F.col("f") >= min_count)), "phrases")


def _key(phrase: Column | str) -> Column:
    """One key of a phrase, which has no tab, and its language."""
    return F.concat(phrase, F.lit("\t"), F.col("lang"))


def _part(start: int, size: int) -> Column:
    """So many words of the phrase."""
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, min_count: int = 10, contained_percent: int = 50, top: int = 2_000, budget: int = BUDGET) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces and these into words.  Candidates are phrases of 2 to ``max_words`` words
    with a = f(phrase) >= ``min_count``.  Cut after its first words, a candidate has l = f(first part), r = f(rest) and the
    score floor(10^6 a a / (l r)); the cut with the lowest score counts, of equal ones the first.  A candidate goes if its
    words lie in a longer candidate that has ``contained_percent`` of its occurrences.  ``n`` counts the language's words.

    A null text is empty, a null language is ``und``.  Repeated rows count each time.  Other columns are not read.  A table
    without a candidate gives no row.
    """
    counted = phrase_counts(docs, text, lang, max_words, min_count, budget)
    known = counted.where("size > 0").select(_key(F.col("phrase")).alias("key"), "f")
    candidates = counted.where("size > 1").withColumn("key", _key(F.col("phrase")))
    cuts = [F.struct(F.lit(k).alias("k"), _key(_part(1, k)).alias("first"), _key(_part(k + 1, max_words)).alias("rest")) for k in range(1, max_words)]
    cut = candidates.select("key", "f", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("size"))).alias("cut")).select("key", F.col("f").alias("a"), "cut.*")
    cut = materialise(cut, "phrase-cuts")
    cut = lookup_join(cut, known.toDF("first", "l"), "first", "inner")
    cut = lookup_join(cut, known.toDF("rest", "r"), "rest", "inner")
    score = F.expr("cast(1000000 as decimal(7, 0)) * (cast(a as decimal(20, 0)) * a) div (cast(l as decimal(20, 0)) * r)")
    best = cut.select("key", F.struct(score.alias("score"), "k", "l", "r").alias("best")).groupBy("key").agg(F.min("best").alias("best"))
    places = [(start, size) for size in range(2, max_words) for start in range(1, max_words - size + 2)]
    inner = [F.when((F.col("size") > size) & (F.col("size") >= start + size - 1), _key(_part(start, size))) for start, size in places]
    kept = candidates.join(best, "key")
    if inner:
        held = candidates.select(F.explode(F.array(*inner)).alias("key"), "f").where("key IS NOT NULL").groupBy("key").agg(F.max("f").alias("held"))
        kept = kept.join(held, "key", "left").where(F.coalesce(100 * F.col("held") < contained_percent * F.col("f"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
