"""Quality rules with cross-document line frequency.

Lines are normalised and hashed.  For every host the distinct documents of each line are counted; lines above the limits
are boilerplate of the host, and a document left with too little without them is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialise, ship_by_value
from lacuna.llm.jaccard import mix, sliced

ship_by_value(__name__)

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: A line is above the limits in more distinct documents of a host than this, and more than this share of them.
MAX_DOCUMENTS = 10
MAX_SHARE = 0.001
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_left long, cleaned string, removed array<array<long>>"


def line_hash(line: bytes) -> int | None:
    """The hash of a normalised line, None without a word.  A-Z are lower-cased and words joined by one blank."""
    own = line.lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63) if own else None


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def without_lines(text: bytes, frequent: set[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without its frequent lines, and their byte spans; each goes with its line break, the last with that before."""
    if not frequent:
        return text, []
    spans, at = [], 0
    for line in text.split(b"\n"):
        if line_hash(line) in frequent:
            start, stop = at, min(at + len(line) + 1, len(text))
            if spans and spans[-1][1] == start:
                start = spans.pop()[0]
            spans.append((start, stop))
        at += len(line) + 1
    if spans and spans[-1][1] == len(text) and text[-1:] != b"\n" and spans[-1][0]:
        spans[-1] = (spans[-1][0] - 1, len(text))  # no line break is left behind the last line that stays
    edges = [0, *[x for span in spans for x in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), spans


def repeated_words(word: np.ndarray, owner: np.ndarray, texts: int, size: int = WINDOW) -> np.ndarray:
    """By text: words inside a window of ``size`` words that occurs twice or more in the text.

    ``word`` has one code per distinct word, ``owner`` the text of each.
    """
    n = len(word) - size + 1
    if n < 2:
        return np.zeros(texts, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    value = owner[at].astype(np.uint64)
    for k in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + word[at + k].astype(np.uint64))
    order = np.argsort(value, kind="stable")
    a, b = at[order[:-1]], at[order[1:]]
    same = (value[order[:-1]] == value[order[1:]]) & (owner[a] == owner[b])
    for k in range(size):
        same &= word[a + k] == word[b + k]
    found = np.zeros(len(word) + 1, np.int64)
    hit = np.zeros(len(word), bool)
    hit[a[same]] = hit[b[same]] = True
    hit = np.flatnonzero(hit)
    np.add.at(found, hit, 1)
    np.add.at(found, hit + size, -1)
    return np.bincount(owner[np.cumsum(found[:-1]) > 0], minlength=texts)


def _lines(docs: DataFrame) -> DataFrame:
    """(id, host, mark, lines): the hashes of the distinct normalised lines of each row's text."""
    first = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    names = [c for c in docs.columns if c != "text"]
    at_text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at, texts in sliced(batch.column(at_text)):
                own = [list({line_hash(line) for line in t.split(b"\n")} - {None}) for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]
                kept = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns) if i != at_text]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.list_(pa.int64()))], names=[*names, "lines"])

    return docs.mapInArrow(run, f"{first}, lines array<long>")


def _metrics(docs: DataFrame) -> DataFrame:
    """All columns but ``text`` and ``frequent``, the metrics of each row's text, and the text without its frequent lines."""
    gone = ("text", "frequent")
    first = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in gone)
    names = [c for c in docs.columns if c not in gone]
    at_text, at_frequent = (docs.columns.index(c) for c in gone)

    def run(batches):
        for batch in batches:
            for at, whole in sliced(batch.column(at_text)):
                texts = pc.fill_null(whole, "")
                parts = pc.ascii_split_whitespace(texts)
                flat = parts.flatten()
                real = pc.not_equal(pc.binary_length(flat), 0)
                owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)]
                flat = flat.filter(real)
                word = flat.dictionary_encode().indices.to_numpy()
                raw = texts.cast(pa.binary()).to_pylist()
                frequent = batch.column(at_frequent).slice(at, len(texts)).to_pylist()
                cleaned = [without_lines(t, set(f or ())) for t, f in zip(raw, frequent)]
                n_words = np.bincount(owner, minlength=len(texts))
                numbers = [
                    n_words, np.bincount(owner, pc.utf8_length(flat).to_numpy(), len(texts)), pc.count_substring_regex(texts, SYMBOLS).to_numpy(),
                    [repeated_lines(t) for t in raw], repeated_words(word, owner, len(texts)),
                    [len(left.split()) if spans else n for (left, spans), n in zip(cleaned, n_words.tolist())],
                ]
                left = pa.array([None if null else c for (c, _), null in zip(cleaned, whole.is_null().to_pylist())], pa.binary()).cast(pa.string())
                spans = pa.array([s for _, s in cleaned], pa.list_(pa.list_(pa.int64())))
                kept = [batch.column(i).slice(at, len(texts)) for i, c in enumerate(batch.schema.names) if c not in gone]
                arrays = [*kept, *[pa.array(np.asarray(x).astype(np.int64)) for x in numbers], left, spans]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[m.split()[0] for m in METRICS.split(", ")]])

    return docs.mapInArrow(run, f"{first}, {METRICS}")


def frequent_lines(profile: DataFrame, max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, hash) of the lines above the limits.

    Distinct documents are distinct texts: copies count once.  Counting distinct texts shuffles by (host, line, text)
    first, so a hot host or line is spread.
    """
    lines = profile.select("host", "mark", F.explode("lines").alias("hash"))
    counted = lines.groupBy("host", "hash").agg(F.count_distinct("mark").alias("documents")).where(F.col("documents") > max_documents)
    hosts = profile.groupBy("host").agg(F.count_distinct("mark").alias("of_host"))
    return counted.join(hosts, "host").where(F.col("documents") > max_share * F.col("of_host")).select("host", "hash")


def clean(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    max_share: float = MAX_SHARE,
    least_left: float = LEAST_LEFT,
) -> DataFrame:
    """One row per document: ``id``, the metrics, ``n_left``, ``base_failed``, ``kept``, ``text``, ``removed``.

    ``text`` has no lines above the host's limits any more, ``removed`` are the byte spans of those in the original, line
    breaks included; a null text stays null.  ``n_left`` are the words of ``text``.  ``base_failed``: fewer than 10 words,
    or over 20 % of them in repeated 5-word windows.  A document with less than ``least_left`` of its words left is
    depleted.  ``kept`` is neither.  Null and empty texts have no words and fail.  Rows without a host share one host.
    Each row is judged, repeated or not, and copies of a text count once for the limits.  Other columns are not read; an
    empty table gives none.

    Hashes of lines are shuffled, and the texts once, to meet their frequent lines.
    """
    bare = docs.select(F.col(id).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    profile = materialise(_lines(bare), "line-quality")
    above = materialise(frequent_lines(profile, max_documents, max_share), "frequent-lines")
    # Rows equal in id, host and text have the same lines.
    own = profile.select("id", "host", "mark", F.explode("lines").alias("hash")).join(above, ["host", "hash"])
    own = own.groupBy("id", "host", "mark").agg(F.collect_set("hash").alias("frequent")).toDF("_id", "_host", "_mark", "frequent")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("mark") == F.col("_mark"))
    judged = _metrics(bare.join(own, same, "left").select("id", "text", "frequent"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_left") >= least_left * F.col("n_words")))
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")
    return judged.select(F.col("id").alias(id), *numbers, F.col("cleaned").alias(text), "removed")


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = MAX_DOCUMENTS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """The verdicts of ``clean`` alone, without the texts it cleaned."""
    return clean(docs, id, text, host, max_documents, max_share, least_left).drop(text, "removed")
