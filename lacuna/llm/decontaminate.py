"""Benchmark decontamination with one Aho-Corasick automaton over word codes.

Texts are normalised to words; each word of a benchmark becomes one character, every other word a blank.  The windows
of the items are the automaton's patterns, so one pass over a document's codes finds every occurrence of every window,
and a position in the codes is the ordinal of a word, whose place in the original is known.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import materialise, ship_by_value, worker_state

ship_by_value(__name__)

WINDOW = 13
#: An automaton holds items of at most so many bytes; more items are taken in blocks, each against all documents.  It takes
#: some 200 MB for each MB of items.
BLOCK_BYTES = 2 * 1024 * 1024
#: Lower-cases A-Z and blanks all bytes that no word has: below 0x80 all but digits and letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FIRST_CODE = 0x21


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; folding keeps every byte in place, so offsets are those of the original's UTF-8."""
    return text.translate(FOLD).split() if text else []


#: So many numbers of words have a character of their own; all have two characters if there are more.
CODES = 0x10FFFF - FIRST_CODE - 0x800


def code_point(ordinal: int) -> str:
    """The character of a word's number, leaving out the surrogates."""
    at = FIRST_CODE + ordinal
    return chr(at if at < 0xD800 else at + 0x800)


def code_of(ordinal: int, width: int) -> str:
    """The characters of a word's number.  Of two, the first is from the lower half and the second from the upper, so that a
    code is only ever found where one starts."""
    half = CODES // 2
    return code_point(ordinal) if width == 1 else code_point(ordinal // half) + code_point(half + ordinal % half)


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def automaton_of(items: list[tuple[object, bytes]], size: int) -> tuple[dict[bytes, str], ahocorasick.Automaton]:
    """Codes of the items' words, and the automaton; a pattern's value is (length, its items)."""
    known = dict.fromkeys(w for _, text in items for w in words_of(text))
    width = 1 if len(known) <= CODES else 2
    codes = {w: code_of(k, width) for k, w in enumerate(known)}
    owners: dict[str, set] = {}
    for item, text in items:
        words = words_of(text)
        for window in windows(words, size):
            owners.setdefault("".join(codes[w] for w in window), set()).add(item)
    machine = ahocorasick.Automaton()
    for pattern, found in owners.items():
        machine.add_word(pattern, (len(pattern) // width, sorted(found, key=str)))
    if owners:
        machine.make_automaton()
    return codes, machine


def known_runs(machine: ahocorasick.Automaton) -> re.Pattern | None:
    """Runs of benchmark words that can hold a pattern; a blank takes the automaton back to its root, so it skips the rest."""
    shortest = min(map(len, machine.keys()), default=0)
    return re.compile("[^ ]{%d,}" % shortest) if shortest else None


def scan(words: list[bytes], codes: dict[bytes, str], machine: ahocorasick.Automaton, fits: re.Pattern | None) -> tuple[list[tuple[int, int]], set]:
    """Merged runs [from, to) of hit words, and the items found."""
    runs: list[tuple[int, int]] = []
    items: set = set()
    if fits is None:
        return runs, items
    width = len(next(iter(codes.values())))
    coded = "".join(map(codes.get, words, repeat(" " * width)))
    for known in fits.finditer(coded):
        for end, (length, owners) in machine.iter(coded, known.start(), known.end()):
            stop = (end + 1) // width
            start = stop - length
            while runs and runs[-1][1] >= start:  # ends only grow, starts need not
                start = min(start, runs.pop()[0])
            runs.append((start, stop))
            items.update(owners)
    return runs, items


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as [from, to) in the text's UTF-8 bytes."""
    if not runs:
        return []
    blank = np.frombuffer(text.translate(FOLD), np.uint8) == 32
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [(int(first[a]), int(last[b - 1])) for a, b in runs]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Append to every document: ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted as strings), ``hit_spans``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A document
    word inside an occurrence of a window is hit.  ``hit_spans`` are the hit runs as offsets [start, stop) into the
    original's UTF-8 bytes.  Null and wordless texts have 0 words and no hits; items without words or without an id
    never occur; an item id that repeats is one item with all its texts; an empty benchmark hits nothing.  Each row
    stands for itself, repeated ids included.  Columns of the same names as the new ones are replaced.

    The automaton is broadcast, in blocks of items of ``block_bytes`` at most (or one item, if that is larger).  Between
    blocks the documents are written to the shared folder.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("binary").alias("bytes")).where("item IS NOT NULL AND bytes IS NOT NULL")
    total = items.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found_type = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    )
    kept = docs.drop("n_words", "n_hit", "n_items", "items", "hit_spans")
    own = [f"c{i}" for i in range(len(kept.columns))]  # by place, so that no name of the input matters
    raw = F.col(f"`{text}`").cast("binary")
    out = kept.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept.columns, own)], raw.alias("_bytes"), F.lit(None).cast(found_type).alias("_found"))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(str(r["item"]), bytes(r["bytes"])) for r in part.collect()])
        if block:
            out = materialise(out, "decontaminate")
        out = _scan_block(out, shared, window, found_type)
    length = F.aggregate("_found.runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    new = [F.col("_found.n_words"), length.alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"), F.col("_found.items"), F.col("_found.hit_spans")]
    return out.select(*[F.col(k).alias(c) for c, k in zip(kept.columns, own)], *new)


def _scan_block(docs: DataFrame, shared, window: int, found_type: T.StructType) -> DataFrame:
    columns, token = docs.columns, uuid.uuid4().hex
    raw, earlier = columns.index("_bytes"), columns.index("_found")
    schema = T.StructType([f for f in docs.schema.fields if f.name != "_found"] + [T.StructField("_found", found_type)])
    arrow_type = pa.struct(
        [("n_words", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.list_(pa.int64())))]
    )

    def run(batches):
        kept = worker_state()
        if kept.get("automaton_of") != token:  # a worker builds it once for all of its tasks
            kept.update(automaton_of=token, automaton=automaton_of(shared.value, window))
        codes, machine = kept["automaton"]
        fits = known_runs(machine)
        for batch in batches:
            values = []
            for text, before in zip(batch.column(raw), batch.column(earlier).to_pylist()):
                text = text.as_py()
                words = words_of(text)
                runs, items = scan(words, codes, machine, fits)
                if before:
                    runs, items = merged(runs + [tuple(r) for r in before["runs"]]), items | set(before["items"])
                spans = byte_spans(text, runs) if runs else []
                values.append({"n_words": len(words), "runs": runs, "items": sorted(items), "hit_spans": spans})
            others = [batch.column(i) for i in range(len(columns)) if i != earlier]
            yield pa.RecordBatch.from_arrays([*others, pa.array(values, arrow_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """At least one hit word, and at least one in so many words hit."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def items_digest(items: Column) -> Column:
    """SHA-256 (lowercase hex) of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)
