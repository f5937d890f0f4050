"""Free-text backstops: dictionary terms, a plugged-in entity detector, a plugged-in rewriter.

They run after the patterns and are probabilistic or list-based: a backstop,
never the only control.  The dictionary is native.  Detector and rewriter are
the one place where Python runs: as iterator pandas UDFs that receive only the
text column in Arrow batches and build their model once per task.

Each ``*_backstop`` returns a transform ``(df, column, hits_column) -> df`` that
fits ``RedactPolicy.free_text``.
"""

from __future__ import annotations

import queue
import re
import sys
import threading
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.column_rules import MASK_TOKEN
from lacuna.functions.names import unused
from lacuna.functions.nested import literal, name
from lacuna.functions.patterns import WORD, WORD_BEHIND, replace_matches
from lacuna.sources.bloom import bloom_filter, may_hold
from lacuna.sources.sizing import bounded_batches, fits_broadcast, lookup_join

# Python workers receive this module's code with the job; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Transform = Callable[[DataFrame, str, str], DataFrame]
_RESULT = "text string, hits bigint"

# Entity kinds looked for by default, and the least score that counts.
DEFAULT_ENTITIES = ("PERSON", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER")
DEFAULT_THRESHOLD = 0.5
CELL_TIMEOUT_SECONDS = 30.0

# A list up to this size becomes one alternation inside the plan; a longer one is looked up word by word.
INLINE_TERMS = 500
# Texts of a batch are looked up so many bytes at a time.
SLICE_BYTES = 1_000_000


# ---------------------------------------------------------------- dictionary


def _label_in(labels: str) -> Callable[[str], str]:
    return lambda m: f"concat('<', try_element_at({labels}, {m}), '>')"


def _replaced(column: str, regex: str, labels: str, found: str, hits: str) -> dict[str, Column]:
    text = name(column)
    return {
        column: F.expr(f"CASE WHEN {found} THEN {replace_matches(text, regex, _label_in(labels))} ELSE {text} END"),
        hits: F.expr(f"CAST(CASE WHEN {found} THEN regexp_count({text}, {regex}) ELSE 0 END AS BIGINT)"),
    }


def dictionary_backstop(terms: Mapping[str, str]) -> Transform:
    """Replace whole-word occurrences of ``term -> label`` by ``<label>``, longest term first.

    A short list becomes one regex inside the plan, a longer one an index by
    first word that every task looks up; the result is the same.
    """
    if len(terms) > INLINE_TERMS:
        return lambda df, column, hits: _look_up(df, column, _by_first_word(terms.items()), hits)
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    body = "|".join("".join(c if c.isalnum() or c in "_ " else f"\\{c}" for c in t) for t in ordered)
    regex = literal(f"(?<!{WORD_BEHIND})(?:{body})(?!{WORD})")
    labels = "map(" + ", ".join(f"{literal(t)}, {literal(terms[t])}" for t in ordered) + ")"

    def transform(df: DataFrame, column: str, hits: str) -> DataFrame:
        if not ordered:
            return df.withColumn(hits, F.expr("0L"))
        return df.withColumns(_replaced(column, regex, labels, f"{name(column)} RLIKE {regex}", hits))

    return transform


TermIndex = dict[str, list[tuple[str, str]]]


def _by_first_word(terms: Iterable[tuple[str, str]]) -> TermIndex:
    """Terms and labels by the word they start with (or a first character that is none), longest first."""
    index: TermIndex = {}
    for term, label in sorted(terms, key=lambda t: (-len(t[0]), t[0])):
        if term:
            index.setdefault(re.match(r"\w+|\W", term).group(), []).append((term, label))
    return index


def _replace_words(text: str, index: TermIndex, starts: re.Pattern) -> tuple[str, int]:
    """The text with whole-word terms replaced, and how many; at each place the longest term that fits wins."""
    out: list[str] = []
    at = 0
    for m in starts.finditer(text):
        if m.start() < at:
            continue
        for term, label in index.get(m.group(), ()):
            end = m.start() + len(term)
            if not text.startswith(term, m.start()) or _is_word(text[end : end + 1]):
                continue
            if m.start() and _is_word(text[m.start() - 1]):
                continue
            out += [text[at : m.start()], f"<{label}>"]
            at = end
            break
    return "".join(out) + text[at:], len(out) // 2


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _starts(index: TermIndex) -> re.Pattern:
    """Where a term can start: at words, and at other characters if a term starts with one."""
    return re.compile(r"\w+" if all(_is_word(k[0]) for k in index) else r"\w+|\W")


def _slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, some ``SLICE_BYTES`` of them at a time, or one."""
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield texts.slice(a, b - a).to_pylist()


def _look_up(df: DataFrame, column: str, index: TermIndex, hits: str) -> DataFrame:
    """In-row lookup of terms that are small enough to broadcast; a worker holds a slice of a batch as Python's strings."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        starts = _starts(known)
        for batch in batches:
            for texts in _slices(batch):
                done = [_replace_words(t, known, starts) if t else (t, 0) for t in texts]
                parts = pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())
                yield pa.StructArray.from_arrays(parts, names=["text", "hits"])

    return _scanned(F.arrow_udf(run, _RESULT))(df, column, hits)


def replace_terms(df: DataFrame, column: str, terms: DataFrame, hits: str = "hits") -> DataFrame:
    """``dictionary_backstop`` for a term *table* (term, label) of any size.

    Of a term with several labels the last in order holds.  A table that was
    counted small is broadcast and looked up in each row: no text is shuffled.
    Otherwise runs of tokens that may be terms are joined to the terms, see
    ``_joined_terms``.  Rows with null texts have no terms.
    """
    listed = terms.where("term IS NOT NULL AND term <> ''").groupBy("term").agg(F.max("label").alias("label"))
    if fits_broadcast(listed):
        index = _by_first_word((r["term"], r["label"]) for r in listed.collect())
        return _look_up(df, column, index, hits)
    return _joined_terms(df, column, listed, hits)


_TOKEN = rf"{WORD}+|[\s\S]"


def _joined_terms(df: DataFrame, column: str, listed: DataFrame, hits: str) -> DataFrame:
    """``replace_terms`` for a term table of any size, by native expressions and one join.

    A term is a run of tokens, which are words and single other characters.  Each run of a text that has as many tokens as
    some term, and starts with the first token of some term, is looked up in a filter of all terms; the few that it lets
    through are joined to the terms by the whole run, so it does not matter how many terms start alike.  What is found of
    a text, by its digest, is put in order of place, and the text rebuilt from the offsets.
    """
    tokens_of = F.regexp_extract_all("term", F.lit(_TOKEN), F.lit(0))
    known = listed.select("term", "label", F.size(tokens_of).alias("n"), F.element_at(tokens_of, 1).alias("first"))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # token counts of terms: a few numbers
    text, own = name(column), unused("_own", df.columns, [hits])
    filters = bloom_filter(known.select(F.xxhash64("term"))), bloom_filter(known.select(F.xxhash64("first")).distinct())
    tokens = F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0)).alias("tokens")
    frame = df.select(F.col(text).alias("text")).select(F.sha2("text", 256).alias("digest"), tokens)
    # Each token is a row of its own, so that a filter is asked by generated code and no row holds a copy of it.  The outer
    # forms, as Spark would work the tokens out twice to leave rows without any out.
    at = F.col("at")
    each = frame.select("digest", "tokens", F.posexplode_outer("tokens").alias("at", "token"))
    started = each.where(F.col("token").isNotNull() & may_hold(filters[1].scalar(), F.xxhash64("token")) & ~_cut_word(at))
    run = lambda n: F.when(at + n <= F.size("tokens"), F.struct(F.lit(n).alias("n"), F.array_join(F.slice("tokens", at + 1, n), "").alias("term")))
    runs = started.select("digest", "tokens", "at", F.explode_outer(F.array(*[run(n) for n in lengths])).alias("r"))
    # A word token ends where a word ends, so only a last token that is none needs the test of the next one.
    ends = ~F.coalesce(F.get("tokens", at + F.col("r.n")).rlike(WORD), F.lit(False))
    found = runs.where(F.col("r").isNotNull() & may_hold(filters[0].scalar(), F.xxhash64("r.term")) & ends).select("digest", "at", "r.*").distinct()
    met = lookup_join(found, known.select("term", "label"), "term", "inner")
    runs_of = F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "label")))
    small = met.groupBy(F.col("digest").alias(own)).agg(runs_of.alias("_runs"))
    names = {n: unused(n, df.columns, [hits]) for n in ("_runs", "_tokens", "_done")}
    keyed = df.withColumn(own, F.sha2(F.col(text), 256))
    joined = lookup_join(keyed, small.withColumnRenamed("_runs", names["_runs"]), own)
    joined = joined.withColumn(names["_tokens"], F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(0)))
    tokens = F.col(names["_tokens"])
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,end:int,label:string>>").alias("kept"))

    def take(state: Column, r: Column) -> Column:
        """The next run, if it starts behind the last one taken; of runs from one place the longest comes first."""
        span = F.struct(r["at"].alias("at"), (r["at"] - r["less"]).alias("end"), r["label"].alias("label"))
        taken = F.struct((r["at"] - r["less"]).alias("end"), F.array_append(state["kept"], span).alias("kept"))
        return F.when(r["at"] >= state["end"], taken).otherwise(state)

    kept = F.aggregate(F.col(names["_runs"]), start, take, lambda state: state["kept"])
    joined = joined.withColumn(names["_done"], kept)
    done = F.col(names["_done"])
    piece = lambda k, i: F.concat(
        F.array_join(F.slice(tokens, F.coalesce(F.get(done, i - 1)["end"], F.lit(0)) + 1, k["at"] - F.coalesce(F.get(done, i - 1)["end"], F.lit(0))), ""),
        F.lit("<"), k["label"], F.lit(">"),
    )
    rest = F.array_join(F.slice(tokens, F.element_at(done, -1)["end"] + 1, F.size(tokens)), "")
    new = F.when(F.size(done) > 0, F.concat(F.array_join(F.transform(done, piece), ""), rest)).otherwise(F.col(text))
    counted = F.coalesce(F.when(F.size(done) > 0, F.size(done)), F.lit(0)).cast("bigint")
    out = joined.withColumns({column: new, hits: counted})
    return out.select(*[F.col(name(c)) for c in df.columns if c != hits], hits)


def _cut_word(i: Column) -> Column:
    """Whether a token that is no word stands right behind a word: no term starts there."""
    token, before = F.get("tokens", i), F.get("tokens", i - 1)
    return ~token.rlike(WORD) & F.coalesce(before.rlike(WORD), F.lit(False))


# ------------------------------------------------------------------ detector


@dataclass(frozen=True)
class Span:
    """Characters ``start:end`` of a text hold an entity."""

    start: int
    end: int
    label: str
    score: float = 1.0


Detector = Callable[[Sequence[str]], Sequence[Sequence[Span]]]


def _cover(text: str, spans: Sequence[Span]) -> str:
    """Replace spans by ``<LABEL>``; of overlapping ones the best-scored, then longest, stays."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.score, s.start - s.end, s.start)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    out, at = [], 0
    for s in sorted(kept, key=lambda s: s.start):
        out += [text[at : s.start], f"<{s.label}>"]
        at = s.end
    return "".join(out) + text[at:]


def detector_backstop(
    factory: Callable[[], Detector],
    entities: Sequence[str] = DEFAULT_ENTITIES,
    threshold: float = DEFAULT_THRESHOLD,
) -> Transform:
    """Replace what a detector finds.  ``factory`` runs once per task, the detector once per batch."""
    wanted = frozenset(entities)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for batch in batches:
            texts = batch.tolist()
            at = [i for i, t in enumerate(texts) if t]
            counts = [0] * len(texts)
            replies = list(detect([texts[i] for i in at])) if at else []
            if len(replies) != len(at):
                raise ValueError(f"the detector answered {len(replies)} times for {len(at)} texts")
            for i, spans in zip(at, replies):
                found = [s for s in spans if s.score >= threshold and (not wanted or s.label in wanted)]
                counts[i] = len(found)
                if found:
                    texts[i] = _cover(texts[i], found)
            yield pd.DataFrame({"text": texts, "hits": counts})

    return _python_transform(run)


# ------------------------------------------------------------------ rewriter


def rewriter_backstop(
    factory: Callable[[], Callable[[str], str]],
    timeout: float = CELL_TIMEOUT_SECONDS,
    parallel: int = 4,
) -> Transform:
    """Let a model rewrite each text, failing closed.

    An error, a timeout or an empty reply masks the whole cell and counts one;
    a changed text counts one, an unchanged one none.  Equal texts of a batch
    are sent once; ``parallel`` calls are in flight, since they mostly wait.
    A text's time runs from its own call on, and a call that hangs gives its
    place to the next text.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rewrite = factory()
        for batch in batches:
            replies = _call_all(rewrite, [t for t in dict.fromkeys(batch.tolist()) if t], timeout, parallel)
            done: dict[str | None, tuple[str | None, int]] = {None: (None, 0), "": ("", 0)}
            for text, reply in replies.items():
                reply = reply.strip() if isinstance(reply, str) else ""
                done[text] = (reply, int(reply != text)) if reply else (MASK_TOKEN, 1)
            results = [done[t] for t in batch.tolist()]
            yield pd.DataFrame({"text": [r[0] for r in results], "hits": [r[1] for r in results]})

    return _python_transform(run)


def _call_all(call: Callable[[str], str], texts: Sequence[str], timeout: float, parallel: int) -> dict[str, str | None]:
    """Every text's reply, None where the call failed or took too long.

    Each call has a daemon thread, so one that never returns cannot keep the worker from ending.
    """
    replies: dict[str, str | None] = dict.fromkeys(texts)
    arrived: queue.SimpleQueue = queue.SimpleQueue()

    def one(text: str) -> None:
        try:
            arrived.put((text, call(text)))
        except BaseException:  # noqa: BLE001 - whatever went wrong, the cell is masked
            arrived.put((text, None))

    waiting, flying = list(reversed(texts)), {}
    while waiting or flying:
        while waiting and len(flying) < parallel:
            text = waiting.pop()
            flying[text] = time.monotonic() + timeout
            threading.Thread(target=one, args=(text,), daemon=True).start()
        try:
            text, reply = arrived.get(timeout=max(0.0, min(flying.values()) - time.monotonic()))
            if flying.pop(text, None) is not None:  # else it came too late
                replies[text] = reply
        except queue.Empty:
            now = time.monotonic()
            flying = {t: end for t, end in flying.items() if end > now}
    return replies


def _python_transform(run: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]]) -> Transform:
    return _scanned(F.pandas_udf(run, _RESULT))


def _scanned(scan: Callable[[Column], Column]) -> Transform:
    def transform(df: DataFrame, column: str, hits: str) -> DataFrame:
        found = unused("_found", df.columns, [hits])
        scanned = df.withColumn(found, scan(F.col(name(column))))
        return scanned.withColumns({column: F.col(f"{found}.text"), hits: F.col(f"{found}.hits")}).drop(found)

    return transform
