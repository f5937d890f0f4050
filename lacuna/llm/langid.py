"""Language identification by n-gram filters that answer for all languages at once.

The filter is a bit-sliced Bloom filter: every slot holds one bit per language, so that the AND over the slots of an
n-gram is the set of all languages that contain it.  A text's n-grams are looked up, the bits are counted per language
and corrected for the measured false-positive rate of that language's slice; the language with the most hits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import map_arrow, ship_by_value

ship_by_value(__name__)

#: Letters end below this code point; larger ones count as separators.
LETTERS_END = 0x32400
#: Texts are cut into pieces of so many characters for processing; a word at a cut counts as two.
PIECE_CHARS = 1_000_000
WORD = 63  # languages per mask word; the sign bit stays free
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageFilter:
    """The fitted model; its size depends on the parameters of ``fit`` only."""

    languages: tuple[str, ...]
    slots: np.ndarray  # int64[words, slots]: one bit per language
    false_positive: np.ndarray  # float64[languages]
    probes: int


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(LETTERS_END)), bool, LETTERS_END)


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams and trigrams of lower-cased letter runs, with the ordinal of their text.

    A run is padded with one blank on either side.  An n-gram is an integer of 21 bits per character.
    """
    joined = "\n" + "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters[np.minimum(code, LETTERS_END - 1)] & (code < LETTERS_END)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    owner = np.append(owner, len(texts) - 1)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    code, is_letter, owner = np.where(is_letter, code, 32)[keep], is_letter[keep], owner[keep]
    # The separator before a text belongs to it: owner runs from each separator to the next.
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    mid = is_letter[1:-1]
    both = is_letter[:-1] & is_letter[1:]
    return np.concatenate([two[both], three[mid]]), np.concatenate([owner[1:][both], owner[1:-1][mid]])


def pieces(texts: list) -> list[tuple[list[int], list[str]]]:
    """Lower-cased texts in groups of bounded size: (row of each piece, piece)."""
    out, rows, held, size = [], [], [], 0
    for row, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, max(1, len(low)), PIECE_CHARS):
            piece = low[at : at + PIECE_CHARS]
            if size + len(piece) > PIECE_CHARS and held:
                out.append((rows, held))
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(piece)
            size += len(piece) + 1
    return [*out, (rows, held)] if held else out


def slot_of(gram: np.ndarray, probe: int, slots: int) -> np.ndarray:
    """Multiplicative hashing; the shift takes the high bits, slots being a power of two."""
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * probe + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = gram.astype(np.uint64) * odd
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def fit(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = 4_000,
    grams_per_language: int = 50_000,
    relative_rate: float = 0.1,
    bits: int = 16,
    probes: int = 4,
) -> LanguageFilter:
    """Fit the filter on rows with text and language.

    Bounds, as documented parameters: about ``rows_per_language`` rows of each language, chosen by a hash of the id, and
    the ``grams_per_language`` most frequent n-grams of each.  An n-gram belongs to a language if its rate there is at
    least ``relative_rate`` of its highest rate in any language, which keeps out quotations.  Repeated rows count as
    often as they occur; null texts and languages are ignored; without any row the filter knows no language.
    """
    known = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageFilter((), np.zeros((1, 2), np.int64), np.zeros(0), probes)
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, rows_per_language / sizes[name]).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_003)) / 1_000_003
    schema = "lang string, gram long, n long"

    def count(batches):
        letters, seen = letter_table(), {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for rows, held in pieces(batch.column("text").to_pylist()):
                gram, owner = grams(held, letters)
                tag = np.array([languages.index(names[r]) for r in rows])[owner]
                for k in np.unique(tag):
                    value, n = np.unique(gram[tag == k], return_counts=True)
                    seen.setdefault(int(k), []).append((value, n))
                    if len(seen[int(k)]) > 16:
                        seen[int(k)] = [_merged(seen[int(k)])]
        for k, parts in seen.items():
            value, n = _merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([languages[k]] * len(value)), pa.array(value), pa.array(n)], names=["lang", "gram", "n"]
            )

    counted = known.where(draw < share).select("lang", "text").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Windows over n-grams of the bounded sample only.
    total = Window.partitionBy("lang")
    rated = counted.withColumn("rate", F.col("n") / F.sum("n").over(total))
    top = F.row_number().over(total.orderBy(F.desc("n"), "gram"))
    chosen = rated.withColumn("place", top).where(F.col("place") <= grams_per_language)
    chosen = chosen.withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
    table = chosen.where((F.col("rate") >= relative_rate * F.col("best")) & (F.col("n") > 1)).select("lang", "gram").toArrow()
    gram = table.column("gram").to_numpy()
    owner = np.array([languages.index(x) for x in table.column("lang").to_pylist()], np.int64)
    most = max(np.bincount(owner, minlength=len(languages)), default=1)
    slots = 1 << max(10, int(bits * most - 1).bit_length())
    mask = np.zeros(((len(languages) + WORD - 1) // WORD, slots), np.int64)
    for probe in range(probes):
        where = slot_of(gram, probe, slots)
        for k in range(len(languages)):
            np.bitwise_or.at(mask[k // WORD], where[owner == k], np.int64(1) << np.int64(k % WORD))
    filled = np.array([np.count_nonzero(mask[k // WORD] >> (k % WORD) & 1) / slots for k in range(len(languages))])
    return LanguageFilter(languages, mask, filled**probes, probes)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def hits_by_language(model: LanguageFilter, gram: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """float64[texts, languages]: n-grams of each text that each language contains, by the filter."""
    slots = model.slots.shape[1]
    at = [slot_of(gram, probe, slots) for probe in range(model.probes)]
    out = np.zeros((texts, len(model.languages)))
    for word, plane in enumerate(model.slots):
        found = plane[at[0]]
        for where in at[1:]:
            found = found & plane[where]
        for k in range(word * WORD, min(len(model.languages), (word + 1) * WORD)):
            out[:, k] = np.bincount(owner[(found >> (k % WORD) & 1).astype(bool)], minlength=texts)
    return out


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` to every row, whatever other columns there are.

    ``score`` is the share of the text's n-grams that the language contains, corrected for false positives.  Null texts,
    texts without a letter and a filter without languages give ``und`` and 0.  Ties go to the language first in order.
    Every row is judged by its whole text alone, so repeated rows agree.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # a plain dict, as the workers may lack the package
    position = docs.drop("lang_pred", "score").columns.index(text)

    def make():
        letters, model = letter_table(), LanguageFilter(**shared.value)

        def compute(batch: pa.RecordBatch) -> list:
            texts = batch.column(position).to_pylist()
            hits, n = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
            for rows, held in pieces(texts):
                gram, owner = grams(held, letters)
                np.add.at(hits, rows, hits_by_language(model, gram, owner, len(rows)))
                np.add.at(n, rows, np.bincount(owner, minlength=len(rows)))
            if not model.languages:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
            # A language's hits are true ones plus false positives among the rest.
            true = np.maximum(0, hits - n[:, None] * model.false_positive) / (1 - model.false_positive)
            best = true.argmax(axis=1)
            score = np.where(n > 0, true.max(axis=1) / np.maximum(n, 1), 0)
            names = [model.languages[k] if c else UNKNOWN for k, c in zip(best.tolist(), n.tolist())]
            return [pa.array(names, pa.string()), pa.array(np.minimum(1, score))]

        return compute

    return map_arrow(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
