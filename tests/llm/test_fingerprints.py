"""Fingerprints against a tree built in Python, and where they say that texts differ."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lacuna.llm import fingerprints

BLANK = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaves(paragraph: str) -> list[str]:
    """Up to four words of 64 characters, ended by punctuation; blanks belong to the word before, at the start to the first."""
    out, at = [], 0
    while at < len(paragraph):
        words, k = 0, at
        while k < len(paragraph) and paragraph[k] in BLANK:
            k += 1
        if k == len(paragraph):
            out.append(paragraph[at:])
            break
        while True:
            start = k
            while k < len(paragraph) and paragraph[k] not in BLANK and k - start < 64:
                k += 1
            whole = k == len(paragraph) or paragraph[k] in BLANK
            last, words = paragraph[k - 1], words + 1
            end = k
            while end < len(paragraph) and paragraph[end] in BLANK:
                end += 1
            more = whole and end > k and words < 4 and last not in ".!?,;:" and end < len(paragraph)
            k = end
            if not more:
                break
        out.append(paragraph[at:k])
        at = k
    return out


def tree(text: str) -> str:
    sections = re.findall(r"(?:[^\n]|\n[^\n])+\n*|\n+", text)
    parts, digests = [], []
    for section in sections:
        inner, own = [], []
        for paragraph in re.findall(r"[^\n]*\n|[^\n]+", section):
            cut = leaves(paragraph)
            assert "".join(cut) == paragraph
            low = [sha(x) for x in cut]
            own.append(sha("".join(low)))
            inner.append(own[-1][:8] + "=" + ",".join(x[:6] for x in low))
        digests.append(sha("".join(own)))
        parts.append("|" + digests[-1][:8] + ":" + ";".join(inner))
    return sha("".join(digests)) + "".join(parts)


def like(a: str, b: str) -> float:
    if a[:64] == b[:64]:
        return 1.0
    x, y = (set(re.findall(r"[=,]([0-9a-f]{6})", t)) for t in (a, b))
    return 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def texts_of(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    words = ["ab", "cd.", "e,", "éß", "\U0001f600", "x" * 63, "y" * 64, "z" * 65, "w" * 200 + ".", "...", "1:"]
    gaps = [" ", " ", " ", "  ", "\t", "\n", "\n\n", "\n \n", "\n\n\n", "\r\n", " "]
    return ["".join(rnd.choice(["", *gaps]) + rnd.choice(words) for _ in range(rnd.randrange(40))) + rnd.choice(["", "\n", "\n\n", " "]) for _ in range(n)]


def test_tree_equals_python(spark):
    texts = ["", " ", "\n", "\n\n\n", "a", "a\n", "\na\n\n\n b", *texts_of(1, 300)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    for row in fingerprints.with_fingerprint(docs).collect():
        assert row["fingerprint"] == tree(row["text"]), row["text"]


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for k, (doc_id, text, _) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + follower[:quarter]
        own, other = tree(text), tree(edited)
        out.append((doc_id, len(text), sha(edited), own, other, like(own, other), like(own, tree(follower))))
    return sorted(out, key=repr)


def compared(spark, docs):
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    want = brute([tuple(r) for r in hashed.collect()])
    got = fingerprints.compare_with_edits(docs)
    assert sorted((tuple(r) for r in got.drop("changed").collect()), key=repr) == want
    return got


def test_edits_against_brute_force(spark):
    rnd = random.Random(9)
    texts = texts_of(2, 120)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, *texts])) for _ in range(150)] + [(5, texts[3])] * 40
    compared(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    compared(spark, spark.createDataFrame(rows[:1], "doc_id long, text string"))


def test_odd_tables(spark, odd, none):
    clash = odd.withColumnsRenamed({"items": "next", "host": "hash", "removed": "_at", "score": "fingerprint"})
    assert compared(spark, clash).count() == odd.count()
    assert fingerprints.compare_with_edits(none).collect() == []
    kept = fingerprints.with_fingerprint(clash)
    assert kept.columns == clash.columns and kept.where("fingerprint IS NULL").isEmpty()


def test_differing_branches_locate_edits(spark):
    text = "One line here.\nA second line.\n\nNext section, first.\nIts second line.\n"
    cases = [
        (text, text, []),
        (text, text.replace("second line.\n\n", "changed line.\n\n"), [(0, 1)]),
        (text, text.replace("Its second", "Its other"), [(1, 1)]),
        (text, "", [(0, 0), (0, 1), (1, 0), (1, 1)] if "\n\n" not in text[:29] else None),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    found = rows.select("k", fingerprints.changed_paragraphs(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("at"))
    got = {r["k"]: [tuple(x) for x in r["at"]] for r in found.collect()}
    assert got[0] == [] and got[1] == [(0, 1)] and got[2] == [(1, 1)] and set(got[3]) >= {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_no_python_in_the_plan(spark, odd):
    plan = fingerprints.compare_with_edits(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
