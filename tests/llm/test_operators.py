"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, graph, jaccard, langid, linededup, linequality, packing, puquality, sharding, urlrules, warc


def by(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# URL rules


def test_url_rules(spark):
    rules = spark.createDataFrame(
        [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("a.example.net", "/en/", "block"), ("a.example.net", None, "allow"), ("", "/", "block"), (None, "/x", "block"), ("org", "/", "allow"), ("org", "/", "block")],
        "host string, path string, verdict string",
    )
    urls = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "http://NET/": ("net", "/", "net/", "block"), "http://net": ("net", "", None, "allow"), "http://planet/": ("planet", "/", None, "allow"),
        "https://x.example.net/en/1?q#f": ("x.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/eN/": ("example.net", "/eN/", "net/", "block"),
        "http://b.a.example.net/en/": ("b.a.example.net", "/en/", "a.example.net/en/", "block"), "http://a.example.net?/en/": ("a.example.net", "", "a.example.net", "allow"),
        "ftp://w.org/x": ("w.org", "/x", "org/", "block"), "http://example.net.evil.com/": ("example.net.evil.com", "/", None, "allow"), "http://a..net/": ("a..net", "/", "net/", "block"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    for cells in (1, 3, 50):
        got = urlrules.judge(pages, rules, cells=cells).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]], r["url"]
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_url_rules_spread_a_hot_host(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.net/"), F.col("id")).alias("url"))
    rules = spark.createDataFrame([("net", "/1", "block")], "host string, path string, verdict string")
    got = urlrules.judge(pages, rules, cells=7).collect()
    assert all((r["verdict"] == "block") == str(r["page_id"]).startswith("1") for r in got)


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://b.example/x", "same"), (9, "http://a.example/\r\ny", "same"), (9, "http://a.example/\r\ny", "same"), (None, None, "same"), (2, "http://b.example/x", None), (3, "", ""), (4, "http://c/ü", "Wörter\r\n\r\nWARC/1.1" * 500)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    records, index = warc.archive(pages, str(tmp_path / "warc"))
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    last = {"same": 9, "": 3, rows[-1][2]: 4}
    want = [(i, len((h or "").encode()), digest(h), "response" if i == last[h or ""] else "revisit", None if i == last[h or ""] else last[h or ""]) for i, _, h in rows]
    assert by(records.collect(), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    merged = index.orderBy("range").collect()
    ordered = [(r["range"], r["urlkey"], r["captured"]) for r in merged]
    assert ordered == sorted(ordered) and len(merged) == len(rows)
    empty, _ = warc.archive(pages.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0


def test_merge_of_many_runs_is_globally_ordered(spark):
    runs = spark.range(4000).select(
        F.col("id").cast("string").alias("page_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("urlkey"), (F.col("id") * 7 % 101).alias("captured"),
        F.concat(F.lit("run"), F.col("id") % 5).alias("run"), F.lit("f").alias("file"), F.col("id").alias("position"), F.lit(1).cast("long").alias("size"), F.lit("response").alias("record_type"),
    )
    merged = warc.merge_runs(runs, range_records=300)
    parts = [r for r in merged.withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()]
    keys = [(r["urlkey"], r["captured"], r["page_id"]) for r in parts]
    assert keys == sorted(keys) and len({r["range"] for r in parts}) > 8
    assert max(Counter(r["range"] for r in parts).values()) < 1500


def test_small_payloads_are_never_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.archive(pages, str(tmp_path / "w"), least_bytes=3)[0].collect()} == {"response"}


# Decontamination


def test_decontamination(spark, odd, none):
    bench = [(1, "It has two"), (2, None), (3, ""), (4, "word5 and word6 and word7 and word8 and word9 and word10 and word11 and word12"), (4, "x"), (None, "x"), (5, "X")]
    benchmark = spark.createDataFrame([(*b, "clash") for b in bench], "item_id long, text string, items string")
    for block in (1 << 20, 1):  # one block, and a block for each item or so
        got = decontaminate.find_contamination(odd, benchmark, block_bytes=block).collect()
        assert len(got) == odd.count() and got[0].asDict().keys() >= {"shard", "hit_spans"}
        found = {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got if r["doc_id"] != 5}
        assert found == {(1, 7, 3, ("1",)), (2, 0, 0, ()), (3, 0, 0, ()), (4, 0, 0, ()), (None, 7, 0, ()), (6, 1, 1, ("4", "5")), (7, 1, 1, ("4", "5")), (-8, 3, 0, ())}
        long = next(r for r in got if r["doc_id"] == 5)
        assert long["n_hit"] == 15 * 61 and long["n_items"] == 1
        first = next(r for r in got if r["doc_id"] == 1)
        assert [first["text"].encode()[a:b] for a, b in first["hit_spans"]] == [b"It has two"]
    assert decontaminate.find_contamination(none, benchmark).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.find_contamination(odd, benchmark.limit(0)).collect())


# Line dedup

PASSAGE = "One sentence stands here. Another one follows it closely. A third sentence has some words more. Then a fourth comes along with it. The fifth is the last of them all."


def test_line_dedup(spark, odd, none):
    rows = [(10, f"Start of ten.\n{PASSAGE}\nEnd of ten."), (11, f"Another text begins. It goes on.\n{PASSAGE}"), (12, f"{PASSAGE}\n{PASSAGE}"), (13, "Short. Line.\nIts own."), (14, "Short. Line.\nIts own words.")]
    lines = "\n".join(f"line number {i} of a poem without sentences" for i in range(20))
    rows += [(20, lines), (21, f"prose before\nand more\n{lines}\nand after")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.remove_repeated(odd.unionByName(more, allowMissingColumns=True)).collect()}
    assert got[10]["text"] == rows[0][1] and not got[10]["removed"]
    assert got[11]["text"].split() == "Another text begins. It goes on.".split()
    assert got[12]["text"] == "" and got[13]["text"] == rows[3][1] and got[14]["text"] == rows[4][1]
    assert got[20]["text"] == lines and len(got[21]["text"]) < 0.5 * len(rows[-1][1]) and got[21]["text"].endswith("and after")
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == " \t\n " and got[1]["shard"] == 7
    raw = rows[1][1].encode()
    assert b"".join(raw[a:b] for a, b in got[11]["removed"]).decode().strip() == PASSAGE
    assert linededup.remove_repeated(odd).count() == odd.count() and linededup.remove_repeated(none).count() == 0


def test_line_dedup_against_brute_force(spark):
    """All planted paragraphs stay once; everything else stays."""
    rows = [(i, f"Own words {i} stand here. They are {i * 7} in number.\n{PASSAGE if i % 3 else PASSAGE.replace('fourth', 'next')}\nThe end of text {i}.") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in linededup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    seen: dict[bytes, int] = {}
    for i, text in rows:
        raw = text.encode()
        parts = linededup.chunks(raw)
        late = {k for k, (a, b, _, _) in enumerate(parts) if seen.setdefault(raw[a:b], (i, k)) != (i, k)}
        spans = linededup.removed_spans(parts, late, len(raw), 30, 2)
        want = raw
        for a, b in reversed(spans):
            want = want[:a] + want[b:]
        assert got[i] == want.decode()


# Quality


def test_pu_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = puquality.fit(odd, labels)
    assert model.prior == pytest.approx(2 / 3)
    got = puquality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert puquality.score(none, model).count() == 0
    assert puquality.fit(none, labels.limit(0)).score(puquality.features(puquality.pa.array(["a"]))).tolist() == [0.5]


def test_pu_quality_on_held_out_rows(spark):
    from lacuna.llm.queries import op5_pu_quality

    folder = "/root/testdata/sf0.01"
    rows = op5_pu_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.93 * len(rows)


# Jaccard join


def test_jaccard_of_odd_rows(odd, none):
    got = by(jaccard.jaccard_components(odd).collect(), "doc_id", "n_shingles", "component_id", "n_copies")
    want = [(1, 5, 1, 1)] * 2 + [(2, 0, 2, 0), (3, 0, 3, 0), (4, 0, 4, 0), (5, 1995, 5, 0), (None, 5, None, 0), (6, 1, 6, 1), (7, 1, 6, 1), (-8, 4, -8, 0)]
    assert got == sorted(want, key=repr)
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_against_brute_force(spark):
    """Chains of near copies, whose ends link only through others, and families below the threshold."""
    import random

    rnd, rows = random.Random(2), []
    for family in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([12, 80, 200]))]
        for _ in range(rnd.choice([1, 4, 25])):
            base = list(base)
            base[rnd.randrange(len(base))] = f"n{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(base) + rnd.choice(["", "  ", "\n"])))
    shingles = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in rows)}
    least = {i: i for i in shingles}
    for _ in shingles:
        for i, a in shingles.items():
            for j, b in shingles.items():
                if 100 * len(a & b) >= 90 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least and len(set(least.values())) < len(rows)


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 3), (9, 8), (5, 5)] + [(k, k + 1) for k in range(100, 140)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 141)} | {k: 200 for k in range(200, 230)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Language


def test_language(spark, odd, none):
    model = langid.fit(odd)
    assert model.languages == ("de", "en")
    got = langid.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (2, 3, 4)} == {"und"} and {r["score"] for r in got if r["doc_id"] in (2, 3, 4)} == {0.0}
    assert {(r["doc_id"], r["lang_pred"]) for r in got} >= {(1, "en"), (5, "en"), (None, "de")}
    assert langid.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_language_on_held_out_rows(spark):
    from lacuna.llm.queries import op7_language

    folder = "/root/testdata/sf0.01"
    rows = op7_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) > 0.95 * len(rows)


# Packing


def test_packing(odd, none):
    public = pytest.importorskip("public_tokenizers")
    rows = packing.pack(odd, "word_bpe_49k.json", 2).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = sorted([len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect()])
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want and sum(r["length"] for r in rows) == sum(want)
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
    x = [r for r in rows if r["doc_id"] == 6]
    ids = [*tokenizer.encode("x", add_special_tokens=False).ids, 2]
    assert len(x) == 1 and x[0]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert packing.pack(none, "word_bpe_49k.json", 2).count() == 0


# Line frequency


def test_line_quality(spark, odd, none):
    got = {r["doc_id"]: r for r in linequality.judge(odd).collect()}
    assert [got[2][c] for c in ("n_words", "word_chars", "n_dup_lines", "base_failed", "kept")] == [0, 0, 0, True, False]
    assert got[-8]["word_chars"] == 5 + 3 + 1 + 1 + 1 + 2 and got[5]["n_repeat_words"] == 119_999  # all but the last, which has a full stop
    assert linequality.judge(odd).count() == odd.count() and linequality.judge(none).count() == 0
    footer = "all rights reserved by the host of these pages"
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(30))
    rows = [(i, f"{own(i)}\n{footer.upper() if i % 2 else footer}", "h1") for i in range(12)] + [(50, f"a b c d e f\n{footer}", "h1"), (51, f"a b c d e f\n{footer}", "h2")]
    rows += [(60 + i, f"{own(99)}\n{own(98)}", "h1") for i in range(20)]  # copies count once
    got = {r["doc_id"]: r for r in linequality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_left=0.5).collect()}
    assert got[0]["n_left"] == 30 and got[0]["kept"] and not got[50]["kept"] and got[50]["n_left"] == 6 and got[51]["kept"]
    assert all(got[60 + i]["kept"] for i in range(20))


# Sharding


def test_sharding(spark, odd, none):
    rows = sharding.assign(odd, 3).collect()
    assert len(rows) == odd.count()
    for shard in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    null = next(r for r in rows if r["doc_id"] == 2)
    assert (null["size"], null["text_crc32"], null["law"]) == (16, 0, "key")
    assert sharding.assign(none, 3).count() == 0
    hot = spark.range(5000).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert sorted(r["slot"] for r in sharding.assign(hot, 40).collect()) == list(range(5000))
    named = sharding.with_shards(spark.createDataFrame([("a",), (None,)], "k string"), "k", {"shard": 5})
    assert {r["shard"] for r in named.collect()} <= set(range(5))


def test_written_shards(odd, tmp_path):
    sharding.write_shards(odd, 4, str(tmp_path / "shards"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == odd.count() and set(back.columns) == set(odd.columns)
