"""Every registered query: name -> callable(spark, folder of Parquet tables) -> DataFrame."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lacuna.functions import column_rules, wire
from lacuna.functions.patterns import PATTERNS, hits, luhn_valid, scrub
from lacuna.operators import audit as audits
from lacuna.operators import catalog, detect, discover, governed, screen
from lacuna.operators.detect import Span
from lacuna.operators.findings import cut, findings
from lacuna.operators.redact import (
    apply_rules,
    column_rule_counts,
    redact,
    redact_text,
    redact_with_hits,
    redaction_counts,
    text_hits,
)
from lacuna.operators.sessions import sessions
from lacuna.plans import derived
from lacuna.policy import ColumnRule, Governance, PatternToggles, ReadPolicy, RedactPolicy
from lacuna.sources.audit_log import append_audit, parse_audit_lines, read_audit, stream_to_audit
from lacuna.sources.registry import Sources
from lacuna.sources.sizing import shared_folder, spread_small
from lacuna.streaming.audit_stream import (
    closing_entry,
    late_entries,
    read_appended,
    read_rollup,
    write_closed_rollup,
    write_matches,
    write_rollup,
    write_sessions,
    write_without_replays,
)
from lacuna.streaming.redact_stream import observed_counts, read_redacted, write_redacted, write_redacted_by_source

# The stand-in models below travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")
NO_TEXT = ("embeddings", "labels")
PII_TABLES = ("contacts", "users")
SALT = "pepper"
ALL = PatternToggles.all()
CONTACT_POLICY = RedactPolicy(
    rules=(
        ColumnRule("full_name"),
        ColumnRule("email", "hash"),
        ColumnRule("ssn", "partial", 4),
        ColumnRule("card", "null"),
    ),
    patterns=ALL,
    salt=SALT,
)
SCREEN_POLICY = ReadPolicy(pii_tables=PII_TABLES)


def query(fn: Callable[[Sources], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Sources.from_parquet(spark, folder, TABLES))

    QUERIES[fn.__name__] = run
    return run


def _contacts(t: Sources) -> DataFrame:
    return derived.contacts(spread_small(t["customer"]))


def _events(t: Sources) -> DataFrame:
    return spread_small(t["events"].select("event_id", "ts"))


def _documents(t: Sources, *columns: str) -> DataFrame:
    return spread_small(t["documents"].select("doc_id", *columns, "text"))


# ---------------------------------------------------- scans, sources, sinks


@query
def bounded_read(t: Sources) -> DataFrame:
    return governed.bounded_read(t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus"), 1000, ["o_orderkey"])


@query
def bounded_read_flag(t: Sources) -> DataFrame:
    return governed.bounded_read_flag(t["orders"], 1000)


@query
def wire_values(t: Sources) -> DataFrame:
    e = t["events"]
    typed = e.select(
        "event_id",
        "ts",
        "event_type",
        "value",
        F.col("value").cast("decimal(12,2)").alias("price"),
        F.to_date("ts").alias("day"),
        F.col("props").cast("binary").alias("raw"),
        F.array("ts", F.lit(None).cast("timestamp_ntz")).alias("times"),
        F.struct(F.col("user_id"), F.to_date("ts").alias("day")).alias("who"),
        F.create_map(F.col("event_type"), F.col("ts")).alias("seen"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("maybe"),
    )
    return wire.wire_json(typed)


@query
def outcome_payload(t: Sources) -> DataFrame:
    return audits.outcome_payload(_governed_contacts(t).outcome).select("payload")


@query
def outcome_rows(t: Sources) -> DataFrame:
    """The rows that go with the payload, each as JSON."""
    return wire.wire_json(_governed_contacts(t).rows)


def _governed_contacts(t: Sources) -> governed.GovernedResult:
    governance = Governance(read=ReadPolicy(pii_tables=PII_TABLES, max_rows=200), redact=CONTACT_POLICY)
    columns = ["contact_id", "full_name", "email", "ssn", "note"]
    return governed.govern({"prod": {"contacts": _contacts(t)}}, governance, "prod", "contacts", columns, ["contact_id"])


@query
def governed_audit(t: Sources) -> DataFrame:
    """Audit rows of allowed, blocked and failed reads of two sources with limits of their own."""
    governance = Governance(
        read=ReadPolicy(pii_tables=PII_TABLES, max_rows=120),
        redact=CONTACT_POLICY,
        overrides={"prod": {"read": {"max_rows": 40}}},
    )
    tables = {"contacts": _contacts(t), "orders": t["orders"]}
    sources = {"prod": tables, "staging": tables}
    runs = []
    for database in sources:
        runs += [
            governed.govern(sources, governance, database, "contacts", ["contact_id", "email", "note"], ["contact_id"]),
            governed.govern(sources, governance, database, "contacts", ["*"]),
            governed.govern(sources, governance, database, "contacts", ["contact_id", "no_such_column"]),
            governed.govern(sources, governance, database, "visits", ["id"]),
        ]
    rows = audits.audit_rows(reduce(DataFrame.unionAll, [r.outcome.drop("result_columns") for r in runs]))
    return rows.drop("ts", "duration_ms")


@query
def outcome_status_payloads(t: Sources) -> DataFrame:
    return audits.outcome_payload(derived.outcomes(_events(t))).select("query_id", "payload")


def _audit(t: Sources) -> DataFrame:
    return audits.audit_rows(derived.outcomes(_events(t)))


_AUDIT_NTZ = (
    "query_id bigint, ts timestamp_ntz, database string, status string, sql string, reason string, "
    "error string, rows bigint, redactions bigint, truncated boolean, duration_ms double"
)


def _iso(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@query
def audit_roundtrip(t: Sources) -> DataFrame:
    path = shared_folder(t.spark, "audit")
    append_audit(_audit(t), path)
    return _iso(read_audit(t.spark, path, _AUDIT_NTZ))


def _audit_lines(t: Sources) -> DataFrame:
    k = F.col("query_id")
    line = wire.wire_json(_audit(t).where(k % 17 != 0), "value")
    bad = derived.outcomes(_events(t)).where(k % 17 == 0)
    broken = F.when(k % 2 == 0, "   ").otherwise(F.concat(F.lit('{"query_id": '), k.cast("string"), F.lit(', "ts": ')))
    mistyped = F.concat(F.lit('{"query_id": '), k.cast("string"), F.lit(', "rows": "many", "duration_ms": [1], "status": "odd"}'))
    return line.unionAll(bad.select(F.when(k % 3 == 0, mistyped).otherwise(broken).alias("value")))


@query
def audit_parse(t: Sources) -> DataFrame:
    return _iso(parse_audit_lines(_audit_lines(t), schema=_AUDIT_NTZ)).select("query_id", "ts", "status", "duration_ms")


@query
def table_inventory(t: Sources) -> DataFrame:
    return catalog.table_inventory(t.frames())


@query
def column_profile(t: Sources) -> DataFrame:
    return catalog.profile_tables({n: spread_small(df) for n, df in t.frames().items()}, exact=True)


@query
def profile_incremental(t: Sources) -> DataFrame:
    """Profiles of two halves of every table, kept one after the other and merged, against the exact profile."""
    folder = shared_folder(t.spark, "profile")
    for half in (0, 1):
        own = F.pmod(F.xxhash64("c0"), F.lit(2)) == half
        parts = []
        for table, df in t.frames().items():
            named = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).where(own).toDF(*df.columns)
            parts.append(catalog.profile_sketches(named, table))
        catalog.keep_profile(reduce(DataFrame.unionAll, parts), folder, str(half))
    kept = catalog.profile_of(catalog.kept_sketches(t.spark, folder))
    exact = catalog.profile_tables({n: spread_small(df) for n, df in t.frames().items()}, exact=True)
    exact = exact.select("table_name", "ordinal", F.col("distinct_values").alias("exact"))
    near = F.abs(F.col("distinct_values") - F.col("exact")) <= 1 + 0.033 * F.col("exact")  # four standard errors
    both = kept.join(exact, ["table_name", "ordinal"])
    return both.select("table_name", "ordinal", "column_name", "nulls", "max_length", near.alias("distinct_ok"))


# ------------------------------------------------------------ column rules


@query
def redact_mask(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "full_name", "email")
    return apply_rules(c, RedactPolicy(rules=(ColumnRule("full_name"), ColumnRule("email", "mask"))))


@query
def redact_null(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "email", "nationkey")
    return apply_rules(c, RedactPolicy(rules=(ColumnRule("email", "null"), ColumnRule("nationkey", "null"))))


@query
def redact_hash(t: Sources) -> DataFrame:
    return _contacts(t).select("contact_id", column_rules.hash_token(F.col("email")).alias("email"))


@query
def redact_hash_salted(t: Sources) -> DataFrame:
    rules = (ColumnRule("email", "hash"), ColumnRule("c_key", "hash"), ColumnRule("day", "hash"))
    o = t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_key"), F.to_date("o_orderdate").alias("day"))
    return apply_rules(o, RedactPolicy(rules=rules, salt=SALT, digits=16))


@query
def redact_partial(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "ssn", "phone", F.col("contact_id").alias("number"))
    rules = (ColumnRule("ssn", "partial"), ColumnRule("phone", "partial", 7), ColumnRule("number", "partial", 2))
    return apply_rules(c, RedactPolicy(rules=rules))


@query
def redact_partial_short(t: Sources) -> DataFrame:
    c = _contacts(t)
    keeps = {"none": 0, "negative": -3, "exact": 11, "long": 40, "one": 1}
    return c.select("contact_id", *[column_rules.partial(F.col("ssn"), k).alias(n) for n, k in keeps.items()])


@query
def redact_rules_resolve(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", F.col("email").alias("EMail"), F.col("ssn").alias("Ssn"), "phone", "note")
    rules = (
        ColumnRule("email", "hash"),
        ColumnRule("EMAIL", "partial", 3),
        ColumnRule("ssn"),
        ColumnRule("unused", "null"),
    )
    return apply_rules(c, RedactPolicy(rules=rules)).select(
        "contact_id", F.col("EMail").alias("mail"), F.col("Ssn").alias("number"), "phone", "note"
    )


@query
def redact_column_counts(t: Sources) -> DataFrame:
    return column_rule_counts(_contacts(t), CONTACT_POLICY.rules)


# ------------------------------------------------------------ text patterns


def _one_pattern(name: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Sources.from_parquet(spark, folder, TABLES)
        p = PATTERNS[name]
        docs = _documents(t).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        notes = _contacts(t).select(F.lit("contacts"), "contact_id", F.concat_ws(" | ", "note", "ssn", "card", "ip"))
        both = docs.unionAll(notes)
        found = both.select("origin", "id", scrub("text", p).alias("scrubbed"), hits("text", p).alias("hits"))
        return found

    QUERIES[f"pattern_{name}"] = run


for _name in PATTERNS:
    _one_pattern(_name)


@query
def luhn_filter(t: Sources) -> DataFrame:
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERNS["card"].regex), F.lit(0))
    each = _documents(t).select("doc_id", F.posexplode(found).alias("pos", "candidate"))
    return each.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "candidate", F.expr(luhn_valid("candidate")).alias("valid")
    )


@query
def pattern_cascade(t: Sources) -> DataFrame:
    return redact_text(_documents(t), "text", ALL)


@query
def pattern_toggles(t: Sources) -> DataFrame:
    default = text_hits(_documents(t), "text")
    return default.select("doc_id", F.md5("text").alias("text_md5"), "hits")


def _hit_columns(df: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in (*[f"{p}_hits" for p in PATTERNS], "hits")]


@query
def pattern_counts(t: Sources) -> DataFrame:
    parts = []
    for table, key, text in (
        ("documents", "doc_id", "text"),
        ("pages", "page_id", "html"),
        ("conversations", "conv_id", "text"),
        ("benchmark", "item_id", "text"),
    ):
        df = spread_small(t[table].select(F.col(text).alias("text")))
        counted = text_hits(df, "text", ALL)
        parts.append(counted.agg(*_hit_columns(counted)).select(F.lit(table).alias("table_name"), "*"))
    return reduce(DataFrame.unionAll, parts)


@query
def pattern_counts_by_lang(t: Sources) -> DataFrame:
    counted = text_hits(_documents(t, "lang"), "text", ALL)
    return counted.groupBy("lang").agg(*_hit_columns(counted))


# ------------------------------------------------------------ full redactor


@query
def redact_full(t: Sources) -> DataFrame:
    return redact_with_hits(_contacts(t), CONTACT_POLICY)


@query
def redact_full_counts(t: Sources) -> DataFrame:
    return redaction_counts(_contacts(t), CONTACT_POLICY)


@query
def redact_rescan_hashed(t: Sources) -> DataFrame:
    policy = replace(CONTACT_POLICY, rescan_hashed=True)
    return redact(_contacts(t).select("contact_id", "email", "note"), policy)


@query
def redact_nested(t: Sources) -> DataFrame:
    """Strings inside an array, a struct and a map are scanned too."""
    c = _contacts(t).select(
        "contact_id",
        F.array("note", "ip", F.lit(None).cast("string")).alias("items"),
        F.struct("phone", F.col("nationkey").alias("area")).alias("reach"),
        F.create_map(F.lit("card"), F.col("card"), F.lit("mail"), F.col("email")).alias("props"),
    )
    done = redact_with_hits(c, RedactPolicy(patterns=ALL))
    return done.select(
        "contact_id",
        F.array_join("items", " | ").alias("items"),
        F.col("reach.phone").alias("phone"),
        F.try_element_at("props", F.lit("card")).alias("card"),
        F.try_element_at("props", F.lit("mail")).alias("mail"),
        "redactions",
    )


@query
def redact_stream(t: Sources) -> DataFrame:
    out, checkpoint, counts = (shared_folder(t.spark, p) for p in ("stream", "checkpoint", "counts"))
    incoming = derived.contacts(t.stream("customer"))
    write_redacted(incoming, CONTACT_POLICY, out, checkpoint, counts).awaitTermination()
    return read_redacted(t.spark, out)


@query
def redact_stream_counts(t: Sources) -> DataFrame:
    out, checkpoint, counts = (shared_folder(t.spark, p) for p in ("stream", "checkpoint", "counts"))
    write_redacted(derived.contacts(t.stream("customer")), CONTACT_POLICY, out, checkpoint, counts).awaitTermination()
    return observed_counts(t.spark, counts)


@query
def pii_findings(t: Sources) -> DataFrame:
    """Every document with its hits, the characters they take, and its text with the spans of the hits cut out."""
    docs = _documents(t)
    found = findings(docs, ["doc_id"], ["text"], ALL, SALT)
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "pattern")
    own = found.groupBy("doc_id").agg(F.collect_list(span).alias("spans"), F.count(F.lit(1)).alias("hits"), F.sum(F.col("stop") - F.col("start")).alias("covered"))
    both = docs.join(own, "doc_id", "left")
    none = F.lit(0).cast("bigint")
    return both.select("doc_id", F.coalesce("hits", none).alias("hits"), F.coalesce("covered", none).alias("covered"), F.expr(cut("text", "spans")).alias("text"))


def _variants(t: Sources) -> DataFrame:
    """Contacts as one value of a shape that no schema tells."""
    c = _contacts(t)
    inner = F.struct("ip", F.array("note", F.lit("a \"quoted\" é\n")).alias("list"), F.create_map(F.lit("1.2.3.4"), "card").alias("map"))
    deep = F.to_json(F.struct(F.array(inner, inner).alias("deep"), "email", F.col("contact_id").alias("n")))
    return c.select("contact_id", F.parse_json(F.when(F.col("contact_id") % 7 != 3, deep)).alias("v"))


@query
def redact_variant(t: Sources) -> DataFrame:
    """Strings inside a VARIANT are scanned at every depth; keys and numbers stay."""
    done = redact_with_hits(_variants(t), RedactPolicy(patterns=ALL))
    return done.select("contact_id", F.to_json("v").alias("v"), "redactions")


@query
def wire_variant(t: Sources) -> DataFrame:
    return wire.wire_json(_variants(t))


# -------------------------------------------------------- free-text backstops

TERMS = {"mary jones": "PERSON", "mary": "PERSON", "London": "LOCATION", "file": "THING", "the": "WORD"}


@query
def dictionary_backstop(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "note")
    return redact_with_hits(c, RedactPolicy(patterns=ALL, free_text=detect.dictionary_backstop(TERMS)))



def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """A term table from the data: long words and opening word pairs of ``benchmark``."""
    words = benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term"))
    pairs = benchmark.select(F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1).alias("term"))
    listed = words.where(F.length("term") >= 10).unionAll(pairs.where(F.col("term") != "")).distinct()
    return listed.select("term", F.lit("TERM").alias("label"))


@query
def dictionary_table(t: Sources) -> DataFrame:
    return detect.replace_terms(_documents(t), "text", benchmark_terms(t["benchmark"]))


def name_detector() -> Callable[[Sequence[str]], list[list[Span]]]:
    """A deterministic stand-in for a model: one name, one place, one weak guess."""
    looked_for = (("mary jones", "PERSON", 0.9), ("twice", "LOCATION", 0.5), ("call", "PERSON", 0.4))

    def find(texts: Sequence[str]) -> list[list[Span]]:
        return [
            [Span(i, i + len(w), label, score) for w, label, score in looked_for if (i := text.find(w)) >= 0]
            for text in texts
        ]

    return find


@query
def detector_backstop(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "note")
    return redact_with_hits(c, RedactPolicy(patterns=ALL, free_text=detect.detector_backstop(lambda: name_detector())))



def stub_rewriter() -> Callable[[str], str]:
    """A deterministic stand-in for a model that fails on some texts and says nothing to others."""

    def rewrite(text: str) -> str:
        if "paid" in text:
            raise TimeoutError("no answer")
        if "on file" in text:
            return "  "
        return text.replace("mary jones", "[name]")

    return rewrite


@query
def backstop_fail_closed(t: Sources) -> DataFrame:
    c = _contacts(t).select("contact_id", "note")
    return redact_with_hits(c, RedactPolicy(patterns=ALL, free_text=detect.rewriter_backstop(lambda: stub_rewriter())))


# ------------------------------------------------------ query-text screening


def _rules(t: Sources) -> DataFrame:
    return screen.rule_columns(derived.query_log(_events(t)), policy=SCREEN_POLICY)


@query
def screen_empty(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", "is_empty")


@query
def screen_parse(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", "parse_error")


@query
def screen_multi(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", "is_multi")


@query
def screen_top(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", "bad_top")


@query
def screen_explain(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", "explain_analyze")


@query
def screen_writes(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", F.array_join("violations", ", ").alias("violations"))


@query
def screen_into(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", F.array_contains("violations", "SELECT INTO").alias("selects_into"))


@query
def screen_lock(t: Sources) -> DataFrame:
    lock = F.exists("violations", lambda v: v.startswith("row-locking"))
    return _rules(t).select("query_id", lock.alias("locks_rows"))


@query
def screen_star_pii(t: Sources) -> DataFrame:
    return _rules(t).select("query_id", F.array_join("star_pii", ", ").alias("star_pii"))


def _screened(t: Sources) -> DataFrame:
    return screen.screen_queries(derived.query_log(_events(t)), policy=SCREEN_POLICY)


@query
def screen_queries(t: Sources) -> DataFrame:
    return _screened(t).select("query_id", "allowed", "rule", "reason")



@query
def screen_by_source(t: Sources) -> DataFrame:
    """prod guards contacts, staging allows any star: the same text passes in one and not in the other."""
    policies = t.spark.createDataFrame(
        [("prod", ["Contacts"], False), ("staging", ["contacts", "users"], True), (None, ["users"], False)],
        "source string, pii_tables array<string>, allow_star boolean",
    )
    judged = screen.screen_by_source(derived.query_log(_events(t)), policies)
    return judged.select("query_id", "database", "allowed", "rule", "reason")


@query
def screen_shapes(t: Sources) -> DataFrame:
    """Verdicts on texts put together from fragments, thousands of shapes."""
    judged = screen.screen_queries(derived.shaped_log(t["events"].select("event_id")), policy=SCREEN_POLICY)
    return judged.select("query_id", "allowed", "rule", "reason")


@query
def screen_as_of(t: Sources) -> DataFrame:
    """Each query judged by the policy that was in force when it ran."""
    log = derived.query_log(_events(t))
    judged = screen.screen_as_of(log, derived.policy_versions(t["events"].select("event_id", "ts")))
    return judged.select("query_id", "database", "allowed", "rule", "reason")


@query
def screen_summary(t: Sources) -> DataFrame:
    return screen.screen_summary(_screened(t), "database")



@query
def governed_select(t: Sources) -> DataFrame:
    return governed.governed_select(
        _contacts(t),
        "contacts",
        ["contact_id", "email", "ssn", "note"],
        ReadPolicy(pii_tables=PII_TABLES, max_rows=500),
        CONTACT_POLICY,
        order_by=["contact_id"],
    )


# ---------------------------------------------------------------- discovery


def _catalog(t: Sources) -> DataFrame:
    return catalog.column_catalog({**t.frames(), "contacts": _contacts(t)}, discover.looks_personal)


@query
def pii_columns_by_name(t: Sources) -> DataFrame:
    return discover.pii_columns_by_name(_catalog(t))


@query
def pii_rule_suggestions(t: Sources) -> DataFrame:
    return discover.pii_rule_suggestions(_catalog(t))


@query
def pii_tables(t: Sources) -> DataFrame:
    return discover.pii_tables(_catalog(t))


def _content(t: Sources) -> DataFrame:
    frames = {n: spread_small(t[n]) for n in TABLES if n not in NO_TEXT}
    return discover.profile_content({**frames, "contacts": _contacts(t)})


@query
def pii_content_profile(t: Sources) -> DataFrame:
    return _content(t)


@query
def pii_policy_suggestions(t: Sources) -> DataFrame:
    return discover.policy_suggestions(_catalog(t), _content(t), threshold=0.02)


@query
def suggested_redaction(t: Sources) -> DataFrame:
    """Contacts redacted by the policy that their own profile suggests."""
    suggestions = discover.policy_suggestions(
        catalog.column_catalog({"contacts": _contacts(t)}, discover.looks_personal),
        discover.content_profile(_contacts(t), "contacts"),
        threshold=0.02,
    )
    return redact(_contacts(t), discover.suggested_policy(suggestions, "contacts", SALT, ALL))


# ---------------------------------------------------------- audit analytics


@query
def audit_status(t: Sources) -> DataFrame:
    o = derived.outcomes(_events(t))
    return o.select("query_id", audits.status(F.col("reason"), F.col("error")).alias("status"))


@query
def audit_rows(t: Sources) -> DataFrame:
    return _iso(_audit(t))


@query
def audit_rollup(t: Sources) -> DataFrame:
    return audits.rollup_by_status(_audit(t))


@query
def audit_last_n(t: Sources) -> DataFrame:
    # Ordered and cut first, so that only these entries are scrubbed.
    newest = audits.newest(derived.outcomes(_events(t)), 30, ties=["query_id"])
    return audits.display(audits.audit_rows(newest), ties=["query_id"])


@query
def audit_top_reasons(t: Sources) -> DataFrame:
    return audits.top_reasons(_audit(t))


@query
def audit_stream_append(t: Sources) -> DataFrame:
    """The audit log written by a stream equals the one written in batch."""
    path, checkpoint = shared_folder(t.spark, "audit"), shared_folder(t.spark, "checkpoint")
    stream_to_audit(audits.audit_rows(derived.outcomes(t.stream("events"))), path, checkpoint).awaitTermination()
    return _iso(read_audit(t.spark, path, _AUDIT_NTZ)).select("query_id", "ts", "status", "sql", "error")


@query
def audit_stream_windowed(t: Sources) -> DataFrame:
    out, checkpoint = shared_folder(t.spark, "windows"), shared_folder(t.spark, "checkpoint")
    incoming = audits.audit_rows(derived.outcomes(t.stream("events"))).withColumn("ts", F.col("ts").cast("timestamp"))
    write_rollup(incoming, out, checkpoint).awaitTermination()
    windows = read_rollup(t.spark, out)
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _replay(parts: dict[str, DataFrame], run: Callable[[dict[str, DataFrame]], Sequence[StreamingQuery]]) -> None:
    """Deliver tables with a column ``delivery`` one delivery after the other, running the streams over what has come.

    Each table is staged once, by delivery.  The last delivery ends with a closing entry.
    """
    spark = next(iter(parts.values())).sparkSession
    inboxes, staged, schemas = {}, {}, {}
    for name, rows in parts.items():
        staged[name], inboxes[name] = shared_folder(spark, f"staged-{name}"), shared_folder(spark, f"inbox-{name}")
        rows.write.partitionBy("delivery").parquet(staged[name])
        schemas[name] = rows.drop("delivery").schema
    arrived = {n: {r["delivery"] for r in spark.read.parquet(p).select("delivery").distinct().collect()} for n, p in staged.items()}
    numbers = sorted(set().union(*arrived.values()))  # a handful of deliveries
    for number in numbers:
        for name, path in staged.items():
            if number in arrived[name]:
                spark.read.schema(schemas[name]).parquet(f"{path}/delivery={number}").write.mode("append").parquet(inboxes[name])
            if number == numbers[-1]:
                closing_entry(spark, schemas[name], query_id=-1).write.mode("append").parquet(inboxes[name])
        streams = {name: spark.readStream.schema(schemas[name]).parquet(path) for name, path in inboxes.items()}
        for query in run(streams):
            query.awaitTermination()


def _shown(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in times})


@query
def audit_stream_watermark(t: Sources) -> DataFrame:
    """Windows given once, when the watermark has passed them, and the entries that came after that, apart."""
    closed, seen, state, counted = (shared_folder(t.spark, n) for n in ("closed", "seen", "state", "counted"))
    entries = derived.delivered(_audit(t).select("query_id", "ts", "database", "status", "redactions"), late=True)
    _replay(
        {"audit": entries},
        lambda s: [write_closed_rollup(s["audit"], closed, state), write_rollup(s["audit"], seen, counted)],
    )
    windows = read_appended(t.spark, closed)
    late = late_entries(read_rollup(t.spark, seen), windows)
    keys = ["window_start", "database", "status"]
    none = F.lit(0).cast("bigint")
    both = windows.withColumn("late", none).unionByName(
        late.select(*keys, none.alias("queries"), none.alias("redactions"), F.col("queries").alias("late"))
    )
    sums = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("queries", "redactions", "late")])
    return sums.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def audit_sessions(t: Sources) -> DataFrame:
    """Runs of entries of a database without a break of half an hour."""
    return _shown(sessions(_audit(t).withColumn("ts", F.col("ts").cast("timestamp"))), "started", "ended")


@query
def audit_sessions_stream(t: Sources) -> DataFrame:
    """The same sessions from a stream, each given once it has ended."""
    out, state = shared_folder(t.spark, "sessions"), shared_folder(t.spark, "state")
    entries = derived.delivered(_audit(t).select("query_id", "ts", "database", "redactions"))
    _replay({"audit": entries}, lambda s: [write_sessions(s["audit"], out, state)])
    return _shown(read_appended(t.spark, out), "started", "ended")


@query
def audit_stream_dedup(t: Sources) -> DataFrame:
    """Entries delivered twice, in one delivery and in a later one, are held once."""
    out, state = shared_folder(t.spark, "once"), shared_folder(t.spark, "state")
    entries = derived.delivered(_audit(t).select("query_id", "ts", "database", "status", "redactions"))
    again = entries.where("query_id % 7 = 0")
    later = entries.where("query_id % 5 = 0").withColumn("delivery", F.col("delivery") + 1)
    inputs = {"audit": entries.unionAll(again).unionAll(later)}
    _replay(inputs, lambda s: [write_without_replays(s["audit"], ["query_id"], out, state)])
    return _shown(read_appended(t.spark, out).where("query_id >= 0"), "ts")


@query
def match_outcomes_stream(t: Sources) -> DataFrame:
    """Two streams: every query with its outcomes within ten minutes, or with none."""
    out, state = shared_folder(t.spark, "matches"), shared_folder(t.spark, "state")
    log = derived.delivered(derived.query_log(_events(t)).select("query_id", "ts", "database"))
    outcomes = derived.delivered(derived.replies(_events(t)))
    _replay({"log": log, "outcomes": outcomes}, lambda s: [write_matches(s["log"], s["outcomes"], out, state)])
    return _shown(read_appended(t.spark, out).where("query_id >= 0"), "ts", "answered")


# ----------------------------------------------------- policies, verification


def source_rules(t: Sources) -> DataFrame:
    """Per-source column rules as a policy table.

    prod hashes the e-mail and drops the phone, staging shows a part of the
    e-mail and masks the rest; the stricter shared rule hides the SSN everywhere.
    """
    rules = [
        ("prod", "EMAIL", "hash", None),
        ("prod", "phone", "NULL", None),
        ("staging", "email", "partial", 6),
        ("staging", "phone", "no such strategy", None),
        ("staging", "nationkey", "mask", None),
        (None, "ssn", "mask", None),
        (None, "ssn", "partial", 4),
    ]
    return t.spark.createDataFrame(rules, "source string, column string, strategy string, keep int")


@query
def redact_by_source(t: Sources) -> DataFrame:
    policy = RedactPolicy(patterns=ALL, salt=SALT)
    return governed.redact_by_source(_contacts(t), "source", source_rules(t), policy=policy)


@query
def redact_by_source_stream(t: Sources) -> DataFrame:
    """Row-level policy on a stream, its rules read from their table for every micro-batch."""
    out, state, listed = (shared_folder(t.spark, n) for n in ("by-source", "state", "rules"))
    source_rules(t).write.parquet(listed)
    policy = RedactPolicy(patterns=ALL, salt=SALT)
    incoming = derived.contacts(t.stream("customer"))
    write_redacted_by_source(incoming, "source", lambda spark: spark.read.parquet(listed), out, state, policy).awaitTermination()
    return read_redacted(t.spark, out)


def _two_sources(t: Sources) -> DataFrame:
    governance = Governance(
        redact=RedactPolicy(rules=(ColumnRule("email", "hash"), ColumnRule("key", "hash")), salt=SALT),
        overrides={"staging": {"redact": {"rules": (ColumnRule("email"),), "patterns": ALL}}},
    )
    c = _contacts(t)
    prod = c.where("source = 'prod'").select(F.col("contact_id").alias("key"), "email", "note")
    staging = c.where("source = 'staging'").select(F.col("contact_id").alias("key"), "email", "note", "ip")
    return governed.redact_sources({"prod": prod, "staging": staging}, governance)


@query
def multi_source_redact(t: Sources) -> DataFrame:
    return _two_sources(t)


@query
def leak_check(t: Sources) -> DataFrame:
    docs = RedactPolicy(patterns=ALL)
    c = discover.leak_check(redact(_contacts(t), CONTACT_POLICY), CONTACT_POLICY, "contacts")
    texts = [discover.leak_check(redact(spread_small(df), docs), docs, n) for n, df in t.frames().items() if n not in NO_TEXT]
    return reduce(DataFrame.unionAll, [c, *texts])


@query
def value_leaks(t: Sources) -> DataFrame:
    """Names that are masked in one column and still stand in another's text."""
    people = derived.tickets(spread_small(t["customer"]))
    policy = RedactPolicy(rules=(ColumnRule("full_name"), ColumnRule("email", "hash")), patterns=ALL, salt=SALT)
    return discover.value_leaks(people, policy, {"tickets": redact(people, policy), "documents": t["documents"].select("text")}, SALT)


@query
def hash_join_integrity(t: Sources) -> DataFrame:
    o = t["orders"].select(F.col("o_custkey").alias("key"))
    c = t["customer"].select(F.col("c_custkey").alias("key"))
    report = discover.hash_join_integrity(o, c, "key", SALT)
    return report.select(*[F.col(n).cast("bigint").alias(n) for n in report.columns])


# -------------------------------------------- composition with Spark's own SQL


@query
def join_then_redact(t: Sources) -> DataFrame:
    o = spread_small(t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"))
    # Each contact is redacted once, not once per order.
    people = redact(_contacts(t).select("contact_id", "email", "note"), CONTACT_POLICY)
    joined = o.join(people, F.col("o_custkey") == F.col("contact_id"))
    return joined.select("o_orderkey", "o_totalprice", "email", "note")


def _hashed(df: DataFrame, key: str, name: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.select(column_rules.hash_token(F.col(key), SALT).alias(name), *rest)


@query
def hash_key_join(t: Sources) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    o = _hashed(t["orders"].select("o_custkey", cents.alias("cents")), "o_custkey", "token")
    # Summed per token before the join, so that a customer with many orders is one row of it.
    per = o.groupBy("token").agg(F.count(F.lit(1)).alias("orders"), F.sum("cents").alias("cents"))
    c = _hashed(t["customer"].select("c_custkey", "c_mktsegment"), "c_custkey", "token")
    return per.join(c, "token").groupBy("c_mktsegment").agg(F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))


@query
def suppression_anti_join(t: Sources) -> DataFrame:
    """Contacts whose hashed key is on neither of two hashed suppression lists."""
    c = _hashed(t["customer"].select("c_custkey", "c_name"), "c_custkey", "token")
    return c.join(_suppressed(t), "token", "left_anti")


def _suppressed(t: Sources) -> DataFrame:
    """Distinct tokens of two lists: customers with a finished order, and those of four nations."""
    finished = _hashed(t["orders"].where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "token")
    nations = _hashed(t["customer"].where("c_nationkey < 4").select("c_custkey"), "c_custkey", "token")
    return finished.unionAll(nations).distinct()


@query
def suppression_semi_join(t: Sources) -> DataFrame:
    """Contacts whose hashed key is on one of the suppression lists."""
    c = _hashed(t["customer"].select("c_custkey", "c_name"), "c_custkey", "token")
    return c.join(_suppressed(t), "token", "left_semi")


@query
def agg_then_redact(t: Sources) -> DataFrame:
    per = (
        t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))
    )
    return redact(per, RedactPolicy(rules=(ColumnRule("o_custkey", "hash"),), salt=SALT))


@query
def hash_key_distinct(t: Sources) -> DataFrame:
    token = column_rules.hash_token(F.col("o_custkey"), SALT)
    return t["orders"].agg(
        F.count_distinct("o_custkey").alias("raw_keys"), F.count_distinct(token).alias("hashed_keys")
    )


@query
def redactions_rollup(t: Sources) -> DataFrame:
    counted = text_hits(_documents(t, "lang", "source"), "text", ALL)
    return counted.rollup("lang", "source").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("docs"))


@query
def topk_per_group_then_redact(t: Sources) -> DataFrame:
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = o.withColumn("place", F.row_number().over(best).cast("bigint")).where("place <= 5")
    return redact(top, RedactPolicy(rules=(ColumnRule("o_custkey", "hash"),), salt=SALT))


@query
def union_sources_redact(t: Sources) -> DataFrame:
    both = _two_sources(t)
    return both.groupBy("database").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("email").alias("emails"),
        F.count("ip").alias("ips"),
    )
