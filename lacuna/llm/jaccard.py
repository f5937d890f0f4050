"""Jaccard join of documents on word n-grams with rare-first prefix filtering.

1. Every document becomes the set of its shingles' 64-bit hashes.  Documents with equal sets are one node from here on.
2. Shingles are ordered rare-first, by the count of their bucket over the whole corpus and then by hash.  Any common
   order is correct, and counts per bucket keep the table of the order at a fixed size.
3. Sets that reach the threshold share one of the first ``n - ceil(t n) + 1`` shingles, their prefixes.
4. Nodes that share a prefix shingle are candidates.  First each is compared only with two leaders of the shingle, which
   joins groups of near copies without comparing all their pairs.  Then every pair of different components that still
   shares a prefix shingle is compared, so that no link between components is lost.
5. Length, positional and suffix filters thin out the candidates; each pair left is verified once, on the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_rows, hash_filter, materialise, ship_by_value
from lacuna.llm.graph import components

ship_by_value(__name__)

#: Buckets of the shingle counts and how they are cut for adding up.
BUCKETS = 1 << 20
COUNT_BLOCKS = 32
FAN_IN = 256
#: Longs of the parity sketch that the suffix filter compares.
SKETCH_LONGS = 8
#: Texts are shingled so many bytes at a time.
SLICE_BYTES = 1_000_000
#: And reach the workers in batches of so many rows.
BATCH_ROWS = 1_000
#: Tables of a few numbers a row are broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 200_000
#: So many pairs of a node are compared in one place.
PAIRS_PER_PLACE = 256
#: A shingle with more nodes, and more than one in so many of all, is hot: its nodes are spread over so many places.
HOT_NODES = 50_000
HOT_SHARE = 1_000_000
HOT_PLACES = 64
#: So many nodes outside a shingle's largest component meet the others in one place.
LOOSE_NODES = 1_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
M64 = 0xFFFFFFFFFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, each text's in ascending order, and the bounds of the texts.

    Words are runs between ASCII white space, A-Z lower-cased.  A text of fewer words is one shingle; a null or wordless
    text has none.
    """
    texts = pc.fill_null(texts, "")
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten().cast(pa.binary())
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))[real]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w.lower()) for w in coded.dictionary.to_pylist()], np.uint64)
    word = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    value, held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= size:
        rolled = np.zeros(len(word) - size + 1, np.uint64)
        for k in range(size):
            rolled = mix(rolled + word[k : len(word) - size + 1 + k] * np.uint64(MULTIPLIERS[k % 4] + 2 * (k // 4)))
        inside = owner[: len(rolled)] == owner[size - 1 :]
        value, held = rolled[inside], owner[: len(rolled)][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = [xxhash.xxh3_64_intdigest(word[first[k] : first[k] + count[k]].tobytes(), seed=1) for k in short.tolist()]
        value, held = np.concatenate([value, np.array(own, np.uint64)]), np.concatenate([held, short])
    order = np.lexsort((value, held))
    value, held = value[order], held[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (held[1:] != held[:-1])
    value, held = value[new], held[new]
    return value, np.searchsorted(held, np.arange(len(texts) + 1))


def sliced(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of bounded size, or single texts: (first row, texts)."""
    group = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield a, pa.concat_arrays([texts.slice(a, b - a)])


def signature(own: np.ndarray) -> tuple[int, int]:
    """96 bits that stand for the set."""
    digest = xxhash.xxh3_128_intdigest(own.tobytes())
    return (digest & M64) - (1 << 63), (digest >> 64 & 0xFFFFFFFF) - (1 << 31)


def bucket(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(BUCKETS - 1)).astype(np.int64)


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """For each part of the hash range, whether it holds an odd number of the set's shingles.

    A shingle that only one of two sets has changes one bit, so two sketches differ in no more bits than there are such
    shingles.
    """
    bits = 64 * SKETCH_LONGS
    part = (own >> np.uint64(64 - (bits - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: id, mark, n, s1, s2; and per task the counts of the buckets, in blocks."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, mark long, n int, s1 long, s2 int, block int, task long, counts binary"

    def run(batches):
        counts, ids = np.zeros(BUCKETS, np.int64), None
        names = ["id", "mark", "n", "s1", "s2", "block", "task", "counts"]
        for batch in batches:
            ids = batch.schema.field(0).type
            for at, texts in sliced(batch.column(1)):
                value, bound = shingle_sets(texts, size)
                counts += np.bincount(bucket(value), minlength=BUCKETS)
                marks = [signature(value[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]
                none = pa.nulls(len(texts))
                columns = [
                    batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(np.diff(bound), pa.int32()), pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if ids is not None:
            none, parts = pa.nulls(COUNT_BLOCKS), np.split(counts, COUNT_BLOCKS)
            columns = [
                none.cast(ids), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(range(COUNT_BLOCKS), pa.int32()),
                pa.array([TaskContext.get().partitionId()] * COUNT_BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def _total_counts(profile: DataFrame) -> np.ndarray:
    """The counts of all tasks added up block by block, never more than ``FAN_IN`` at once."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"block": table.column("block")[:1], "task": table.column("task")[:1], "counts": [total.tobytes()]}, schema=table.schema.remove(table.schema.get_field_index("part")))

    counts = profile.where("block IS NOT NULL").select("block", "task", "counts")
    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        counts = counts.withColumn("part", F.floor(F.col("task") / FAN_IN)).groupBy("block", "part").applyInArrow(add, "block int, task long, counts binary")
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            rows = {r["block"]: np.frombuffer(r["counts"], np.int64) for r in counts.select("block", "counts").collect()}
            return np.concatenate([rows[k] for k in range(COUNT_BLOCKS)]) if rows else np.zeros(BUCKETS, np.int64)
        counts = counts.withColumn("task", F.floor(F.col("task") / FAN_IN))


def prefix_length(n: int, percent: int) -> int:
    """Shingles at least one of which a set that reaches the threshold must share."""
    return n - -(-percent * n // 100) + 1


def _prefixes(docs: DataFrame, size: int, percent: int, rank) -> DataFrame:
    """One row per document that has a shingle: id, n, s1, s2, the prefix in order, the parity sketch."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, texts in sliced(batch.column(1)):
                value, bound = shingle_sets(texts, size)
                place = rank.value[bucket(value)]
                rows, marks, prefix, sketch = [], [], [], []
                for k, (a, b) in enumerate(zip(bound[:-1].tolist(), bound[1:].tolist())):
                    if a == b:
                        continue
                    own = value[a:b]
                    keep = prefix_length(b - a, percent)
                    order = np.argsort(place[a:b], kind="stable")[:keep]  # equal ranks stay in order of hash
                    rows.append(k)
                    marks.append((b - a, *signature(own)))
                    prefix.append(own[order].view(np.int64))
                    sketch.append(parity_sketch(own))
                if rows:
                    columns = [
                        batch.column(0).slice(at, len(texts)).take(pa.array(rows)), pa.array([m[0] for m in marks], pa.int32()), pa.array([m[1] for m in marks], pa.int64()),
                        pa.array([m[2] for m in marks], pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "prefix", "sketch"])

    return docs.mapInArrow(run, f"id {id_type}, n int, s1 long, s2 int, prefix array<long>, sketch array<long>")


def _reaches(common: Column, n: Column, percent: int) -> Column:
    """100 common >= percent (n - common), n being both sizes together; any multiple of both will do."""
    return (100 + percent) * common >= percent * n


def _may_reach(percent: int) -> Column:
    """Length and positional filter on rows ``l`` and ``r`` that share a shingle at their positions.

    Before the shared shingle the sets have at most the smaller position in common, behind it the smaller rest.
    """
    by_place = F.least("l.pos", "r.pos") + F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    n = F.col("l.n") + F.col("r.n")
    return _reaches(F.least("l.n", "r.n"), n, percent) & _reaches(by_place, n, percent)


def _close(l: str, r: str, percent: int) -> Column:
    """Suffix filter on the Hamming distance: the sets differ in as many shingles as their sketches in bits, at least."""
    bits = " + ".join(f"bit_count({l}sketch[{i}] ^ {r}sketch[{i}])" for i in range(SKETCH_LONGS))
    n = F.col(f"{l}n") + F.col(f"{r}n")
    return _reaches(n - F.expr(bits), 2 * n, percent)  # twice the common ones are n less those that differ


def _unordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, whichever way round: (low, high, hub, member)."""
    once = pairs.groupBy(F.least("hub", "member").alias("low"), F.greatest("hub", "member").alias("high")).agg(F.min("hub").alias("hub"))
    return once.withColumn("member", F.when(F.col("hub") == F.col("low"), F.col("high")).otherwise(F.col("low")))


def _suffix_filter(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the suffix filter lets through."""
    hub, member = (prefixes.select(F.col("node").alias(k), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch")) for k in ("hub", "member"))
    return pairs.join(hub, "hub").join(member, "member").where(_close("hub_", "member_", percent)).select(*pairs.columns)


def _broadcast_if_small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (hub, member) whose whole sets reach the threshold, as (a, b).

    The text of a member goes, compressed, to where its hub is compared.  A hub with many pairs is compared in several
    places, each of which gets its text.
    """
    places = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_PLACE).alias("places"))
    placed = pairs.join(places, "hub").withColumn("place", F.pmod(F.xxhash64("member"), F.col("places")))
    members = placed.select("hub", "place", F.col("member").alias("node"), F.lit(1).alias("role"))
    hubs = places.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.col("hub").alias("node"), F.lit(0).alias("role"))
    wanted = hubs.unionByName(members).join(nodes.select("node", "min_id", "min_mark", "s1", "s2"), "node")
    wanted = materialise(wanted, "jaccard-wanted")
    own = (F.col("mark") == F.col("min_mark")) & F.col("id").eqNullSafe(F.col("min_id"))
    rows = docs.join(_broadcast_if_small(wanted), own).select("text", "hub", "place", "role", "node", "s1", "s2")

    def send(batches):
        packer, last = zstandard.ZstdCompressor(1), (None, None)
        for batch in batches:
            packed = []
            for text in batch.column(0):
                raw = text.as_buffer().to_pybytes()
                if raw != last[0]:
                    last = (raw, packer.compress(raw))
                packed.append(last[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(packed, pa.binary())], names=["hub", "place", "role", "node", "s1", "s2", "packed"])

    def compare(batches):
        opener, own, at = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64), None
        for batch in batches:
            found = []
            # Rows that repeat give the same links again.
            marks = list(zip(*[batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5)]))
            for start in range(0, len(marks), 512):
                part = marks[start : start + 512]
                texts = pa.array([opener.decompress(x) for x in batch.column(6).slice(start, 512).to_pylist()], pa.binary()).cast(pa.string(), safe=False)
                for first, held in sliced(texts):
                    value, bound = shingle_sets(held, size)
                    for k in range(len(held)):
                        hub, place, role, node, s1, s2 = part[first + k]
                        mine = value[bound[k] : bound[k + 1]]
                        if signature(mine) != (s1, s2):
                            continue
                        if role == 0:
                            own, at = mine, (hub, place)
                        elif at == (hub, place):
                            both = np.concatenate([own, mine])
                            both.sort(kind="stable")  # merges two sorted runs
                            common = int(np.count_nonzero(both[1:] == both[:-1]))
                            if 100 * common >= percent * (len(both) - common):
                                found.append((hub, node))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    schema = "hub long, place long, role int, node long, s1 long, s2 int, packed binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(send, schema).repartition(parts, "hub", "place").sortWithinPartitions("hub", "place", "role")
    return sent.mapInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``n_copies``, ``text_hash``, ``is_least``.

    Two documents link if their sets of distinct ``size``-word shingles have a Jaccard similarity of ``percent`` in a
    hundred at least.  ``component_id`` is the smallest id reachable by links, its own included.  ``n_copies`` counts the
    other documents with an equal set.  ``is_least`` marks one document of each component, that with the smallest id and, of
    several texts with that id, the smallest ``text_hash``; rows equal in both are marked alike.  A text with fewer words is one shingle; null and wordless
    texts have no shingle, link with nothing and are their own component.  Repeated rows have equal sets and one
    component; a null id is smaller than none, so a component of null ids only has a null id.  Other columns are not
    read.  An empty table gives none.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _components(docs, id, text, size, percent)


def _components(docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """All jobs that need Python run here; the joins that are returned do not."""
    bare = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("mark"))
    profile = materialise(_profile(bare, size), "jaccard-profile")
    rows = profile.where("block IS NULL").select("id", "mark", "n", "s1", "s2")
    mark = ["n", "s1", "s2"]
    nodes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct(F.isnull("id").alias("without"), "id", "mark")).alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select(*mark, F.col("least.id").alias("min_id"), F.col("least.mark").alias("min_mark"), "copies")  # a row that exists: its id and the hash of its text
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    counts = _total_counts(profile)
    rank = docs.sparkSession.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8))
    prefixes = _prefixes(bare, size, percent, rank).join(nodes, mark).where(F.col("id").eqNullSafe(F.col("min_id")))
    prefixes = materialise(prefixes.select("node", "n", "prefix", "sketch"), "jaccard-prefixes")
    placed = materialise(_placed(prefixes), "jaccard-placed")

    def links_of(pairs: DataFrame) -> DataFrame:
        return materialise(_verified(bare, nodes, pairs, size, percent), "jaccard-links")

    first = materialise(_suffix_filter(_unordered(_leader_pairs(placed, percent)), prefixes, percent), "jaccard-pairs")
    links = links_of(first.select("hub", "member"))
    labels = materialise(components(links), "jaccard-components")
    second = _unordered(_cross_pairs(placed, labels, prefixes, percent))
    second = materialise(second.join(first, ["low", "high"], "left_anti"), "jaccard-pairs")
    labels = components(links.union(links_of(second.select("hub", "member"))))
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.isnull("min_id").alias("without"), "min_id", "min_mark")
    least = named.groupBy("component").agg(F.min("min_id").alias("component_id"), F.min(first).alias("least"))
    classes = named.join(least, "component").select(*mark, "component_id", (F.col("copies") - 1).alias("n_copies"), "least.min_id", "least.min_mark")
    out = rows.join(classes, mark, "left")
    some = F.col("n") > 0
    own = F.when(some, F.col("component_id")).otherwise(F.col("id"))
    is_least = ~some | (F.col("id").eqNullSafe(F.col("min_id")) & (F.col("mark") == F.col("min_mark")))
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.col("mark").alias("text_hash"), is_least.alias("is_least"))


def _placed(prefixes: DataFrame) -> DataFrame:
    """(token, place, places, node, n, pos, low, high) of the shingles in the prefixes of two nodes at least, low and high
    being their first and last node.

    A filter of the shared shingles keeps the others, which are most, from being shuffled again.  The nodes of a hot shingle
    are spread over several places.
    """
    token = prefixes.select("node", F.explode("prefix").alias("token"))
    shared = token.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("nodes")).where("low < high")
    shared = materialise(shared, "jaccard-shared")
    known = prefixes.sparkSession.sparkContext.broadcast(hash_filter(shared.select("token")))

    def keep(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                size = pc.list_value_length(part.column(2)).to_numpy()
                value = part.column(2).flatten().to_numpy()
                owner = np.repeat(np.arange(len(size)), size)
                pos = (np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
                kept = known.value(value)
                at = pa.array(owner[kept])
                yield pa.RecordBatch.from_arrays([pa.array(value[kept]), part.column(0).take(at), part.column(1).take(at), pa.array(pos[kept])], names=["token", "node", "n", "pos"])

    rows = prefixes.select("node", "n", "prefix").mapInArrow(keep, "token long, node long, n int, pos int")
    limit = max(HOT_NODES, (shared.agg(F.sum("nodes")).first()[0] or 0) // HOT_SHARE)
    places = F.when(F.col("nodes") > limit, HOT_PLACES).otherwise(1)
    hot = shared.where(F.col("nodes") > limit).select("token", places.alias("places"))  # a millionth of all each, so they are few
    rows = rows.join(F.broadcast(hot), "token", "left").withColumn("place", F.coalesce(F.pmod(F.xxhash64("node"), F.col("places")), F.lit(0)).cast("int")).drop("places")
    spread = shared.select("token", places.alias("places"), "low", "high").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    return rows.join(spread, ["token", "place"]).dropDuplicates(["token", "place", "node"])


def _leader_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Every node of a shared shingle with the shingle's first and last node: linear in the size of a group."""
    leader = placed.where("node = low OR node = high").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).alias("r")
    same = (F.col("l.token") == F.col("r.token")) & (F.col("l.place") == F.col("r.place"))
    met = placed.alias("l").join(leader, same & (F.col("l.node") != F.col("r.node")) & _may_reach(percent))
    return met.select(F.col("r.node").alias("hub"), F.col("l.node").alias("member"))


def _cross_pairs(placed: DataFrame, labels: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components: nodes outside a shingle's largest component with all nodes of the shingle.

    Where many are outside, they are spread over several places, to each of which the others go, and only sets of like
    sizes meet: those of one band of sizes or of neighbouring ones.
    """
    known = placed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = materialise(known.select("token", "node", "n", "pos", "component"), "jaccard-known")
    sizes = known.groupBy("token", "component").count()
    loose = F.sum("count") - F.max("count")
    largest = sizes.groupBy("token").agg(F.count(F.lit(1)).alias("parties"), F.max_by("component", F.struct("count", "component")).alias("largest"), F.ceil(loose / LOOSE_NODES).alias("places"))
    mixed = largest.where("parties > 1").select("token", "largest", "places")
    open_rows = materialise(known.join(mixed, "token").join(prefixes.select("node", "sketch"), "node"), "jaccard-open")
    band = F.floor(F.log("n") / math.log(100.001 / percent))  # sets that reach the threshold are at most one apart
    many = F.col("places") > 1
    left = open_rows.where("component <> largest").withColumns({"band": F.when(many, band).otherwise(0), "place": F.pmod(F.xxhash64("node"), F.col("places"))})
    bands = F.when(many, F.array(band - 1, band, band + 1)).otherwise(F.array(F.lit(0).cast("long")))
    right = open_rows.withColumn("band", F.explode(bands)).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    left, right = left.alias("l"), right.alias("r")
    met = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("token", "band", "place")]
    differ = met[0] & met[1] & met[2] & (F.col("l.component") != F.col("r.component"))
    once = (F.col("r.component") == F.col("r.largest")) | (F.col("l.node") < F.col("r.node"))
    met = left.join(right, differ & once & _may_reach(percent) & _close("l.", "r.", percent))
    return met.select(F.col("l.node").alias("hub"), F.col("r.node").alias("member"))
