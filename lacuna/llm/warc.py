"""WARC archives of web pages and a globally ordered index of their captures by external merge.

Each task writes its pages as gzip members into WARC files of its own and notes every record in an index run, sorted by
URL key and time.  The runs are merged range by range: a range holds a slice of every run, and a loser tree merges the
slices.  The ranges follow each other, so the index is in one order, the history of each URL together.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import materialise, scratch_path, ship_by_value
from lacuna.llm.urlrules import host_key, url_host
from lacuna.sources.sizing import lookup_join

ship_by_value(__name__)

#: A file is closed when it has so many bytes.
FILE_BYTES = 64 << 20
#: A range of the merged index has about so many records.
RANGE_RECORDS = 100_000
INDEX = "page_id string, urlkey string, captured long, run string, file string, position long, size long, record_type string"


def open_store(uri: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page: dict) -> bytes:
    """A WARC record, compressed; a revisit has the HTTP header of the payload, but not the payload."""
    stamp = datetime.fromtimestamp(page["captured"], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = page["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = page["refers_to"] is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page['page_id'])}", f"WARC-Date: {stamp}",
        f"WARC-Payload-Digest: sha1:{base32(page['sha1'])}", "Content-Type: application/http; msgtype=response",
    ]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in page["url"]))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(page['refers_to'])}"]
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def urn(id: str | None) -> str:
    """An id as a header's value: escaped, so that any text can be one; a null id is told from an empty one."""
    return "<urn:page>" if id is None else f"<urn:page:{quote(id, safe='')}>"


def id_of(value: str | None) -> str | None:
    return None if value is None or value == "<urn:page>" else unquote(value[len("<urn:page:") : -1])


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def parse(member: bytes) -> dict:
    """What a record says, its payload's digest computed anew where it has the payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.decode().split("\r\n") if line.startswith("Content-Length: ")).split(": ")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": id_of(fields.get("WARC-Record-ID")), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": id_of(fields.get("WARC-Refers-To"))}


def write_archives(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", captured: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write every row as a record below ``folder`` and return the index runs, one sorted file per task.

    Of records with one payload, of ``least_bytes`` at least, that with the largest id is the response and the others
    revisit it; equal payloads are those with equal SHA-1, length and xxHash64.  Smaller payloads are responses always.  A row that repeats
    the largest id is a response too.  A null payload is empty; a null id is smaller than all and null when read back;
    a null URL has no target and an empty key.  ``captured`` names a column of epoch seconds, 0 where null; without one
    the times are drawn from a hash of the id.  An empty table gives no records.

    A task that is run again writes new files, and only the files that the runs name count.  The payloads are shuffled
    only if too many different ones repeat to broadcast their digests.
    """
    data = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    time = F.col(captured).cast("long") if captured else F.coalesce(F.pmod(F.xxhash64(F.col(id)), F.lit(1 << 30)), F.lit(0))
    key = F.concat(host_key(url_host(F.col(url))), F.lit(")"), F.coalesce(F.regexp_extract(url, r"://[^/?#]*(.*)", 1), F.lit("")))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), data.alias("payload"), F.sha1(data).alias("sha1"), F.coalesce(time, F.lit(0)).alias("captured"), key.alias("urlkey"))
    rows = rows.withColumn("content", F.concat_ws(" ", "sha1", F.octet_length("payload").cast("string"), F.xxhash64("payload").cast("string")))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("content").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where("n > 1").drop("n"), "warc-groups")
    rows = lookup_join(rows, groups, "content")  # payloads of a hot digest, as of empty pages, stay where they are
    refers = F.when(~F.col("id").eqNullSafe(F.col("winner")), F.col("winner")).cast("string")
    rows = rows.select(F.col("id").cast("string").alias("page_id"), "url", "urlkey", "captured", "payload", "sha1", refers.alias("refers_to"))

    def run(batches):
        store, base = open_store(folder)
        store.create_dir(base)
        name, out, position = "", None, 0
        run_name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files = 0
        for batch in batches:
            noted = []
            for page in batch.to_pylist():
                if out is None or position >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, position, files = f"{run_name}-{files:04d}.warc.gz", 0, files + 1
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: lacuna\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    position += out.write(gzip.compress(head.encode() + info + b"\r\n\r\n", 1, mtime=0))
                member = record(page)
                out.write(member)
                kind = "response" if page["refers_to"] is None else "revisit"
                noted.append((page["page_id"], page["urlkey"], page["captured"], run_name, name, position, len(member), kind))
                position += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*noted), INDEX_TYPES)] if noted else [pa.array([], t) for t in INDEX_TYPES], names=INDEX_NAMES)
        if out is not None:
            out.close()

    index = rows.mapInArrow(run, INDEX).sortWithinPartitions("urlkey", "captured", "page_id", "position")
    return materialise(index, "warc-runs")


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
INDEX_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in INDEX.split(", ")]


class LoserTree:
    """Merges sorted sequences: inner nodes keep the loser of their match, so one path is replayed for each element."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.size = len(sources)
        self.head = [next(s, None) for s in sources]
        self.loser = [-1] * max(1, self.size)
        for k in range(self.size):
            self._replay(k)

    def _before(self, a: int, b: int) -> bool:
        """Ties go to the earlier source; an exhausted one loses."""
        x, y = self.head[a], self.head[b]
        return y is None and (x is not None or a < b) if x is None or y is None else (x, a) < (y, b)

    def _replay(self, k: int) -> None:
        node = (k + self.size) // 2
        while node > 0:
            if self.loser[node] == -1:  # no opponent has come yet
                self.loser[node] = k
                return
            if self._before(self.loser[node], k):
                self.loser[node], k = k, self.loser[node]
            node //= 2
        self.loser[0] = k

    def __iter__(self) -> Iterator:
        while self.size and self.head[self.loser[0]] is not None:
            k = self.loser[0]
            yield self.head[k]
            self.head[k] = next(self.sources[k], None)
            self._replay(k)


def merge_runs(runs: DataFrame, range_records: int = RANGE_RECORDS) -> DataFrame:
    """The index in one order by URL key, time and place, with ``range``, the number of the key range.

    The rows of a range come run by run; a task holds the rows of one range, about ``range_records``, in columns.  The
    range bounds include the record's place, so the captures of one URL, however many, spread over ranges.
    """
    records = runs.count()
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records // range_records))
    order = ["urlkey", "captured", "page_id", "file", "position"]
    dealt = runs.repartitionByRange(ranges, *order).sortWithinPartitions("run", *order)

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        names = table.column("run").to_pylist()
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        text = {c: table.column(c) for c in order}

        def cursor(at: int, stop: int) -> Iterator:
            for i in range(at, stop):
                yield tuple("" if (v := text[c][i].as_py()) is None else v for c in order), i

        tree = LoserTree([cursor(a, b) for a, b in zip(starts, [*starts[1:], len(names)])])
        merged = table.take(pa.array([i for _, i in tree], pa.int64()))
        number = pa.array([TaskContext.get().partitionId()] * len(names), pa.int64())
        yield from merged.append_column("range", number).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, f"{INDEX}, range long")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record that the index names, from the files.

    The digest of a response is computed from its payload and must equal the header's.
    """

    def run(batches):
        store, base = open_store(folder)
        name, handle = None, None
        for batch in batches:
            found = []
            for file, position, size in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if file != name:
                    if handle is not None:
                        handle.close()
                    name, handle = file, store.open_input_file(f"{base}/{file}")
                handle.seek(position)
                found.append(parse(handle.read(size)))
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in zip(names, types)], names=names)
        if handle is not None:
            handle.close()

    places = index.select("file", "position", "size")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartitionByRange(parts, "file", "position").sortWithinPartitions("file", "position")
    return dealt.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive(pages: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write the pages' archives, merge their index and read all records back: (records, index).

    ``folder`` is where the archives go, by default a fresh one in the shared folder.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    runs = write_archives(pages, folder, id, url, payload, least_bytes=least_bytes)
    index = materialise(merge_runs(runs), "warc-index")
    kind = pages.schema[id].dataType
    records = read_archives(index, folder)
    return records.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page_id", id), index
