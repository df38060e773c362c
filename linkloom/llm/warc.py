"""WARC (7): archives of gzipped records, and an index of captures made by merging locally sorted runs.

Each task writes archives of about ARCHIVE_BYTES at most and, beside each, the run of its captures sorted by URL key,
timestamp and page. Runs are then merged by a loser tree, in as many ranges of the key as the index is large, into one globally ordered history.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, width, written

SMALLEST_REVISIT = 1000  # payloads below this many bytes are stored each time
ARCHIVE_BYTES = 256 << 20
CRLF = b"\r\n"
RUN = pa.schema([("key", pa.binary()), ("stamp", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RUN_ROWS = 4096


# --- records ---------------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, stamp: str, digest: str, n_bytes: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One gzip member that holds a response (payload given) or a revisit of an equal payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + CRLF + CRLF + block + CRLF + CRLF) + z.flush()


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in (x.partition(b":") for x in lines)}


def parse_record(data: bytes) -> dict:
    """Reads one decompressed record; a response's payload is digested anew and must match its header."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    warc = _fields(lines[1:])
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != CRLF + CRLF:
        raise ValueError("the block's length doesn't fit")
    http, _, payload = block.partition(CRLF + CRLF)
    n = int(_fields(http.split(CRLF)[1:])["content-length"])
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    if warc["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't fit its digest")
    page = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": page(warc["warc-record-id"]), "url": warc["warc-target-uri"], "payload_bytes": n, "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": page(warc.get("warc-refers-to", "")), "payload": payload}


def read_archive(f, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """offset, compressed length and content of each gzip member of an open file, read in chunks."""
    base, data = 0, b""
    while True:
        if not data and not (data := f.read(chunk)):
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
            if z.eof:
                break
            if not (data := f.read(chunk)):
                raise ValueError("the archive is cut off")
        yield base, used, b"".join(parts)
        base += used


# --- runs and their merge ----------------------------------------------------------------------------------------------


class LoserTree:
    """Merges k sorted iterators with about log2(k) comparisons an item: inner nodes keep the loser of their match."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams, self.k = streams, max(1, len(streams))
        self.head: list[tuple | None] = [next(s, None) for s in streams] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[a] is not None
        return (self.head[a], a) < (self.head[b], b)

    def _play(self, i: int) -> None:
        """Takes stream i from its leaf to the top; at a node that nobody has reached yet it waits."""
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._before(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while True:
            i = self.tree[0]
            item = self.head[i]
            if item is None:
                return
            yield item
            self.head[i] = next(self.streams[i], None)
            self._play(i)


def sort_key(row: tuple) -> tuple:
    """(key, stamp, page_id, ...) as something that can be compared: a null page comes first."""
    return row[0], row[1], -(1 << 63) if row[2] is None else row[2]


def write_run(out, rows: Iterator[tuple]) -> None:
    with pa.ipc.new_file(out, RUN) as w:
        part: list[tuple] = []
        for row in rows:
            part.append(row)
            if len(part) == RUN_ROWS:
                w.write_batch(_batch(part))
                part = []
        if part:
            w.write_batch(_batch(part))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUN, strict=True)], schema=RUN)


def read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """Items (sort key, row) of a run with low <= key < high; batches before low are found by bisection and not read."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        run = pa.ipc.open_file(f)
        rows = lambda k: zip(*(c.to_pylist() for c in run.get_batch(k).columns), strict=True)
        a, b = 0, run.num_record_batches
        while low is not None and b - a > 1:
            mid = (a + b) // 2
            if sort_key(tuple(run.get_batch(mid).slice(0, 1).select([c]).to_pylist()[0][c] for c in RUN.names[:3])) <= low:
                a = mid
            else:
                b = mid
        for k in range(a, run.num_record_batches):
            for row in rows(k):
                key = sort_key(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row


def merged_runs(paths: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    for _, row in LoserTree([read_run(p, low, high) for p in paths]):
        yield row


def merge_index(runs: DataFrame, folder: str, fan_in: int = 512, range_rows: int = 200_000) -> DataFrame:
    """Merges sorted runs(run, n_rows) into one table in the order of URL key, timestamp and page: index_range, index_pos, then the run's columns.

    More than ``fan_in`` runs are first merged in groups into longer ones, again and again. The last pass splits the key
    space at keys sampled evenly from the runs, so a URL with any number of captures can span ranges; each task merges one
    range of all runs. The driver holds the runs' names and about 8 sampled keys a range.
    """
    spark = runs.sparkSession
    names, total = [r["run"] for r in runs.orderBy("run").collect()], runs.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    level = 0
    while len(names) > fan_in:
        groups = [names[i : i + fan_in] for i in range(0, len(names), fan_in)]

        def lengthen(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs
            from pyspark import TaskContext

            for batch in batches:
                for row in batch.to_pylist():
                    at = f"{folder}/runs-{level}/{row['k']:06d}.arrow"
                    store, name = fs.FileSystem.from_uri(at)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    temp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    with store.open_output_stream(temp) as out:
                        write_run(out, merged_runs(row["runs"]))
                    store.move(temp, name)
                    yield pa.RecordBatch.from_pydict({"run": [at]})

        table = spark.createDataFrame(list(enumerate(groups)), "k int, runs array<string>")
        names = sorted(r["run"] for r in table.repartitionByRange(len(groups), "k").mapInArrow(lengthen, "run string").collect())
        level += 1

    ranges = max(1, math.ceil(total / range_rows))
    each = max(1, math.ceil(8 * ranges / max(1, len(names))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as f:
                    run = pa.ipc.open_file(f)
                    n = run.num_record_batches
                    full = max(0, n - 1) * RUN_ROWS + (run.get_batch(n - 1).num_rows if n else 0)
                    picks = [run.get_batch(i // RUN_ROWS).slice(i % RUN_ROWS, 1).select([0, 1, 2]) for i in sorted({full * j // (each + 1) for j in range(1, each + 1)}) if i < full]
                yield from picks

    cuts: list[tuple] = []
    if ranges > 1:
        keys = sorted(sort_key(tuple(r)) for r in spark.createDataFrame([(x,) for x in names], "run string").repartition(min(len(names), width(spark))).mapInArrow(sample, "key binary, stamp string, page_id long").toLocalIterator())
        cuts = sorted({keys[len(keys) * j // ranges] for j in range(1, ranges)})
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part, pos = [], 0
                for row in merged_runs(names, *bounds[k]):
                    part.append(row)
                    if len(part) == RUN_ROWS:
                        yield _numbered(part, k, pos)
                        pos, part = pos + len(part), []
                if part:
                    yield _numbered(part, k, pos)

    table = spark.createDataFrame([(k,) for k in range(len(bounds))] if names else [], "k int")
    return written(table.repartitionByRange(max(1, len(bounds)), "k").mapInArrow(merge, "index_range int, index_pos long, key binary, stamp string, page_id long, file string, offset long, length long"), "index", f"{folder}/index")


def _numbered(rows: list[tuple], k: int, pos: int) -> pa.RecordBatch:
    b = _batch(rows)
    return pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array(range(pos, pos + len(rows)), pa.int64()), *b.columns], ["index_range", "index_pos", *RUN.names])


# --- the operator ------------------------------------------------------------------------------------------------------


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query, in lower case and without scheme, www, port 80/443 and fragment; '' for null."""
    url = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#]*)", 1)
    port = F.regexp_replace(F.regexp_extract(host, "(:[0-9]*)$", 1), "^:(?:80|443)?$", "")
    host = F.regexp_replace(host, ":[0-9]*$", "")
    rest = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*([^#]*)", 1)
    return F.when(url == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def write_archives(pages: DataFrame, stamp: Column, folder: str, smallest_revisit: int = SMALLEST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, html) as archives with a sorted run beside each; returns file, run, n_rows of each.

    Of rows with equal payloads (SHA-1 and length) of at least ``smallest_revisit`` bytes, those with the largest page_id
    hold the payload and the others refer to it. That choice is made on digests alone; html goes through one shuffle, by
    page and digest, which no group of copies makes uneven. A task begins another archive when one has ``archive_bytes``, so
    the index entries that it holds don't grow with the table. Names hold the number of the task's attempt, and only those
    of attempts that succeeded are in the result, so an archive and its run are always of one attempt. A null html is empty;
    rows without page_id never hold a payload for others, and refer to one if there is one. Repeated rows are all written:
    of a payload's rows with the largest page_id each holds it. A very long page is one record. An empty table gives no
    archive. Other columns aren't read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.date_format(stamp, "yyyyMMddHHmmss").alias("stamp"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    thin = rows.select("page_id", "digest", "n_bytes").filter(F.col("n_bytes") >= smallest_revisit)
    held = thin.groupBy(F.col("digest").alias("d"), F.col("n_bytes").alias("n")).agg(F.max("page_id").alias("held"), F.count("*").alias("copies")).filter("copies > 1 and held is not null")
    copies = thin.join(held, (F.col("digest") == F.col("d")) & (F.col("n_bytes") == F.col("n"))).filter(~F.col("page_id").eqNullSafe(F.col("held")))
    copies = copies.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("held").alias("refers_to")).distinct()
    rows = rows.join(copies, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "stamp", "digest", "n_bytes", "refers_to", url_key(F.col("url")).cast("binary").alias("key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        mark = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        store, root = fs.FileSystem.from_uri(folder)
        shard, f, run, at = 0, None, [], 0

        def done() -> pa.RecordBatch:
            f.close()
            run.sort(key=sort_key)
            with store.open_output_stream(f"{root}/part-{mark}-{shard}.arrow") as out:
                write_run(out, iter(run))
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/part-{mark}-{shard}.warc.gz"], "run": [f"{folder}/part-{mark}-{shard}.arrow"], "n_rows": [len(run)]})

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for r in batch.slice(k, 500).to_pylist():
                    if f is None:
                        store.create_dir(root, recursive=True)
                        f = store.open_output_stream(f"{root}/part-{mark}-{shard}.warc.gz", compression=None)
                    data = record(r["page_id"], r["url"], r["stamp"], r["digest"], r["n_bytes"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["refers_to"])
                    f.write(data)
                    run.append((r["key"], r["stamp"], r["page_id"], f"{folder}/part-{mark}-{shard}.warc.gz", at, len(data)))
                    at += len(data)
                    if at >= archive_bytes:
                        yield done()
                        shard, f, run, at = shard + 1, None, [], 0
        if f is not None:
            yield done()

    archives = rows.mapInArrow(write, schema := "file string, run string, n_rows long").collect()  # a row for each archive
    return written(pages.sparkSession.createDataFrame(archives, schema), "archives", f"{folder}/archives", parts=1)


READ = "file string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """Reads archives back, one after another; checks lengths and payload digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(file)
                out: list[tuple] = []
                with store.open_input_stream(name, compression=None) as f:
                    for offset, _, data in read_archive(f):
                        r = parse_record(data)
                        out.append((file, offset, *(r[k] for k in names[2:])))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return archives.select("file").repartitionByRange(width(archives.sparkSession), "file").mapInArrow(read, READ)


def capture_history(pages: DataFrame, stamp: Column, folder: str | None = None) -> DataFrame:
    """Writes the archives, merges their runs, and returns each record as read back with its place in the merged index.

    (index_range, index_pos) orders all captures by URL key, timestamp and page_id; captures that are equal in these have
    places in the order of their runs. Null urls come first; for other odd rows see write_archives(). An empty table gives an
    empty result.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    archives = write_archives(pages, stamp, folder)
    index = merge_index(archives.select("run", "n_rows"), folder).select("file", "offset", "length", "key", "stamp", "index_range", "index_pos")
    return read_archives(archives).join(index.hint("merge"), ["file", "offset"])  # the index grows with the pages


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # The table has no capture times: pages are taken to be fetched a second apart.
    stamp = F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(F.col("page_id"), F.lit(0)))
    got = capture_history(pages, stamp)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").cast("string").alias("url_key"), "index_range", "index_pos")
