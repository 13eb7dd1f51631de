"""WARC archives as a chunked record table.

Writing: payloads go to the writing tasks as (record, chunk number, bytes) rows of bounded size, their length and SHA-1 known from
a pass of their own, so a record is compressed and written chunk by chunk. Reading: an archive is streamed, and comes back as
rows of record identifier and chunk number with the digest of all payload bytes so far; neither side holds a whole record.

Every attempt of a task writes files of its own; the table of archives lists those of the attempts that were completed, so a task that
runs again after a loss meets no file of the lost one. Archives are in the shared folder, so readers see those of executors that are gone.
"""

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumspark.llm._graph import shared, shared_folder, written

CHUNK = 256 << 10
_CLEAN = {c: f"%{c:02X}" for c in [*range(33), 127]}


def marked(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """`pages` with `_warc_sha1`, `_warc_bytes` and `_warc_refers`: the id of the record that a revisit refers to, else null."""
    rows = pages.withColumn("_warc_payload", F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary"))
    rows = rows.withColumn("_warc_sha1", F.sha1("_warc_payload")).withColumn("_warc_bytes", F.octet_length("_warc_payload").cast("long"))
    ids = rows.select(F.col(id_col).alias("id"), F.col("_warc_sha1").alias("d"), F.col("_warc_bytes").alias("n")).where(F.col("n") >= min_bytes)
    first = ids.groupBy("d", "n").agg(F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # one row for each page that revisits another
    again = ids.join(first, ["d", "n"]).where(F.col("id").isNull() | (F.col("id") != F.col("first"))).where("first is not null").select(F.col("id").alias("_warc_id"), F.col("d").alias("_warc_d"), F.col("first").alias("_warc_refers")).distinct()
    again = written(again)
    return rows.join(again, F.col(id_col).eqNullSafe(F.col("_warc_id")) & (F.col("_warc_sha1") == F.col("_warc_d")), "left").drop("_warc_id", "_warc_d")


def _head(r):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['n']}\r\n\r\n".encode()
    kind = "revisit" if r["refers"] is not None else "response"
    name = lambda i, d: f"<urn:page:{'' if i is None else i}:{d}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(r['id'], r['d'])}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {(r['uri'] or '').translate(_CLEAN)}", f"WARC-Payload-Digest: sha1:{r['d']}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(r['refers'], r['d'])}"]
    size = len(http) + (0 if kind == "revisit" else r["n"])
    return "\r\n".join([*lines, f"Content-Length: {size}"]).encode() + b"\r\n\r\n" + http


def _writer(folder, date, max_bytes):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        out = pack = None
        files = []

        def put(data):
            out.write(data)
            files[-1][2] += len(data)

        for b in batches:
            for r in b.to_pylist():
                if r["k"] == 0:
                    if out and files[-1][2] >= max_bytes:
                        out.close()
                        out = None
                    if not out:
                        path = f"{name}-{len(files):04d}.warc.gz"
                        files.append([f"{folder}/{path}", 0, 0])
                        out = store.open_output_stream(f"{root}/{path}", compression=None)
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    put(pack.compress(_head(r | {"date": date})))
                    files[-1][1] += 1
                if r["refers"] is None:
                    put(pack.compress(r["chunk"]))
                if r["last"]:
                    put(pack.compress(b"\r\n\r\n") + pack.flush())
        if out:
            out.close()
        if files:
            yield pa.record_batch([pa.array(x) for x in zip(*files, strict=True)], ["path", "n_records", "n_bytes"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", max_bytes: int = 1 << 30) -> DataFrame:
    """Write a record for each row to gzipped WARC files of about `max_bytes`; returns their (path, n_records, n_bytes), written already.

    Of rows with equal payloads of at least `min_bytes` bytes the one with the largest id is a response, the others are revisits of
    it (repeated rows with the largest id are responses each); all others are responses. A null payload is empty, a null id
    is left empty in the record's name, and an id that comes again with other payloads names its rows apart by digest. folder: a URI
    that all executors can write to (default: a new folder in spark.checkpoint.dir). An empty table writes no files.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = marked(pages, id_col, payload_col, min_bytes)
    # one chunk a row, cut from the payload only after the chunk numbers are rows; a revisit has no payload to send
    chunks = F.when(F.col("_warc_refers").isNull(), F.greatest(F.ceil(F.col("_warc_bytes") / CHUNK), F.lit(1))).otherwise(F.lit(1)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("_warc_k"))
    piece = F.when(F.col("_warc_refers").isNull(), F.substring(F.col("_warc_payload"), F.col("_warc_k") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b"").cast("binary"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col("_warc_sha1").alias("d"), F.col("_warc_bytes").alias("n"), F.col("_warc_refers").cast("long").alias("refers"), F.col("_warc_k").alias("k"), piece.alias("chunk"))
    rows = rows.withColumn("last", F.col("refers").isNotNull() | ((F.col("k") + 1) * F.lit(CHUNK).cast("long") >= F.col("n")))
    return shared(rows.mapInArrow(_writer(folder, date, max_bytes), "path string, n_records long, n_bytes long"))


def _plain(stream, size=1 << 16):
    """Bytes of a gzip file of any number of members, piece by piece."""
    unpack, rest = None, b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            return
        unpack = unpack or zlib.decompressobj(31)
        piece = unpack.decompress(data, 4 * size)
        if piece:
            yield piece
        while unpack.unconsumed_tail:
            yield unpack.decompress(unpack.unconsumed_tail, 4 * size)
        if unpack.eof:
            rest, unpack = unpack.unused_data, None


class _Reader:
    def __init__(self, pieces):
        self.pieces, self.buffer = pieces, b""

    def until(self, mark):
        """Everything up to `mark`, which is dropped; None at the end."""
        while mark not in self.buffer:
            more = next(self.pieces, None)
            if more is None:
                return None
            self.buffer += more
        out, _, self.buffer = self.buffer.partition(mark)
        return out

    def take(self, n):
        """Some of the next n bytes (n > 0)."""
        if not self.buffer:
            self.buffer = next(self.pieces, b"")
            if not self.buffer:
                raise ValueError("an archive ends inside a record")
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out


def _records(reader):
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
        http = reader.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http) - 4
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, total, k = hashlib.sha1(), 0, 0
        while True:
            parts, room = [], min(CHUNK, left)
            while room:
                parts.append(reader.take(room))
                room -= len(parts[-1])
            chunk = b"".join(parts)
            left -= len(chunk)
            total += len(chunk)
            digest.update(chunk)
            yield fields["WARC-Record-ID"][1:-1], fields["WARC-Type"], fields["WARC-Target-URI"], fields.get("WARC-Refers-To", "<>")[1:-1] or None, fields["WARC-Payload-Digest"].removeprefix("sha1:"), length, k, chunk, total, digest.hexdigest(), not left
            k += 1
            if not left:
                break
        if reader.until(b"\r\n\r\n") != b"":
            raise ValueError("a record does not end where it should")


NAMES = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "chunk", "data", "bytes_so_far", "digest_so_far", "last"]
SCHEMA = "path string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean"
_ARROW = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def _read(batches):
    from pyarrow import fs

    for b in batches:
        for path in b.column(0).to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            rows, size = [], 0

            def packed(rows, path=path):
                return pa.record_batch([pa.array([path] * len(rows)), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True))], ["path", *NAMES])

            with store.open_input_stream(at, compression=None) as stream:
                for r in _records(_Reader(_plain(stream))):
                    rows.append(r)
                    size += len(r[7]) + 200
                    if size > (4 << 20):
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """The chunked record table of archives (`path` column): one row for each record and chunk, in order, with the running digest.

    A record without payload (a revisit, or an empty page) is one row with an empty chunk. `payload_bytes` and
    `payload_digest` are those that the record declares of its full payload. A record cut short is an error.
    """
    return archives.select("path").mapInArrow(_read, SCHEMA)


def digest(chunks: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of each record, from its last chunk; a response's figures are those of the bytes read."""
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]*):", 1)
    own = F.col("record_type") == "response"
    return chunks.where("last").select(
        F.when(number("record_id") != "", number("record_id")).cast("long").alias(id_col),
        F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).cast("long").alias("refers_to"),
    )
