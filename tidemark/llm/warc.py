"""WARC archives and a two-level capture index over them.

Archives are .warc.gz files as other tools read them: one gzip member a record, bounded in size. A payload that is kept already becomes a
revisit record. Spark's text writer writes them: it puts bytes out as they are, and every member ends in a zero byte, which is its
separator. So any store that Spark writes to will do, and each file is one task's.

The index sorts captures by reversed host (com,example)/path) and packs the lines into gzip blocks of BLOCK_LINES; its files are cut by key
ranges. The directory keeps, per index file, the first key and the place of each block. A lookup searches the files' first keys, then one
file's directory, by bisection; it reads the ranges of the blocks that can hold the key, and from their lines the ranges of the records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from tidemark.llm.shared import materialise, release

#: Compressed bytes of an archive, lines of an index block, blocks of an index file, about each.
ARCHIVE_BYTES, BLOCK_LINES, FILE_BLOCKS = 16 << 20, 1000, 256
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-capture:"


# ---- records -------------------------------------------------------------------------------------------------------------


def member(data: bytes) -> bytes:
    """A gzip member that ends in a zero byte (from 16 MB on, the length at its end may not: an empty member follows)."""
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if not out[-1] else out + member(b"")


def record_id(key: str | None, copy: int) -> str:
    """Names a record by the key of its page (null: none) and the number of its row."""
    return f"<{_URN}{'n' if key is None else 'k' + quote(key, safe='')}:{copy}>"


def page_of(name: str) -> str | None:
    body = name.strip("<>").removeprefix(_URN).rpartition(":")[0]
    return unquote(body[1:]) if body[:1] == "k" else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, url: str | None, date: str, digest: str, size: int, payload: bytes, refers_to: str | None = None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": date}
    if url is not None:  # control characters and outer blanks cannot stand in a header
        fields["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
    if refers_to:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + len(payload))}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return member(b"".join([VERSION, b"\r\n", head.encode("utf-8", "surrogatepass"), b"\r\n", http, payload, b"\r\n\r\n"]))


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member that is not empty."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unpack, to, parts = zlib.decompressobj(31), at, []
        while not unpack.eof:
            if to >= len(content):
                raise ValueError(f"the member at {at} is cut off")
            parts.append(unpack.decompress(view[to : to + step]))
            to = min(to + step, len(content))
        end = to - len(unpack.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Fields of a record, the length of the payload it names, and the payload it holds (of a revisit: nothing)."""
    head, _, block = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines)}
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


def verified(data: bytes) -> tuple[dict[str, str], int]:
    """parse(), and an error where a response's payload is not the one that its fields name."""
    fields, size, payload = parse(data)
    if fields["WARC-Type"] == "response" and (len(payload) != size or f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return fields, size


def host_key(url: str | None) -> str:
    """The sort key of a url: host labels reversed, then path and query: com,example)/a?b. Scheme, user, default port and fragment do not
    count. A null url has the key '-', one without :// its own lower-cased text."""
    if url is None:
        return "-"
    scheme, found, rest = url.partition("://")
    if not found:
        return url.lower()
    rest = rest.partition("#")[0]
    cut = min([rest.find(c) for c in "/?" if c in rest], default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    tail = "" if not port or (scheme.lower(), port) in (("http", "80"), ("https", "443")) else f":{port}"
    return ",".join(reversed(name.split("."))) + tail + ")" + (path if path[0] == "/" else "/" + path)


# ---- writing -------------------------------------------------------------------------------------------------------------

_STAGED = "copy long, page string, url string, date string, bytes long, digest binary, record binary"


def _responses(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):  # compressed records leave in small batches
            part, rows = batch.slice(at, 64), []
            for copy, page, url, date, payload in zip(*(part[c].to_pylist() for c in ("copy", "page", "url", "date", "payload"))):
                body = payload or b""
                sha = hashlib.sha1(body).digest()
                rows.append((len(body), sha, _record("response", record_id(page, copy), url, date, base64.b32encode(sha).decode(), len(body), body)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part["copy"], part["page"], part["url"], part["date"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["copy", "page", "url", "date", "bytes", "digest", "record"])


def _final(batches):
    """Records as they are written: revisits in place of repeated payloads, without the zero byte at the end."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            row = {c: batch[c][k].as_py() for c in ("copy", "page", "url", "date", "bytes", "digest", "first_copy", "first_page")}
            if row["first_copy"] is None:
                out.append(batch["record"][k].as_py()[:-1])
            else:
                sha = base64.b32encode(row["digest"]).decode()
                out.append(_record("revisit", record_id(row["page"], row["copy"]), row["url"], row["date"], sha, row["bytes"], b"", record_id(row["first_page"], row["first_copy"]))[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, key: str, url: str, payload: str, folder: str, least: int = 0, date: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row into folder/warc. Of rows with equal payloads of at least `least` bytes, the one of the largest key is a
    response and the others revisit it (of rows with that key too, the first is the response); all others are responses.

    Null payloads are empty, null urls have no WARC-Target-URI; null keys are the smallest. Repeated rows are records each. An empty table
    gives no archive. date: column of record dates (default: the epoch). Other columns do not matter, whatever they are called."""
    when = F.lit("1970-01-01T00:00:00Z") if date is None else date
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), when.cast("string").alias("date"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    rows = rows.withColumn("copy", F.monotonically_increasing_id())  # fixed by the write that follows
    staged = materialise(rows.mapInArrow(_responses, _STAGED), "warc-staged")

    order = F.col("page").cast(dict(pages.dtypes)[key])  # keys are compared as what they are
    facts = staged.where(F.col("bytes") >= least).select("copy", "page", "bytes", "digest")
    heads = facts.groupBy("digest", "bytes").agg(F.max(F.struct(order.alias("order"), (-F.col("copy")).alias("minus"), "page")).alias("head"), F.count("*").alias("n")).where("n > 1")
    revisits = facts.join(heads, ["digest", "bytes"]).where(F.col("copy") != -F.col("head.minus")).select("copy", (-F.col("head.minus")).alias("first_copy"), F.col("head.page").alias("first_page"))
    total = staged.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    dealt = staged.repartition(parts, "copy").join(revisits.repartition(parts, "copy"), "copy", "left")
    dealt.mapInArrow(_final, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").text(f"{folder}/warc")
    release(staged)


# ---- reading -------------------------------------------------------------------------------------------------------------

_LINES = "host_key string, date string, path string, offset long, length long, line string"


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the archives; of a folder without any, no rows."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("path", "content")


def _scanned(batches):
    import pyarrow as pa

    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            rows = []
            for offset, length, data in members(content.as_buffer()):
                fields, size, _ = parse(data)
                url = fields.get("WARC-Target-URI")
                facts = {"url": url, "digest": fields["WARC-Payload-Digest"], "type": fields["WARC-Type"], "size": size, "length": length, "offset": offset, "filename": path}
                rows.append((host_key(url), fields["WARC-Date"], path, offset, length, json.dumps(facts, ensure_ascii=False)))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["host_key", "date", "path", "offset", "length", "line"])


def _blocks(lines: int):
    """Packs sorted lines into blocks, numbered within the index file (the task)."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def packed(rows, number):
            body = member("".join(f"{k} {d} {x}\n" for k, d, x in rows).encode("utf-8", "surrogatepass"))
            return pa.RecordBatch.from_pydict({"file": pa.array([task], pa.int32()), "number": pa.array([number], pa.int32()), "first": [rows[0][0]], "lines": pa.array([len(rows)], pa.int32()), "block": [body]})

        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("host_key", "date", "line")))
            while len(held) >= lines:
                yield packed(held[:lines], number)
                held, number = held[lines:], number + 1
        if held:
            yield packed(held, number)

    return pack


def build_index(spark: SparkSession, folder: str, block_lines: int = BLOCK_LINES, file_blocks: int = FILE_BLOCKS) -> None:
    """Reads the archives in folder/warc and writes the index: sorted blocks in folder/index, the directory in folder/directory."""
    lines = materialise(archives(spark, f"{folder}/warc").mapInArrow(_scanned, _LINES), "warc-lines")
    files = max(1, -(-lines.count() // (block_lines * file_blocks)))
    dealt = lines.repartitionByRange(files, "host_key", "date", "path", "offset").sortWithinPartitions("host_key", "date", "path", "offset")
    blocks = materialise(dealt.mapInArrow(_blocks(block_lines), "file int, number int, first string, lines int, block binary"), "warc-blocks")
    value = F.expr("substring(block, 1, octet_length(block) - 1)").cast("string").alias("value")
    blocks.repartition(files, "file").sortWithinPartitions("file", "number").select("file", value).write.partitionBy("file").option("lineSep", "\0").text(f"{folder}/index")
    size = F.octet_length("block").cast("long")
    start = F.sum(size).over(W.partitionBy("file").orderBy("number")) - size  # a file holds about FILE_BLOCKS blocks
    each = blocks.select("file", F.struct("number", "first", start.alias("offset"), size.alias("length"), "lines").alias("b"))
    directory = each.groupBy("file").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    empty = not blocks.take(1)
    paths = spark.createDataFrame([], "file int, path string") if empty else spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/index").select(F.col("file").cast("int"), "path")
    directory = directory.join(paths, "file").select("path", F.element_at("blocks", 1)["first"].alias("first"), "blocks")
    directory.write.parquet(f"{folder}/directory")
    release(lines, blocks)


_CAPTURE = "host_key string, date string, url string, type string, digest string, size long, path string, offset long, length long"


def _captures_of(data: bytes) -> list[tuple]:
    out = []
    for text in data.decode("utf-8", "surrogatepass").split("\n")[:-1]:
        head, _, body = text.partition(" {")
        host, _, date = head.rpartition(" ")
        x = json.loads("{" + body)
        out.append((host, date, x["url"], x["type"], x["digest"], x["size"], x["filename"], x["offset"], x["length"]))
    return out


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of the index, each block by its place in the directory."""
    places = spark.read.parquet(f"{folder}/directory").select("path", "blocks")  # at most some FILE_BLOCKS entries a row
    if not places.take(1):
        return spark.createDataFrame([], _CAPTURE)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/index").select("path", "content")

    def unpacked(batches):
        import pyarrow as pa

        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["host_key", "date", "url", "type", "digest", "size", "path", "offset", "length"]
        for batch in batches:
            for blocks, body in zip(batch["blocks"].to_pylist(), batch["content"]):
                view = memoryview(body.as_buffer())
                for b in blocks:
                    rows = _captures_of(zlib.decompress(view[b["offset"] : b["offset"] + b["length"]], 31))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return content.repartition(max(1, content.select("path").count()), "path").join(places.hint("shuffle_hash"), "path").select("blocks", "content").mapInArrow(unpacked, _CAPTURE)


def fetch(found: DataFrame, folder: str) -> DataFrame:
    """The records of captures, read by their ranges and verified: page, payload_bytes, payload_digest, record_type, refers_to. Ranges
    are gathered by archive, so each archive with a capture is read once."""
    ranges = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))  # of one archive, whose size is bounded

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for ranges, content in zip(batch["ranges"].to_pylist(), batch["content"]):
                view, rows = memoryview(content.as_buffer()), []
                for r in ranges:
                    fields, size = verified(zlib.decompress(view[r["offset"] : r["offset"] + r["length"]], 31))
                    to = fields.get("WARC-Refers-To")
                    rows.append((page_of(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], to and page_of(to)))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    content = archives(found.sparkSession, f"{folder}/warc")
    count = max(1, content.select("path").count())  # a listing; an archive or a few to a task, at any size
    return content.repartition(count, "path").join(ranges.hint("shuffle_hash"), "path").select("ranges", "content").mapInArrow(read, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def range_reader(spark: SparkSession) -> Callable[[str, int, int], bytes]:
    """read(path, offset, length) from whatever store holds the path."""

    def read(path: str, offset: int, length: int) -> bytes:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        try:
            stream.seek(offset)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    return read


class CaptureIndex:
    """Lookups of single urls. It holds the first key of each index file (one in some 256,000 captures) and the directories of the files
    that were asked for; all else is read by ranges."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._directory = spark.read.parquet(f"{folder}/directory")
        found = sorted((r["first"].encode("utf-8", "surrogatepass"), r["path"]) for r in self._directory.select("first", "path").collect())
        self._firsts, self._paths = [f for f, _ in found], [p for _, p in found]
        self._read, self._held = range_reader(spark), {}
        self.blocks_read = 0

    def _blocks(self, path: str) -> list:
        if path not in self._held:
            self._held[path] = self._directory.where(F.col("path") == path).first()["blocks"]
        return self._held[path]

    def lookup(self, url: str | None) -> list[dict]:
        """The captures of a url, in order of their dates."""
        key, names, out = host_key(url), [x.split()[0] for x in _CAPTURE.split(", ")], []
        wanted = key.encode("utf-8", "surrogatepass")
        # a key's lines may begin in the block (and file) before the first one that starts with it
        for path in self._paths[max(0, bisect_left(self._firsts, wanted) - 1) : bisect_right(self._firsts, wanted)]:
            blocks = self._blocks(path)
            firsts = [b["first"].encode("utf-8", "surrogatepass") for b in blocks]
            for b in blocks[max(0, bisect_left(firsts, wanted) - 1) : bisect_right(firsts, wanted)]:
                self.blocks_read += 1
                lines = _captures_of(zlib.decompress(self._read(path, b["offset"], b["length"]), 31))
                out += [dict(zip(names, x)) for x in lines if x[0] == key]
        return out

    def payload(self, capture: dict) -> bytes:
        """The payload of a response capture."""
        return parse(zlib.decompress(self._read(capture["path"], capture["offset"], capture["length"]), 31))[2]


def round_trip(pages: DataFrame, key: str, url: str, payload: str, folder: str, least: int = 0) -> DataFrame:
    """Writes archives and their index, and reads every record back through the index: the key (in its own type), payload_bytes,
    payload_digest, record_type and refers_to per row. See write_archives for nulls, repeats, ties and empty tables."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[key]
    write_archives(pages, key, url, payload, folder, least)
    build_index(spark, folder)
    rows = fetch(captures(spark, folder), folder)
    return rows.select(F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
