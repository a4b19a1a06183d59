"""Operator 6: WARC archives, written and read through an index.

Writing: each task writes one archive (every record its own gzip member) and gives
one index row for each record: archive, offset, length, URL and payload digest.
The index is a Parquet table beside the archives; only rows of tasks that
succeeded are in it, so an archive that a lost executor left half-written is never
read.  Records with equal payloads are written once, the others as revisits.

Reading: selected index rows are dealt by archive and range, sorted by offset, and
neighbouring byte ranges are read in one go; each record is then cut out, unpacked
and checked against its digest.

Paths may be of any file system that pyarrow opens (local or mounted, HDFS, S3, GCS).

Cases: a null html has an empty payload, which is deduplicated like any other; of
rows with equal payloads the largest page_id is the response (null is the least),
and repeated rows of that id are all responses; very long payloads are held one at
a time; a null or odd URL is written percent-encoded; extra columns are not
written; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import by_value, ensure_checkpoint_dir, settle, small_batches

#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: the page a record is of, and the page that a revisit refers to.
PAGE, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
INDEX_SCHEMA = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "archive string, offset long, length long"
)
#: Byte ranges less than GAP apart are read together, up to READ bytes; an archive is dealt in stretches of STRETCH.
GAP, READ, STRETCH = 64 << 10, 8 << 20, 32 << 20
#: Level of the gzip members; speed matters more than size here.
LEVEL = 1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(url: str | None) -> str:
    """A URL as a header may hold it."""
    return quote(url or "about:blank", safe=":/?#[]@!$&()*+,;=%~")


def record(
    place: str, page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, response: tuple | None, date: str
) -> bytes:
    """One record as a gzip member; ``place`` (archive and offset) makes its id unique.

    ``response`` is None for a response, else (page_id, url) of the one that a revisit
    refers to; a revisit has the HTTP header only, which gives the length of its payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
    block = http.encode() + (payload if response is None else b"")
    head = [
        VERSION,
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"{PAGE}: {page_id}",
    ]
    if response is not None:
        head += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {target(response[1])}",
            f"WARC-Refers-To-Date: {date}", f"{REFERS_TO_PAGE}: {response[0]}",
        ]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def fields_of(lines: list[str]) -> dict[str, str]:
    """Header fields, names in lower case."""
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(packed: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the length that the payload has by its HTTP header, and the payload of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"no record begins here: {lines[0][:40]!r}")
    fields = fields_of(lines[1:])
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, int(fields_of(http.decode().split("\r\n")[1:])["content-length"]), payload


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder`` and return the index, read from its table.

    The number of archives is that of the tasks after the join on the digest; AQE sizes them.
    """
    html = F.coalesce("html", F.lit(""))
    marked = small_batches(pages).select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("n"))
    # Settled, so that the join shuffles both sides itself and a payload that a third of the pages have can be split.
    first = settle(marked.groupBy("sha", "n").agg(F.max("page_id").alias("response"), F.max_by("url", "page_id").alias("response_url")))
    revisit = ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = marked.join(first, ["sha", "n"]).select(
        "page_id", "url", F.when(~revisit, F.encode("html", "UTF-8")).alias("payload"), F.col("n").cast("long").alias("n"), "sha",
        F.when(revisit, F.struct("response", "response_url")).alias("refers_to"),
    )

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, at = "", None, 0
        for batch in batches:
            found = []
            for page_id, url, payload, n, sha, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, base = opened(folder)
                    system.create_dir(base, recursive=True)
                    place = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(place, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                response = refers_to and (refers_to["response"], refers_to["response_url"])
                packed = record(f"{place}#{at}", page_id, url, payload or b"", n, digest, response, date)
                out.write(packed)
                kind = "revisit" if response else "response"
                found.append((page_id, url, kind, response[0] if response else None, digest, n, place, at, len(packed)))
                at += len(packed)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), INDEX_TYPES)], INDEX_NAMES)
        if out is not None:
            out.close()

    index = f"{folder}/index"
    rows.mapInArrow(put, INDEX_SCHEMA).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(index)


INDEX_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
INDEX_TYPES = [pa.int64() if x.split()[1] == "long" else pa.string() for x in INDEX_SCHEMA.split(", ")]


def spans(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted (offset, length) rows as reads: (start, end, numbers of the rows within)."""
    start, end, held = 0, 0, []
    for i, (offset, length) in enumerate(rows):
        if held and (offset - end > GAP or offset + length - start > READ):
            yield start, end, held
            held = []
        if not held:
            start = offset
        held.append(i)
        end = max(end, offset + length) if len(held) > 1 else offset + length
    if held:
        yield start, end, held


def read(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read the records of index rows: the index columns, the type and digest found there, and the payload (or null).

    All ``read_`` columns come from the record: a response's digest and length are
    computed over its payload, a revisit's are those of its headers, as it has none;
    ``unmatched_revisits`` holds them against the response.  A record that differs from
    its index row fails the task.
    """
    names = [*INDEX_NAMES, "read_type", "read_refers_to", "read_digest", "read_bytes", "payload"]
    schema = INDEX_SCHEMA + ", read_type string, read_refers_to long, read_digest string, read_bytes long, payload binary"
    types = [*INDEX_TYPES, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        place, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(n).to_pylist() for n in INDEX_NAMES)))
            at = 0
            while at < len(rows):
                upto = at
                while upto < len(rows) and rows[upto][6] == rows[at][6]:
                    upto += 1
                if place != rows[at][6]:
                    if source is not None:
                        source.close()
                    place = rows[at][6]
                    source = system.open_input_file(place)
                own = rows[at:upto]
                for start, end, held in spans([(r[7], r[8]) for r in own]):
                    source.seek(start)
                    stretch, found = source.read(end - start), []
                    for i in held:
                        row = own[i]
                        fields, n, payload = parse(stretch[row[7] - start : row[7] - start + row[8]])
                        said = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind, refers_to, digest = fields["warc-type"], None, said
                        if kind == "revisit":
                            refers = fields[REFERS_TO_PAGE.lower()]
                            refers_to = None if refers == "None" else int(refers)
                        elif digest_of(payload) != said or len(payload) != n:
                            raise ValueError(f"{place} at {row[7]}: the payload isn't what was written")
                        if (kind, refers_to, digest, n) != (row[2], row[3], row[4], row[5]):
                            raise ValueError(f"{place} at {row[7]}: the record isn't what the index says")
                        found.append((*row, kind, refers_to, digest, n, payload if payloads else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)
                at = upto
        if source is not None:
            source.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = selected.select(*INDEX_NAMES).repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(get, schema)


def unmatched_revisits(found: DataFrame) -> DataFrame:
    """Revisits of records read whose response isn't among them, or has another digest or length."""
    key = ["read_refers_to", "read_digest", "read_bytes"]
    responses = found.where("read_type = 'response'").select(F.col("page_id").alias("read_refers_to"), "read_digest", "read_bytes")
    return found.where("read_type = 'revisit'").join(responses, key, "left_anti")


def new_folder(spark: SparkSession) -> str:
    """A folder for archives in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"


by_value(__name__)
