"""WARC archives with an index first: offset, length, URL and digest of every record.

Tasks write archives of gzip members straight to the shared folder and return
index rows; only a task that succeeded has its rows in the index, so archives
of lost attempts are never read.  Reading starts from any selection of index
rows: they are sorted by archive and offset, neighbouring byte ranges are
coalesced, and each run is one ranged read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import PLACE, located, shared_folder, small_side, stored, workers_see_package

#: Payloads of fewer bytes are never revisits (contract: all may be).
MIN_REVISIT_BYTES = 0
#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges are read in one go if at most so many bytes lie between, up to a run of so many.
MAX_GAP, MAX_RUN = 1 << 16, 8 << 20
COMPRESSION = 4

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Pages have no time of retrieval.
DATE = "1970-01-01T00:00:00Z"
#: Extension fields: the page's identifier, and that of the response.
PAGE, RESPONSE_PAGE = "X-Page-Id", "X-Response-Page-Id"

INDEX = (
    "archive string, offset long, length long, url string, digest string, page_id long,"
    " record_id string, record_type string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(place: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, place))


def _longs(values) -> pd.arrays.IntegerArray:
    """Whole numbers with nulls, without a detour through floating point."""
    return pd.array([None if x is None or x != x else int(x) for x in values], dtype="Int64")


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    """One gzip member; fields that are None are left out."""
    lines = [VERSION, *[f"{name}: {value}" for name, value in fields.items() if value is not None]]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", COMPRESSION, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one gzip member."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """The index (``INDEX``) of archives with one record per row of ``pages``.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the
    largest identifier (null smallest; of repeated rows the last in place) is a
    response and the others revisit it.  A null payload is empty; a null URL
    has no target field.  The HTML moves only if the digests of repeated
    payloads are too many to broadcast.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    workers_see_package(spark)
    rows = located(pages).select(
        *PLACE,
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    last = F.struct("page_id", *PLACE)
    repeated = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha1")
        .agg(F.max(last).alias("response"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    repeated = small_side(stored(repeated, "warc-repeated"), 60)
    place = lambda prefix: F.concat(F.col(f"{prefix}{PLACE[0]}"), F.lit(":"), F.col(f"{prefix}{PLACE[1]}"))
    marked = rows.join(repeated, "sha1", "left").select(
        "payload",
        "url",
        F.col("page_id").cast("string").alias("page"),
        F.col("response.page_id").cast("string").alias("response_page"),
        place("").alias("place"),
        place("response.").alias("response_place"),
    )
    folder = shared_folder(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        out, archive, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.itertuples(index=False):
                    payload, url, page, response_page, place, response_place = row
                    revisit = response_place is not None and response_place != place
                    own = record_id(place)
                    digest = digest_of(payload)
                    fields = {
                        "WARC-Type": "revisit" if revisit else "response",
                        "WARC-Record-ID": f"<urn:uuid:{own}>",
                        "WARC-Date": DATE,
                        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
                        "WARC-Payload-Digest": f"sha1:{digest}",
                        "Content-Type": "application/http; msgtype=response",
                        PAGE: page,
                    }
                    if revisit:
                        fields |= {
                            "WARC-Profile": PROFILE,
                            "WARC-Refers-To": f"<urn:uuid:{record_id(response_place)}>",
                            RESPONSE_PAGE: response_page,
                        }
                    member = record(fields, HTTP if revisit else HTTP + payload)
                    if out is not None and offset >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        archive, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        store, path = fs.FileSystem.from_uri(archive)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    out.write(member)
                    index.append((archive, offset, len(member), url, digest, page, own, fields["WARC-Type"]))
                    offset += len(member)
                frame = pd.DataFrame(index, columns=[part.split()[0] for part in INDEX.split(", ")])
                frame["page_id"] = _longs(frame["page_id"])
                yield frame
        finally:
            if out is not None:
                out.close()

    return stored(marked.mapInPandas(write, INDEX), "warc-index")


def runs_of(index: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of one archive each whose ranges are near enough for one read; ``index`` is sorted."""
    if index.empty:
        return
    ends = index.offset + index.length
    far = (index.archive != index.archive.shift()) | (index.offset - ends.shift() > MAX_GAP)
    size, numbers, number = 0, [], 0
    for new, length in zip(far, index.length):
        size = 0 if new else size
        if new or size + length > MAX_RUN:
            number, size = number + 1, 0
        size += length
        numbers.append(number)
    for _, run in index.groupby(numbers):
        yield run


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` selects, with the checked digest of what was read.

    Columns: page_id, url, record_id, record_type, digest, refers_to_id, response_page,
    payload_bytes (null for revisits), and ``payload`` if wanted (null for revisits).
    """
    workers_see_package(index.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for run in runs_of(batch):
                store, path = fs.FileSystem.from_uri(run.archive.iloc[0])
                begin = int(run.offset.iloc[0])
                size = int(run.offset.iloc[-1] + run.length.iloc[-1]) - begin
                with store.open_input_file(path) as archive:
                    data = archive.read_at(size, begin)
                rows = []
                for offset, length, url, digest in zip(run.offset, run.length, run.url, run.digest):
                    fields, block = parsed(data[offset - begin : offset - begin + length])
                    revisit = fields["WARC-Type"] == "revisit"
                    payload = None if revisit else block[len(HTTP) :]
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if stated != digest or not revisit and digest_of(payload) != digest:
                        raise ValueError(f"record at {offset} of {path} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    rows.append((
                        fields.get(PAGE), url, fields["WARC-Record-ID"][10:-1], fields["WARC-Type"], digest,
                        refers and refers[10:-1], fields.get(RESPONSE_PAGE),
                        None if revisit else len(payload), payload,
                    ))
                names = ["page_id", "url", "record_id", "record_type", "digest", "refers_to_id",
                         "response_page", "payload_bytes", "payload"]
                frame = pd.DataFrame(rows, columns=names)
                for name in ("page_id", "response_page", "payload_bytes"):
                    frame[name] = _longs(frame[name])
                yield frame if with_payload else frame.drop(columns="payload")

    schema = (
        "page_id long, url string, record_id string, record_type string, digest string,"
        " refers_to_id string, response_page long, payload_bytes long"
    ) + (", payload binary" if with_payload else "")
    wanted = index.select("archive", "offset", "length", "url", "digest")
    return wanted.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInPandas(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of all pages, read back.

    A revisit's payload is that of the response it refers to, by record identifier.
    """
    records = stored(read_records(write_archives(pages), with_payload=False), "warc-records")
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("payload_bytes").alias("bytes"), F.col("digest").alias("digest_of")
    )
    own = records.where("record_type = 'response'").withColumns(
        {"bytes": F.col("payload_bytes"), "digest_of": F.col("digest")}
    )
    again = records.where("record_type = 'revisit'").join(responses, "refers_to_id", "left")
    return own.unionByName(again).select(
        "page_id",
        "url",
        F.col("bytes").alias("payload_bytes"),
        F.col("digest_of").alias("payload_digest"),
        "record_type",
        F.col("response_page").alias("refers_to"),
    )
