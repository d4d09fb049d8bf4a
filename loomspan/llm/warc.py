"""Zstandard WARC archives: writer, and a reader that decodes one frame per record.

Format.  An archive opens with a skippable frame (magic 0x184D2A5D, little-endian length)
that holds the dictionary; every record is one Zstandard frame compressed with it, content
size and checksum in the frame header.  The reader loads the dictionary from that frame
(it may itself be compressed), decodes frame by frame, and checks each record: version
line, mandatory headers, ``Content-Length`` against the block, the closing blank lines,
block and payload digests, no bytes left over.

Scale.  Payloads are hashed where they are read; records with equal payloads meet as short
digest rows, combined before the shuffle, so a payload shared by a third of all pages is
one row a task, and what such a group joins to goes out by broadcast.  Only the rows'
(id, digest) decide which record each becomes.  If the revisits are too many to broadcast,
the pages are shuffled once to meet them.  Archives are cut at ``archive_bytes`` of payload,
written under a task-attempt name and renamed, so a lost executor leaves nothing a reader
would take.  The reader opens the files of the manifest in its tasks and decodes them as
streams: a task holds one record, not one archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_by_group, materialize, shared_path, slices

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = "WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20
READ_BYTES = 1 << 18
READ_ROWS = 5000
#: Bounds of the dictionary and of the sample it is trained on: payloads, and bytes of each.
DICT_BYTES = 64 << 10
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 16
RECORD = (
    "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, "
    "archive string, record_id string, refers_to_id string"
)
#: Types of records that hold or stand for a payload; records of other types are passed over.
TYPES = ("response", "revisit", "resource")
#: Ids that this module's writer makes: the row's id follows.
OWN = "<urn:page:"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def base32_sha1(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_bytes(page_id, url, payload: bytes, date: str, refers_to=None) -> bytes:
    """One record.  A revisit (``refers_to`` set) has an empty block and names the payload's digest and length."""
    block = b"" if refers_to is not None else payload
    clean = "".join(c for c in (url or "") if c >= " " and c != "\x7f")
    head = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if refers_to is not None:
        head += [
            f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>",
            f"WARC-Refers-To-Payload-Length: {len(payload)}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers (by lower-case name) and block of one record; raises :class:`WarcError`."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the headers do not end")
    try:
        lines = raw[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"the headers are no UTF-8: {e}") from e
    if lines[0] not in ("WARC/1.0", VERSION):
        raise WarcError(f"version line {lines[0]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    length = int(headers["content-length"])
    block, rest = raw[end + 4 : end + 4 + length], raw[end + 4 + length :]
    if len(block) != length or rest != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, {len(raw) - end - 8} bytes are there")
    if not agrees(headers.get("warc-block-digest"), block):
        raise WarcError("the block does not have its digest")
    return headers, block


def agrees(digest: str | None, data: bytes) -> bool:
    """Whether a digest header fits; SHA-1 in base32 or hexadecimal is checked, other kinds cannot be."""
    import hashlib

    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == base32_sha1(data) or value.lower() == hashlib.sha1(data).hexdigest()


def page_id(record_id: str | None) -> int | None:
    """The row's id in a record id of this module's writer; None for others."""
    number = (record_id or "").removeprefix(OWN).removesuffix(">")
    return int(number) if (record_id or "").startswith(OWN) and number.lstrip("-").isdigit() else None


def described(h: dict, block: bytes) -> tuple | None:
    """``(page_id, type, digest, bytes, refers_to, url, record_id, refers_to_id)`` of a record, None if passed over.

    The payload of an HTTP message is what follows its headers, of other blocks the block.  A
    revisit's digest and length are those it states; one of another writer may state no length and
    name no record, one of this module must, and must be empty.
    """
    kind, ident = h["warc-type"].lower(), h["warc-record-id"]
    if kind not in TYPES:
        return None
    stated, target = h.get("warc-payload-digest"), h.get("warc-refers-to")
    if kind == "revisit":
        size = h.get("warc-refers-to-payload-length")
        if ident.startswith(OWN) and (target is None or block or size is None):
            raise WarcError(f"{ident}: a revisit must name its response and be empty")
        if size is not None and not size.isdigit():
            raise WarcError(f"{ident}: the payload's length is no number")
        digest = stated.split(":", 1)[-1] if stated else None
        return page_id(ident), kind, digest, None if size is None else int(size), page_id(target), h.get("warc-target-uri"), ident, target
    payload = block
    if h.get("content-type", "").lower().startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        if end < 0:
            raise WarcError(f"{ident}: the HTTP headers do not end")
        payload = block[end + 4 :]
    if not agrees(stated, payload):
        raise WarcError(f"{ident}: the payload does not have its digest")
    return page_id(ident), kind, base32_sha1(payload), len(payload), page_id(target), h.get("warc-target-uri"), ident, target


def archive_head(dictionary: bytes) -> bytes:
    """The leading skippable frame."""
    import struct

    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frames(data):
    """Decoded records of an archive (bytes or a binary stream), one frame each.

    Of a stream a block and one record are held at a time.
    """
    import io
    import struct

    import zstandard

    source = io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data
    options, held, at = {}, source.read(8), 0
    if len(held) == 8 and struct.unpack_from("<I", held)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", held, 4)[0]
        words = source.read(size)
        if len(words) != size:
            raise WarcError("the dictionary frame is cut short")
        held, at = b"", 8 + size
        if words[:4] == struct.pack("<I", FRAME):
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        if words:
            options["dict_data"] = zstandard.ZstdCompressionDict(words)
    decoder = zstandard.ZstdDecompressor(**options)
    while held := held or source.read(READ_BYTES):
        one, out, begun = decoder.decompressobj(), [], at
        while not one.eof:
            if not held and not (held := source.read(READ_BYTES)):
                raise WarcError(f"the frame at byte {begun} is cut short")
            try:
                out.append(one.decompress(held))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at byte {begun}: {e}") from e
            rest = one.unused_data if one.eof else b""
            at += len(held) - len(rest)
            held = rest
        yield b"".join(out)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Dictionary bytes; empty where the samples are too few or too small to train on."""
    import zstandard

    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def marks(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``(id, digest, bytes)`` of every page, stored; null payload: empty."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    return materialize(
        pages.select(
            F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"),
            F.octet_length(payload).cast("long").alias("bytes"),
        ),
        "digests",
    )


def revisits(marked: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(id, digest, refers_to)``, stored: of the pages (id, digest) whose payload has at least
    ``min_bytes`` and stands under a smaller id too.  ``marked``: see :func:`marks`."""
    named = marked.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull())
    shared = materialize(
        named.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared"
    )
    later = join_by_group(named, shared, "digest").where("id > first")
    return materialize(later.select("id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")


def sample_payloads(
    pages: DataFrame, marked: DataFrame, id_col: str = "page_id", payload_col: str = "html"
) -> list[bytes]:
    """Payloads to train the dictionary on: those of the ``SAMPLE_ROWS`` smallest digests.

    Ids are chosen first, among narrow rows; then only the chosen payloads move.
    """
    small = marked.where(F.col("id").isNotNull() & F.col("bytes").between(1, SAMPLE_BYTES))
    chosen = small.groupBy("digest").agg(F.min("id").alias("id")).orderBy("digest").limit(SAMPLE_ROWS).collect()
    if not chosen:
        return []
    payload = F.encode(F.col(payload_col).cast("string"), "UTF-8")
    rows = pages.where(
        F.col(id_col).cast("long").isin([r.id for r in chosen])
        & (F.octet_length(F.col(payload_col).cast("string")) <= SAMPLE_BYTES)
    )
    got = rows.select(
        F.sha1(payload).alias("d"), payload.alias("p")
    ).where(F.col("d").isin([r.digest for r in chosen])).groupBy("d").agg(F.min("p").alias("p"))
    return [bytes(r.p) for r in got.orderBy("d").collect()]


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write ``path/*.warc.zst`` and return ``(archive, records, bytes)`` of the files.

    One record per row, null payload: empty.  Of equal payloads of at least ``min_bytes``
    the rows with the smallest id are responses (one, unless a row is repeated), the others
    revisit it.  A row is known by its id and its payload: rows that share an id with
    different payloads are records of their own.  Rows without an id are responses.  The
    dictionary is trained on a bounded sample (:func:`sample_payloads`).
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    marked = marks(pages, id_col, payload_col)
    dictionary = train_dictionary(sample_payloads(pages, marked, id_col, payload_col))
    back = broadcast_if_small(revisits(marked, min_bytes).withColumnsRenamed({"id": "r_id", "digest": "r_digest"}))
    full = rows.join(
        back, (F.col("id") == F.col("r_id")) & (F.sha1(F.encode("payload", "UTF-8")) == F.col("r_digest")), "left"
    ).select("id", "url", "payload", "refers_to")

    def run(batches):
        import uuid

        import pyarrow as pa
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        coder = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True,
            write_content_size=True,
        )
        done: list = []
        out, name, count, held = None, None, 0, 0

        def close():
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                out = None
                store.move(f"{root}/_{name}", f"{root}/{name}")
                done.append((name, count, size))

        for batch in slices(batches):
            for ident, url, payload, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, count, held = f"part-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/_{name}", compression=None)
                    out.write(archive_head(dictionary))
                data = payload.encode("utf-8")
                out.write(coder.compress(record_bytes(ident, url, data, date, first)))
                count += 1
                held += len(data)
                if held >= archive_bytes:
                    close()
        close()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)],
            names=["archive", "records", "bytes"],
        )

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    # a manifest makes the set of archives the one that committed tasks wrote
    return materialize(full.mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def read_archives(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """Records of ``path/*.warc.zst``, validated; see :data:`RECORD`.

    ``names`` (column ``archive``) restricts the files to those of a manifest.  A broken
    archive raises :class:`WarcError`.  The payload is checked against its digest and its
    length is returned; of a revisit, digest and length are those the record states.  Records
    of other types than :data:`TYPES` (warcinfo, request, metadata and the like) are passed over.  Archives
    of other writers are read too: their ids are text, in ``record_id`` and ``refers_to_id``.
    """
    if names is None:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(
            F.element_at(F.split("path", "/"), -1).alias("archive")
        )
    # a row is a file of some megabytes: each is a piece of its own, as far as there are cores
    files = names.select("archive").repartition(spark.sparkContext.defaultParallelism)
    kinds = dict(x.split() for x in RECORD.split(", "))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        types = [pa.string() if k == "string" else pa.int64() for k in kinds.values()]
        store, root = fs.FileSystem.from_uri(path)

        def batch_of(got):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(c, type=t)
                    for c, t in zip(list(zip(*got, strict=True)) or [()] * len(types), types, strict=True)
                ],
                names=list(kinds),
            )

        for name in (n for b in batches for n in b.column(0).to_pylist()):
            got = []
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for raw in frames(stream):
                    try:
                        row = described(*parse_record(raw))
                    except WarcError as e:
                        raise WarcError(f"{name}: {e}") from e
                    if row is None:
                        continue
                    got.append((*row[:6], name, *row[6:]))
                    if len(got) >= READ_ROWS:
                        yield batch_of(got)
                        got = []
            yield batch_of(got)

    return files.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write archives to the shared folder, read them back, return their records."""
    path = shared_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, path, min_bytes, **options)
    return read_archives(pages.sparkSession, path, manifest)
