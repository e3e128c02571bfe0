"""WARC records in Zstandard archives: one frame for each record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import table

DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds the dictionary
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
_VERSION = re.compile(rb"WARC/[01]\.\d+\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)\r\n((?:[ \t][^\r\n]*\r\n)*)")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC record. A revisit has no block; the digest and length of the payload it stands for are in its header."""
    block = b"" if kind == "revisit" else payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri or "urn:none"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(length)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if kind == "revisit" else []),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record of version 0.x or 1.x; ValueError if it is not well formed.

    A line that begins with a space or tab goes on with the field before it; a field that is there twice has both values,
    with a comma between. Values are UTF-8, or else Latin-1.
    """
    version = _VERSION.match(data)
    if not version:
        raise ValueError("no WARC version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the header has no end")
    fields: dict[str, str] = {}
    at = version.end()
    while at < end + 2:
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError(f"bad header line at {at}")
        raw = b" ".join([m[2], *(x.strip(b" \t") for x in m[3].split(b"\r\n") if x.strip(b" \t"))]).rstrip(b" \t")
        try:
            value = raw.decode()
        except UnicodeDecodeError:
            value = raw.decode("latin-1")
        name = m[1].decode().lower()
        fields[name] = f"{fields[name]}, {value}" if name in fields else value
        at = m.end()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise ValueError(f"no {k}")
    block = data[end + 4 : -4]
    if data[-4:] != b"\r\n\r\n" or len(data) < end + 8 or not fields["content-length"].isdigit() or len(block) != int(fields["content-length"]):
        raise ValueError("Content-Length is not the block's length")
    return fields, block


def _unchunked(body: bytes) -> bytes:
    """The body of a message that came in chunks; ValueError if it did not."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or len(body) < end + 2 + size:
            raise ValueError("a bad chunk")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payloads(fields: dict[str, str], block: bytes) -> list[bytes]:
    """What may be meant by a record's payload: the body of an HTTP message, as it was sent and with its chunks joined; else the block."""
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return [block]
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return [b""]
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        try:
            return [_unchunked(body), body]
        except ValueError:
            pass
    return [body]


def _is_digest(said: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` (base 32 or hexadecimal) is the digest of ``data``; algorithms that are not known are believed."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return True
    digest = hashlib.new(name, data).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(digest).decode().rstrip("="), digest.hex().upper())


class ArchiveWriter:
    """Collects records; the dictionary is trained on the first ``sample`` of them, at most ``dict_bytes`` large."""

    def __init__(self, level: int = 3, sample: int = 400, dict_bytes: int = 32 << 10):
        self.level, self.sample, self.dict_bytes = level, sample, dict_bytes
        self.waiting: list[bytes] = []
        self.out: bytearray | None = None

    def add(self, rec: bytes) -> None:
        if self.out is None:
            self.waiting.append(rec)
            if len(self.waiting) >= self.sample:
                self._start()
        else:
            self.out += self.packer.compress(rec)

    def _start(self) -> None:
        try:
            found = zstandard.train_dictionary(self.dict_bytes, [r[: 1 << 16] for r in self.waiting], level=self.level).as_bytes()
        except zstandard.ZstdError:  # too few or too uniform samples
            found = b""
        self.out = bytearray(struct.pack("<II", DICTIONARY_MAGIC, len(found)) + found)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(found) if found else None, write_content_size=True, write_checksum=True)
        for r in self.waiting:
            self.out += self.packer.compress(r)
        self.waiting = []

    def size(self) -> int:
        return len(self.out or b"") + sum(map(len, self.waiting))

    def close(self) -> bytes:
        if self.out is None:
            self._start()
        return bytes(self.out)


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, a frame each; ValueError on damage."""
    view, at, known = memoryview(archive), 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        if len(archive) < 8 + size:
            raise ValueError("the dictionary frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        at = 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(archive):
        if len(archive) - at < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", archive, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        d, parts, begun = opener.decompressobj(), [], at
        while not d.eof:  # in steps, as what follows the frame is handed back as a copy
            if at >= len(archive):
                raise ValueError("a frame is cut off")
            try:
                parts.append(d.decompress(view[at : at + (16 << 10)]))
            except zstandard.ZstdError as e:
                raise ValueError(f"the frame at {begun} is damaged: {e}") from None
            at = min(at + (16 << 10), len(archive))
        at -= len(d.unused_data)
        yield b"".join(parts)


def _write(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(w: ArchiveWriter, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"n_records": pa.array([n], pa.int64()), "archive": pa.array([w.close()], pa.binary())})

        writer, n, size = ArchiveWriter(), 0, 0
        for batch in batches:
            for name, uri, html, digest, length, kind, to in zip(*(batch[c] for c in ("name", "uri", "html", "digest", "length", "kind", "refers_to")), strict=True):
                writer.add(record(kind.as_py(), name.as_py(), uri.as_py(), html.as_py().encode(), digest.as_py(), length.as_py(), to.as_py()))
                n, size = n + 1, size + length.as_py()
                if size >= most:
                    yield out(writer, n)
                    writer, n, size = ArchiveWriter(), 0, 0
        if n:
            yield out(writer, n)

    return run


_READ = "record_id string, name string, target_uri string, date string, payload_bytes long, payload_digest string, record_type string, refers_to string, block binary, error string"


def _read(blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "block": pa.binary()}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)

        for batch in batches:
            for archive in batch["archive"]:
                rows, size = [], 0
                try:
                    for data in records(archive.as_py() or b""):
                        rows.append(_checked(data, blocks))
                        size += len(data) if blocks else 200
                        if size > 1 << 22:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    rows.append((None,) * 9 + (str(e),))
                yield out(rows)

    return run


def _own(record_id: str | None) -> str | None:
    """The page's name in an id that :func:`record` made."""
    m = re.fullmatch(r"<urn:page:(.*)>", record_id or "")
    return m[1] if m else None


def _checked(data: bytes, blocks: bool) -> tuple:
    """A row of a record; what is wrong with it, if anything, in the last column."""
    try:
        fields, block = parse(data)
        kind, said = fields["warc-type"].lower(), fields.get("warc-payload-digest")
        if "warc-block-digest" in fields and not _is_digest(fields["warc-block-digest"], block):
            raise ValueError("the block has another digest")
        to = fields.get("warc-refers-to")
        length, digest = None, None
        if kind == "revisit":  # of the payload of another record
            if not said and not to and "warc-refers-to-target-uri" not in fields:
                raise ValueError("a revisit of nothing")
            size = fields.get("warc-payload-length", "")
            length = int(size) if size.isdigit() else None
            to = to or fields.get("warc-refers-to-target-uri")
        elif kind in ("response", "resource", "request", "conversion"):
            some = payloads(fields, block)
            fits = [p for p in some if said is None or "warc-segment-number" in fields or _is_digest(said, p)]  # a segment is not the whole
            if not fits:
                raise ValueError("the payload has another digest")
            length, digest = len(fits[0]), base32_sha1(fits[0])
        if said and (digest is None or "warc-segment-number" in fields):
            digest = said.removeprefix("sha1:")
        name = _own(to)
        return fields["warc-record-id"], _own(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-date"], length, digest, kind, to if name is None else name, block if blocks else None, None
    except ValueError as e:
        return (None,) * 9 + (str(e),)


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Archives (n_records, archive) of ``pages`` (page_id, url, html), about ``archive_bytes`` of payload each.

    The payload is the html in UTF-8; null is empty. Of the records with equal payloads of at least
    ``least`` bytes the one with the largest page_id is a response and the others revisit it; rows that
    share that page_id are all responses; so is a row without a page_id whose payload no page with an id has.
    Smaller payloads are all responses. A null url is written as urn:none.
    """
    ship(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("uri"), html.alias("html"), F.sha1(html.cast("binary")).alias("hex"), F.octet_length(html).alias("length"))
    last = table(rows.where(F.col("length") >= least).groupBy("hex").agg(F.max("page_id").alias("best")), "payloads")
    rows = rows.join(last, "hex", "left")
    revisit = (F.col("length") >= least) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    rows = rows.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name"),
        "uri",
        F.when(revisit, "").otherwise(F.col("html")).alias("html"),
        _base32("hex").alias("digest"),
        "length",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("best").cast("string")).alias("refers_to"),
    )
    return rows.mapInArrow(_write(archive_bytes), "n_records long, archive binary")


def _base32(column: str):
    """40 hexadecimal digits as 32 characters of base 32: groups of 5 digits are 20 bits, 4 characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: F.conv(F.substring(column, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda i, k: F.substring(F.lit(letters), F.shiftright(group(i), 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(letter(i, k) for i in range(8) for k in range(4)))


def _save(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for i, n, archive in zip(batch["i"].to_pylist(), batch["n_records"].to_pylist(), batch["archive"], strict=True):
                data = archive.as_buffer()
                name = f"{i:015d}-{hashlib.sha256(data).hexdigest()[:16]}.warc.zst"
                part = f"{top}/_{uuid.uuid4().hex}"  # seen under its name when it is whole; written again, it is the same
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, f"{top}/{name}")
                rows.append((name, n, len(data)))
            names, counts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["name", "n_records", "bytes"])

    return run


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes ``archives`` (n_records, archive) as files ``*.warc.zst`` into a folder that all executors reach; returns (name, n_records, bytes) of each.

    The archives should be a table (see :func:`~.common.table`): a task that runs again then writes the same files under the same names.
    """
    ship(archives.sparkSession)
    numbered = archives.select(F.monotonically_increasing_id().alias("i"), "n_records", "archive")
    return table(numbered.mapInArrow(_save(folder), "name string, n_records long, bytes long"), "archive-names")


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive) of all files ``*.warc.zst`` in a folder, by any store that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select("path", F.col("content").alias("archive"))


def read_archives(archives: DataFrame, blocks: bool = False) -> DataFrame:
    """The records of ``archives`` (a binary column ``archive``): record_id, name, target_uri, date, payload_bytes, payload_digest, record_type, refers_to, block, error.

    Records are of any type, with any id, by any writer of versions 0.x and 1.x. Every frame is decoded with the archive's own dictionary
    and must hold one record whose header, Content-Length and digests (where it has some) are right; a record that is not has nulls
    and says why in ``error``; a damaged frame ends its archive with such a row. name: the page in ids that :func:`record` made, else
    null; refers_to likewise, else the id, or the address, that a revisit names. The payload is the body of an HTTP message, else the
    block; payload_bytes and payload_digest are null where a record has none (warcinfo, metadata), and a revisit's are what it says.
    ``blocks``: return the blocks, else null.
    """
    ship(archives.sparkSession)
    return archives.select("archive").mapInArrow(_read(blocks), _READ)
