"""Media columns: interleaved documents of text and media references.

A page's HTML is parsed into an ordered sequence of items: runs of text and references to media, each with its
place in the sequence, its digest and its caption. Media live in a table of their own, keyed by a digest of
their payload, and a join on the digest resolves the references; places and captions stay with them.

A payload of any bytes is stored as an 8-bit grey image, 64 samples a row, in PNG form: the bytes, padded with
0 to a positive multiple of 64, are its samples. Reading it back gives the samples, their digests and features.

Defined cases: null HTML or text is empty; an empty document still has a medium (64 zero samples); references
without digest or without a medium stay in the sequence, unresolved (payload columns null); media that occur
more than once in the table are taken once; repeated rows, null ids and other columns pass through; empty
tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwater.llm import common

WIDTH = 64
ITEM = "struct<position: bigint, kind: string, text: string, digest: string, source: string, caption: string>"
_ITEM = pa.struct([("position", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("source", pa.string()), ("caption", pa.string())])
#: Fixed values of the PNG format: its signature, and elements of HTML that end a run of text, hide their content, or refer to media.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style template noscript head".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}


# --------------------------------------------------------------------------- stored form


def pad(data: bytes) -> bytes:
    return data + bytes(WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A payload of a positive multiple of 64 bytes as an 8-bit grey image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    filtered[:, 1:] = rows
    return PNG_SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() made; every chunk's checksum is verified."""
    if data[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, height = 8, [], 0
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", chunk[:10])
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not a stored payload")
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("not a stored payload")
    return rows[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Rows, sum of the samples, a 16-bin histogram of the samples, and a 64-bit mean hash of their 64 columns."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16)
    columns = samples.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    bits = np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()
    return f"{len(samples) // WIDTH}:{int(samples.sum(dtype=np.int64))}:{','.join(map(str, bins.tolist()))}:{bits}"


def payload_of(text: Column) -> Column:
    """A text's UTF-8 bytes, padded; the same bytes as pad() gives."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    more = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.substring(F.lit(bytes(WIDTH)), F.lit(1), more))


def store(texts: DataFrame) -> DataFrame:
    """(text) -> digest (of the padded payload), media: written as a table in shared storage, and read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "text", 2_000_000):
            payloads = [pad((x or "").encode("utf-8", "surrogatepass")) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array([to_png(x) for x in payloads], pa.binary())], names=["digest", "media"])

    return common.stash(common.map_batches(texts.select("text"), run, "digest string, media binary"), "media", codec="uncompressed")


def examine(media: DataFrame) -> DataFrame:
    """digest, media -> a row for each digest: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, all of the stored bytes read back. Media whose bytes are not those of their digest are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for digest, data in zip(part.column("digest").to_pylist(), part.column("media").to_pylist(), strict=True):
                payload = from_png(data)
                found = hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"the medium of {digest} holds {found}")
                rows.append((digest, len(payload), found, zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    seen = common.map_batches(media.select("digest", "media"), run, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return seen.groupBy("digest").agg(*[F.min(c).alias(c) for c in names[1:]])


# --------------------------------------------------------------------------- documents


class _Sequence(HTMLParser):
    """Collects the items of one page in order. A figure's caption belongs to the media in the figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = self.caption = 0
        self.figure: list[dict] | None = None

    def settle(self) -> None:
        text = "".join(self.run).strip(" \t\n\r\f\v")
        self.run = []
        if text and self.caption and self.figure is not None:
            for x in self.figure:
                x["caption"] = text if not x["caption"] else f"{x['caption']} {text}"
        elif text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "source": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.settle()
            self.hidden += 1
        elif tag in MEDIA:
            self.settle()
            a = dict(attrs)
            source = a.get("src") or ""
            digest = re.fullmatch(r"sha256:([0-9a-f]{64})", source)
            item = {"position": len(self.items), "kind": MEDIA[tag], "text": None, "digest": digest[1] if digest else None, "source": source, "caption": a.get("alt") or a.get("title") or None}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in BLOCKS:
            self.settle()
            if tag == "figure":
                self.figure = []
            self.caption += tag == "figcaption"

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.run = []
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.settle()
            self.caption -= tag == "figcaption" and self.caption > 0
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            self.run.append(data)


def parse(html: str | None) -> list[dict]:
    page = _Sequence()
    page.feed(html or "")
    page.close()
    page.settle()
    return page.items


def sequences(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of keep, and items: array<struct<position, kind, text, digest, source, caption>>."""
    source = pages.select(*keep, F.col(html).alias("html_"))
    types = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in source.schema if x.name != "html_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "html_", 2_000_000):
            items = pa.array([parse(x) for x in part.column("html_").to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), items], names=[*keep, "items"])

    return common.map_batches(source, run, f"{types}, items array<{ITEM}>")


def references(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each media reference: keep, and the item's position, kind, digest, source, caption."""
    one = documents.select(*keep, F.explode(F.filter("items", lambda x: x["kind"] != "text")).alias("item_"))
    return one.select(*keep, *[F.col(f"item_.{c}").alias(c) for c in ("position", "kind", "digest", "source", "caption")])


def resolve(refs: DataFrame, examined: DataFrame) -> DataFrame:
    """References with the columns of examine(); a hot digest only repeats a short row, and the join can be split."""
    return refs.join(examined, "digest", "left")


def as_page(text: Column, caption: Column) -> Column:
    """A text as HTML: its first line, the figure of its own payload, and its other lines."""

    def safe(x: Column) -> Column:
        return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    text = F.coalesce(text, F.lit(""))
    lines = F.split(safe(text), "\n", 2)
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.sha2(payload_of(text), 256), F.lit('"><figcaption>'), safe(F.coalesce(caption, F.lit(""))), F.lit("</figcaption></figure>"))
    rest = F.replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), F.lit("\n"), F.lit("</p><p>"))
    return F.concat(F.lit("<article><p>"), F.element_at(lines, 1), F.lit("</p>"), figure, F.lit("<p>"), rest, F.lit("</p></article>"))
