"""Interleaved text and media sequences with payloads resolved by digest.

A page's HTML becomes an ordered array of structs: text blocks and media references, each with its
position; a reference carries its digest and the caption of its figure. The media store is a table
of (digest, media). Resolving joins references and store on the digest, after the store has been
reduced to what is wanted from each payload, so that payloads are read where they lie and never
shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, scratch, small_batches, staged

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ELEMENT = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
BLOCK_TAGS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "pre", "blockquote", "article", "section", "br", "table", "ul", "ol", "title", "body", "figure"))
MEDIA_TAGS = frozenset(("img", "video", "audio", "source", "embed"))
SILENT = frozenset(("script", "style", "noscript", "template"))
DIGEST = re.compile(r"(?:sha256[:-])?([0-9a-fA-F]{64})\Z")


def digest_of(attrs: dict[str, str | None]) -> str | None:
    """From ``data-sha256``, a ``sha256:`` reference, or the bytes of a base64 ``data:`` URI."""
    for name in ("data-sha256", "src"):
        if m := DIGEST.match(attrs.get(name) or ""):
            return m[1].lower()
    head, _, body = (attrs.get("src") or "").partition(",")
    if head.startswith("data:") and head.endswith(";base64"):
        try:
            return hashlib.sha256(base64.b64decode(body, validate=True)).hexdigest()
        except binascii.Error:
            return None
    return None


class Sequence(HTMLParser):
    """Collects the elements of one page in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.silent = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.add(kind="text", text=text)

    def add(self, **what: str | None) -> None:
        self.elements.append({"position": len(self.elements), "text": None, "src": None, "digest": None, "caption": None} | what)

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in MEDIA_TAGS:
            self.flush()
            of = dict(attrs)
            if of.get("src") or of.get("data-sha256"):
                self.add(kind="media", src=of.get("src"), digest=digest_of(of), caption=" ".join((of.get("alt") or "").split()) or None)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.elements)

    def handle_startendtag(self, tag, attrs):
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag in BLOCK_TAGS:
            self.close_caption()
            self.flush()
            if tag == "figure":
                self.figure = None

    def close_caption(self) -> None:
        """A caption belongs to all media of its figure; outside a figure it is text."""
        text = " ".join("".join(self.caption or []).split())
        self.caption = None
        if text and self.figure is not None and (media := [e for e in self.elements[self.figure :] if e["kind"] == "media"]):
            for e in media:
                e["caption"] = text
        elif text:
            self.add(kind="text", text=text)

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    if html is None:
        return []
    s = Sequence()
    s.feed(html)
    s.close()
    s.close_caption()
    s.flush()
    return s.elements


def parse_interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, elements)`` for every row: the ordered text and media structs of its HTML.

    A null or empty page has an empty array. Unclosed tags end with the page. Media without a digest
    keep their ``src`` with a null digest. Ids may be null or repeat. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    kind = pa.list_(pa.struct([("position", pa.int32())] + [(n, pa.string()) for n in ("kind", "text", "src", "digest", "caption")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(elements, b.column(1).to_pylist())), kind)], ["id", "elements"])

    read = pages.select(pages[id_col].cast("long").alias("id"), pages[html_col].cast("string").alias("html"))
    return read.mapInArrow(run, f"id long, elements {ELEMENT}")


def resolve(sequences: DataFrame, known: DataFrame) -> DataFrame:
    """One row per element of ``sequences``, with the columns of ``known`` for its digest.

    ``known`` has one row per digest. References whose digest is null or unknown keep their row with
    ``resolved`` false, so positions and captions stay aligned. One digest may be referred to by any
    number of rows: the join is an ordinary one, whose large partitions Spark splits. Columns of ``known`` other than ``digest``
    must not be named like those of an element. Rows with a null id stay; a row without elements has none here.
    """
    flat = sequences.select("id", F.explode("elements").alias("e")).select("id", "e.*")
    out = flat.join(known.withColumn("resolved", F.lit(True)), "digest", "left")
    return out.withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))


def to_png(data: bytes) -> bytes:
    """Bytes, zero-padded to a positive multiple of 64, as an 8-bit grey image 64 wide; the length goes in a text chunk."""
    height = max(1, -(-len(data) // WIDTH))
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    padded = np.zeros(height * WIDTH, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    rows[:, 1:] = padded.reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return b"".join(
        [SIGNATURE, chunk(b"IHDR", head), chunk(b"tEXt", b"Length\0%d" % len(data)), chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)), chunk(b"IEND", b"")]
    )


def from_png(media: bytes) -> tuple[int, np.ndarray]:
    """The length before padding and the samples, rows by 64; for images that ``to_png`` made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, shape, length = 8, [], (0, 0), 0
    while at < len(media):
        size, name = struct.unpack(">I4s", media[at : at + 8])
        part = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(part, zlib.crc32(name)):
            raise ValueError(f"chunk {name!r} is damaged")
        if name == b"IHDR":
            shape = struct.unpack(">II", part[:8])
        elif name == b"tEXt" and part.startswith(b"Length\0"):
            length = int(part[7:])
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return length, np.ascontiguousarray(rows[:, 1:])


def average_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8 by 8 grid are brighter than the image; short images repeat rows."""
    edges = np.arange(8) * len(samples) // 8
    sums = samples.reshape(len(samples), 8, -1).sum(axis=2, dtype=np.int64)
    rows = np.add.reduceat(sums, edges, axis=0)
    sizes = np.maximum(np.diff(np.r_[edges, len(samples)]), 1)[:, None]
    mean = rows / sizes
    return np.packbits(mean > mean.mean()).tobytes().hex()


def read_back(media: bytes) -> tuple:
    length, samples = from_png(media)
    payload = samples.tobytes()
    return (
        length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
        len(media), hashlib.sha256(media).hexdigest(), average_hash(samples),
    )


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(store: DataFrame) -> DataFrame:
    """One row per digest of ``store(digest, media)``: what decoding each stored image gives."""
    small_batches(store.sparkSession)
    names = ["digest", *(x.split()[0] for x in FEATURES.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(read_back, b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    read = store.select("digest", "media").mapInArrow(run, f"digest string, {FEATURES}")
    one = read.groupBy("digest").agg(F.first(F.struct(*names[1:])).alias("f"))
    return one.select("digest", "f.*")


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, html, digest, media)``: each text as an image, and a page with a figure that refers to it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [to_png(x or b"") for x in b.column(1).to_pylist()]
            digests = [hashlib.sha256(x).hexdigest() for x in media]
            html = [
                f'<article><p>A document of {len(x or b"")} bytes.</p><figure><img src="sha256:{d}"><figcaption>Samples of {len(x or b"")} bytes</figcaption></figure></article>'
                for x, d in zip(b.column(1).to_pylist(), digests, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(html, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["id", "html", "digest", "media"]
            )

    return bytes_of(docs, id_col, text_col).mapInArrow(run, "id long, html string, digest string, media binary")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a 64-wide 8-bit image, refer to it from a page, resolve and read it back.

    One row per row of ``docs`` with the features of its image, its position in the page and its
    caption. A null text is an empty one: 64 zero bytes, ``n_bytes`` 0. Equal texts have equal digests: each image is
    stored and decoded where its document lies, and references get the features of one of the copies. Ids may be null or repeat. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    at = scratch(spark)
    made = illustrated(docs, id_col, text_col)
    made.write.option("compression", "none").parquet(at)  # images are deflated already
    kept = spark.read.schema(made.schema).parquet(at)
    sequences = parse_interleaved(kept, "id", "html")
    # a table of its own on either side lets Spark split the partitions of a digest with many references
    found = resolve(sequences, staged(features(kept))).where("kind = 'media'")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return found.select(F.col("id").alias("doc_id"), *names, "position", "caption")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
