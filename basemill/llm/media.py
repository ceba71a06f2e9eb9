"""Media columns: pages as ordered sequences of text and media references.

HTML is parsed to an array of parts in reading order: text parts, and references to media with their captions. Payloads
live in a content-addressed store, one row per stored object, and are joined by digest; what is joined to a part stays at
its position, beside its caption.

Defined results: null or empty HTML has no parts; a reference without a payload in the store stays, with null media;
objects stored twice are joined once; text in script and style is no part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

PART = "struct<pos:int,kind:string,text:string,ref:string,caption:string>"
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "", "embed": "document", "object": "document"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "body", "nav", "figure", "blockquote", "pre", "header", "footer", "main", "title"}
SCHEME = "sha256:"
#: A payload is stored as a grey image of this width: one byte a sample.
WIDTH = 576


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.said: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[dict] = []
        self.inside = self.hidden = 0
        self.outer = ""

    def flush(self) -> None:
        text = " ".join("".join(self.said).split())
        self.said = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            self.outer = MEDIA[tag] or self.outer
            ref = a.get("src") or a.get("data")
            if ref:
                self.flush()
                part = {"kind": MEDIA[tag] or self.outer or "document", "text": None, "ref": ref, "caption": a.get("alt") or a.get("title")}
                self.parts.append(part)
                if self.inside:
                    self.figure.append(part)
        elif tag in BLOCKS:
            self.flush()
            self.inside += tag == "figure"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.figure:
                part["caption"] = said or part["caption"]
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.inside = max(0, self.inside - 1)
                self.figure = []

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.said if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    """The parts of one page, numbered in reading order."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return [{"pos": i, **x} for i, x in enumerate(parser.parts)]


def sequences(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: seq_id and parts (array of PART)."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("seq_id"), pa.array([parse_page(x) for x in part.column("html").to_pylist()], kind)], ["seq_id", "parts"])

    return pages.select(F.col(key).alias("seq_id"), F.col(html).alias("html")).mapInArrow(run, f"seq_id {dict(pages.dtypes)[key]}, parts array<{PART}>")


def resolve(seqs: DataFrame, store: DataFrame) -> DataFrame:
    """``seqs`` (seq_id unique, parts) with a field ``media`` in each part: the row of ``store`` (digest, ...) that it refers to.

    Only the columns of ``store`` that are used later are shuffled. Objects are made unique by digest first; then they
    and the references meet by their address, in a join that the adaptive planner splits where one object is referred
    to by very many pages. Parts are gathered again per page, ordered by position.
    """
    columns = [c for c in store.columns if c != "digest"]
    objects = store.groupBy("digest").agg(F.first(F.struct(*columns)).alias("media")).select(F.concat(F.lit(SCHEME), F.col("digest")).alias("address"), "media")
    parts = seqs.select("seq_id", F.explode_outer("parts").alias("part"))
    met = parts.withColumn("address", F.col("part.ref")).join(objects, "address", "left")
    part = F.struct(*[F.col(f"part.{x}").alias(x) for x in ("pos", "kind", "text", "ref", "caption")], F.col("media"))
    return met.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), part)), _by_pos).alias("parts"))


def _by_pos(a, b):
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def encode(text: bytes) -> bytes:
    """A payload (the text and bytes 255 up to a multiple of WIDTH) as a binary grey map: WIDTH samples a row, 8 bits each."""
    rows = max(1, -(-len(text) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(text), WIDTH, rows) + text + b"\xff" * (rows * WIDTH - len(text))


def decode(media: bytes) -> tuple[int, bytes]:
    """(length of the text, payload) from a stored form."""
    head = re.match(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n", media)
    if not head:
        raise ValueError("not a stored payload")
    payload = media[head.end() :]
    if len(payload) != int(head[2]) * int(head[3]):
        raise ValueError("a stored payload is cut")
    return int(head[1]), payload


def feature(payload: bytes) -> str:
    """Mean and deviation in thousandths and a histogram of 16 levels, of all samples."""
    x = np.frombuffer(payload, np.uint8)
    levels = np.bincount(x >> 4, minlength=16)
    total, squares, n = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum()), len(x)
    return f"mean={total * 1000 // n};var={(squares * n - total * total) * 1000 // (n * n)};levels={','.join(map(str, levels))}"


def store_texts(docs: DataFrame) -> DataFrame:
    """For each document its stored form, the form's digest, and a page that refers to it (seq_id, doc_id, html, digest, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, media = part.column("doc_id").to_pylist(), [encode(x) for x in utf8(part.column("text"))]
            digests = [hashlib.sha256(x).hexdigest() for x in media]
            pages = [f'<article><p>Document {i}</p><figure><img src="{SCHEME}{d}"><figcaption>{htmllib.escape(f"samples of {i}")}</figcaption></figure><p>End of {i}</p></article>' for i, d in zip(ids, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("seq_id"), part.column("doc_id"), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["seq_id", "doc_id", "html", "digest", "media"])

    rows = docs.select(F.monotonically_increasing_id().alias("seq_id"), F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "seq_id long, doc_id long, html string, digest string, media binary")


DESCRIBED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(store: DataFrame) -> DataFrame:
    """digest and DESCRIBED of every stored object, from its stored bytes."""
    names = ["digest", *(x.split()[0] for x in DESCRIBED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for media in part.column("media").to_pylist():
                n, payload = decode(media)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DESCRIBED.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("digest"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return store.select("digest", "media").mapInArrow(run, f"digest string, {DESCRIBED}")
