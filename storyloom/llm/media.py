"""Media columns as interleaved document sequences.

A page's html is parsed to one ordered sequence of items: texts, and references to media with their captions. Media
are stored under the digest of their content, once written as a table; references meet
payloads by a join on the digest, and each item keeps its position, so that texts, captions and media stay
aligned. Payloads of bytes are kept losslessly as 8-bit grey images (PNG).
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.session import checkpoint_dir
from storyloom.llm.columns import quoted
from storyloom.llm.html_text import TAG

#: Samples of an image row; payloads are filled up to whole rows.
ROW, FILL = 576, 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SOURCE = re.compile(r"""(?:^|[\s"'])(src|alt)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"


def padded(raw: bytes) -> bytes:
    """The bytes, filled up with 255 to a positive multiple of a row."""
    return raw + bytes([FILL]) * (-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; any damage raises."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, shape, ended = 8, [], (0, 0), False
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body, crc = image[at + 8 : at + 8 + size], image[at + 8 + size : at + 12 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != crc:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if not ended or lines.size != shape[1] * (shape[0] + 1) or lines.reshape(shape[1], -1)[:, 0].any():
        raise ValueError("damaged image")
    return lines.reshape(shape[1], -1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their coarse histogram (16 shares in thousandths), as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts / counts.sum()
    mean = float(p @ np.arange(256))
    sd = float(np.sqrt(max(p @ (np.arange(256) - mean) ** 2, 0)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    shares = ",".join(str(int(x)) for x in (counts.reshape(16, 16).sum(axis=1) * 1000 // counts.sum()))
    return f"mean={mean:.4f};sd={sd:.4f};entropy={entropy:.4f};hist={shares}"


def sequence_of(html: str | None) -> list[dict]:
    """Texts and media references of a page in order, numbered from 0; a figure's caption goes to its media.

    A reference is an element with a ``src`` of the form ``sha256:<hex>``; without a caption its ``alt`` is the caption.
    """
    items: list[dict] = []
    now: list[str] = []
    figure, caption = None, None
    skip = ""

    def flush() -> None:
        nonlocal now
        if text := " ".join(unescape("".join(now)).split()):
            items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        now = []

    at, html = 0, html or ""
    while at < len(html):
        m = TAG.search(html, at)
        stop = m.start() if m else len(html)
        if stop > at and not skip:
            (now if caption is None else caption).append(html[at:stop])
        if m is None:
            break
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        closing = m[0][:2] == "</"
        if skip:
            skip = "" if closing and name == skip else skip
            continue
        if name in ("script", "style", "title"):
            skip = "" if closing else name
        elif name in ("img", "video", "audio", "source") and not closing:
            found = {k.lower(): unescape(a or b or c) for k, a, b, c in SOURCE.findall(m[2] or m[4] or "")}
            if found.get("src", "").startswith("sha256:"):
                flush()
                items.append({"kind": "media", "text": None, "digest": found["src"][7:].lower(), "caption": found.get("alt")})
        elif name == "figure":
            flush()
            figure = None if closing else len(items)
        elif name == "figcaption":
            if not closing:
                flush()
                caption = []
            elif caption is not None:
                text = " ".join(unescape("".join(caption)).split())
                for item in items[figure or 0 :] if figure is not None else []:
                    if item["kind"] == "media":
                        item["caption"] = text
                caption = None
        elif name and name not in ("a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code"):
            flush()
    if caption is not None:
        now = caption
    flush()
    return [{"pos": k, **item} for k, item in enumerate(items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``(key, items)`` of every row; null and empty html have no items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sequence_of(h) for h in part.column(1).to_pylist()], kind)], [key, "items"])

    rows = pages.select(key, F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"{rows.schema[key].name} {rows.schema[key].dataType.simpleString()}, items {ITEMS}")


def resolved(items: DataFrame, key: str, payloads: DataFrame) -> DataFrame:
    """``items(key, items)`` exploded, with each reference's columns of ``payloads(digest, ...)``, one row for each item.

    ``payloads`` has a digest once; a column of it that is named like one of an item comes back as ``payload_<name>``. A reference whose digest isn't there, and a text, have nulls. A digest that many
    items share is a hot key of the join, which AQE splits, as the key is no column that ``payloads`` can be grouped by already; nothing is grouped again.
    """
    rows = items.select(key, F.explode("items").alias("i")).select(key, "i.*")
    taken = {c.lower() for c in rows.columns}
    stored = payloads.select(
        F.xxhash64("digest").alias("of_key"), F.col("digest").alias("of_digest"),
        F.struct(*(F.col(quoted(c)).alias(f"payload_{c}" if c.lower() in taken else c) for c in payloads.columns if c.lower() != "digest")).alias("stored"),
    )
    met = rows.join(stored, (F.xxhash64("digest") == F.col("of_key")) & (F.col("digest") == F.col("of_digest")), "left")
    return met.select(*rows.columns, "stored.*")


def stored_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_bytes, media)``: each row's whole text (null: empty) as a stored image, named by the payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                raw = [(t or "").encode("utf-8") for t in part.column(1).to_pylist()]
                full = [padded(r) for r in raw]
                columns = [part.column(0), pa.array([hashlib.sha256(p).hexdigest() for p in full], pa.string()), pa.array(list(map(len, raw)), pa.int64()), pa.array([to_png(p) for p in full], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, n_bytes long, media binary")


def read_back(store: DataFrame) -> DataFrame:
    """``(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of each stored image, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                media = part.column(1).to_pylist()
                payloads = [from_png(m) for m in media]
                columns = [
                    part.column(0), pa.array(list(map(len, payloads)), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array(list(map(len, media)), pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array([feature(p) for p in payloads], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.select("digest", "media").mapInArrow(run, schema)


def figure_html(digest: Column, caption: Column) -> Column:
    """A figure that refers to a stored payload."""
    return F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))


def text_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption)`` for every row of ``docs(doc_id, text, ...)``.

    The text is stored as an image, the image is written to a table in the shared folder and read again; each row becomes
    a page with a figure that refers to the image by digest, the page is parsed to its sequence, and the
    reference is resolved by the join. Null and empty texts are a row of 255. Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result; a null doc_id stays null.
    """
    folder = f"{checkpoint_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    stored_texts(docs).write.parquet(folder)
    store = docs.sparkSession.read.parquet(folder)
    payloads = read_back(store).distinct()  # equal digests have equal columns
    caption = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(", "), F.col("n_bytes").cast("string"), F.lit(" bytes"))
    pages = store.select(F.struct("doc_id", "n_bytes").alias("key"), figure_html(F.col("digest"), caption).alias("html"))
    found = resolved(sequences(pages, "key"), "key", payloads).where("kind = 'media'")
    return found.select(
        "key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("pos").alias("position"), "caption"
    )
