"""Media columns: interleaved sequences of text and media, and a lossless store of payloads.

HTML is parsed into ordered structs of text and media references with captions; a join on the payload's digest resolves the
references; positions and captions stay with their elements. Payloads are kept as 8-bit greyscale PNG images 64 samples wide.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidied

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Payload, a positive multiple of WIDTH bytes, as greyscale samples in rows without filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote; anything else raises ValueError."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image of this width")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def store_text():
    """A function of a text column: the padded payload's digest and its stored form; null as the empty text."""

    @F.pandas_udf("digest string, media binary")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                raw = (t or "").encode("utf-8", "surrogatepass")
                payload = raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH))
                out.append((hashlib.sha256(payload).hexdigest(), to_png(payload)))
            yield pd.DataFrame(out, columns=["digest", "media"])

    return apply


def features():
    """A function of a media column, read back from the stored form: sizes, digests, and mean, deviation and entropy of the samples."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            for media in column:
                media = bytes(media)
                payload = from_png(media)
                x = np.frombuffer(payload, np.uint8)
                share = np.bincount(x, minlength=256) / len(x)
                share = share[share > 0]
                entropy = max(0.0, float(-(share * np.log2(share)).sum()))
                said = f"rows={len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), said))
            yield pd.DataFrame(out, columns=names)

    return apply


_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr td th table ul ol article section main header footer nav aside figure blockquote pre br hr body html".split())
_HIDDEN = frozenset("script style template noscript head title".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": None}


class _Interleaver(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.buf: list[str] = []
        self.hidden = 0
        self.figure: list[list] = []  # where the open figures began, and their captions so far
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.buf).split())
        self.buf = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            self.flush()
            got = dict(attrs)
            digest = got.get("data-digest") or ((got.get("src") or "").removeprefix("sha256:") if (got.get("src") or "").startswith("sha256:") else None)
            self.out.append({"kind": _MEDIA[tag] or "media", "text": None, "digest": digest, "caption": (self.figure[-1][1] if self.figure else None) or got.get("alt") or None})
        elif tag in _BLOCKS and self.caption is None:
            self.flush()
            if tag == "figure":
                self.figure.append([len(self.out), None])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            if self.figure:
                self.figure[-1][1] = said or None
            for e in self.out[self.figure[-1][0] if self.figure else len(self.out) :]:
                if e["kind"] != "text":
                    e["caption"] = said or e["caption"]
            self.caption = None
        elif tag in _BLOCKS and self.caption is None:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.buf if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered elements of a page: kind, text, digest and caption. A figure's caption, even if it stands first, goes to its media."""
    if not html:
        return []
    p = _Interleaver()
    p.feed(html)
    p.close()
    if p.caption:
        p.buf = p.caption
    p.flush()
    return p.out


def elements():
    """A function of an HTML column: the array of its elements."""

    @F.pandas_udf("array<struct<kind:string,text:string,digest:string,caption:string>>")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([parse(h) for h in pages])

    return apply


def references():
    """A function of an HTML column: the media references of its sequence with their positions, how many elements there are, and the
    checksum of the text elements, one a line. For those who do not need the texts: they stay with the worker."""

    @F.pandas_udf("refs array<struct<position:int,digest:string,caption:string>>, n_elements int, text_crc32 long")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            out = []
            for h in pages:
                e = parse(h)
                refs = [{"position": i, "digest": x["digest"], "caption": x["caption"]} for i, x in enumerate(e) if x["kind"] != "text"]
                out.append((refs, len(e), zlib.crc32("\n".join(x["text"] for x in e if x["kind"] == "text").encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(out, columns=["refs", "n_elements", "text_crc32"])

    return apply


def interleave(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, position (from 0), kind, text, digest, caption: one row for each element in page order. Null or empty pages have none."""
    return pages.select(*keys, F.posexplode(elements()(html)).alias("position", "e")).select(*keys, "position", "e.*")


def resolve(sequence: DataFrame, store: DataFrame) -> DataFrame:
    """Joins a sequence with a store on `digest`; unknown digests keep their row with null columns of the store.

    The store must have one row a digest. Common digests cost nothing more: the store's rows are small or read one at a time.
    """
    return sequence.join(store, "digest", "left")


def text_store(docs: DataFrame) -> DataFrame:
    """digest, media: each distinct payload of the documents' texts once."""
    return docs.select(store_text()("text").alias("s")).select("s.*").groupBy("digest").agg(F.first("media").alias("media"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def pages_of(docs: DataFrame) -> DataFrame:
    """doc_id, html: every document as a page: its lines as paragraphs in order, and after the first of them a figure that refers to the
    document's payload by digest, with the payload's unpadded bytes as caption. Null is the empty text: a figure alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(raw)
    padded = F.when(n == 0, F.lit(bytes(WIDTH))).when(n % WIDTH == 0, raw).otherwise(F.rpad(raw, (n + (WIDTH - n % WIDTH)).cast("int"), F.lit(b"\x00")))
    figure = F.concat(F.lit('<figure><img data-digest="'), F.sha2(padded, 256), F.lit('"><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure>"))
    safe = _escaped(text)
    first, rest = F.substring_index(safe, "\n", 1), F.substring(safe, F.length(F.substring_index(safe, "\n", 1)) + 2, F.length(safe))
    body = F.concat(F.lit("<p>"), first, F.lit("</p>"), figure, F.lit("<p>"), F.replace(rest, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    return docs.select("doc_id", F.concat(F.lit("<article>"), body, F.lit("</article>")).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption, n_elements, text_crc32
    for every row.

    Each document is a page of its paragraphs and one media reference among them, by the digest of its padded payload. The sequence is
    parsed back out of the HTML; the digest join resolves the reference to what is read back from the store, and the reference's position,
    caption and neighbours stay with it: n_elements counts the page's elements and text_crc32 is the checksum of its text elements, one
    a line. Null is the empty text: one row of 64 zero samples. Repeated rows resolve to the same stored payload; so do null and empty
    texts, and a digest that very many rows share is one stored row, joined to rows that can be split.
    """
    seq = pages_of(docs).select("doc_id", references()("html").alias("r")).select("doc_id", "r.n_elements", "r.text_crc32", F.explode("r.refs").alias("x"))
    seq = seq.select("doc_id", "x.position", "x.digest", "x.caption", F.regexp_extract("x.caption", r"^(\d+)", 1).cast("long").alias("n_bytes"), "n_elements", "text_crc32")
    read = text_store(docs).select("digest", features()("media").alias("f")).select("digest", "f.*")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_elements", "text_crc32"]
    return resolve(seq, read).select(*names)
