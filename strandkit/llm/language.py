"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of its documents, each of which gives as many bytes, from
places spread over its whole text. A text, lower-cased and reduced to its letters, is compressed piece by piece with every dictionary;
the language with the fewest bytes wins. Where the best two lie closer than a margin, the answer is marked as rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, lowest, tidied

#: Languages that are learned, the commonest of the training rows; documents of each that its dictionary is made of; and bytes it may have.
LANGS, PER_LANG, DICT_BYTES = 200, 300, 96 * 1024
#: Bytes that a dictionary takes at one place of a text.
GRAIN = 108
#: Bytes that are compressed at once; every piece of a text is.
PIECE = 16384
MARGIN = 0.01
LEVEL = 3
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") if text else b""


@dataclass
class Model:
    """The dictionaries, the commonest language of the training rows first."""

    dictionaries: dict[str, bytes]

    def compressors(self) -> list[tuple[str, object]]:
        import zstandard as z

        out = []
        for lang, raw in self.dictionaries.items():
            d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append((lang, z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return out


def predict(text: str | None, compressors: list) -> tuple[str, float, bool]:
    """(language, score from 0 to 1, rejected). und without a letter or without a learned language; ties go to the commoner."""
    raw = letters(text)
    if not raw or not compressors:
        return "und", 0.0, True
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    sizes = sorted((sum([len(c.compress(p)) for p in pieces]), k) for k, (_, c) in enumerate(compressors))
    best, lang = sizes[0][0], compressors[sizes[0][1]][0]
    if len(sizes) == 1:
        return lang, 1.0, False
    margin = (sizes[1][0] - best) / max(1, sizes[1][0])
    return lang, min(1.0, 0.5 + 5 * margin), margin < MARGIN


def spread(raw: bytes, share: int) -> bytes:
    """About `share` bytes of a text in runs of GRAIN, one from each equal part of it, at a place that the text's checksum chooses."""
    if len(raw) <= share:
        return raw
    n = max(1, share // GRAIN)
    size, part = share // n, len(raw) // n
    at = zlib.crc32(raw) % (part - size + 1)
    return b" ".join(raw[j * part + at : j * part + at + size] for j in range(n))


def fit(docs: DataFrame, learn: Column, per_lang: int = PER_LANG) -> Model:
    """Takes the `per_lang` documents of lowest hash of each language among those that `learn` admits."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    most = {r["lang"]: (min(per_lang, DICT_BYTES // GRAIN), r["count"]) for r in counts}
    for r in lowest(rows, "lang", "doc_id", most) if most else []:
        texts[r["lang"]].append(letters(r["text"]))
    out = {}
    for lang, ts in texts.items():
        raw = b" ".join(spread(t, DICT_BYTES // max(1, len(ts)) - 1) for t in ts)
        if raw.strip():
            out[lang] = raw
    return Model(out)


def predictor(model: Model):
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    @tidied
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for texts in batches:
            yield pd.DataFrame([predict(t, compressors) for t in texts], columns=["lang_pred", "score", "rejected"])

    return apply


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row, repeated rows and null ids included.

    Null texts and texts without a letter are `und` with score 0, and so is every text if there is nothing to learn from. A near tie
    keeps its best language, of equal ones the commoner, and is marked in `rejected`. Rows of a null id are predicted, not learned from.
    An empty table gives an empty result; other columns are ignored.
    """
    learn = ~held_out("doc_id", 5, 0)
    apply = predictor(fit(docs, learn, per_lang))
    return docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), apply("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"
    )
