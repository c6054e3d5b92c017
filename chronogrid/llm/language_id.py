"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language's dictionary is raw text of a bounded sample of labelled rows: the `sample_rows` texts with the
smallest hashes (copies once), up to `text_bytes` of each in PIECES spread over the whole text,
`dictionary_bytes` in all.  Every whole text is
lower-cased, stripped of ASCII symbols and digits, cut into blocks of `block_bytes` so that the dictionary
counts throughout a long text, and compressed with each dictionary; the smallest total wins.  The margin is
the share by which the second-best total exceeds the best; a text below `min_margin` is rejected.

Any number of languages is learned; beyond about 128 they share `total_bytes` of samples.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; with no labelled
row everything is `und`; ties go to the language that sorts first; null lang is never learned; repeated rows
get equal results, and copies count once in a sample; a text of any length is compressed whole, a block at a
time; an empty table gives no rows; a column named like an output column is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, held_out, materialize

UNKNOWN = "und"
SAMPLE_ROWS, TEXT_BYTES, DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 256, 2048, 256 << 10, 4096, 6
MIN_MARGIN, TOTAL_BYTES, PIECES = 0.005, 64 << 20, 8
_DROP = bytes(x for x in range(33, 127) if not chr(x).isalpha())
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def clean(text: bytes) -> bytes:
    return text.decode("utf-8", "replace").lower().encode().translate(None, _DROP)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _pieces(text_bytes: int) -> Column:
    """A text of up to `text_bytes` characters whole; of a longer one PIECES from its start to its end."""
    size = max(1, text_bytes // PIECES)
    at = lambda k: (F.floor((F.length("text") - size) * k / (PIECES - 1)) + 1).cast("int")
    parts = F.array(*(F.substring("text", at(k), F.lit(size)) for k in range(PIECES)))
    return F.when(F.length("text") <= text_bytes, F.array("text")).otherwise(parts)


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_bytes: int = TEXT_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """A dictionary for each language of the rows given (doc_id, text, lang).

    The driver gets about `total_bytes` characters at most: with very many languages each has a smaller sample.
    """
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    hashed = materialize(rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")), "hashes")
    # a language's share of the hashes is cut to about eight times the sample before any one task ranks it
    sizes = materialize(hashed.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    sample_rows = max(4, min(sample_rows, total_bytes // (text_bytes * max(1, sizes.count()))))
    low = F.shiftrightunsigned("h", 1) <= F.lit(2.0**63) * 8 * sample_rows / F.col("n")
    hashed = hashed.join(broadcast_if_small(sizes), "lang").where(low)
    first = materialize(hashed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= sample_rows), "sample")
    picked = rows.select("doc_id", "lang", F.xxhash64("text").alias("h"), _pieces(text_bytes).alias("pieces")).join(broadcast_if_small(first), ["doc_id", "lang", "h"])
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.dropDuplicates(["lang", "h"]).select("lang", "h", "pieces").toLocalIterator():
        own = [clean(x.encode())[: text_bytes // len(r.pieces)] for x in r.pieces]
        texts.setdefault(r.lang, []).append((r.h, b"\n".join(own)))
    return {lang: b"\n".join(x for _, x in sorted(own))[:dictionary_bytes] for lang, own in sorted(texts.items())}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in sorted(dictionaries.items()):
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
        if data is not None:
            data.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: bytes, by_lang: list[tuple[str, zstandard.ZstdCompressor]], block_bytes: int = BLOCK_BYTES) -> tuple[str, float]:
    """The language with the smallest total, and the margin to the next; of one language alone it is 1."""
    if not by_lang or not has_letter(text):
        return UNKNOWN, 0.0
    raw = clean(text)
    blocks = [raw[i : i + block_bytes] for i in range(0, len(raw), block_bytes)] or [b""]
    sizes = [(sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang]
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def _judge(dictionaries: dict[str, bytes], min_margin: float, block_bytes: int, level: int):
    """A function of text arrays: languages, margins and whether each is rejected."""
    by_lang = compressors(dictionaries, level)

    def judge(texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
        langs, scores = [], []
        for text in texts.cast(pa.binary()):
            lang, score = (UNKNOWN, 0.0) if not text.is_valid else classify(text.as_py(), by_lang, block_bytes)
            langs.append(lang)
            scores.append(score)
        return langs, scores, [lang == UNKNOWN or score < min_margin for lang, score in zip(langs, scores, strict=True)]

    return judge


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, block_bytes: int = BLOCK_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score (the margin) and rejected for every row; no shuffle."""
    bounded_batches(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(dictionaries, min_margin, block_bytes, level)
        for batch in batches:
            langs, scores, rejected = judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, min_margin: float = MIN_MARGIN, block_bytes: int = BLOCK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of `docs`, all columns, that are not rejected: decided row by row in one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    dictionaries = learn(docs.select("doc_id", "text", "lang").where(~held_out("doc_id")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(dictionaries, min_margin, block_bytes, level)
        for batch in batches:
            yield batch.filter(pa.array([not x for x in judge(batch.column("text"))[2]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def language_id(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Learn from the rows that are not held out and predict all: doc_id, held_out, lang_pred, score, rejected."""
    learned = learn(docs.select("doc_id", "text", "lang").where(~held_out("doc_id")))
    out = identify(docs, learned, min_margin)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
