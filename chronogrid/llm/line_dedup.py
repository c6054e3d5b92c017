"""Cross-site boilerplate lines by their spread over distinct sites.

Lines are hashed (96 bits) and a HyperLogLog sketch of the sites is kept for each hash; sketches merge in the
aggregation, so a line that a third of all documents share is one small row per map task.  Lines whose
estimate lies clearly above `min_sites` are boilerplate, those clearly below are not, and those within
`band` of it get an exact distinct count.  A boilerplate line is removed wherever it stands but at its first
occurrence, the smallest (doc_id, line number), so that one copy of any text stays.

Boilerplate lines reach the documents as sorted 64-bit hashes in blocks of at most `block_lines`, each sent to
all tasks; one pass over the texts looks lines up in all blocks and cuts them.  Texts are never shuffled.

Defined results: a line counts only if it has a word, and is compared as it is; null text has no lines and
stays null; a null source is a site of its own; identical rows are judged alike (all of a repeated first row
stay); of equally early occurrences the smaller doc_id is the first, and a null doc_id sorts before all; a
text of which nothing is removed is unchanged, byte for byte; a text of any length is split in one task; an
empty table gives no rows; extra columns stay, but n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, broadcast_if_small, materialize

MIN_SITES, BAND, LG_K, BLOCK_LINES = 12, 0.15, 10, 2_000_000
_HASHES = ["h1", "h2"]
#: The seed of Spark's xxhash64(); of a string it hashes the UTF-8 bytes.
_SEED = 42


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, site, pos and the line's hashes, for each line with a word."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """h1, h2 and the first occurrence (first_doc, first_pos) of lines on at least `min_sites` sites."""
    sketched = lines.groupBy(*_HASHES).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"))
    near = materialize(sketched.select(*_HASHES, F.hll_sketch_estimate("sketch").alias("sites"), "first").where(F.col("sites") >= min_sites * (1 - band)), "lines")
    unsure = near.where(F.col("sites") <= min_sites * (1 + band)).select(*_HASHES)
    exact = lines.select(*_HASHES, "site").join(broadcast_if_small(unsure), _HASHES, "left_semi").distinct().groupBy(*_HASHES).agg(F.count("*").alias("exact"))
    counted = near.join(exact, _HASHES, "left").where(F.coalesce("exact", "sites") >= min_sites)
    return materialize(counted.select(*_HASHES, F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")), "boilerplate")


class Block:
    """Sorted hashes of boilerplate lines with their first occurrences."""

    def __init__(self, rows: pa.Table) -> None:
        h = rows.column("h1").to_numpy()
        order = np.argsort(h)
        self.hash, self.pos = h[order], rows.column("first_pos").to_numpy()[order]
        ids = rows.column("first_doc")
        self.null = ids.is_null().to_numpy()[order]
        self.doc = ids.fill_null(0).to_numpy()[order]

    def gone(self, h: np.ndarray, null: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of the lines are in the block and not at the first occurrence."""
        if not len(self.hash) or not len(h):
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        first = (self.null[at] == null) & (self.doc[at] == doc) & (self.pos[at] == pos)
        return (self.hash[at] == h) & ~first


def _cutter(sent: list):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            parts = [None if x is None else x.split(b"\n") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            count = np.array([len(x or ()) for x in parts], np.int64)
            row = np.repeat(np.arange(len(parts)), count)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            h = np.fromiter((xxhash.xxh64_intdigest(x, _SEED) for own in parts if own for x in own), np.uint64, len(row)).view(np.int64)
            worded = np.fromiter((bool(x.strip(b" \t\n\x0b\x0c\r")) for own in parts if own for x in own), bool, len(row))
            ids = batch.column("doc_id").cast(pa.int64())
            null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            gone = np.zeros(len(row), bool)
            for block in sent:
                gone |= block.value.gone(h, null[row], doc[row], pos)
            gone &= worded
            removed = np.bincount(row[gone], minlength=len(parts))
            texts, cuts = batch.column("text").to_pylist(), np.cumsum(count) - count
            for k in np.flatnonzero(removed):
                own = gone[cuts[k] : cuts[k] + count[k]]
                texts[k] = b"\n".join(x for x, y in zip(parts[k], own.tolist(), strict=True) if not y).decode()
            columns = [pa.array(texts, pa.string()) if k == at else x for k, x in enumerate(batch.columns)]
            n_lines = np.bincount(row[worded], minlength=len(parts))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines.astype(np.int64)), pa.array(removed.astype(np.int64))], names=[*batch.schema.names, "n_lines", "n_removed"])

    return cut


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The rows of `docs` with text cleaned, n_lines and n_removed added (and replacing columns so named)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("n_lines", "n_removed")
    found = boilerplate(exploded(docs), min_sites, band)
    blocks = 1 + found.count() // block_lines
    sent = [spark.sparkContext.broadcast(Block(found.where(F.pmod("h1", F.lit(blocks)) == k).toArrow())) for k in range(blocks)]
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return docs.mapInArrow(_cutter(sent), schema)


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """doc_id, n_lines, n_removed, kept_sha256 in DuckDB SQL, for unique doc_ids."""
    return f"""
    with s as (select doc_id, coalesce('=' || source, '-') as site, string_split(text, chr(10)) as parts from documents where text is not null),
    l as (select doc_id, site, unnest(parts) as line, unnest(range(len(parts))) as pos from s),
    w as (select * from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    b as (select line, min((doc_id, pos)) as first from w group by 1 having count(distinct site) >= {min_sites}),
    m as (select l.doc_id, l.line, l.pos, b.line is not null and (l.doc_id, l.pos) <> b.first as gone, regexp_matches(l.line, '[^\\x20\\x09-\\x0D]') as worded from l left join b on l.line = b.line and regexp_matches(l.line, '[^\\x20\\x09-\\x0D]'))
    select d.doc_id, coalesce(sum(worded::int), 0)::bigint as n_lines, coalesce(sum(gone::int), 0)::bigint as n_removed,
      case when any_value(d.text) is not null then sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) end as kept_sha256
    from documents d left join m on d.doc_id = m.doc_id group by 1"""
