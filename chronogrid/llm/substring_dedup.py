"""Repeated passages: every word covered by a `window`-word sequence that also starts elsewhere.

1. Anchors.  Each window's smallest `gram`-word hash (the rightmost of equals) is its anchor: equal windows
   have equal anchors, at equal offsets, and an anchor serves about (window - gram + 2) / 2 windows.  For an
   anchor the corpus counts its occurrences and the smallest and largest hash of its context (the windows it
   serves).  Counted once: no repeat.  One context only: all its windows repeat.  Otherwise it is mixed.
2. Confirmation.  Windows of mixed anchors are counted by their own hashes; those found twice are confirmed.
3. Passages.  A document's confirmed windows merge into maximal passages; the corpus's distinct passages are a
   table, cut into shards by the anchor of a passage's first window, of about `shard_words` words each.
4. Location.  A shard's passages are compiled into one Aho-Corasick automaton over word numbers, and every
   document that has a passage's first anchor is streamed through it.  All occurrences of all passages of the
   shard are located by the automaton alone, and their words are removed.  (A document without such an anchor
   cannot hold the passage, so it need not be streamed: all documents through all shards would cost the
   product of both.  Nor can a stretch of a document that is shorter than the shard's passages or has a
   `gram`-word sequence that none of them has, so the automaton skips those.)  A shard that many documents need is dealt to several tasks of about `task_words` words of
   documents, each with the same automaton, so a passage in a third of all documents is no hot spot.

Passages reach their shard before its documents, by sorting within the task: a task holds one automaton and one
slice of documents.  What is known of anchors and windows reaches the documents as sorted arrays sent to all
tasks while at most `broadcast_entries` (a checked count), else by shuffled joins on the hash and then on the
document.  Counts are summed before they are shuffled, and large partitions of the joins can be split.

Defined results: null text has no words, n_removed 0 and the digest of the empty text; texts shorter than a
window keep all words; equal rows and overlapping repeats in one document count as occurrences; rows are
treated separately, null and repeated doc_ids included; of equally small grams the rightmost is the anchor, and where
that rule breaks, across 2**24 words of one text, equal windows still have equal grams as anchors and are
counted by their own hashes; a text of any length and any number of different words is searched whole in one
task; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize
from .text import SLICE_BYTES, Slice, mix, slices, window_docs, window_hash

WINDOW, GRAM, BROADCAST_ENTRIES = 35, 8, 4_000_000
SHARD_WORDS, TASK_WORDS = 1_000_000, 16_000_000


class Windows:
    """A slice's windows: start, doc, hash, and the anchor that serves each run of them."""

    def __init__(self, s: Slice, window: int = WINDOW, gram: int = GRAM) -> None:
        words = s.hashes()
        self.start, self.doc = window_docs(s.first, window)
        self.window = window
        if not len(self.start):
            self.hash = self.anchor = self.context = np.empty(0, np.uint64)
            self.run, self.first = np.empty(0, np.int64), np.empty(0, np.int64)
            return
        self.hash = window_hash(words, window)[self.start]
        grams = window_hash(words, gram)
        n = len(grams)
        place = np.arange(n, dtype=np.uint64)
        # the rightmost of the smallest: the hash's upper 40 bits, then the distance from the right
        key = grams >> np.uint64(24) << np.uint64(24) | (np.uint64(0xFFFFFF) - (place & np.uint64(0xFFFFFF)))
        wide, span = key, 1
        width = window - gram + 1
        while span * 2 <= width:
            wide = np.minimum(wide[: len(wide) - span], wide[span:])
            span *= 2
        if width > span:
            wide = np.minimum(wide[: n - width + 1], wide[width - span :][: n - width + 1])
        low = np.uint64(0xFFFFFF) - (wide[self.start] & np.uint64(0xFFFFFF))
        at = self.start + ((low.astype(np.int64) - self.start) & 0xFFFFFF)
        fresh = np.r_[True, (at[1:] != at[:-1]) | (self.doc[1:] != self.doc[:-1])]
        self.first = np.flatnonzero(fresh)  # of each run of windows with one anchor
        self.run = np.cumsum(fresh) - 1
        self.anchor = grams[at[self.first]]
        offset = (at - self.start).astype(np.uint64)
        self.context = mix(np.add.reduceat(mix(self.hash + offset * np.uint64(0x9E3779B97F4A7C15)), self.first))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column("text")):
            w = Windows(s)
            a, c = w.anchor.view(np.int64), w.context.view(np.int64)
            order = np.lexsort((c, a))
            a, c = a[order], c[order]
            begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
            end = np.r_[begin[1:], len(a)] if len(a) else begin
            yield pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array((end - begin).astype(np.int32)), pa.array(c[begin]), pa.array(c[end - 1])], names=["anchor", "n", "lo", "hi"])


class Known:
    """A sorted table of hashes with a flag each, the same for all documents or a document's own."""

    def __init__(self, keys: np.ndarray, flags: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.flags = keys[order], flags[order]

    def flag(self, h: np.ndarray) -> np.ndarray:
        """The flag of each hash, 0 where it is unknown."""
        if not len(self.keys):
            return np.zeros(len(h), np.int8)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.flags[at], 0).astype(np.int8)


def _collect(found: DataFrame) -> Known:
    rows = found.toArrow()
    return Known(rows.column("h").to_numpy().view(np.uint64), rows.column("flag").to_numpy().astype(np.int8))


class Repeats:
    """The search for repeated passages of `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> None:
        self.docs, self.spark, self.limit = docs, docs.sparkSession, broadcast_entries
        counted = docs.select("text").mapInArrow(_anchors, "anchor long, n int, lo long, hi long").groupBy("anchor").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # flag 1: all windows repeat; 2: mixed
        self.anchors = materialize(counted.where("n > 1").select(F.col("anchor").alias("h"), F.when(F.col("lo") == F.col("hi"), 1).otherwise(2).cast("int").alias("flag")), "anchors")

    def confirmed(self) -> tuple[Known | None, Known | None]:
        """Both tables, where they are small enough to send."""
        anchors = self._small(self.anchors)
        if anchors is None:
            return None, None
        windows = self._mixed(self.docs.select("text"), anchors).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", F.lit(1).alias("flag"))
        return anchors, self._small(materialize(windows, "windows"))

    def _small(self, table: DataFrame) -> Known | None:
        return _collect(table) if table.limit(self.limit + 1).count() <= self.limit else None

    def _mixed(self, docs: DataFrame, known: Known) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in slices(batch.column("text")):
                    w = Windows(s)
                    h, n = np.unique(w.hash[(sent.value.flag(w.anchor) == 2)[w.run]] if len(w.run) else w.hash, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

        return docs.mapInArrow(run, "h long, n int")

    def joined(self) -> DataFrame:
        """The other way: k1, k2, doc_id, text and the row's repeated windows as `wins` (array of long), by joins.

        A row is known by its id and the hash of its text; equal rows have equal windows.
        """
        key, docs = _KEY, self.docs

        def served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k1, k2 = (batch.column(x).to_numpy() for x in key)
                for s in slices(batch.column("text")):
                    w = Windows(s)
                    at = s.lo + w.doc[w.first] if len(w.first) else np.empty(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[w.first, len(w.hash)].astype(np.int32)), pa.array(w.hash.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), pa.array(w.anchor.view(np.int64)), lists], names=[*key, "h", "wins"])

        rows = docs.select(*key, "text").mapInArrow(served, "k1 long, k2 long, h long, wins array<long>")
        hits = materialize(rows.join(self.anchors, "h").select(*key, "flag", "wins"), "hits")
        mixed = hits.where("flag = 2").select(*key, F.explode("wins").alias("w"))
        twice = mixed.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        sure = hits.where("flag = 1").select(*key, F.explode("wins").alias("w"))
        repeated = sure.union(mixed.join(twice, "w").select(*key, "w")).groupBy(*key).agg(F.collect_set("w").alias("wins"))
        return docs.join(repeated, key, "left").select(*key, "doc_id", "text", "wins")


#: A row is known by its id and the hash of its text; equal rows have equal windows.
_KEY = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("text", F.col("doc_id").isNull())})


def passages(s: Slice, w: Windows, repeated: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, first word, end, anchor of the first window) of the maximal passages of repeated windows."""
    index = np.flatnonzero(repeated)
    at, doc = w.start[index], w.doc[index]
    if not len(at):
        return []
    split = np.flatnonzero((at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])) + 1
    begin, end = np.r_[0, split], np.r_[split, len(at)] - 1
    anchor = w.anchor[w.run[index[begin]]].view(np.int64)
    return list(zip(doc[begin].tolist(), at[begin].tolist(), (at[end] + w.window).tolist(), anchor.tolist(), strict=True))


def _own_passages(batch: pa.RecordBatch, sent) -> Iterator[tuple[Slice, list[tuple[int, int, int, int]]]]:
    """The passages of each slice of a batch, by the tables sent or by the rows' own windows."""
    for s in slices(batch.column("text"), SLICE_BYTES):
        w = Windows(s)
        if not len(w.start):
            repeated = np.zeros(0, bool)
        elif sent is not None:
            flag = sent.value[0].flag(w.anchor)[w.run]
            repeated, mixed = flag == 1, np.flatnonzero(flag == 2)
            repeated[mixed] = sent.value[1].flag(w.hash[mixed]) == 1
        else:
            own = [x.values.to_numpy() for x in batch.column("wins")[s.lo : s.hi] if x.is_valid]
            own = np.concatenate(own).view(np.uint64) if own else np.empty(0, np.uint64)
            repeated = Known(own, np.ones(len(own), np.int8)).flag(w.hash) == 1
        yield s, passages(s, w, repeated)


def _passage_rows(sent):
    """anchor, passage, n (its words) and served (words of the documents that have it), each passage once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for s, own in _own_passages(batch, sent):
                for d, a, b, anchor in own:
                    text = b" ".join(s.data[s.starts[a] : s.ends[b - 1]].tobytes().split())
                    row = found.setdefault(text, [anchor, b - a, 0])
                    row[2] += int(s.counts[d])
            columns = list(zip(*found.values(), strict=True)) if found else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in found], pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["passage", "anchor", "n", "served"])

    return run


def _routes(sent, shards: int):
    """k1, k2, shard and text: a row for each shard that has a passage of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({(s.lo + d, anchor % shards) for s, own in _own_passages(batch, sent) for d, _, _, anchor in own})
            rows = batch.select([*_KEY, "text"]).take(pa.array([d for d, _ in pairs], pa.int64()))
            yield rows.append_column("shard", pa.array([k for _, k in pairs], pa.int64()))

    return run


#: Characters that stand for words: below the surrogates, one a word, or two where there are more words.
_CODES = 0xD000


def _runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the end of each run of true values; runs end with their document."""
    edge, before, after = np.zeros(len(mask) + 1, bool), np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    edge[first] = True
    before[1:], after[:-1] = mask[:-1], mask[1:]
    return np.flatnonzero(mask & (edge[:-1] | ~before)), np.flatnonzero(mask & (edge[1:] | ~after)) + 1


class Phrases:
    """An Aho-Corasick automaton over the numbers of the words of some passages.

    It reads the stretches of a text that can hold a passage: at least as long as the shortest one, and each
    `gram`-word sequence in them has the table entry of one that passages have.
    """

    def __init__(self, texts: pa.Array, gram: int = GRAM) -> None:
        hashes = [(s, s.hashes()) for s in slices(texts)]
        self.alphabet = np.unique(np.concatenate([np.empty(0, np.uint64), *(h for _, h in hashes)]))
        self.width = 1 if len(self.alphabet) < _CODES else 2
        self.automaton = ahocorasick.Automaton()
        for s, h in hashes:
            for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
                self.automaton.add_word(self._text(self._numbers(h[a:b])), b - a)
        self.automaton.make_automaton()
        self.shortest = min((int(n) for s, _ in hashes for n in s.counts if n), default=1)
        self.gram = min(gram, self.shortest)
        bits = (4 * sum(len(h) for _, h in hashes) + 1024).bit_length()
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        for s, h in hashes:
            if len(start := window_docs(s.first, self.gram)[0]):
                self.seen[self._entries(h)[start]] = True

    def _numbers(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)  # 0 is every word that no passage has

    def _text(self, number: np.ndarray) -> str:
        return (np.stack([number // _CODES, number % _CODES], 1) if self.width == 2 else number).astype("<u4").tobytes().decode("utf-32-le")

    def _entries(self, words: np.ndarray) -> np.ndarray:
        return (window_hash(words, self.gram) >> self.shift).astype(np.int64)

    def stretches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the end of each stretch that can hold a passage; they may overlap."""
        start, _ = window_docs(first, self.gram)
        known = np.zeros(len(words), bool)
        if len(start):
            known[start] = self.seen[self._entries(words)[start]]
        begin, end = _runs(known, first)
        end += self.gram - 1
        enough = end - begin >= self.shortest
        return begin[enough], end[enough]

    def cover(self, words: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
        """Which words an occurrence of a passage covers; `first`: as in Slice, for words of several documents."""
        edge = np.zeros(len(words) + 1, np.int32)
        begin, end = self.stretches(words, np.array([0, len(words)]) if first is None else first)
        if not len(begin):
            return edge[:-1] > 0
        size = end - begin + 1  # and a word that no passage has
        total = np.cumsum(size)
        at = np.arange(total[-1]) - np.repeat(total - size - begin, size)
        number = self._numbers(words[np.minimum(at, len(words) - 1)])
        number[total - 1] = 0
        longest: dict[int, int] = {}
        for last, length in self.automaton.iter(self._text(number)):
            if length > longest.get(last, 0) and (last + 1) % self.width == 0:  # else between the characters of a word
                longest[last] = length
        stop = at[np.array([*longest], np.int64) // self.width] + 1
        np.add.at(edge, stop - np.array([*longest.values()], np.int64), 1)
        np.add.at(edge, stop, -1)
        return np.cumsum(edge[:-1]) > 0


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2 and the first and the end of each covered stretch; a shard's passages come before its documents."""
    key, pending, phrases = None, [], None
    for batch in batches:
        shard, salt, is_doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "is_doc"))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(is_doc.astype(np.int8)) != 0)) + 1
        out: list[tuple[int, int, int, int]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            if (shard[lo], salt[lo]) != key:
                key, pending, phrases = (shard[lo], salt[lo]), [], None
            text = batch.column("text").slice(lo, hi - lo)
            if not is_doc[lo]:
                pending.append(text)
                continue
            if phrases is None:
                phrases, pending = Phrases(pa.concat_arrays(pending)), []
            k1, k2 = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in _KEY)
            for s in slices(text):
                begin, end = _runs(phrases.cover(s.hashes(), s.first), s.first)
                doc = np.searchsorted(s.first, begin, "right") - 1
                out += zip(k1[s.lo + doc].tolist(), k2[s.lo + doc].tolist(), (begin - s.first[doc]).tolist(), (end - s.first[doc]).tolist(), strict=True)
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*_KEY, "first", "end"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' words without those of the stretches in `gone` (first, end, first, end and so on)."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        gone = batch.column("gone")
        for s in slices(batch.column("text")):
            for d in range(s.hi - s.lo):
                words, n = s.words(d), int(s.counts[d])
                own = gone[s.lo + d]
                n_words.append(n)
                if own.is_valid:
                    flat = own.values.to_numpy()
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, flat[::2], 1)
                    np.add.at(edge, flat[1::2], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [x for x, y in zip(words, stays.tolist(), strict=True) if y]
                n_removed.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def located(source: DataFrame, sent, shard_words: int = SHARD_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """k1, k2, first and end: the stretches of words that passages cover."""
    rows = source.mapInArrow(_passage_rows(sent), "passage string, anchor long, n long, served long")
    table = materialize(rows.groupBy(F.xxhash64("passage").alias("h"), "anchor", "n").agg(F.any_value("passage").alias("passage"), F.sum("served").alias("served")), "passages")
    shards = 1 + (table.agg(F.sum("n")).first()[0] or 0) // shard_words
    table = table.withColumn("shard", F.pmod("anchor", F.lit(shards)))
    tasks = broadcast_if_small(materialize(table.groupBy("shard").agg((1 + F.floor(F.sum("served") / task_words)).alias("tasks")), "shards"))
    patterns = table.join(tasks, "shard").select("shard", F.explode(F.expr("sequence(0, tasks - 1)")).alias("salt"), F.lit(False).alias("is_doc"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("passage").alias("text"))
    routed = source.mapInArrow(_routes(sent, shards), "k1 long, k2 long, text string, shard long").join(tasks, "shard")
    routed = routed.select("shard", F.pmod(F.xxhash64(*_KEY), F.col("tasks")).alias("salt"), F.lit(True).alias("is_doc"), *_KEY, "text")
    count = tasks.agg(F.sum("tasks")).first()[0] or 1
    dealt = patterns.union(routed).repartition(int(count), "shard", "salt").sortWithinPartitions("shard", "salt", "is_doc")
    return dealt.mapInArrow(_locate, "k1 long, k2 long, first long, end long")


def remove_repeats(docs: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES, shard_words: int = SHARD_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    bounded_batches(docs.sparkSession)
    docs = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    search = Repeats(docs, broadcast_entries)
    anchors, windows = search.confirmed()
    sent = docs.sparkSession.sparkContext.broadcast((anchors, windows)) if windows is not None else None
    source = docs if sent is not None else materialize(search.joined(), "windows-of-rows")
    found = located(source, sent, shard_words, task_words)
    gone = materialize(found.groupBy(*_KEY).agg(F.flatten(F.collect_list(F.array("first", "end"))).alias("gone")), "stretches")
    return docs.join(gone, _KEY, "left").select("doc_id", "text", "gone").mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept string")


def oracle_sql(window: int = WINDOW) -> str:
    """doc_id, n_words, n_removed, kept_sha256 in DuckDB SQL, for unique doc_ids."""
    return f"""
    with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as ws from documents),
    s as (select doc_id, ws, unnest(range(1, len(ws) - {window} + 2)) as i from w where len(ws) >= {window}),
    h as (select doc_id, i, md5(array_to_string(ws[i:i + {window} - 1], ' ')) as h from s),
    r as (select h from h group by h having count(*) > 1),
    c as (select distinct doc_id, i + j as pos from h join r using (h) cross join range({window}) t(j)),
    l as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
    k as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as kept from l anti join c using (doc_id, pos) group by 1)
    select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
    from w left join k using (doc_id)"""
