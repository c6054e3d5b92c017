"""Near-duplicate documents by Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its occurrence number.  For each of
SKETCHES permutations the ELL labelled shingles with the smallest hashes are kept in text order and hashed to
one key, so equal keys mean shared shingles in equal order.  Candidates are verified by alignment within a
band of diagonals; as labelled shingles are unique in a text, the longest common subsequence is the longest
increasing run of matched places.  Similarity is common / (a + b - common), and 0.8 or more links two texts.

Equal texts collapse into one representative before anything is compared.  The same steps hold for buckets
of every size:

1. Each member of a bucket is compared with the bucket's lead, the text that meets most others over all of
   its buckets: the original of many edited copies, whatever its id.  That is linear in the members.
2. Buckets that still hold several classes, and members not compared, get a second lead from outside the
   first one's class.
3. What still is in several classes gets every pair across classes that a prefix filter leaves.  It is exact:
   in any one order of shingles, texts at 0.8 share one of the first n - ceil(0.8 n) + 1.  The order is rarest
   first, so a passage that many share makes no pairs.  Only texts that look alike and that no lead links
   cost pairs here.

So two texts of a bucket are compared, in one class through others, or below the similarity by the filter:
classes equal those of all pairs, but for pairs without one equal sketch (at 0.8 once in about 30 million).
Classes are connected components by label propagation in DataFrames.

Defined results: texts without a word, null texts and rows without a doc_id are alone (class_id is their own
doc_id, class_size 1); texts of fewer than five words link only to equal texts; a repeated doc_id is one
document, linked by all of its texts, and equal rows are in one class; ties for a lead go to the smallest id;
a text of any length is one sequence in one task (4 bytes a word); extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize
from .graph import connected_components
from .text import Slice, mix, occurrence_labels, slices, window_docs, window_hash

SHINGLE, SIMILARITY, SKETCHES, ELL = 5, 0.8, 24, 3
ORDER_BITS = 18
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def labelled_shingles(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles in text order, and their documents."""
    at, doc = window_docs(s.first, SHINGLE)
    h = window_hash(s.hashes(), SHINGLE)[at] if len(at) else np.empty(0, np.uint64)
    label = occurrence_labels(doc, h)
    again = label > 0
    h[again] = mix(h[again] + label[again].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return h, doc


def sketches(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A row of SKETCHES keys per document; 0 where it has no shingle."""
    out = np.zeros((docs, SKETCHES), np.uint64)
    if not len(h):
        return out
    count = np.bincount(doc, minlength=docs)
    # a document's ELL smallest are nearly always below this bound; else all of its shingles are ranked
    bound = np.minimum(2.0**64 * 1.0 * (ELL + 13) / np.maximum(count, 1), 2.0**64 - 2048).astype(np.uint64)
    bound[count <= ELL + 13] = np.uint64(2**64 - 1)
    limit = bound[doc]
    for k, seed in enumerate(_SEEDS):
        value = mix(h ^ seed)
        near = np.flatnonzero(value <= limit)
        short = np.bincount(doc[near], minlength=docs) < np.minimum(count, ELL)
        if short.any():
            near = np.flatnonzero((value <= limit) | short[doc])
        order = near[np.lexsort((value[near], doc[near]))]
        own = doc[order]
        begin = np.searchsorted(own, np.arange(docs))
        rank = np.arange(len(own)) - begin[own]
        chosen = np.sort(order[rank < ELL])  # text order
        own = doc[chosen]
        place = np.arange(len(own)) - np.searchsorted(own, np.arange(docs))[own]
        part = mix(h[chosen] + mix(place.astype(np.uint64) + np.uint64(7)))
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[begin], k] = mix(np.add.reduceat(part, begin) + seed)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2, n, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, SKETCHES), np.int64)]
        for s in slices(batch.column("text")):
            words, place = s.hashes(), np.arange(len(s.starts)) - np.repeat(s.first[:-1], s.counts)
            for into, salt in ((k1, 0x8CB92BA72F3D8DD7), (k2, 0xD6E8FEB86659FD93)):
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(mix(words ^ mix(place.astype(np.uint64) + np.uint64(salt))), out=total[1:])
                into.append((total[s.first[1:]] - total[s.first[:-1]]).view(np.int64))
            h, doc = labelled_shingles(s)
            n.append(s.counts)
            keys.append(sketches(h, doc, s.hi - s.lo).view(np.int64))
        flat = np.concatenate(keys)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * SKETCHES), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x)) for x in (k1, k2, n)), lists], names=["doc_id", "k1", "k2", "n_words", "keys"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in slices(batch.column("text")):
            h, doc = labelled_shingles(s)
            cuts = np.searchsorted(doc, np.arange(s.hi - s.lo + 1))
            packed = (h >> np.uint64(32)).astype("<u4")
            out += [packed[cuts[k] : cuts[k + 1]].tobytes() for k in range(s.hi - s.lo)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["rep", "seq"])


def aligned_similarity(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """common / (len(a) + len(b) - common) along a band that is wide enough for `similarity`; 0 below it."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return 0.0
    band = int((n + m) * (1 - similarity) / (1 + similarity)) + 1  # gaps in all that the similarity allows
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), m - 1)
    place = order[at]
    matched = (b[place] == a) & (np.abs(place - np.arange(n)) <= band)
    run = place[matched]
    if len(run) < similarity * (n + m) / (1 + similarity) - 1e-9:
        return 0.0
    if not (np.diff(run) > 0).all():
        tails: list[int] = []
        for x in run.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    else:
        common = len(run)
    found = common / (n + m - common)
    return found if found >= similarity - 1e-12 else 0.0


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column("seq_a"), batch.column("seq_b"), strict=True):
                found.append(aligned_similarity(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), similarity))
            kept = pa.array([x > 0 for x in found])
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])
            yield rows.filter(kept)

    return run


def shared_buckets(reps: DataFrame) -> DataFrame:
    """rep, n (shingles), weight, bucket and lead of each place in a bucket of two or more; reps has rep, n and keys.

    A text's weight is the number of texts it meets over all of its buckets; a bucket is led by its heaviest
    text (the smallest id of equals), the likeliest to be similar to the rest.
    """
    spread = reps.select("rep", "n", F.posexplode("keys").alias("k", "key")).select("rep", "n", F.xxhash64("k", "key").alias("bucket"))
    # tables that joins read are written before: then large partitions of either side can be split
    sizes = materialize(spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    # a text has SKETCHES keys, so this list is short
    weighed = spread.join(sizes, "bucket").groupBy("rep", "n").agg(F.sum("size").alias("weight"), F.collect_set("bucket").alias("own"))
    members = materialize(weighed, "weighed").select("rep", "n", "weight", F.explode("own").alias("bucket"))
    leads = materialize(members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "n")).alias("lead")), "leads")
    return materialize(members.join(leads, "bucket").select("rep", "n", "weight", "bucket", (-F.col("lead.rep")).alias("lead"), F.col("lead.n").alias("lead_n")), "members")


def _fits(x, y, similarity: float):
    return F.least(x, y) >= similarity * F.greatest(x, y)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def lead_pairs(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs a < b of members and the leads of their buckets, linear in the number of members."""
    return members.where((F.col("rep") != F.col("lead")) & _fits(F.col("n"), F.col("lead_n"), similarity)).select(*_pair("rep", "lead")).distinct()


def _unsettled(members: DataFrame, links: DataFrame, compared: int) -> DataFrame | None:
    """Members, with their classes, of the buckets that hold several classes and pairs not compared yet; None without any.

    compared: how many members of a bucket have met all others outside their class.
    """
    classes = connected_components(links.select("a", "b")).withColumnRenamed("node", "rep")
    named = members.join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where((F.col("lo") < F.col("hi")) & (F.col("size") > compared + 1)).select("bucket")
    several = broadcast_if_small(materialize(several, "several"))
    out = materialize(named.join(several, "bucket"), "unsettled")
    return out if out.limit(1).count() else None


def _second_lead_pairs(unsettled: DataFrame, similarity: float) -> DataFrame:
    """Each bucket's heaviest member outside the lead's class, with the members outside its own class."""
    led = broadcast_if_small(materialize(unsettled.where("rep = lead").select("bucket", F.col("component").alias("lead_component")).distinct(), "led"))
    others = unsettled.where("rep <> lead").join(led, "bucket")
    best = others.where("component <> lead_component").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"), "n", "component")).alias("e"))
    best = broadcast_if_small(materialize(best, "best"))
    met = others.join(best, "bucket").where((F.col("component") != F.col("e.component")) & _fits(F.col("n"), F.col("e.n"), similarity))
    return met.select("rep", (-F.col("e.rep")).alias("second")).select(*_pair("rep", "second")).distinct()


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint32(32 - ORDER_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for x in batch.column("seq"):
            total += np.bincount(_slots(np.frombuffer(x.as_buffer(), "<u4")), minlength=len(total))
    used = np.flatnonzero(total > 1)  # any table gives an order that all tasks share
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "times"])


def prefix(h: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a text in the order of (times of the slot, hash), one of which every similar text shares."""
    own = np.unique(h)
    own = own[np.lexsort((own, times[_slots(own)]))]
    return own[: max(0, len(own) - int(np.ceil(similarity * len(h) - 1e-9)) + 1)]


def remaining_pairs(unsettled: DataFrame, sequences: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs a < b across classes, with no similar pair left out."""
    docs = broadcast_if_small(materialize(unsettled.select("rep", "component").distinct(), "unsettled-ids"))
    own = materialize(sequences.join(docs, "rep"), "unsettled-sequences")
    found = own.select("seq").mapInArrow(_frequencies, "slot int, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow().to_pandas()
    times = np.zeros(1 << ORDER_BITS, np.int64)
    times[found.slot] = found.times
    sent = own.sparkSession.sparkContext.broadcast(times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("seq")]
            parts = [prefix(h, sent.value, similarity) for h in texts]
            sizes = [len(x) for x in parts]
            row = np.repeat(np.arange(len(texts)), sizes)
            taken = batch.select(["rep", "component"]).take(pa.array(row))
            n = pa.array(np.array([len(h) for h in texts], np.int64)[row])
            place = pa.array(np.concatenate([np.arange(k) for k in sizes] or [np.empty(0)]).astype(np.int64))
            token = pa.array(np.concatenate([*parts, np.empty(0, "<u4")]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*taken.columns, n, place, token], names=["rep", "component", "n", "place", "token"])

    tokens = materialize(own.mapInArrow(run, "rep long, component long, n long, place long, token long"), "prefixes")
    # classes of a shingle: only members outside its largest one look for partners
    shared = tokens.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    members = materialize(tokens.join(shared.select("token", F.col("top.component").alias("main")), "token"), "shared-prefixes")
    x, y = members.where("component <> main").alias("x"), members.alias("y")
    c = F.col
    # the first shared shingle leaves enough shingles behind it in both
    enough = F.least(c("x.n") - c("x.place"), c("y.n") - c("y.place")) >= similarity / (1 + similarity) * (c("x.n") + c("y.n")) - 1e-9
    once = F.expr("x.component <> y.component and (y.component = y.main or x.rep < y.rep)")
    met = x.join(y, (c("x.token") == c("y.token")) & once & enough & _fits(c("x.n"), c("y.n"), similarity))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _links(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    sides = pairs.join(sequences.select(F.col("rep").alias("a"), F.col("seq").alias("seq_a")), "a").join(sequences.select(F.col("rep").alias("b"), F.col("seq").alias("seq_b")), "b")
    return materialize(sides.select("a", "b", "seq_a", "seq_b").mapInArrow(_verify(similarity), "a long, b long, similarity double"), "links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and class_size (rows of the class) per row."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(texts.mapInArrow(_signatures, "doc_id long, k1 long, k2 long, n_words long, keys array<long>"), "signatures")
    usable = signed.where("n_words > 0 and doc_id is not null")
    reps = materialize(usable.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"), F.count("*").alias("copies")), "representatives")
    members = shared_buckets(reps.where(F.col("n_words") >= SHINGLE).select("rep", (F.col("n_words") - SHINGLE + 1).alias("n"), "keys"))
    ids = broadcast_if_small(materialize(members.select(F.col("rep").alias("doc_id")).distinct(), "ids"))
    # all rows of an id: a copy's row with another text would only add a comparison
    sequences = materialize(texts.where("text is not null").join(ids, "doc_id").mapInArrow(_sequences, "rep long, seq binary").where("length(seq) > 0"), "sequences")
    links = _links(lead_pairs(members, similarity), sequences, similarity)
    rounds = (lambda left: _second_lead_pairs(left, similarity), lambda left: remaining_pairs(left, sequences, similarity))
    for compared, pairs in enumerate(rounds, 1):
        left = _unsettled(members, links, compared)
        if left is None:
            break
        links = links.union(_links(materialize(pairs(left), "pairs"), sequences, similarity))
    # copies of a text that share no representative because of repeated ids are joined here too
    known = reps.join(connected_components(links.select("a", "b")), F.col("rep") == F.col("node"), "left").select("k1", "k2", "n_words", "copies", F.coalesce("component", "rep").alias("class_id"))
    known = known.join(known.groupBy("class_id").agg(F.sum("copies").alias("class_size")), "class_id")
    out = signed.select("doc_id", "k1", "k2", "n_words").join(known, ["k1", "k2", "n_words"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_words") == 0)
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stand for their class; equal rows once; rows without a doc_id stay."""
    classes = materialize(near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("rows")), "classes")
    dropped = broadcast_if_small(classes.where("doc_id <> class_id").select("doc_id"))
    again = classes.where("doc_id = class_id and rows > 1").select("doc_id")
    left = docs.join(dropped, "doc_id", "left_anti")
    if not again.limit(1).count():
        return left
    again = broadcast_if_small(again)
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
