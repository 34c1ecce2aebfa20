"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order, which is cut into fragments. In each fragment the documents' parts are
held against each other separately:

1. Parts travel packed, one row per batch of documents and fragment. A fragment finds which of its n-grams occur in more than
   one document, and how often. Only these return to their documents. A document that shares less than the threshold's part
   of its set with anyone is out, which most are.
2. Ordered by rising frequency, only the n-grams of a document's prefix can lead to a partner (prefix filter). Each document
   first tries the least leader of its n-grams, then a leader of each n-gram that is not in its component yet. Then only
   pairs of different components that no leader has joined are left, and all of these are tried.
3. For a pair, every fragment counts its partial overlap, and the sum per pair decides.

So a group of near copies costs a pair per member, not one per two members, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm.common import mixed, sliced, text_sizes, word_shingles
from voxspark.llm.components import components
from voxspark.session import settle

#: Documented parameters: words of an n-gram; n-grams that a fragment holds on average; fragments at least; documents of a bucket;
#: n-grams of a batch; fragments in which the overlap of a pair is counted.
WIDTH = 5
FRAGMENT_GRAMS = 2_000_000
MIN_FRAGMENTS = 64
BUCKET_DOCUMENTS = 4096
BATCH_GRAMS = 2_000_000
OVERLAP_FRAGMENTS = 8
#: An n-gram is a hash of 64 bits. The leading ones are the number of its fragment, so that only the others travel.
GRAM_BITS = 64
#: N-grams that are in HOT_COUNT or more of about HOT_SAMPLE documents come last in the order, HOT_LIMIT of them at most.
#: They are known to be shared and do not travel to a fragment. This moves work only: any order gives the same links.
HOT_SAMPLE = 4096
HOT_COUNT = 8
HOT_LIMIT = 1 << 16
HOT_BASE = 1 << 40


def _join(column: pa.ChunkedArray, kind: type | str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _hot(rows: DataFrame, count: int, width: int) -> np.ndarray:
    """The commonest n-grams of a sample of documents, by rising frequency; at most HOT_LIMIT."""
    every = max(1, count // HOT_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_sizes("text")):
            found, times = np.unique(np.concatenate([word_shingles(t, width) for t in batch.column("text").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], names=["gram", "times"])

    counted = sample.mapInArrow(explode, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    common = counted.where(F.col("times") >= HOT_COUNT).orderBy(F.desc("times"), "gram").limit(HOT_LIMIT)
    return np.array([row["gram"] for row in common.collect()][::-1], np.int64).view(np.uint64)


PACKED = "place int, kind int, docs binary, sizes binary, grams binary, more binary, flags binary"


def _packed(place: int, kind: int, docs=b"", sizes=b"", grams=b"", more=b"", flags=b"") -> tuple:
    return place, kind, bytes(docs), bytes(sizes), bytes(grams), bytes(more), bytes(flags)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and stop of each run of equal values, none of which is negative."""
    starts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(values)], strict=True)) if starts else []


def _tail_bytes(fragment_bits: int) -> int:
    """Bytes that an n-gram takes besides its fragment's number and its low 32 bits."""
    return -(-(GRAM_BITS - 32 - fragment_bits) // 8)


def _tails(grams: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes of each n-gram that follow its low 32 bits."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 4 : 4 + size])


def _pack_batch(docs: list[int], sets: list[np.ndarray], hot: np.ndarray, fragment_bits: int) -> list[tuple]:
    """Rows of a batch: one per fragment with the parts of its documents, and one of the documents themselves.

    Documents with equal sets are sent once, by their least id; the others are marked as copies. The row of the documents
    goes to a place that its first id draws.
    """
    number = int(_bucket(np.array(docs[:1], np.int64), 1 << fragment_bits)[0])
    order = np.argsort(np.array(docs), kind="stable")
    sorted_hot, hot_ranks = np.sort(hot), np.argsort(hot, kind="stable").astype(np.uint32)
    ids, sizes, digests, copies, hot_sizes, hot_lists, kept, kept_ids = [], [], [], [], [], [], [], []
    seen: set[bytes] = set()
    for i in order.tolist():
        grams = sets[i]
        digest = xxhash.xxh3_128_digest(grams.tobytes())
        copy = digest in seen
        seen.add(digest)
        ids.append(docs[i])
        sizes.append(len(grams))
        digests.append(digest)
        copies.append(copy)
        found = np.empty(0, np.uint32)
        if not copy and len(grams):
            if len(hot):
                at = np.minimum(np.searchsorted(sorted_hot, grams), len(hot) - 1)
                is_hot = sorted_hot[at] == grams
                found, grams = hot_ranks[at[is_hot]], grams[~is_hot]
            kept.append(grams)
            kept_ids.append(docs[i])
        hot_sizes.append(len(found))
        hot_lists.append(found)
    out = [
        _packed(
            -1 - number,
            0,
            np.array(ids, np.int64),
            np.array([sizes, hot_sizes], np.uint32),
            np.concatenate(hot_lists) if hot_lists else b"",
            b"".join(digests),
            np.array(copies, np.uint8),
        )
    ]
    if kept:
        grams = np.concatenate(kept)
        owners = np.repeat(np.arange(len(kept)), [len(g) for g in kept])
        fragments = (grams >> np.uint64(GRAM_BITS - fragment_bits)).astype(np.int64)
        by = np.argsort(fragments.astype(np.uint16) if fragment_bits <= 16 else fragments, kind="stable")
        grams, owners, fragments = grams[by], owners[by], fragments[by]
        size = _tail_bytes(fragment_bits)
        own = grams & np.uint64((1 << (GRAM_BITS - fragment_bits)) - 1)
        low, tails = own.astype(np.uint32), _tails(own, size)
        kept_ids = np.array(kept_ids, np.int64)
        for a, b in _runs(fragments):
            starts = np.flatnonzero(np.diff(owners[a:b], prepend=-1))
            counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
            out.append(_packed(int(fragments[a]), 1, kept_ids[owners[a:b][starts]], counts, low[a:b], tails[a:b]))
    return out


def _bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _shared(group: pa.Table, buckets: int, fragment_bits: int) -> list[tuple]:
    """Of a fragment: its n-grams of more than one document with their frequency, dealt to the documents' buckets."""
    fragment = group.column("place")[0].as_py()
    docs = np.repeat(_join(group.column("docs"), np.int64), _join(group.column("sizes"), np.uint32))
    size = _tail_bytes(fragment_bits)
    whole = np.zeros((len(docs), 8), np.uint8)
    whole[:, :4] = _join(group.column("grams"), np.uint8).reshape(-1, 4)
    whole[:, 4 : 4 + size] = _join(group.column("more"), np.uint8).reshape(-1, size)
    grams = whole.view("<u8").ravel()
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(grams)))
    times = np.repeat(times, times)
    shared = times > 1
    grams, docs, times = grams[shared] | np.uint64(fragment << (GRAM_BITS - fragment_bits)), docs[order][shared], times[shared]
    places = _bucket(docs, buckets)
    by = np.lexsort((docs, places))
    grams, docs, times, places = grams[by], docs[by], times[by].astype(np.uint32), places[by]
    return [_packed(int(places[a]), 1, docs[a:b], times[a:b], grams[a:b]) for a, b in _runs(places)]


def _deal_documents(group: pa.Table, buckets: int) -> list[tuple]:
    """The documents of a batch, dealt to their buckets."""
    out = []
    for row in group.to_pylist():
        docs = np.frombuffer(row["docs"], np.int64)
        sizes, hot_sizes = np.frombuffer(row["sizes"], np.uint32).reshape(2, -1)
        hot = np.frombuffer(row["grams"], np.uint32)
        digests = np.frombuffer(row["more"], "V16")
        copies = np.frombuffer(row["flags"], np.uint8)
        owners = np.repeat(np.arange(len(docs)), hot_sizes)
        places = _bucket(docs, buckets)
        for place in np.unique(places):
            own = places == place
            out.append(_packed(int(place), 0, docs[own], np.stack([sizes[own], hot_sizes[own]]), hot[own[owners]], digests[own].tobytes(), copies[own]))
    return out


PROFILE = "doc long, n long, m long, digest binary, copy boolean, grams array<long>"


def _profiles(group: pa.Table, hot: np.ndarray, percent: int) -> pa.Table:
    """Of a bucket: a row per document; with its shared n-grams by rising frequency if they can reach the threshold."""
    parts = [r for r in group.to_pylist() if r["kind"] == 0]
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in parts])
    both = np.concatenate([np.frombuffer(r["sizes"], np.uint32).reshape(2, -1) for r in parts], axis=1).astype(np.int64)
    digests = np.concatenate([np.frombuffer(r["more"], "V16") for r in parts])
    copies = np.concatenate([np.frombuffer(r["flags"], np.uint8) for r in parts]).astype(bool)
    hot_of = np.concatenate([np.frombuffer(r["grams"], np.uint32) for r in parts])
    distinct, first = np.unique(docs, return_index=True)
    owners = np.searchsorted(distinct, np.repeat(docs, both[1]))
    entries = group.filter(pc.equal(group.column("kind"), 1))
    index = np.concatenate((np.searchsorted(distinct, _join(entries.column("docs"), np.int64)), owners))
    grams = np.concatenate((_join(entries.column("grams"), np.uint64), hot[hot_of] if len(hot_of) else np.empty(0, np.uint64)))
    times = np.concatenate((_join(entries.column("sizes"), np.uint32).astype(np.int64), HOT_BASE + hot_of.astype(np.int64)))
    order = np.lexsort((grams, times, index))
    index, grams, times = index[order], grams[order], times[order]
    fresh = np.concatenate(([True], (index[1:] != index[:-1]) | (grams[1:] != grams[:-1]))) if len(index) else np.empty(0, bool)
    index, grams = index[fresh], grams[fresh]
    n = both[0][first]
    m = np.bincount(index, minlength=len(distinct))
    alive = (100 * m >= percent * n) & (n > 0) & ~copies[first]
    lengths = np.where(alive, m, 0)
    values = pa.array(grams[alive[index]].view(np.int64))
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, values, mask=pa.array(~alive))
    columns = [pa.array(distinct), pa.array(n), pa.array(m), pa.array([d.tobytes() for d in digests[first]], pa.binary()), pa.array(copies[first]), lists]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in PROFILE.split(", ")])


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text) of every id once; of several rows with one id, the least of their texts stays, null before all others."""
    rows = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    again = settle(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc"))
    if again.isEmpty():
        return rows
    least = F.min(F.struct("text")).alias("least")
    several = rows.join(again, "doc", "left_semi").groupBy("doc").agg(least).select("doc", "least.text")
    return rows.join(again, "doc", "left_anti").unionByName(several)


def shared_profiles(df: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Step 1: (doc, n, m, digest, copy, grams) of every document; ``grams`` is null where no partner is possible."""
    rows = _documents(df, doc_id, text)
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    fragments = max(MIN_FRAGMENTS, (total["bytes"] or 0) // 6 // FRAGMENT_GRAMS)
    fragment_bits = min(24, int(fragments - 1).bit_length())
    buckets = max(MIN_FRAGMENTS, total["rows"] // BUCKET_DOCUMENTS)
    spark = df.sparkSession
    hot = spark.sparkContext.broadcast(_hot(rows, total["rows"], width))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[int] = []
        sets: list[np.ndarray] = []
        held = number = 0
        for batch in sliced(batches, text_sizes("text")):
            for doc, value in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs.append(doc)
                sets.append(word_shingles(value, width))
                held += len(sets[-1])
                if held >= BATCH_GRAMS:
                    yield _rows(_pack_batch(docs, sets, hot.value, fragment_bits))
                    docs, sets, held = [], [], 0
        if docs:
            yield _rows(_pack_batch(docs, sets, hot.value, fragment_bits))

    def share(group: pa.Table) -> pa.Table:
        found = _deal_documents(group, buckets) if group.column("kind")[0].as_py() == 0 else _shared(group, buckets, fragment_bits)
        return pa.Table.from_batches([_rows(found)])

    def profile(group: pa.Table) -> pa.Table:
        return _profiles(group, hot.value, percent)

    packed = rows.mapInArrow(pack, PACKED).groupBy("place").applyInArrow(share, PACKED)
    return settle(packed.groupBy("place").applyInArrow(profile, PROFILE))


def _sides(other: str) -> tuple[Column, ...]:
    """n, m and place of the n-gram of a row's document and of the one in the struct ``other``."""
    return tuple(F.col(c) for c in ("n", "m", "at", f"{other}.n", f"{other}.m", f"{other}.at"))


def _possible(percent: int, n_a: Column, m_a: Column, at_a: Column, n_b: Column, m_b: Column, at_b: Column) -> Column:
    """Whether two sets of n n-grams, m of them shared with anyone, can reach the threshold if the n-gram in place ``at`` of
    each one's shared n-grams is the first that they have in common. It holds for every link at its first common n-gram."""
    most = F.least(m_a - at_a, m_b - at_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (100 * most >= percent * (n_a + n_b - most))


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Step 3: the pairs (a, b) whose overlap, summed over the fragments, reaches the threshold."""
    left = segments.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("part").alias("part_a"))
    right = segments.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("part").alias("part_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("overlap"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    return summed.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def ngram_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: links where 100 * intersection >= percent * union.

    ``component_id`` is the least doc_id that links lead to. Null, empty and blank texts have no n-gram and link with
    nothing; a text of fewer words than ``width`` has its whole word sequence as its only n-gram. Rows of one doc_id are
    one document with the least of their texts; rows without doc_id are no documents. An empty table gives no rows; other
    columns are not read.
    """
    profiles = shared_profiles(df, doc_id, text, width, percent)
    sets = profiles.where("n > 0").select("doc", "digest")
    # Settled, so that the join below has plain scans on both sides: a digest that many documents have can then be broadcast
    # or split, while an aggregation inside the join's stage would hold all of them in one task.
    least = settle(sets.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    copies = settle(sets.join(least, "digest").where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    active = profiles.where("grams IS NOT NULL").join(copies.select(F.col("a").alias("doc")), "doc", "left_anti")
    # The prefix: all but the last ceil(percent * n / 100) - 1 n-grams, of which the n - m that nobody shares come first.
    needed = F.ceil(F.col("n") * percent / 100)
    active = settle(active.select("doc", "n", "m", "grams", (F.col("m") - needed + 1).cast("int").alias("prefix")))
    postings = active.select("doc", "n", "m", F.posexplode(F.slice("grams", F.lit(1), F.col("prefix"))).alias("at", "gram"))
    # What is summed by n-gram is settled before it is joined, as above: a very frequent n-gram can then be split.
    lists = postings.groupBy("gram").agg(F.min(F.struct("doc", "n", "m", "at")).alias("leader"), F.count(F.lit(1)).alias("size"))
    lists = settle(lists.where("size > 1"))
    postings = settle(postings.join(lists, "gram").select("gram", "doc", "n", "m", "at", "leader"))
    met = active.join(postings.select("doc").distinct(), "doc", "left_semi")
    segments = met.select("doc", "n", F.posexplode(_cut("grams")).alias("fragment", "part"))
    segments = settle(segments.where(F.size("part") > 0))
    # At first each document tries the least leader of its n-grams, which near copies have in common.
    stars = postings.where(_possible(percent, *_sides("leader")) & (F.col("doc") != F.col("leader.doc")))
    stars = stars.groupBy(F.col("doc").alias("a")).agg(F.min("leader.doc").alias("b"))
    linked = settle(_verified(stars, segments, percent))
    postings = postings.drop("leader")
    rows = _with_components(postings, components(linked))
    draw = F.struct(F.xxhash64("doc").alias("draw"), "doc", "n", "m", "at", "component")
    leaders = settle(rows.groupBy("gram").agg(F.min(draw).alias("leader")))
    stars = rows.join(leaders, "gram").where(_possible(percent, *_sides("leader")) & (F.col("component") != F.col("leader.component")))
    stars = stars.select(F.col("doc").alias("a"), F.col("leader.doc").alias("b")).distinct()
    linked = settle(linked.unionByName(_verified(stars, segments, percent)))
    # N-grams whose documents were of one component have nothing left to try.
    rows = _with_components(rows.select(*postings.columns), components(linked))
    crossed = settle(_verified(_cross_pairs(rows, percent), segments, percent))
    joined = components(linked.unionByName(crossed).unionByName(copies)).withColumnRenamed("node", "doc")
    told = profiles.select("doc", "n").join(joined, "doc", "left")
    return told.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _cut(grams: str) -> Column:
    """The n-grams in OVERLAP_FRAGMENTS ranges of their order."""
    return F.array(*[F.filter(grams, _inside(k)) for k in range(OVERLAP_FRAGMENTS)])


def _inside(k: int) -> Callable[[Column], Column]:
    """Of the low 40 bits, which are spread evenly, the leading three make eight ranges; whether they are k."""
    return lambda gram: F.shiftright(gram, 40 - 3).bitwiseAND(F.lit(OVERLAP_FRAGMENTS - 1)) == k


def _with_components(postings: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of n-grams whose documents are of several components so far, with their ``component`` and the largest one of
    the n-gram (``top``)."""
    rows = postings.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("gram").agg(F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    whole = settle(whole.where("parts > 1").select("gram", F.col("top.component").alias("top")))
    return settle(rows.join(whole, "gram").select(*rows.columns, "top"))


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share an n-gram.

    In each n-gram's list, documents outside its largest component meet all others, so that the largest one, which may be
    most of the list, never meets itself.
    """
    few = rows.where("component <> top").select("gram", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "m", "at", "component")])
    every = rows.select("gram", "top", *[F.col(c).alias(f"{c}_b") for c in ("doc", "n", "m", "at", "component")])
    sides = [F.col(f"{c}_{side}") for side in "ab" for c in ("n", "m", "at")]
    met = few.join(every, "gram").where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("top")) | (F.col("doc_a") < F.col("doc_b")))
        & _possible(percent, *sides)
    )
    return met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
