"""Near copies by DartMinHash signatures and banded joining.

An element x of a weighted set owns a fixed Poisson process of darts over weight and
rank, thrown region by region (weight and rank grow by factors of two) with hashes
of the element and the region alone.  A set of weights w is hit by the darts of x
whose weight lies below w(x); each dart also has a hashed coordinate, and the
earliest rank at each coordinate is the signature there.  Two sets agree at a
coordinate with the probability of their weighted Jaccard similarity.  Only
about k (ln k + 2) darts have to be thrown for k coordinates, whatever the set's
size.

Documents are sets of five-word shingles (lower case, split at white space);
weights are 1 ("presence", Jaccard of sets) or how often a shingle stands
there ("count").  A shorter text is one shingle.  Equal texts become one
node first.  No text is shuffled to compare it (``keep_one`` joins whole rows at the end): one pass over the texts gives signatures, a second one the sorted
shingles of those that share a band with another, which a bit map of bounded size tells from
the rest.  Nodes that share a band of a
signature are compared exactly by their shingles, in two steps that neither list all
pairs of a bucket nor lose one:

1. each member of a bucket with the bucket's pivot, its member that shares most
   bands with others;
2. where a member stays outside the pivot's component, it meets those of its
   bucket's members that share enough of its rarest shingles.  Two sets with a
   similarity of s have at least a share s of either in common, so that the rarest share
   1 - s of each and m more hold m common ones.  Boilerplate is hardly
   among the rarest, so that a cluster that shares it alone makes few pairs.  Rows of which
   even the rarest shingles are held by many meet within blocks, from which only links
   come out.

Every pair that shares a band and whose ends are not yet connected is so decided by
exact counts; agreement of signatures drops nothing.

Classes are the components of all pairs with a similarity of ``SIMILARITY`` or more,
named by their least doc_id.

Null texts count as empty.  Texts without words are copies of equal texts
alone.  Repeated rows are copies.  Null ids are kept, but name a class only where all
its ids are null.  Texts of any length are read whole, hashed in pieces.  Extra columns, maps
too, are ignored or kept as they are.  An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselite.llm import hashing
from tesselite.llm._util import discard, map_texts, materialise, merge_join, spread_join, whole_row
from tesselite.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
COORDINATES = BANDS * ROWS
#: First region of ranks; the next ones double.
FIRST_RANK = 2.0**-4
#: Members compared with one copy of a pivot's shingles.
STAR = 256
#: Of a set's shingles so many, as a share and one more, must be common among the rarest.
COMMON = 0.1
#: Pairs that one shingle may propose; rows of which a rare shingle proposes more meet in blocks.
PROPOSED = 4096
#: Rows that a block holds, and rows that come by in one task.
HELD = 512
PASSING = 2048
#: Equal texts that a task remembers, in one of two generations.
SEEN = 200_000
#: Bits of the map that tells which texts' shingles are wanted: 16 for each, within these bounds (16 MB at most).  A map too
#: small for them lets more texts pass, which the join behind it drops.
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 27

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _point_table() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64) + _GOLD)


def _of_point(c: np.ndarray) -> np.ndarray:
    return _point_table()[c] if not len(c) or c.max() < 1 << 16 else mix(c.astype(np.uint64) + _GOLD)


def shingles_of(lows: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of n words of the lower-cased texts, in order and with repeats; of all words of
    a text where there are fewer."""
    w, doc = hashing.words(lows, _of_point)
    w = mix(w)
    out = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + _GOLD) + w[k : k + len(out)]
    inside = doc[: len(out)] == doc[n - 1 :]
    out, owner = mix(out[inside]), doc[: len(out)][inside]
    count = np.bincount(doc, minlength=len(lows))
    small = np.flatnonzero((count > 0) & (count < n))
    if len(small):
        first = np.searchsorted(doc, small)
        short = np.zeros(len(small), np.uint64)
        for k in range(n - 1):
            own = count[small] > k
            short[own] = mix(short[own] + _GOLD) + w[first[own] + k]
        out, owner = np.concatenate((out, mix(short))), np.concatenate((owner, small))
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    return shingles_of(hashing.lowered([text]), n)[0]


def weighted_sets(x: np.ndarray, doc: np.ndarray, docs: int, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, text number) of the distinct elements, sorted within each text.  doc ascends."""
    x = x.copy()
    ends = np.searchsorted(doc, np.arange(docs), side="right")
    at = 0
    for end in ends.tolist():
        x[at:end].sort()
        at = end
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])))) if len(x) else np.empty(0, np.int64)
    n = np.diff(np.append(new, len(x)))
    return x[new], n.astype(np.float64) if weighting == "count" else np.ones(len(new)), doc[new]


def elements(x: np.ndarray, w: np.ndarray, weighting: str) -> np.ndarray:
    """A plain sorted set whose Jaccard similarity is the weighted one: each occurrence counts as an element."""
    if weighting != "count" or w.max(initial=1) == 1:
        return x
    n = w.astype(np.int64)
    occurrence = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(mix(np.repeat(x, n) + occurrence.astype(np.uint64) * _GOLD))


@cache
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson number with this mean."""
    most = int(area + 12 * np.sqrt(area) + 16)
    k = np.arange(most + 1)
    log = k * np.log(area) - area - np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    return np.cumsum(np.exp(log))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(x: np.ndarray, w: np.ndarray, doc: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts (hash, rank, text number) of the elements up to their text's reach, region by region."""
    out = []
    low_w, high_w, region_w = 0.0, 1.0, 0
    own = np.arange(len(x))
    while len(own := own[w[own] > low_w]):
        low_r, high_r, region_r = 0.0, FIRST_RANK, 0
        part = own
        while len(part := part[reach[doc[part]] > low_r]):
            seed = mix(x[part] + np.uint64(((region_w << 8 | region_r) + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            n = np.searchsorted(_poisson((high_w - low_w) * (high_r - low_r)), _unit(seed), side="right")
            hit = np.flatnonzero(n)
            n = n[hit]
            who = np.repeat(part[hit], n)
            dart = mix(np.repeat(seed[hit], n) + (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64) * _M2)
            rank = low_r + (high_r - low_r) * _unit(mix(dart + _GOLD))
            keep = (rank < reach[doc[who]]) & (low_w + (high_w - low_w) * _unit(mix(dart + _M1)) < w[who])
            out.append((dart[keep], rank[keep], doc[who[keep]]))
            low_r, high_r, region_r = high_r, 2 * high_r, region_r + 1
        low_w, high_w, region_w = high_w, 2 * high_w, region_w + 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures_of(x: np.ndarray, w: np.ndarray, doc: np.ndarray, docs: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart at each of k coordinates of every text; zeros for texts without weight."""
    out = np.zeros((docs, k), np.uint64)
    total = np.bincount(doc, weights=w, minlength=docs)
    open_ = total > 0
    reach = np.where(open_, k * (np.log(k) + 2) / np.where(open_, total, 1.0), 0.0)
    while open_.any():
        if not open_.all():
            mine = open_[doc]
            x, w, doc = x[mine], w[mine], doc[mine]
        dart, rank, owner = _throw(x, w, doc, np.where(open_, reach, 0.0))
        at = owner * k + (((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        found = np.zeros(docs * k, np.uint64)
        met = np.zeros(docs * k, bool)
        found[at[order]] = dart[order]
        met[at] = True
        full = met.reshape(docs, k).all(axis=1)
        out[full] = found.reshape(docs, k)[full]
        reach *= 2
        open_ = open_ & ~full
    return out


def signature(x: np.ndarray, w: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """One set's signature."""
    return signatures_of(x, np.asarray(w, np.float64), np.zeros(len(x), np.int64), 1, k)[0]


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64) * _GOLD), parts.shape[:2])
    for k in range(rows):
        out = mix(out * _M1 + parts[:, :, k])
    return out.view(np.int64)


def _node(text):
    """128 bits that stand for the text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Seen:
    """Names met before, the last ones at least: bounded in two generations."""

    def __init__(self, most: int = SEEN):
        self.most, self.young, self.old = most, set(), set()

    def add(self, name: bytes) -> bool:
        """Whether the name is new."""
        if name in self.young:
            return False
        new = name not in self.old
        self.young.add(name)
        if len(self.young) >= self.most:
            self.young, self.old = set(), self.young
        return new


def signatures(documents: DataFrame, weighting: str) -> DataFrame:
    """(key, row, node, own, bands): a number and its text's name for every row; where a task meets a text with words first
    (``own``) its bands as well."""
    rows = documents.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), _node(F.col("text")).alias("_node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = TaskContext.get().partitionId() << 33, Seen()
        for b in batches:
            nodes = b.column("_node").to_pylist()
            new = [k for k, node in enumerate(nodes) if seen.add(node)]
            lows = hashing.lowered(b.column("_text").take(pa.array(new, pa.int64())).to_pylist())
            bands: list = [None] * len(nodes)
            for first, end in hashing.groups(lows):
                x, w, doc = weighted_sets(*shingles_of(lows[first:end]), end - first, weighting)
                keys = band_keys(signatures_of(x, w, doc, end - first))
                for d in np.unique(doc).tolist():
                    bands[new[first + d]] = keys[d]
            yield pa.RecordBatch.from_pydict({"key": b.column("_key"), "row": pa.array(np.arange(number, number + len(nodes)), pa.int64()), "node": b.column("_node"), "own": pa.array([i is not None for i in bands], pa.bool_()), "bands": pa.array(bands, pa.list_(pa.int64()))})
            number += len(nodes)

    return map_texts(rows, run, f"key {rows.schema['_key'].dataType.simpleString()}, row bigint, node binary, own boolean, bands array<bigint>")


def _places(node, mask: int) -> list:
    """Four places in a bit map."""
    halves = [half for h in (F.xxhash64(node), F.xxhash64(node, F.lit(1))) for half in (h, F.shiftrightunsigned(h, 32))]
    return [h.bitwiseAND(F.lit(mask).cast("long")) for h in halves]


def _sets(documents: DataFrame, wanted: DataFrame, weighting: str) -> DataFrame:
    """(row, items): the sorted shingles of the wanted texts (node, row), kept in the shared folder."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * wanted.count()).bit_length()))
    places = wanted.select(F.explode(F.array(*_places(F.col("node"), bits - 1))).alias("p"))
    set_bits = places.groupBy(F.shiftright("p", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits")).toArrow()
    found = np.zeros(bits >> 5, np.uint32)
    found[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy().astype(np.uint32)
    sent = wanted.sparkSession.sparkContext.broadcast(found)
    node = _node(F.col("text"))
    texts = documents.select(F.col("text").alias("_text"), node.alias("_node")).select("_text", "_node", F.array(*_places(F.col("_node"), bits - 1)).alias("_places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = sent.value, Seen()
        for b in batches:
            at = b.column("_places").flatten().to_numpy().reshape(-1, 4)
            passed = ((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1)
            nodes = b.column("_node")
            new = [k for k in np.flatnonzero(passed).tolist() if seen.add(nodes[k].as_py())]
            took = pa.array(new, pa.int64())
            lows = hashing.lowered(b.column("_text").take(took).to_pylist())
            items: list[bytes] = []
            for first, end in hashing.groups(lows):
                x, w, doc = weighted_sets(*shingles_of(lows[first:end]), end - first, weighting)
                cuts = np.searchsorted(doc, np.arange(end - first + 1)).tolist()
                items += [elements(x[a:z], w[a:z], weighting).tobytes() for a, z in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"node": nodes.take(took), "items": pa.array(items, pa.binary())})

    made = map_texts(texts, run, "node binary, items binary")
    # grouped and joined by one dealing of the shingles
    return materialise(merge_join(made.groupBy("node").agg(F.first("items").alias("items")), wanted, "node").select("row", "items"), "shingles")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets' Jaccard similarity is as high."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if not len(short) or len(short) < similarity * len(long) - 1e-9:
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar.  Sets of many a meet one copy of b's set at a time: they are sorted
    behind it in their partition, and a b with many a has several copies."""
    few = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    dealt = spread_join(pairs, few, "b", F.col("a"), merge=True).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = merge_join(dealt, sets.select(F.col("row").alias("a"), "items"), "a").select("b", "part", F.lit(1).alias("role"), "a", "items")
    pivots = merge_join(few.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), sets.withColumnRenamed("row", "b"), "b").select("b", "part", F.lit(0).alias("role"), F.col("b").alias("a"), "items")
    rows = pivots.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for node, other, role, items in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "role", "items")), strict=True):
                own = np.frombuffer(items, np.uint64)
                if role == 0:
                    pivot = own
                    continue
                if similar(own, pivot, similarity):
                    a.append(other)
                    b.append(node)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_texts(rows, run, "a bigint, b bigint")


def _rarest(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(row, size, least, token): of each row's shingles the rarest among these rows, as many as that any set as similar shares
    ``least`` of them (or as many as its own least, if that is smaller); without those that no other row holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(i, np.int64) for i in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "size": pa.array(list(map(len, tokens)), pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    listed = map_texts(merge_join(rows.select("row").distinct(), sets, "row"), run, "row bigint, size bigint, tokens array<bigint>")
    each = materialise(listed.select("row", "size", F.explode("tokens").alias("token")), "tokens")
    often = each.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    # a row's list is as long as its text
    sorted_ = merge_join(each, often, "token", "left").groupBy("row", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("t"))
    least = F.floor(F.col("size") * COMMON) + 1
    most = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + least
    out = materialise(sorted_.select("row", "size", least.alias("least"), F.explode(F.transform(F.filter(F.slice("t", 1, most.cast("int")), lambda x: x["n"] > 1), lambda x: x["token"])).alias("token")), "rarest")
    discard(each)
    return out


def _rest(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one bucket that its pivot left in different components.  members: bucket, row, n,
    pivot, component, home (the pivot's component).  Rows outside their bucket's home ask, and all members of their bucket
    answer; both are known by home, which many buckets of one group share."""
    outside = (F.col("component") != F.col("home")) & (F.col("n") > 2) & (F.col("row") != F.col("pivot"))
    ask = materialise(members.filter(outside).select("bucket", "home", "row", "component").distinct(), "outside")
    if ask.isEmpty():
        return ask.select(F.col("row").alias("a"), F.col("row").alias("b"))
    answer = merge_join(members.select("bucket", "row", "component"), ask.select("bucket", "home").distinct(), "bucket").select("home", "row", "component", F.lit(False).alias("asks"))
    asked = answer.unionByName(ask.select("home", "row", "component", F.lit(True).alias("asks")))
    asked = materialise(asked.groupBy("home", "row", "component").agg(F.max("asks").alias("asks")), "asked")
    rare = _rarest(asked, sets, similarity)
    each = materialise(merge_join(rare, asked, "row"), "held")
    discard(ask, asked, rare)
    counts = each.groupBy("home", "token").agg(F.count_if("asks").alias("m"), F.count("*").alias("k")).filter("m > 0")
    # a shingle that most rows of a home hold is dealt among tasks; of what is left behind, a shingle's rows are few
    told = materialise(spread_join(each, counts.select("home", "token", (F.col("m") * F.col("k") > PROPOSED).alias("hot")), ["home", "token"], F.col("row"), merge=True), "told")
    discard(each)
    cold, hot = told.filter("not hot"), told.filter("hot")
    mine = cold.filter("asks").select("home", "token", F.col("row").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("least").alias("la"))
    theirs = cold.select("home", "token", F.col("row").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("least").alias("lb"))
    alike = (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-9)
    pairs = merge_join(mine, theirs, ["home", "token"]).filter(alike)
    # a pair that shares a hot shingle meets in blocks; of any other all that it shares is counted here
    enough = pairs.groupBy("home", "a", "b").agg(F.count("*").alias("n"), F.first(F.least("la", "lb")).alias("least")).filter("n >= least")
    pairs = materialise(enough.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verify(pairs, sets, similarity)
    meet = None
    if not hot.isEmpty():
        meet = materialise(hot.select("home", "row", "component", "asks").distinct(), "meet")
        links = links.unionByName(_blocks(meet, sets, similarity))
    out = materialise(links, "links")
    discard(told, pairs, *([] if meet is None else [meet]))
    return out


def _blocks(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between rows (home, row, component, asks) of one home.  Those that ask are held in parts of HELD, with an index
    of their shingles, and all come by in parts of PASSING; one look-up counts what a row shares with all that are held."""
    sizes = rows.groupBy("home").agg(F.ceil(F.count_if("asks") / HELD).alias("parts"), F.ceil(F.count("*") / PASSING).alias("blocks")).filter("parts > 0")
    sized = spread_join(rows, sizes, "home", F.col("row"), merge=True)
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = sized.filter("asks").withColumn("i", F.pmod(F.xxhash64("row"), F.col("parts"))).withColumn("j", up_to("blocks")).withColumn("role", F.lit(0))
    asked = sized.withColumn("j", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))).withColumn("i", up_to("parts")).withColumn("role", F.lit(1))
    key = ["home", "i", "j", "role"]
    both = merge_join(held.select(*key, "row", "component").unionByName(asked.select(*key, "row", "component")), sets, "row")
    dealt = both.select(*key, "row", "component", "items").repartition("home", "i", "j").sortWithinPartitions(*key)
    columns = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, index = None, [], None
        for batch in batches:
            a, b = [], []
            for home, i, j, role, row, component, items in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if at != (home, i, j):
                    at, own, index = (home, i, j), [], None
                mine = np.frombuffer(items, np.uint64)
                if role == 0:
                    own.append((row, component, mine))
                    continue
                if index is None:
                    index = Index([o[2] for o in own])
                for k in index.similar(mine, similarity).tolist():
                    if own[k][1] != component:
                        a.append(row)
                        b.append(own[k][0])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return map_texts(dealt, run, "a bigint, b bigint")


class Index:
    """Sorted sets by their elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.element, self.owner = every[order], np.repeat(np.arange(len(sets)), self.size)[order]

    def similar(self, x: np.ndarray, similarity: float) -> np.ndarray:
        """Numbers of the sets whose Jaccard similarity with x is as high, by exact counts."""
        low, high = np.searchsorted(self.element, x), np.searchsorted(self.element, x, side="right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.size))
        return np.flatnonzero((both > 0) & (both >= similarity * (self.size + len(x) - both) - 1e-9))


def classes(documents: DataFrame, *, similarity: float = SIMILARITY, weighting: str = "presence") -> tuple[DataFrame, DataFrame]:
    """(key, row, node) of every row, and (node, component, class_id) of every distinct text."""
    signed = materialise(signatures(documents, weighting), "signatures")
    nodes = materialise(signed.groupBy("node").agg(F.min("key").alias("first_id"), F.min(F.when(F.col("own"), F.col("row"))).alias("row")), "nodes")
    banded = merge_join(signed.filter("own").select("row", "bands"), nodes.select("row"), "row").select("row", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = materialise(merge_join(banded, full, "bucket"), "buckets")
    popular = buckets.groupBy("row").agg(F.sum("n").alias("popular"))
    pivots = merge_join(buckets, popular, "row").groupBy("bucket").agg(F.max_by("row", F.struct("popular", "row")).alias("pivot"))
    members = materialise(merge_join(buckets, pivots, "bucket"), "members")
    discard(buckets)
    wanted = materialise(merge_join(nodes.select("node", "row"), members.select("row").distinct(), "row", "left_semi"), "wanted")
    sets = _sets(documents, wanted, weighting)
    stars = materialise(members.filter("row <> pivot").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct(), "stars")
    links = materialise(verify(stars, sets, similarity), "links")
    found = components(links)
    # a row is a member of at most as many buckets as there are bands; a pivot may have any number of members
    named = merge_join(members, found, "row", "left").withColumn("component", F.coalesce("component", "row"))
    home = found.select(F.col("row").alias("pivot"), F.col("component").alias("home"))
    named = materialise(spread_join(named, home, "pivot", F.col("row"), left=True, merge=True).withColumn("home", F.coalesce("home", "pivot")), "named")
    discard(members, stars, wanted)
    more = _rest(named, sets, similarity)
    discard(named, sets)
    if not more.isEmpty():
        old, found = found, components(found.select(F.col("row").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(old)
    whole = merge_join(nodes, found, "row", "left").withColumn("component", F.coalesce(F.col("component").cast("string"), F.hex("node")))
    ids = whole.groupBy("component").agg(F.min("first_id").alias("class_id"))
    out = materialise(spread_join(whole, ids, "component", F.col("node"), merge=True).select("node", "component", "class_id"), "classes")
    rows = materialise(signed.select("key", "row", "node"), "rows")
    discard(signed, nodes, links, more, found)
    return rows, out


def near_copies(documents: DataFrame, *, similarity: float = SIMILARITY, weighting: str = "presence") -> DataFrame:
    """(doc_id, class_id) of every row."""
    rows, named = classes(documents, similarity=similarity, weighting=weighting)
    return spread_join(rows, named, "node", F.col("row"), merge=True).select(F.col("key").alias("doc_id"), "class_id")


def keep_one(documents: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the documents' own columns: that of the class's id.  Of several rows with that id the
    one with the least text counts, and of equal texts the one that is greatest as JSON."""
    rows, named = classes(documents, similarity=similarity)
    named_rows = spread_join(rows, named, "node", F.col("row"), merge=True).filter(F.col("key").eqNullSafe(F.col("class_id")))
    chosen = materialise(named_rows.groupBy("component").agg(F.min(F.struct("node", "key")).alias("c"), F.count("*").alias("n")).select("c.node", "c.key", "n"), "chosen")
    own = documents.select(whole_row(documents).alias("_doc"), F.col("doc_id").alias("_id"), _node(F.col("text")).alias("_node"))
    met = own.join(chosen, (F.col("_node") == F.col("node")) & F.col("_id").eqNullSafe(F.col("key")))
    if chosen.filter("n > 1").isEmpty():
        return met.select("_doc.*")
    return met.groupBy("node").agg(F.max_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*")
