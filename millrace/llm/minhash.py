"""MinHash near-duplicates by an LSH forest.

Words are runs of other than ASCII white space, A-Z in lower case; a document's set is its distinct five-word
shingles (64-bit hashes), or its whole word sequence if shorter. Documents with equal sets form a class with one
representative, so copies are never compared. Orders over one signature of `PERMUTATIONS` values give the forest:
`TREES` at `THRESHOLD`, more or fewer at another, so that all miss a link at the threshold with a chance of `MISSED`
at most. In an order, a region is what shares its first `DEPTH` values; a region of one class links nothing. Rows
of a region are sorted by the following values, and a class is a candidate with its longest-common-prefix
neighbours: all of a region of at most `SMALL`, else `NEAR` on either side, and with the region's first class. A
region of more than `LARGE` classes is cut at more values of its order, and at last by salt, to parts that
one task holds, and the first classes of its parts are candidates with that of the region; the depth thus adapts
to the region. Candidates whose signatures agree in under the floor of their values are left out: at the threshold
that is over four standard deviations off.

Candidates are confirmed on full sets: `100 * |A & B| >= threshold * |A | B|`. First each class with one
neighbour, so that large groups collapse into few components; then every other candidate pair whose ends are
not yet in one component. In regions above `SMALL`, every class outside the region's largest component is then
compared with all classes of the region, part by part. Components come from alternating large-star and small-star rounds over
links, all in tables; later links only join components that are there, and copies follow their representative.

Documents without words (null and empty texts) are linked with nothing. Null ids stay out of all links: component_id
null, kept true. Rows of one doc_id are one document, linked through any of its texts, and repeated rows count once.
Very long texts are read whole; an empty table gives an empty result; of a group the least id stays, so there are no
ties. Ids of other types than integers are numbered in their order meanwhile. Other columns are not read. The result
has a row for each row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, small, table

SHINGLE = 5
THRESHOLD = 85
PERMUTATIONS = 512
TREES = 16
DEPTH = 4
SMALL, NEAR, LARGE = 32, 1, 2000
FLOOR = 0.785
#: The chance that all orders miss a link at the threshold; TREES at THRESHOLD is 16 by it.
MISSED = 1e-5
_DRAW = np.random.default_rng(20)
_MULTIPLY = (_DRAW.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_XOR = _DRAW.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_PLACES = _DRAW.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Forest(NamedTuple):
    """What goes with a threshold, in hundredths: the number of orders and the floor of signatures."""

    threshold: int = THRESHOLD
    trees: int = TREES
    floor: float = FLOOR

    @classmethod
    def at(cls, threshold: int) -> Forest:
        if threshold == THRESHOLD:
            return cls()
        j = threshold / 100
        if not 0 < j < 1:
            raise ValueError("a threshold is in hundredths, between 0 and 100")
        trees = max(1, math.ceil(math.log(MISSED) / math.log1p(-(j**DEPTH))))
        if trees * DEPTH > PERMUTATIONS:
            raise ValueError(f"the signature is too short for a threshold of {threshold}")
        return cls(threshold, trees, j - 4.12 * math.sqrt(j * (1 - j) / PERMUTATIONS))  # as far off as FLOOR

    @property
    def orders(self) -> np.ndarray:
        """The signature values that each order reads, first to last."""
        return np.stack([np.roll(np.arange(PERMUTATIONS), -DEPTH * t) for t in range(self.trees)])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    s = np.full(n, np.uint64(size))
    for j in range(size):
        s = (s ^ (s >> np.uint64(31))) * _PLACES[j] + h[j : j + n]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(33)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of the set's hashes under each of the permutations of 32-bit numbers."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    for lo in range(0, len(high), 512):
        out = np.minimum(out, ((high[lo : lo + 512] ^ _XOR) * _MULTIPLY).min(1))
    return out


def signatures(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(doc_id, n_shingles, cls, sig, regions) for every row; cls tells sets apart."""
    orders = forest.orders

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, cls, sig, regions = [], [], [], []
                for text in part.column(1):
                    found = shingle_set(text.as_py())
                    n.append(len(found))
                    cls.append(xxhash.xxh3_128_digest(found.tobytes()))
                    values = signature(found)
                    sig.append(((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes())
                    regions.append([xxhash.xxh3_64_intdigest(values[order[:DEPTH]].tobytes(), seed=t) - 2**63 for t, order in enumerate(orders)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()), pa.array(regions, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "cls", "sig", "regions"],
                )

    return docs.mapInArrow(make, "doc_id bigint, n_shingles bigint, cls binary, sig binary, regions array<bigint>")


_few = small


def regions_of(classes: DataFrame) -> DataFrame:
    """(member, near): the regions of more than one class that a class is in, as structs (tree, region, size)."""
    slim = classes.select(F.col("rep").alias("member"), F.posexplode("regions").alias("tree", "region")).select("member", "tree", F.xxhash64("region", "tree").alias("region"))
    counts = slim.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    return slim.join(counts, "region").groupBy("member").agg(F.collect_list(F.struct("tree", "region", "size")).alias("near"))  # one for each order at most


def region_rows(classes: DataFrame, near: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """A row for each class and region, with part: parts of a region hold LARGE classes at most, about."""
    orders = forest.orders
    rows = classes.join(_few(near), F.col("rep") == F.col("member")).drop("member").withColumn("near", F.explode("near"))
    rows = rows.select("rep", "sig", "n_shingles", "regions", "near.tree", "near.region", "near.size")

    def deepen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, sizes = batch.column("tree").to_pylist(), batch.column("size").to_pylist()
            parts = []
            for t, size, sig, rep in zip(trees, sizes, batch.column("sig").to_pylist(), batch.column("rep").to_pylist(), strict=True):
                if size <= LARGE:
                    parts.append(0)
                    continue
                more, left = 0, size / LARGE  # each further value keeps about the threshold's share of near copies together
                while left > 1 and more < 24:
                    left *= forest.threshold / 100
                    more += 1
                values = np.frombuffer(sig, np.uint16)[orders[t][DEPTH : DEPTH + more]]
                salt = xxhash.xxh3_64_intdigest(str(rep)) % max(1, size // LARGE + 1)
                parts.append(xxhash.xxh3_64_intdigest(values.tobytes(), seed=salt) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, "part"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(deepen, f"{kinds}, part bigint")


def candidates(rows: DataFrame, across: bool, forest: Forest = Forest()) -> DataFrame:
    """(a, b, est), a < b: each pair once. across: instead, what is outside the largest component against all of its part."""
    orders = forest.orders

    def of_groups(part: pa.Table) -> pa.RecordBatch:
        """Pairs of whole groups, one after another in the rows."""
        rep, n, comp = (part.column(c).to_numpy() for c in ("rep", "n_shingles", "comp" if across else "rep"))
        sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        region, piece = part.column("region").to_numpy(), part.column("part").to_numpy()
        group = np.concatenate([[0], np.cumsum((region[1:] != region[:-1]) | (piece[1:] != piece[:-1]))])
        sizes = np.bincount(group)[group]
        tree = part.column("tree").to_numpy()
        # a pair that meets in several whole regions is looked at in the first of them
        whole = part.column("size").to_numpy() <= LARGE
        trees = np.stack(part.column("regions").to_numpy(zero_copy_only=False)) if across else None
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            fits = (100 * np.minimum(n[i], n[j]) >= forest.threshold * np.maximum(n[i], n[j])) & (comp[i] != comp[j])
            i, j = i[fits], j[fits]
            if across and len(i):
                first = (trees[i] == trees[j]).argmax(1) == tree[i]
                i, j = i[first | ~whole[i]], j[first | ~whole[i]]
            for lo in range(0, len(i), 8192):
                x, y = i[lo : lo + 8192], j[lo : lo + 8192]
                est = (sigs[x] == sigs[y]).mean(1)
                near = est >= forest.floor
                out.append((rep[x][near], rep[y][near], est[near]))

        if across:
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            guest = part.column("guest").to_numpy(zero_copy_only=False)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                at = np.arange(lo, hi)
                own = at[~guest[lo:hi]]
                values, counts = np.unique(comp[own], return_counts=True)
                asks = at[guest[lo:hi] | (comp[lo:hi] != (values[counts.argmax()] if len(values) else -1))]
                for i in asks if len(own) else ():
                    take(np.full(len(own), i), own)
        else:
            order = orders[tree][:, DEPTH : DEPTH + 8]
            following = np.take_along_axis(sigs, order, 1)
            by = np.lexsort([rep, *following.T[::-1], group])
            rep, n, comp, sigs = rep[by], n[by], comp[by], sigs[by]  # groups stay where they are
            for step in range(1, max(SMALL, NEAR + 1)):
                at = np.arange(len(group) - step) if len(group) > step else np.zeros(0, np.int64)
                at = at[(group[at] == group[at + step]) & ((sizes[at] <= SMALL) | (step <= NEAR))]
                if not len(at):
                    break
                take(at, at + step)
            first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
            at = np.flatnonzero((sizes > SMALL) & (first < np.arange(len(group))))
            take(first[at], at)
        a, b, est = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(est)], names=["a", "b", "est"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group that a batch cuts waits for its rest."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            region, piece = batch.column("region").to_numpy(), batch.column("part").to_numpy()
            starts = np.flatnonzero((region[1:] != region[:-1]) | (piece[1:] != piece[:-1])) + 1
            if held and (held[-1].column("region")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (region[0], piece[0]):
                yield of_groups(pa.Table.from_batches(held).combine_chunks())
                held = []
            if len(starts):
                held.append(batch.slice(0, starts[-1]))
                yield of_groups(pa.Table.from_batches(held).combine_chunks())
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
        if held:
            yield of_groups(pa.Table.from_batches(held).combine_chunks())

    if across:
        rows = rows.filter(F.col("size") > SMALL).withColumn("guest", F.lit(False))
        # what is outside the largest component of a region that was cut visits the region's other parts
        large = rows.filter(F.col("size") > LARGE)
        most = large.groupBy("region", "comp").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
        parts = large.select("region", F.col("part").alias("other")).distinct()
        minor = large.join(most, "region").filter("comp != main").join(parts, "region").filter("other != part")
        guests = minor.withColumns({"part": F.col("other"), "guest": F.lit(True)}).select(*rows.columns)
        rows = rows.unionByName(guests)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "region", "part").sortWithinPartitions("region", "part")
    pairs = dealt.mapInArrow(stream, "a bigint, b bigint, est double")
    if not across:
        heads = rows.filter(F.col("size") > LARGE)
        firsts = heads.groupBy("region", "part").agg(F.min("rep").alias("b"))
        firsts = firsts.join(heads.groupBy("region").agg(F.min("rep").alias("a")), "region").filter("a < b")
        pairs = pairs.unionByName(firsts.select("a", "b", F.lit(1.0).alias("est")))
    return pairs.groupBy("a", "b").agg(F.max("est").alias("est"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Docs whose id is in wanted (rep, ...), joined; the ids are broadcast if they are few enough."""
    return docs.join(_few(wanted), docs["doc_id"] == wanted["rep"])


def confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) of the pairs that are linked. Sets are made from texts again, and dealt by the pair's hub, a."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [shingle_set(t.as_py()) for t in part.column("text")]
                mine = [xxhash.xxh3_128_digest(s.tobytes()) == c.as_py() for s, c in zip(found, part.column("cls"), strict=True)]
                rows = pa.RecordBatch.from_arrays([part.column("rep"), part.column("hubs"), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "hubs", "shingles"])
                yield rows.filter(pa.array(mine, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                linked.append(100 * both >= threshold * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    slim = docs.select("doc_id", "text")
    leaves = pairs.groupBy(F.col("b").alias("rep")).agg(F.collect_set("a").alias("hubs")).join(reps.select("rep", "cls"), "rep")
    hubs = pairs.select(F.col("a").alias("rep")).distinct().join(reps.select("rep", "cls"), "rep").withColumn("hubs", F.array().cast("array<bigint>"))
    schema = "rep bigint, hubs array<bigint>, shingles binary"
    made = lambda wanted: _texts(slim, wanted).select("text", "rep", "hubs", "cls").mapInArrow(sets, schema)
    left = made(leaves).select(F.col("rep").alias("b"), F.explode("hubs").alias("a"), F.col("shingles").alias("y"))
    right = made(hubs).select(F.col("rep").alias("a"), F.col("shingles").alias("x")).dropDuplicates(["a"])
    return left.join(right, "a").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, comp): the smallest id that links (a, b) reach, for every id that has a link; a materialised table."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        stars = materialise(small, "stars")
        discard(edges)
        edges = stars
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (row["n"], row["s"]):
            break
        state = (row["n"], row["s"])
    out = materialise(edges.select(F.col("u").alias("rep"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("rep"), F.col("v").alias("comp")).distinct()), "components")
    discard(edges)
    return out


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links (a, b): only links between components are gone through. comps is used up."""
    ends = [comps.select(F.col("rep").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    lifted = links.join(small(ends[0]), "a", "left").join(small(ends[1]), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = materialise(lifted.filter("a != b").distinct(), "between")
    if not between.limit(1).count():
        discard(between)
        return comps
    more = components(between)
    moved = small(more.select(F.col("rep").alias("comp"), F.col("comp").alias("to")))
    old = comps.join(moved, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp"))
    out = materialise(old.unionByName(more.join(small(comps.select("rep")), "rep", "left_anti").select("rep", "comp")), "components")
    discard(comps, between, more)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; links have a Jaccard similarity of threshold hundredths."""
    forest = Forest.at(threshold)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return _by_number(docs, threshold)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = materialise(signatures(docs, forest).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    with_words = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # one row stands for a class: the one of its least id; an id with several texts may stand for several classes
    first_of = with_words.groupBy("cls").agg(F.min(F.struct("doc_id", "uid")).alias("f"))
    reps = materialise(first_of.select("cls", F.col("f.doc_id").alias("rep"), F.col("f.uid").alias("uid")), "reps")
    members = with_words.select("doc_id", "cls").join(reps.select("cls", "rep"), "cls")
    classes = rows.join(_few(reps.select("uid")), "uid", "left_semi").select(F.col("doc_id").alias("rep"), "cls", "sig", "regions", "n_shingles")
    near = materialise(regions_of(classes), "near")
    parts = region_rows(classes, near, forest)

    pairs = materialise(candidates(parts.drop("regions"), False, forest), "pairs")
    ends = pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "est").union(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "est"))
    # one neighbour for each class: the smallest that is clearly near, else the nearest
    pick = F.when(F.max(F.col("est") >= 0.9), F.min(F.when(F.col("est") >= 0.9, F.col("y")))).otherwise(F.max_by("y", F.struct("est", -F.col("y"))))
    first = ends.groupBy("x").agg(pick.alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = materialise(first, "first")
    linked = materialise(confirm(docs, reps, first, threshold), "confirmed")
    comps = components(linked)

    def still_apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        a, b = comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
        open_ = pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        return open_.select("a", "b")

    rest = materialise(still_apart(pairs.join(first, ["a", "b"], "left_anti"), comps), "rest")
    more = materialise(confirm(docs, reps, rest, threshold), "confirmed")
    comps = merged(comps, more)
    with_comp = parts.filter(F.col("size") > SMALL).join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    across = materialise(candidates(with_comp, True, forest).join(pairs.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"), "across")
    # ids with several texts link their classes
    several = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a != z").select("doc_id", "a")
    through = members.join(small(several), "doc_id").select("a", F.col("rep").alias("b")).filter("a != b")
    last = materialise(confirm(docs, reps, across, threshold).union(through).distinct(), "confirmed")
    comps = merged(comps, last)
    # a document is where the representative of its class is; most are on their own
    placed = members.join(small(comps), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    moved = materialise(placed.filter("comp != doc_id").groupBy("doc_id").agg(F.min("comp").alias("comp")), "moved")
    own = F.coalesce("comp", "doc_id")
    out = rows.select("doc_id", "n_shingles").join(small(moved), "doc_id", "left")
    out = materialise(out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")), "near_duplicates")
    discard(rows, reps, near, pairs, first, linked, rest, more, across, last, comps, moved)
    return out


def _by_number(docs: DataFrame, threshold: int) -> DataFrame:
    """near_duplicates for ids of other types: numbers in the order of the ids stand for them meanwhile."""
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy("doc_id")  # a range for each task, so that numbers follow the order
    ids = materialise(ids.select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_number")), "ids")
    numbered = materialise(docs.join(ids, F.col("doc_id") == F.col("_id"), "left").select(F.col("_number").alias("doc_id"), "text"), "numbered")
    found = near_duplicates(numbered, threshold=threshold)
    named = found.join(ids, F.col("doc_id") == F.col("_number"), "left").select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")
    named = named.join(ids, F.col("component_id") == F.col("_number"), "left").select("doc_id", "n_shingles", F.col("_id").alias("component_id"), "kept")
    out = materialise(named, "near_duplicates")
    discard(ids, numbered, found)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; of rows of one doc_id the least by text."""
    found = near_duplicates(docs, doc_id, text, threshold)
    gone = materialise(found.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    out = docs.join(small(gone), docs[doc_id] == F.col("_gone"), "left_anti")
    again = docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_again")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_again")
    again = materialise(again, "again")
    if not again.limit(1).count():
        return out
    repeated = out.join(again, out[doc_id] == F.col("_again"), "left_semi")
    first = Window.partitionBy(doc_id).orderBy(text, *(c for c in docs.columns if c not in (doc_id, text)))
    one = repeated.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select(*docs.columns)
    return out.join(again, out[doc_id] == F.col("_again"), "left_anti").unionByName(one)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
