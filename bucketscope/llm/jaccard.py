"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard index of their sets of five-word shingles is 0.8 or more.
If two sets share enough, then under any common order of shingles the prefixes of length
n - ceil(0.8 n) + l share at least l of them. The join uses this twice:

1. by shingle hash, with l = n / 20: a document whose prefix holds too few shingles that any
   other text has links with nothing and leaves;
2. among the rest by (document frequency, hash): each document takes the l of least estimated
   cost, so that costly prefixes grow and demand more common shingles before a pair is verified
   (pairs are met in the prefixes of l = 1, which hold the first common shingle).

Equal sets form one class, so copies are never paired. In every prefix list the classes are
first held against one of them (a star); lists whose classes have then all met in one component
are done, and only pairs across components, if sizes and places in the lists allow a link, are
counted, verified and linked. No pair of unequal
sets that could join components is left out, nothing is capped.

Null and empty texts have no shingles and link with nothing; fewer than five words form one
shingle. Repeated rows are copies of each other. Very long texts are used whole; extra columns
are ignored, or kept by ``without_near_duplicates``, whatever their names. An empty table gives an
empty table. A null doc_id counts as any text, but is never a component's id unless no other is
in the component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketscope.llm.columnar import shingle_rows, slices
from bucketscope.llm.components import components
from bucketscope.llm.tables import stored, table

#: Similarity in hundredths.
LIKE = 80
#: Shingles of a prefix bucket in the first filter, and of a task's outgoing batch.
BUCKET_SHINGLES, BATCH_SHINGLES = 500_000, 1_000_000
#: Candidate ids that are broadcast (8 bytes each); beyond, a shuffled join.
BROADCAST_IDS = 2_000_000
#: Most matches l that an adaptive prefix may ask for; a longer prefix would only cost more, no pair depends on it.
MOST_MATCHES = 64
#: Members of a list that meet all of its others in one task.
PIECE_ROWS = 5_000
#: Step between bands of set sizes, within which pairs across components are met.
BAND = 1.05
#: A class of more than this share of the rows gets its component by broadcast; there are fewer than 1,000 such classes.
HOT_SHARE = 1_000
#: Stands for the classes of a shingle that several of a batch have.
_NOBODY = 0xFFFF


def _class_of(hashes: np.ndarray) -> int:
    """64 bits of a digest of a set (sorted); 0 for the empty set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True) if len(hashes) else 0


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in slices(column):
        for h in shingle_rows(data, offsets):
            yield np.unique(h)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), n (set size), c (class of equal sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(x), _class_of(x)) for x in shingle_sets(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))], ["doc_id", "row", "n", "c"])

    return docs.select(*_key(), "text").mapInArrow(run, "doc_id long, row long, n long, c long")


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row")]


def _alpha(n):  # noqa: ANN001, ANN202
    """Least common shingles of a set of n with any set it links to: ceil(0.8 n)."""
    return (n * LIKE + 99) // 100


def _matches(n):  # noqa: ANN001, ANN202
    """l of the first filter."""
    return (n + 19) // 20


def _may_link(docs: DataFrame, buckets: int) -> DataFrame:
    """c, n of the classes whose hash prefixes hold enough shingles of other classes.

    Prefixes travel as packed arrays of one batch and bucket of hashes, 6 bytes for a shingle and 2
    for its class's place. A batch counts what its own classes share and sends every shingle once
    at most, so that the commonest shingle comes as often as there are batches, not texts.
    """

    def parted(c: np.ndarray, n: np.ndarray, k: np.ndarray) -> list[tuple]:
        """Counts k of shared shingles of classes c, packed by the part that adds them up."""
        part = (c.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        c, n, k, part = c[order], n[order], k[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(c) else np.zeros(1, np.int64)
        return [(int(part[a]), c[a:b].tobytes(), n[a:b].tobytes(), k[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(len(names))], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[int] = []
        total = 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            c, n = np.array(ids, np.int64), np.array(sizes, np.int32)
            held.clear()
            ids.clear()
            sizes.clear()
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            runs = np.diff(np.r_[starts, len(tokens)])
            here = np.bincount(owner[np.repeat(runs > 1, runs)], minlength=len(c)).astype(np.int32)
            tokens, owner = tokens[starts], owner[starts]
            owner[runs > 1] = _NOBODY
            bucket = ((tokens >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            low = tokens.view(np.uint8).reshape(-1, 8)[:, :6]
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, place = np.unique(owner[a:b], return_inverse=True)
                place = np.where(owner[a:b] == _NOBODY, _NOBODY, place).astype(np.uint16)
                own = own[own != _NOBODY]
                rows.append((int(bucket[a]), c[own].tobytes(), n[own].tobytes(), None, low[a:b].tobytes(), place.tobytes()))
            some = np.flatnonzero(here)
            rows += [(*r, None, None) for r in parted(c[some], n[some], here[some])]
            return batch(rows, ["bucket", "classes", "sizes", "counts", "tokens", "places"])

        for b in batches:
            for x in shingle_sets(b.column(0)):
                if len(x) and (c := _class_of(x)) not in seen:
                    seen.add(c)
                    n = len(x)
                    held.append(x[: min(n, n - _alpha(n) + _matches(n))])
                    ids.append(c)
                    sizes.append(n)
                    total += len(held[-1])
                    if total >= BATCH_SHINGLES or len(held) >= 60_000:
                        total = 0
                        yield out()
        if held:
            yield out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class that had a shingle to itself in its batch, how many other batches have; counts pass through."""
        names = ["part", "classes", "sizes", "counts"]
        at: int | None = None
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        passed: list[tuple] = []

        def out() -> pa.RecordBatch:
            done = list(passed)
            passed.clear()
            if rows:
                tokens, nobody, c, n = (np.concatenate([r[k] for r in rows]) for k in range(4))
                rows.clear()
                order = np.lexsort((c, nobody, tokens))
                tokens, nobody, c, n = tokens[order], nobody[order], c[order], n[order]
                fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (c[1:] != c[:-1]) | (nobody[1:] != nobody[:-1])]  # the same class from two batches counts once
                tokens, nobody, c, n = tokens[fresh], nobody[fresh], c[fresh], n[fresh]
                starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
                runs = np.diff(np.r_[starts, len(tokens)])
                common = np.repeat((runs > 1) | np.logical_or.reduceat(nobody, starts), runs) & ~nobody
                c, first, k = np.unique(c[common], return_index=True, return_counts=True)
                done += parted(c, n[common][first], k.astype(np.int32))
            return batch(done, names)

        for b in batches:
            for bucket, own, size, count, tokens, places in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if bucket != at and (rows or passed):
                    yield out()
                at = bucket
                if tokens is None:
                    passed.append((bucket, own, size, count))
                    continue
                low = np.zeros((len(tokens) // 6, 8), np.uint8)
                low[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
                place = np.frombuffer(places, np.uint16)
                nobody = place == _NOBODY
                place = np.where(nobody, 0, place)
                own, size = (np.append(np.frombuffer(x, t), t(0)) for x, t in ((own, np.int64), (size, np.int32)))
                rows.append((low.view(np.uint64).ravel(), nobody, np.where(nobody, 0, own[place]), np.where(nobody, 0, size[place]).astype(np.int32)))
        if rows or passed:
            yield out()

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums each class's counts; those that hold enough shared shingles stay. A class that is in several batches may be counted too high, never too low."""
        at: int | None = None
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            c, n, k = (np.concatenate([r[i] for r in rows]) for i in range(3))
            rows.clear()
            c, first, place = np.unique(c, return_index=True, return_inverse=True)
            n, k = n[first].astype(np.int64), np.bincount(place, k, len(c)).astype(np.int64)
            ok = k >= _matches(_alpha(n))
            return pa.RecordBatch.from_arrays([pa.array(c[ok]), pa.array(n[ok])], ["c", "n"])

        for b in batches:
            for part, *arrays in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != at and rows:
                    yield out()
                at = part
                rows.append(tuple(np.frombuffer(x, t) for x, t in zip(arrays, (np.int64, np.int32, np.int32), strict=True)))
        if rows:
            yield out()

    packed = docs.select("text").mapInArrow(pack, "bucket int, classes binary, sizes binary, counts binary, tokens binary, places binary")
    counts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "part int, classes binary, sizes binary, counts binary")
    return counts.repartition("part").sortWithinPartitions("part").mapInArrow(enough, "c long, n long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """c, n, s (sorted hashes) of the documents in ids (doc_id, row): one row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in slices(b.column(0)):
                rows = [np.unique(h) for h in shingle_rows(data, offsets)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(x) for x in rows], pa.int64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64()))], ["c", "n", "s"])

    known = ids.count()
    ids = F.broadcast(ids) if known <= BROADCAST_IDS else ids
    rows, ids = docs.select(*_key(), "text").alias("x"), ids.alias("y")
    chosen = rows.join(ids, F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.row") == F.col("y.row")), "left_semi")
    sets = stored(chosen.select("text").mapInArrow(run, "c long, n long, s array<long>").filter("n > 0"))
    return sets if sets.count() <= known else stored(sets.dropDuplicates(["c"]))  # a row that is repeated comes repeatedly


def _prefixes(sets: DataFrame) -> DataFrame:
    """c, n, s, matches, list (t, level): the shared shingles of each class's adaptive prefix, in order.

    s is how many shingles of the class are shared; level is the least l whose prefix holds the
    shingle; matches is the class's own l.
    """
    rows = sets.select("c", "n", F.explode("s").alias("t"))
    frequent = rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = rows.join(frequent, "t").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s")).filter(F.size("s") >= F.expr(f"(n * {LIKE} + 99) div 100"))

    # first: shared shingles in the prefix of l = 1 (those of no other class come before them in the order).
    # Reading the lists, then verifying at most lists / l candidates, each as costly as its set is large.
    rows = shared.withColumn("first", F.expr(f"size(s) - (n * {LIKE} + 99) div 100 + 1").cast("int"))
    begun = "aggregate(slice(s, 1, first - 1), 0D, (a, x) -> a + x.df)"
    cost = "(a.total + x.df) * (1 + n / (a.l + 1))"
    step = f"(a, x) -> named_struct('l', a.l + 1, 'total', a.total + x.df, 'best', if({cost} < a.cost, a.l + 1, a.best), 'cost', least(a.cost, {cost}))"
    tried = f"slice(s, first, cast(least({MOST_MATCHES}, (n * {LIKE} + 99) div 100) as int))"
    rows = rows.withColumn("matches", F.expr(f"aggregate({tried}, named_struct('l', 0, 'total', {begun}, 'best', 1, 'cost', double('Infinity')), {step}, a -> a.best)"))
    prefix = F.expr("transform(slice(s, 1, first + matches - 1), (x, i) -> struct(x.t as t, greatest(1, i - first + 2) as level))")
    return rows.select("c", "n", F.size("s").alias("s"), "matches", prefix.alias("list"))


def _may(x: str, y: str) -> Column:
    """May two classes link, by their sizes and by how many of their shingles others share at all?"""
    return F.expr(f"{x}.n * 100 >= {y}.n * {LIKE} and {y}.n * 100 >= {x}.n * {LIKE} and least({x}.s, {y}.s) * {100 + LIKE} >= ({x}.n + {y}.n) * {LIKE}")


def _may_first(x: str, y: str) -> Column:
    """And may they, if this shingle is the first of their common ones? No more than what follows it in either list can be common."""
    return F.expr(f"least({x}.s - {x}.at, {y}.s - {y}.at) * {100 + LIKE} >= ({x}.n + {y}.n) * {LIKE}")


def _match_enough(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs whose l-prefixes share l shingles, l being the lesser of the two."""
    one = prefixes.select(F.col("c").alias("a"), F.col("matches").alias("l"), F.col("list").alias("x"))
    two = prefixes.select(F.col("c").alias("b"), F.col("matches").alias("m"), F.col("list").alias("y"))
    short = lambda k: f"transform(filter({k}, v -> v.level <= least(l, m)), v -> v.t)"
    return pairs.join(one, "a").join(two, "b").filter(F.expr(f"size(array_intersect({short('x')}, {short('y')})) >= least(l, m)")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    one = sets.select(F.col("c").alias("a"), F.col("s").alias("x"))
    two = sets.select(F.col("c").alias("b"), F.col("s").alias("y"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return found.filter(f"both * {100 + LIKE} >= n * {LIKE}").select("a", "b")


def links(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between classes of known (doc_id, n, c): enough of them to join every component."""
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-(total // 4) // BUCKET_SHINGLES))
    reps = known.filter("n > 0").groupBy("c").agg(F.min(F.struct("row", "doc_id")).alias("at"))
    sets = _sets(docs, stored(_may_link(docs, buckets).join(reps, "c").select("at.doc_id", "at.row")))
    prefixes = stored(_prefixes(sets))
    # The first common shingle of two classes that link is in the shortest prefixes of both.
    lists = prefixes.select("c", "n", "s", F.posexplode("list").alias("at", "x")).filter("x.level = 1").select("x.t", "c", "n", "s", "at")

    # The head of a list is the class with the fewest shingles of its own: the centre of a group of near copies, if it has one.
    heads = lists.groupBy("t").agg(F.min_by(F.struct("c", "n", "s"), F.struct(F.col("n") - F.col("s"), "c")).alias("h"), F.min("c").alias("least"), F.max("c").alias("most")).filter("least != most").select("t", "h")
    star = lists.alias("x").join(heads.select(F.col("t").alias("ht"), "h.*").alias("y"), F.col("x.t") == F.col("ht")).filter("x.c != y.c").filter(_may("x", "y"))
    star = stored(star.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())
    first = stored(_verified(_match_enough(star, prefixes), sets))

    found = components(first)
    placed = lists.join(found.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    sizes = placed.groupBy("t", "root").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("t").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.expr(f"cast((sum(k) - 1) div {PIECE_ROWS} + 1 as int)").alias("pieces"))
    # Sizes of the sets that a member may link with, if this shingle is the first common one.
    rest = placed.join(mixed.filter("roots > 1").drop("roots"), "t").withColumn("low", F.expr(f"(n * {LIKE} + 99) div 100")).withColumn("high", F.expr(f"least(n * 100 div {LIKE}, (s - at) * {100 + LIKE} div {LIKE} - n)"))
    rest = stored(rest.filter("low <= high"))
    band = lambda c: f"cast(floor(ln({c}) / ln({BAND})) as int)"
    x = rest.filter("root != main").withColumn("piece", F.expr("pmod(xxhash64(c), pieces)").cast("int")).withColumn("band", F.explode(F.expr(f"sequence({band('low')}, {band('high')})"))).alias("x")
    y = rest.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).withColumn("band", F.expr(band("n"))).alias("y")
    on = (F.col("x.t") == F.col("y.t")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.piece") == F.col("y.piece"))
    across = x.join(y, on).filter("x.root != y.root and (y.root = y.main or x.c < y.c)").filter(_may("x", "y")).filter(_may_first("x", "y"))
    across = across.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    return first.union(_verified(_match_enough(across, prefixes), sets))


def groups(docs: DataFrame) -> DataFrame:
    """A row for each of docs: doc_id, row (a hash of the text), n, group (the same for all texts that reach each other; null without shingles), component_id."""
    known = stored(classes(docs))
    roots = components(links(docs, known))
    reps = known.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    linked = reps.join(roots.withColumnRenamed("node", "c"), "c")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    by_class = reps.join(linked.join(least, "root").select("c", "root", "least"), "c", "left")
    by_class = stored(by_class.select("c", "copies", F.coalesce("root", "c").alias("group"), F.coalesce("least", "rep").alias("component_id")))
    many = (by_class.agg(F.sum("copies")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(by_class.filter(F.col("copies") > many).drop("copies"))
    few = known.join(hot.select("c"), "c", "left_anti").join(by_class.filter(F.col("copies") <= many).drop("copies"), "c", "left")
    rows = few.unionByName(known.join(hot, "c"))
    return rows.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("group")).alias("group"), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"))


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    return groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of texts that reach each other by links: that of the least doc_id (nulls last), then of the least hash of its text; of rows equal in both, any one. Texts without shingles all stay."""
    rows = stored(groups(docs).filter("group is not null").select("doc_id", "row", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = rows.groupBy("group").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    kept = stored(kept.select("group", F.col("k.doc_id").alias("kept_id"), F.col("k.row").alias("kept_row")))
    gone = rows.join(kept, "group").filter("not (doc_id <=> kept_id and row = kept_row)").select("doc_id", "row").distinct()
    again = stored(rows.join(kept, "group").filter("doc_id <=> kept_id and row = kept_row").groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"))
    named = docs.select(F.struct("*").alias("doc"), *_key()).alias("x")
    out = lambda df: df.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
    same = lambda y: F.col("x.doc_id").eqNullSafe(F.col(f"{y}.doc_id")) & (F.col("x.row") == F.col(f"{y}.row"))
    left = named.join(gone.alias("g"), same("g"), "left_anti")
    if again.isEmpty():
        return out(left)
    once = named.join(again.alias("a"), same("a"), "left_semi").groupBy("doc_id", "row").agg(F.first("doc").alias("doc"))
    return out(left.join(again.alias("a"), same("a"), "left_anti")).unionByName(out(once))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))
