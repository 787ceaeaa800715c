"""MinHash near-dedup: bottom-k sketches from one hash function.

A document's set is its distinct word shingles, as 64-bit hashes.  Its sketch
keeps the ``k`` least of them.  Documents with equal sets form a class; all
that follows works on one row a class.

Candidates come from inverted lists of retained values.  Two sketches of sets
with a Jaccard similarity of 0.8 share well over half of their values, so, in
one global order, each has a shared value among its first ``s - c + 1`` of
``s``.  The order is by how common a value's bucket is, rarest first: lists of
common passages hold no rows unless a text has little else.  A pair is made in
the list of its first shared value only: all values before that one differ, so
their number bounds the overlap, and texts that share a passage but are
otherwise different are not paired in that passage's lists.

Within a list, the member with the fewest values before is the hub, and only
(hub, member) pairs are made: copies of one text need as many pairs as there
are copies.  Pairs whose union-sketch estimate lies far below the threshold
are dropped; the others are confirmed on their full sets.

Of lists that still join several components, short ones are compared member by
member.  Members of long ones, such as the many versions of one text that
differ in a few places each, are listed again by the rarest values of their
full sets, where the bounds have no allowance for chance: versions with enough
differences of their own stand in no list there, and the others go through
hubs first and then, as far as their components differ, pair by pair, so no
link between components is lost.  Lists that are too long are split into
salted parts, and for the comparison into cells of two parts.

Defined results: a null text, or one without words, has an empty set and links
with nothing; a text with fewer words than a shingle has its whole sequence as
its one shingle; very long texts are read whole; repeated rows link with each
other and, having the same id, are all kept or all not; a null id is never the
least of a component with another id; ids are whole numbers (others raise
Spark's cast error); an empty table gives no rows; extra columns are not read
and, where documents are kept, come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm._shared import freed, hash_words, in_small_batches, list_array, mix64, released, shingle_hashes, slices, texts_of
from jobloom.llm.bits import build_bits, test
from jobloom.llm.components import components
from jobloom.storage import discard, materialize, release

K = 128
BUCKETS = 1 << 17
LIST_PART = 20_000
#: Members of one part of a list that is compared member by member.
REST_PART = 512
#: Lists of at most so many members are compared member by member.
SHORT = 64
#: Rounds of hubs over the lists from full sets.
STAR_ROUNDS = 2
#: For lists from full sets, of which nothing is left out.
WHOLE = 1 << 40
#: Bytes of a pair, of a list's member, and of a class's row without its sketch.
PAIR, MEMBER, CLASS = 16, 48, 96
#: Pairs that the last turn looks at in one step.
STEP = 1 << 21
BLOOM_BITS = 1 << 26
#: Six standard deviations of the number of shared values in a union sketch at similarity 0.8.
SLACK = 6


def least_shared(k: int, threshold: float) -> int:
    """How many values two full sketches share at least, up to a chance of about 1e-9."""
    return int(k * threshold - SLACK * (k * threshold * (1 - threshold)) ** 0.5)


def prefix_length(size: int, k: int, threshold: float) -> int:
    """How many of a sketch's values, in global order, include a shared one."""
    need = least_shared(k, threshold)
    # a set so small that its partners' sketches are whole sets too has an exact bound
    share = -(-size * round(threshold * 100) // 100) if size <= int(k * threshold) else need
    return max(1, size - min(size, share) + 1)


def _shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, off in slices(texts):
        words, doc = hash_words(data, off)
        yield i, j, *shingle_hashes(words, doc, j - i, width)


def _digests(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set."""
    out = []
    for seed in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(seed)), dtype=np.uint64)))
        out.append((sums[off[1:]] - sums[off[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, k: int = K) -> DataFrame:
    """(key, id, n_shingles, c1, c2, sketch): one row a document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for i, j, h, off in _shingles(texts_of(batch.column(2)), width):
                n = np.diff(off)
                c1, c2 = _digests(h, off)
                take = np.minimum(n, k)
                at = np.repeat(off[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                sketch = list_array(h[at], np.concatenate(([0], np.cumsum(take))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(c1), pa.array(c2), sketch], ["key", "id", "n", "c1", "c2", "sketch"])

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(sign, "key long, id long, n long, c1 long, c2 long, sketch array<long>")


def _bucket_counts(classes: DataFrame) -> np.ndarray:
    """How many retained values fall into each of a fixed number of buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            v = batch.column(0).flatten().to_numpy()
            total += np.bincount(v & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = classes.select("sketch").mapInArrow(released(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def postings(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(v, salt, cid, n, p): the prefix of each class's sketch in global order, ``p`` values standing before ``v``."""
    counts = classes.sparkSession.sparkContext.broadcast(_bucket_counts(classes))
    lengths = np.array([0, *(prefix_length(s, k, threshold) for s in range(1, k + 1))])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(2)
            v, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            c = common[v & (BUCKETS - 1)]
            order = np.lexsort((v, c, owner))
            rank = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            first = rank < np.repeat(lengths[size], size)
            keep, rank = order[first], rank[first]
            own, parts = owner[keep], c[keep] // LIST_PART + 1
            part = 1 + mix64(cid[own].astype(np.uint64)) % parts.astype(np.uint64)
            salt = np.where(parts > 1, part, 0).astype(np.int32)  # 0: the list is whole
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(salt), pa.array(cid[own]), pa.array(n[own]), pa.array(rank.astype(np.int32))], ["v", "salt", "cid", "n", "p"])

    return classes.select("cid", "n", "sketch").mapInArrow(released(post), "v long, salt int, cid long, n long, p int")


def possible(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Can sets of ``n`` and ``m`` values link, if ``p`` and ``q`` values stand before their first shared one?"""
    shared = np.minimum(np.minimum(n, k) - p, np.minimum(m, k) - q)  # at most so many retained values
    whole = (n <= k) & (m <= k)
    enough = np.where(whole, (100 + percent) * shared >= percent * (n + m), shared >= least_shared(k, percent / 100))
    return enough & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _stars(lists: DataFrame, k: int, percent: int) -> DataFrame:
    """Each list's members with its hub; near: another component, and a link is possible.

    The hub itself has a row only in a part of a split list.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, (0, 0, 0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, salt, cid, n, p, comp = (batch.column(i).to_numpy() for i in range(6))
            first = np.ones(len(cid), bool)
            first[1:] = (v[1:] != v[:-1]) | (salt[1:] != salt[:-1])
            first[0] = last != (v[0], salt[0])
            at = np.concatenate(([0], np.flatnonzero(first)))
            heads = [x[at] for x in (cid, n, p, comp)]
            for x, y in zip(heads, hub, strict=True):
                x[0] = y  # rows before the first new list belong to the one of the batch before
            hc, hn, hp, ho = (x[np.cumsum(first)] for x in heads)
            last, hub = (v[-1], salt[-1]), (hc[-1], hn[-1], hp[-1], ho[-1])
            near = ~first & (ho != comp) & possible(hn, hp, n, p, k, percent)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(hc), pa.array(near)], ["v", "cid", "n", "p", "hub", "near"])
            yield out.filter(pa.array(~first | (salt > 0)))

    ordered = lists.repartition("v", "salt").sortWithinPartitions("v", "salt", "p", "cid")
    return ordered.select("v", "salt", "cid", "n", "p", "comp").mapInArrow(released(walk), "v long, cid long, n long, p int, hub long, near boolean")


def _rest(lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the possible pairs between different components in each list.

    Members are sorted by size, so each is compared with those of up to 1.25
    times its size only.  A list of several parts is dealt to cells of two
    parts each, in which members of one meet those of the other.
    """
    parts = lists.groupBy("v").agg(F.ceil(F.count("*") / REST_PART).cast("int").alias("parts"))
    dealt = lists.join(parts, "v").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select("v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "n", "cid", "p", "comp", "own")
    names = ["v", "x", "y", "n", "cid", "p", "comp", "own"]

    def pairs(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of whole lists, a bounded number of comparisons at a time."""
        v, x, y, n, cid, p, comp, own = c
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        group = np.cumsum(new).astype(np.int64)
        wide = np.int64(int(n.max()) * 2 + 2)
        upto = np.searchsorted(group * wide + n, group * wide + n * 100 // percent, side="right")
        count = upto - np.arange(len(n)) - 1
        ends = np.cumsum(count)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, side="right")))
            i = np.repeat(np.arange(start, stop), count[start:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[start:stop]) - count[start:stop], count[start:stop])
            use = (comp[i] != comp[j]) & ((x[i] == y[i]) | (own[i] != own[j])) & possible(n[i], p[i], n[j], p[j], k, percent)
            i, j = i[use], j[use]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], ["a", "b"])
            start = stop

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last list, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy() for i in range(len(names))]
            if held is not None:
                c = [np.concatenate(z) for z in zip(held, c, strict=True)]
            turns = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1]))
            cut = int(turns[-1]) + 1 if len(turns) else 0
            if cut:
                yield from pairs([z[:cut] for z in c])
            held = [z[cut:] for z in c]
        if held is not None:
            yield from pairs(held)

    ordered = cells.repartition("v", "x", "y").sortWithinPartitions("v", "x", "y", "n", "cid")
    return ordered.select(*names).mapInArrow(released(walk), "a long, b long")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs whose union-sketch estimate does not rule the threshold out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            a, b = batch.column(2), batch.column(3)
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                union = np.union1d(x, y)[:k]
                shared = np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).sum()
                m = len(union)
                whole = len(x) < k and len(y) < k  # both sketches are the sets: no slack
                out.append(shared >= m * threshold - (1e-9 if whole else SLACK * (m * threshold * (1 - threshold)) ** 0.5))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    s = classes.select("cid", "sketch")
    both = pairs.join(s.withColumnsRenamed({"cid": "a", "sketch": "sa"}), "a").join(s.withColumnsRenamed({"cid": "b", "sketch": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _spots(h: Column) -> tuple[Column, Column]:
    """The two bits of a hashed key in the Bloom filter."""
    return F.pmod(h, F.lit(BLOOM_BITS)), F.pmod(F.shiftright(h, 31), F.lit(BLOOM_BITS))


def _full_sets(docs: DataFrame, classes: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cid, full): the whole sets of the needed classes, from their representatives' texts.

    A Bloom filter of bounded size keeps the other texts from being hashed
    again; an exact join then drops what it let through.
    """
    spark = docs.sparkSession
    reps = classes.join(needed, "cid", "left_semi").select("cid", "key")
    mixed = F.xxhash64("key")
    spots = reps.select(F.explode(F.array(*_spots(mixed))).alias("position"))
    bits = spark.sparkContext.broadcast(build_bits(spots, BLOOM_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            p, q = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            batch = batch.filter(pa.array(test(bits.value, p) & test(bits.value, q)))
            for i, j, h, off in _shingles(texts_of(batch.column(1)), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(h, off)], ["key", "full"])

    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    p, q = _spots(F.xxhash64("key"))
    rows = rows.select("key", "text", p.alias("p"), q.alias("q"))
    got = in_small_batches(rows).mapInArrow(sets, "key long, full array<long>").join(reps, "key")
    return got.groupBy("cid").agg(F.first("full").alias("full"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.withColumnsRenamed({"cid": "a", "full": "fa"}), "a").join(sets.withColumnsRenamed({"cid": "b", "full": "fb"}), "b")
    n = F.size(F.array_intersect("fa", "fb"))
    return both.filter(100 * n >= percent * (F.size("fa") + F.size("fb") - n)).select("a", "b")


def classes_of(signed: DataFrame) -> DataFrame:
    """(cid, n, c1, c2, key, sketch, first): one row for each distinct set that is not empty, with its least row."""
    first = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")
    one = signed.filter("n > 0").groupBy("c1", "c2", "n").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch"), first)
    return one.withColumn("cid", F.monotonically_increasing_id())


def exact_lists(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(v, salt, cid, n, p, comp): the rarest values of the full sets (cid, full) of ``members`` (cid, comp).

    A value that only one member has needs no list, but stands before the others.
    """
    values = sets.select("cid", F.explode("full").alias("v"))
    counts = values.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    shared = values.join(counts, "v").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("shared"))
    n = F.size("full")
    rows = sets.select("cid", n.cast("bigint").alias("n"), (n - F.ceil(n * percent / 100) + 1).cast("int").alias("prefix")).join(shared, "cid")
    alone = (F.col("n") - F.size("shared")).cast("int")
    few = rows.select("cid", "n", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(F.col("prefix") - alone, F.lit(0))).alias("few"))
    each = few.select("cid", "n", "alone", F.posexplode("few").alias("rank", "x"))
    parts = F.floor(F.col("x.c") / LIST_PART).cast("int") + 1
    salt = F.when(parts > 1, 1 + F.pmod(F.xxhash64("cid"), parts)).otherwise(0).cast("int")
    return each.select(F.col("x.v").alias("v"), salt.alias("salt"), "cid", "n", (F.col("alone") + F.col("rank")).cast("int").alias("p")).join(members, "cid")


def similar_classes(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int, percent: int, k: int) -> DataFrame:
    """(node, component) of all classes that a link joins to another."""
    spark: SparkSession = docs.sparkSession
    threshold = percent / 100
    comp: DataFrame | None = None

    def follow(pairs: DataFrame, size: int | None = None) -> None:
        """Confirm the links among the pairs, of ``size`` bytes, and join them to the components found before."""
        nonlocal comp
        likely = materialize(_estimated(pairs.distinct(), classes, k, threshold), "likely", size=size)
        if n := likely.count():
            needed = likely.select(F.col("a").alias("cid")).union(likely.select(F.col("b").alias("cid"))).distinct()
            sets = _full_sets(docs, classes, needed, id_col, text_col, width)
            found = materialize(_confirmed(likely, sets, percent), "links", size=PAIR * n)
            before = comp
            comp = components(found if before is None else found.union(before.toDF("a", "b")), n_links=n + (0 if before is None else before.count()))
            discard(found, before)
        discard(likely)
        release(spark)

    def hubs(lists: DataFrame, k: int, members: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pairs with hubs, the lists without the hubs that met all members, the table of both); ``members``: the lists' rows at most."""
        stars = materialize(_stars(lists, k, percent), "stars", size=MEMBER * members)
        near = stars.filter("near").select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b"))
        return near, stars.select("v", F.lit(0).alias("salt"), "cid", "n", "p"), stars

    def split(lists: DataFrame) -> DataFrame:
        """The lists that still join several components, with their members' number."""
        size = MEMBER * lists.count()
        if comp is None:
            named = lists.withColumn("comp", F.col("cid"))
        else:
            named = lists.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        several = named.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("v", "members")
        return materialize(named.join(several, "v"), "lists", size=size)

    near, rest, stars = hubs(postings(classes, k, threshold).withColumn("comp", F.col("cid")), k, classes.count() * prefix_length(k, k, threshold))
    follow(near, PAIR * near.count())
    first = split(rest)
    discard(stars)
    pairs = _rest(first.filter(F.col("members") <= SHORT), k, percent)
    long = materialize(first.filter(F.col("members") > SHORT).select("cid", "n", "comp").distinct(), "long", size=MEMBER * first.count())
    if long.isEmpty():
        follow(pairs)
        discard(first, long)
    else:
        values = long.agg(F.sum("n")).first()[0]
        sets = materialize(_full_sets(docs, classes, long.select("cid"), id_col, text_col, width), "sets", size=8 * values)
        lists = exact_lists(sets, long.drop("n"), percent)
        for turn in range(STAR_ROUNDS):
            near, rest, stars = hubs(lists, WHOLE, lists.count() if turn else values)
            follow(near if turn else near.union(pairs))
            before = None if turn == 0 else lists
            lists = split(rest).drop("members")
            discard(stars, before, *((first, long, sets) if turn == 0 else ()))
        follow(_rest(lists, WHOLE, percent))
        discard(lists)
    return comp if comp is not None else spark.createDataFrame([], "node long, component long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """(key, id, n_shingles, component_id, kept, chosen): one row a document.

    ``kept`` says whether its id is its component's; ``chosen`` tells rows of
    one id apart by their texts.  The least row is found for each class before
    it is for each component, and rows with an empty set meet no other, so no
    group of copies is gathered.
    """
    signed = materialize(signatures(docs, id_col, text_col, width, k), "signed")
    classes = materialize(classes_of(signed), "classes", size=(8 * k + CLASS) * signed.count())
    joined = similar_classes(docs, classes, id_col, text_col, width, percent, k)
    grouped = classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("c1", "c2", "n", "first", F.coalesce("component", "cid").alias("group"))
    least = grouped.groupBy("group").agg(F.min("first").alias("least"))
    of_class = materialize(grouped.join(least, "group").select("c1", "c2", "n", F.col("least.id").alias("least"), F.col("least.key").alias("chosen_key")), "groups", size=CLASS * classes.count())
    discard(joined)
    release(docs.sparkSession)
    rows = signed.drop("sketch")
    named = rows.filter("n > 0").join(of_class, ["c1", "c2", "n"]).select("key", "id", "n", "least", (F.col("key") == F.col("chosen_key")).alias("chosen"))
    bare = rows.filter("n = 0").select("key", "id", "n", F.col("id").alias("least"), F.lit(True).alias("chosen"))
    out = named.union(bare).select("key", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), "chosen")
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of least id, all columns kept; rows with an empty set all stay.

    Rows that share an id stay apart by their texts, and of rows with equal id
    and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, width, percent).filter("chosen").select("key", (F.col("n_shingles") == 0).alias("bare")).distinct()
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = keyed.join(found, "key").withColumn("twin", F.when(F.col("bare"), F.col("number")))
    return rows.dropDuplicates(["key", "twin"]).select("row.*")


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
