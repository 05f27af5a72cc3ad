"""Near-duplicates by MinHash with tensored banding; every link is confirmed on full sets.

Two collections of small hashes, of ``PER_KEY`` minhashes each, are combined: each pair of
one from the first and one from the second is the key of a table, so n + n small hashes
serve n x n tables. Texts that share a table's key are candidates. Steps:

1. One pass over the texts: each set's digest and small hashes. Texts with the same set
   become one node, so copies never meet.
2. Keys are counted; nodes under keys that more than one node has are candidates, and their
   sets alone are made again from the texts.
3. Each key's members are compared with its smallest one, and what is alike is joined.
4. Keys that still hold several components are put together to clusters, and within each of
   them nodes of like size are compared in blocks of bounded size, by counting common
   shingles of whole blocks at once. A block returns the links that join components, at most
   one per node, and never its pairs.
5. Components over all links.

Two texts at the limit of similarity miss all tables with a chance below ``MISS``.

Rows: words are bytes between ASCII white space, A-Z lower-cased. A text of one to four words
has one shingle, all of them; one without words, or a null, has none and is linked with
nothing. Repeated rows are copies. A component is named by its smallest doc_id; a null
doc_id is larger than all others and names a component of its like only. An empty table
gives no rows. Only doc_id and text are read; ``keep_one`` keeps all other columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from adtally.llm.common import (
    forget_words,
    importable,
    mixed,
    new_name,
    small_batches,
    stored,
    table,
    word_hashes,
)
from adtally.llm.graph import components

WORDS = 5
PER_KEY = 2
MISS = 1e-4
#: Most hashes and nodes of a block.
BLOCK_HASHES, BLOCK_NODES = 600_000, 768
#: Keys that a task counts, about 100 bytes each.
KEYS_A_TASK = 500_000
#: Candidate ids up to which they are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 1_000_000
WEIGHTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = word_hashes((text or b"").lower().split())
    n = len(words) - WORDS + 1
    if not len(words):
        return words
    if n < 1:
        return mixed((words * WEIGHTS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    made = words[:n] * WEIGHTS[0]
    for k in range(1, WORDS):
        made += words[k : k + n] * WEIGHTS[k]
    return np.unique(mixed(made))


def small_hashes_needed(percent: int) -> int:
    """Small hashes in each collection, so that a pair at the limit is missed by chance
    below ``MISS``."""
    hit = (percent / 100) ** PER_KEY
    return math.ceil(math.log(MISS / 2) / math.log(1 - hit))


def small_hashes(sets: np.ndarray, count: int) -> np.ndarray:
    """``count`` combinations of ``PER_KEY`` minhashes each, for both collections."""
    total = 2 * count * PER_KEY
    salts = mixed(np.arange(1, total + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.array([(sets * (s | np.uint64(1))).min() for s in salts], np.uint64)
    parts = least.reshape(2 * count, PER_KEY)
    return mixed((parts * WEIGHTS[:PER_KEY]).sum(axis=1) + np.arange(2 * count, dtype=np.uint64))


SKETCH = "doc_id BIGINT, n_shingles BIGINT, digest BINARY, a ARRAY<BIGINT>, b ARRAY<BIGINT>"


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """Per row: the set's size, its digest (null without words) and its small hashes."""
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    count = small_hashes_needed(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, firsts, seconds = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                if len(own):
                    small = small_hashes(own, count).view(np.int64)
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    firsts.append(small[:count])
                    seconds.append(small[count:])
                else:
                    digests.append(None)
                    firsts.append(None)
                    seconds.append(None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(firsts, longs),
                    pa.array(seconds, longs),
                ],
                names=["doc_id", "n_shingles", "digest", "a", "b"],
            )
        forget_words()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def table_keys(nodes: DataFrame) -> DataFrame:
    """``(key, node)``: a key for each pair of small hashes, one of either collection."""
    firsts = nodes.select("node", "b", F.posexplode("a").alias("i", "x"))
    both = firsts.select("node", "i", "x", F.posexplode("b").alias("j", "y"))
    return both.select(F.xxhash64("x", "y", "i", "j").alias("key"), "node")


def dealt(nodes: DataFrame, keys_each: int) -> DataFrame:
    """``nodes`` in parts of about ``KEYS_A_TASK`` keys, if each node has ``keys_each``."""
    return nodes.repartition(math.ceil(nodes.count() * keys_each / KEYS_A_TASK) or 1, "node")


def shared_keys(nodes: DataFrame, keys_each: int) -> DataFrame:
    """``(key, lead)`` of the keys that several nodes have, and the smallest of these.

    Each task first combines its own keys, so that a key of very many nodes is few rows. Nearly
    all other keys are alone and stay in the task's table, so the tasks are kept small.
    """
    return (
        table_keys(dealt(nodes, keys_each))
        .groupBy("key")
        .agg(F.min("node").alias("lead"), F.max("node").alias("last"))
        .where("lead < last")
        .select("key", "lead")
    )


def candidate_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, n, hashes)`` of the wanted nodes, made again from one text of each."""
    own = nodes.join(wanted, "node").select("node", "digest", "first_id")
    own = stored(own, "wanted")
    ids = own.select(F.col("first_id").alias("wanted_id")).distinct()
    if own.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                made = [shingles(t) for t in batch.column(0).slice(low, 256).to_pylist()]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digests, pa.binary()),
                        pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64())),
                    ],
                    names=["digest", "hashes"],
                )
        forget_words()

    texts = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
        .join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
        .select("text")
        .mapInArrow(run, "digest BINARY, hashes ARRAY<BIGINT>")
    )
    # Whole sets are dealt out and sorted once: equal ones go before they meet their nodes.
    texts = texts.repartition("digest").dropDuplicates(["digest"])
    sets = texts.join(own.select("node", "digest"), "digest")
    return stored(sets.select("node", F.size("hashes").cast("bigint").alias("n"), "hashes"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are alike enough."""
    sizes = sets.select("node", "n")
    fits = (
        pairs.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("n_u")), "u")
        .join(sizes.select(F.col("node").alias("v"), F.col("n").alias("n_v")), "v")
        .where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    )
    both = fits.join(
        sets.select(F.col("node").alias("v"), F.col("hashes").alias("h_v")), "v"
    ).join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("h_u")), "u")
    common = F.size(F.array_intersect("h_u", "h_v"))
    alike = both.withColumn("common", common).where(
        F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * percent
    )
    return alike.select("u", "v")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right``; values are distinct.

    Values that few sets hold are counted pair by pair of holders, frequent ones as products
    of 0/1 matrices, whichever is less work.
    """
    nl, nr = len(left), len(right)
    out = np.zeros(nl * nr, np.int64)
    if not nl or not nr:
        return out.reshape(nl, nr)
    lens = np.array([len(s) for s in (*left, *right)])
    owner = np.repeat(np.arange(nl + nr), lens)
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    on_left = np.bincount(place, weights=owner < nl, minlength=len(values)).astype(np.int64)
    on_right = np.bincount(place, minlength=len(values)) - on_left
    begins = np.concatenate([[0], np.cumsum(on_left + on_right)])[:-1]
    # Owners ascend within a value: those of the left come first.
    live = np.flatnonzero((on_left > 0) & (on_right > 0))
    few = on_left[live] * on_right[live] * 100 < nl * nr
    rare = live[few]
    shapes = on_left[rare] * (nr + 1) + on_right[rare]
    for shape in np.unique(shapes):
        own = rare[shapes == shape]
        p, q = int(on_left[own[0]]), int(on_right[own[0]])
        step = max(1, 2_000_000 // (p * q))
        for low in range(0, len(own), step):
            at = begins[own[low : low + step]]
            lefts = owner[at[:, None] + np.arange(p)]
            rights = owner[at[:, None] + p + np.arange(q)] - nl
            cells = (lefts[:, :, None] * nr + rights[:, None, :]).ravel()
            out += np.bincount(cells, minlength=nl * nr)
    out = out.reshape(nl, nr)
    often = live[~few]
    for low in range(0, len(often), 1024):
        part = often[low : low + 1024]
        x, y = np.zeros((nl, len(part)), np.float32), np.zeros((nr, len(part)), np.float32)
        for k, v in enumerate(part):
            at = begins[v]
            x[owner[at : at + on_left[v]], k] = 1
            y[owner[at + on_left[v] : at + on_left[v] + on_right[v]] - nl, k] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def joining_links(
    left: list[tuple], right: list[tuple], percent: int
) -> list[tuple[int, int]]:
    """Links that join components, of nodes ``(node, component, hashes)``; a forest of them."""
    common = common_counts([x[2] for x in left], [x[2] for x in right])
    n_left = np.array([len(x[2]) for x in left])[:, None]
    n_right = np.array([len(x[2]) for x in right])[None, :]
    c_left = np.array([x[1] for x in left])[:, None]
    c_right = np.array([x[1] for x in right])[None, :]
    alike = (common * 100 >= (n_left + n_right - common) * percent) & (c_left != c_right)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(alike)):
        a, b = root(left[i][1]), root(right[j][1])
        if a != b:
            parent[a] = b
            out.append((left[i][0], right[j][0]))
    return out


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within clusters, of members ``(node, cluster, component)``.

    Sizes are put into classes so that nodes two classes apart cannot be alike. A group
    compares a block of one class with a block of the same class and the one below; blocks
    are bounded by their hashes and their nodes, and each of the first meets each of the
    second in a group of its own.
    """
    importable(members.sparkSession)
    # A little wide, so that rounding never puts alike sizes two classes apart.
    width = math.log(100 / percent) * 1.001
    rows = members.join(sets, "node").withColumn(
        "class", F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    )
    totals = stored(
        rows.groupBy("cluster", "class").agg(F.sum("n").alias("hashes"), F.count("n").alias("nodes")),
        "totals",
    )
    below = totals.select(
        "cluster", (F.col("class") + 1).alias("class"),
        F.col("hashes").alias("below_hashes"), F.col("nodes").alias("below_nodes"),
    )
    zero = F.lit(0)

    def blocks(hashes, nodes):
        return F.greatest(
            F.ceil(hashes / BLOCK_HASHES), F.ceil(nodes / BLOCK_NODES), F.lit(1)
        ).cast("int")

    plan = totals.join(below, ["cluster", "class"], "left").select(
        "cluster",
        "class",
        blocks(F.col("hashes"), F.col("nodes")).alias("lefts"),
        blocks(
            F.col("hashes") + F.coalesce("below_hashes", zero),
            F.col("nodes") + F.coalesce("below_nodes", zero),
        ).alias("rights"),
    )
    plan = stored(plan, "blocks")
    above = plan.select("cluster", (F.col("class") - 1).alias("class"),
                        F.col("lefts").alias("above_lefts"), F.col("rights").alias("above_rights"))
    seated = rows.join(plan, ["cluster", "class"]).join(above, ["cluster", "class"], "left")
    mark = F.xxhash64("node")
    # Each seat: class of the group, number of its left and right block, and the side.
    as_left = F.transform(
        F.expr("sequence(0, rights - 1)"),
        lambda j: F.struct(
            F.col("class").alias("of"), F.pmod(mark, F.col("lefts")).cast("int").alias("i"),
            j.alias("j"), F.lit(True).alias("is_left"),
        ),
    )
    as_right = F.transform(
        F.expr("sequence(0, lefts - 1)"),
        lambda i: F.struct(
            F.col("class").alias("of"), i.alias("i"),
            F.pmod(mark, F.col("rights")).cast("int").alias("j"), F.lit(False).alias("is_left"),
        ),
    )
    as_lower = F.transform(
        F.expr("sequence(0, above_lefts - 1)"),
        lambda i: F.struct(
            (F.col("class") + 1).alias("of"), i.alias("i"),
            F.pmod(mark, F.col("above_rights")).cast("int").alias("j"), F.lit(False).alias("is_left"),
        ),
    )
    none = F.filter(as_right, lambda s: F.lit(False))
    # One row carries both sides where a node is left and right of the same group.
    lone = (F.col("lefts") == 1) & (F.col("rights") == 1)
    own = F.when(lone, as_left).otherwise(F.concat(as_left, as_right))
    seats = F.concat(own, F.when(F.col("above_lefts").isNull(), none).otherwise(as_lower))
    dealt = seated.select(
        "cluster", "node", "component", "hashes", lone.alias("lone"), "class",
        F.explode(seats).alias("seat"),
    ).select(
        "cluster", "seat.of", "seat.i", "seat.j", "seat.is_left",
        (F.col("lone") & (F.col("seat.of") == F.col("class"))).alias("is_both"),
        "node", "component", "hashes",
    )

    def run(table_: pa.Table) -> pa.Table:
        left, right = [], []
        hashes = table_.column("hashes").combine_chunks()
        values = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
        ends = hashes.offsets.to_numpy()
        keys = [table_.column(c).to_pylist() for c in ("node", "component", "is_left", "is_both")]
        for k, (node, component, is_left, is_both) in enumerate(zip(*keys)):
            entry = (node, component, values[ends[k] : ends[k + 1]])
            if is_left or is_both:
                left.append(entry)
            if not is_left or is_both:
                right.append(entry)
        made = joining_links(left, right, percent)
        return pa.table(
            {
                "u": pa.array([u for u, _ in made], pa.int64()),
                "v": pa.array([v for _, v in made], pa.int64()),
            }
        )

    return dealt.groupBy("cluster", "of", "i", "j").applyInArrow(run, "u BIGINT, v BIGINT")


def linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, digest)`` of every row of ``docs``, and of every set
    ``(digest, first_id, component_id)``: the smallest doc_ids of its own and of all it
    reaches."""
    rows = stored(sketched(docs, percent), "sketched")
    nodes = stored(
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("a").alias("a"),
            F.first("b").alias("b"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    keys = table_keys(nodes)
    leads = stored(shared_keys(nodes, small_hashes_needed(percent) ** 2), "leads")
    members = stored(keys.join(leads, "key"), "members")
    sets = candidate_sets(docs, nodes, members.select("node").distinct())
    pairs = members.where("node <> lead").select(F.col("lead").alias("u"), F.col("node").alias("v"))
    first_links = stored(confirmed(pairs.distinct(), sets, percent), "links")
    first = stored(components(first_links), "components")
    # Keys with members in several components are open; the others are done.
    known = (
        members.join(first, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("key", "node", "lead", "component")
    )
    known = stored(known, "known")
    still = stored(
        known.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("key"),
        "open",
    )
    open_rows = stored(known.join(still, "key").drop("key").distinct(), "open_rows")
    clusters = components(open_rows.select(F.col("lead").alias("u"), F.col("node").alias("v")))
    placed = clusters.select("node", F.col("component").alias("cluster")).join(
        open_rows.select("node", "component").distinct(), "node"
    )
    more = stored(block_links(placed, sets, percent), "more_links")
    final = components(first_links.unionAll(more))
    named = nodes.join(final, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component"), "first_id"
    )
    named = stored(named, "named")
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    sets_ = stored(
        named.join(ids, "component").select("digest", "component", "first_id", "component_id"),
        "ids",
    )
    return rows, sets_


def near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    rows, sets = linked(docs, percent)
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        rows.join(sets.select("digest", "component_id"), "digest", "left")
        .withColumn("component_id", own)
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the digest of each text's set (null without words)."""
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)
    text_at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(text_at).to_pylist():
                own = shingles(text.encode() if text else None)
                made.append(
                    hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.binary())],
                names=[*batch.schema.names, name],
            )
        forget_words()

    return docs.mapInArrow(
        run, StructType([*docs.schema.fields, StructField(name, BinaryType())])
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words.

    The row kept has the component's smallest doc_id; of rows that are the same in id and
    set, any one. Only sets that lose a row meet the texts' digests in a join, broadcast if
    they are few.
    """
    rows, sets = linked(docs, percent)
    counts = rows.where("digest IS NOT NULL").groupBy("digest", "doc_id").agg(
        F.count(F.lit(1)).alias("times")
    )
    chosen = sets.groupBy("component").agg(
        F.min_by("digest", F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("best")
    )
    by_set = counts.groupBy("digest").agg(
        F.sum("times").alias("rows"), F.min_by("times", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("same")
    )
    decided = (
        sets.join(chosen, "component")
        .join(by_set, "digest")
        .select(
            "digest", (F.col("digest") == F.col("best")).alias("stays"), "first_id", "rows", "same"
        )
        .where("NOT stays OR rows > 1")
    )
    decided = stored(decided, "decided")
    name, keep = new_name(docs.columns, "digest"), new_name(docs.columns, "decision")
    few = decided.count() <= BROADCAST_IDS
    repeated = decided.where("stays AND same > 1").limit(1).count() > 0
    decided = decided.select(
        F.col("digest").alias(name),
        F.struct("stays", "first_id", (F.col("same") > 1).alias("again")).alias(keep),
    )
    met = with_digest(docs, name).join(F.broadcast(decided) if few else decided, name, "left")
    left = met.where(
        F.col(keep).isNull()
        | (F.col(f"{keep}.stays") & F.col("doc_id").eqNullSafe(F.col(f"{keep}.first_id")))
    )
    if repeated:  # rows that are the same in id and set: those few alone are shuffled
        again = F.coalesce(F.col(f"{keep}.again"), F.lit(False))
        left = left.where(~again).unionAll(left.where(again).dropDuplicates([name]))
    return left.select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of texts that share 85 % of their shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
