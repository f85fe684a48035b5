"""Near-duplicate documents by circulant MinHash, with links confirmed on the full shingle sets.

One permutation of the 64-bit integers spreads the shingles' hashes; a second one of the 32-bit integers,
shifted circularly by k, gives coordinate k of the signature, for all ``BANDS * ROWS`` coordinates. Two
documents are candidates if all ``ROWS`` coordinates of a band agree. At a similarity of 0.75 a pair misses
all 40 bands of 5 with a chance of 2e-5, at 0.8 of 1e-7.

Documents of one word sequence are one class, represented by its smallest id, before anything is compared.
Only components are wanted, so not every pair of a band's bucket is: first each member is compared with
the bucket's smallest id, then, where a bucket still holds several components, with another member of the
bucket's own, and at last all members that are not yet in one component. In buckets of up to ``LARGE``
members these are pairs; in larger ones members of different components meet in blocks inside tasks, and
only links come out. A near-copy group that is one component so costs about its size in comparisons, and no
link between different components of a bucket is lost.

Buckets are found from counts that are summed before the shuffle; joins on hot buckets or hubs
are left to be split by adaptive execution. Every round's tables are written to the shared folder.

Edge cases: documents without words have an empty set and stand alone; rows without an id take no part and
are kept, with a null component; rows that repeat a text or a row are copies of one another; rows with
one id and different texts count as linked, as one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.llm.common import free_name, id_and_text, run_folder, slices, stored, tidy
from caselink.llm.shingles import mix, sequence_shingles, word_sequence

PERCENT = 75
BANDS, ROWS = 40, 5
LARGE = 64
BLOCK = 256
_CELLS = 16_384
#: Shingles of documents that a task remembers while it confirms pairs, 16 MB of texts and sets or so.
REMEMBERED = 1_000_000


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of each set of 64-bit hashes; sets must not be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (j == i or held + len(sets[j]) <= _CELLS):
            held += len(sets[j])
            j += 1
        # The first permutation spreads, then the second one is shifted.
        spread = (mix(np.concatenate(sets[i:j])) >> np.uint64(32)).astype(np.uint32)
        begins = np.cumsum([0, *(len(s) for s in sets[i:j])])[:-1]
        value, high = np.empty_like(spread), np.empty_like(spread)
        for k in range(coordinates):
            np.add(spread, np.uint32(k), out=value)
            np.multiply(value, np.uint32(0x7FEB352D), out=value)
            np.right_shift(value, np.uint32(15), out=high)
            np.bitwise_xor(value, high, out=value)
            np.multiply(value, np.uint32(0x846CA68B), out=value)
            out[i:j, k] = np.minimum.reduceat(value, begins)
        i = j
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band of each signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the word sequence; null without words), n_shingles, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sequences = [word_sequence(t) for t in texts]
            first: dict[bytes, int] = {}
            which = [first.setdefault(s, len(first)) for s in sequences]
            distinct = list(first)
            sets = [sequence_shingles(s) for s in distinct]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(distinct), BANDS), np.int64)
            if some:
                keys[some] = band_keys(signatures([sets[i] for i in some]))
            empty = np.array([len(s) == 0 for s in sets])[which]
            bounds = pa.array(np.arange(0, BANDS * (len(texts) + 1), BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.md5(s).digest() if s else None for s in sequences], pa.binary()),
                    pa.array(np.array([len(s) for s in sets], np.int64)[which]),
                    pa.ListArray.from_arrays(bounds, pa.array(keys[which].ravel()), mask=pa.array(empty)),
                ],
                ["doc_id", "key", "n_shingles", "bands"],
            )

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, key binary, n_shingles long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share enough: 100 * intersection >= PERCENT * union."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[str, np.ndarray]] = {}
        held = 0

        def shingles(key: int, text: str) -> np.ndarray:
            # Documents of a group recur in many pairs; the sets met last are remembered.
            nonlocal held
            if key not in known or known[key][0] != text:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                known[key] = (text, sequence_shingles(word_sequence(text)))
                held += len(known[key][1])
            return known[key][1]

        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i in range(batch.num_rows):
                x = shingles(a[i], batch.column("text_a")[i].as_py())
                y = shingles(b[i], batch.column("text_b")[i].as_py())
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good[i] = 100 * shared >= PERCENT * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long").distinct()


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """id, component (the smallest id reachable) of every node of ``links`` (a, b).

    Large and small stars in turn: each node's larger neighbours move to the smallest one it knows, then
    each node and its smaller neighbours do, until every component is one star.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), folder, f"{name}-0")
    before, step = None, 0
    while True:
        state = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if state == before or state[0] == 0:
            break
        before, step = state, step + 1
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(),
            folder,
            f"{name}-{step}",
        )
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _star_pairs(members: DataFrame, order: Column) -> DataFrame:
    """Pairs of each bucket's first member by ``order`` with its members of other components."""
    hub = members.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "id", "n", "component")).alias("hub"))
    near = members.join(hub, "bucket").filter((F.col("hub.component") != F.col("component")) & _alike(F.col("hub.n"), F.col("n")))
    return near.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _cross_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a bucket's members that are in different components; for buckets of bounded size."""
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, on & _alike(F.col("x.n"), F.col("y.n"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between different components within buckets of any size, found block by block.

    A bucket's largest component is one side, all others are the second one. Both are cut into blocks; each
    pair of blocks that may hold a link (not two of the first side) meets once, in one group of at most
    about ``2 * BLOCK`` documents, and only links come out of it.
    """
    largest = (
        members.groupBy("bucket", "component")
        .count()
        .groupBy("bucket")
        .agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n_all"))
    )
    cuts = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    sided = members.join(largest, "bucket").select(
        "bucket",
        "id",
        "component",
        (F.col("component") == F.col("main")).alias("is_main"),
        cuts(F.col("n_main")).alias("n_a"),
        cuts(F.col("n_all") - F.col("n_main")).alias("n_b"),
    )
    own = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("n_a")).otherwise(F.col("n_b"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    a_block, b_block = F.concat(F.lit("a"), F.col("own")), F.concat(F.lit("b"), F.col("own"))
    # Blocks of the first side are named a0, a1, ..., those of the second b0, b1, ...
    of_main = F.transform(upto(F.col("n_b")), lambda j: F.concat_ws("-", a_block, F.concat(F.lit("b"), j)))
    of_others = F.concat(
        F.transform(upto(F.col("n_a")), lambda i: F.concat_ws("-", F.concat(F.lit("a"), i), b_block)),
        F.transform(
            upto(F.col("n_b")),
            lambda j: F.concat_ws("-", F.concat(F.lit("b"), F.least(j, F.col("own"))), F.concat(F.lit("b"), F.greatest(j, F.col("own")))),
        ),
    )
    dealt = sided.withColumn("own", own).select(
        "bucket", "id", "component", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_others)).alias("block")
    )

    def compare(group: pa.Table) -> pa.Table:
        ids, component = group.column("id").to_numpy(), group.column("component").to_numpy()
        sets = [sequence_shingles(word_sequence(t.as_py())) for t in group.column("text")]
        size = np.array([len(s) for s in sets], np.int64)
        shared = shared_counts(sets)
        good = (100 * shared >= PERCENT * (size[:, None] + size[None] - shared)) & (component[:, None] < component[None])
        x, y = np.nonzero(good)
        return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    both = dealt.join(texts.select("id", "text"), "id").select("bucket", "block", "id", "component", "text")
    return both.groupBy("bucket", "block").applyInArrow(compare, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    several = count[which] > 1
    owner, which = owner[several], rank[which[several]]
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, int(which[-1]) + 1 if len(which) else 0, columns):
        a, b = np.searchsorted(which, [k, k + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[a:b], which[a:b] - k] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def duplicate_classes(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = stored(prepared(docs), folder, "prepared")
    known = rows.filter("key is not null and doc_id is not null")
    classes = stored(known.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), folder, "classes")
    # One row of each class: its representative's.
    nodes = known.join(classes.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("id")), "left_semi")
    nodes = nodes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands")
    bands = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    members = stored(bands.join(shared, "bucket").distinct(), folder, "members")

    involved = members.select("id").distinct()
    source = id_and_text(docs)
    texts = stored(source.join(involved, source["doc_id"] == involved["id"], "left_semi").withColumnRenamed("doc_id", "id"), folder, "texts")

    labels = None
    for step in range(3):
        labelled = (
            members.withColumn("component", F.col("id"))
            if labels is None
            else members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        )
        if step == 0:
            pairs = _star_pairs(labelled, F.col("id"))
        else:
            split = labelled.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b")
            open_ = stored(labelled.join(split.select("bucket"), "bucket"), folder, f"open-{step}")
            if open_.isEmpty():
                break
            if step == 2:
                sizes = open_.groupBy("bucket").count()
                few = open_.join(sizes.filter(F.col("count") <= LARGE).select("bucket"), "bucket", "left_semi")
                many = stored(open_.join(sizes.filter(F.col("count") > LARGE).select("bucket"), "bucket", "left_semi"), folder, "many")
            pairs = _star_pairs(open_, F.xxhash64("id", "bucket")) if step == 1 else _cross_pairs(few)
        pairs = stored(pairs, folder, f"pairs-{step}")
        links = confirmed(pairs, texts)
        if step == 2 and not many.isEmpty():
            links = links.unionByName(_block_links(many, texts)).distinct()
        elif pairs.isEmpty():
            # Hubs can be unlike all others in size while those are alike: the next round compares them.
            continue
        links = stored(links, folder, f"links-{step}")
        if labels is None:
            labels = stored(components(links, folder, "components-0"), folder, "labels-0")
        elif not links.isEmpty():
            # Links between components join them; only their labels take part.
            ends = links.join(labels.withColumnsRenamed({"id": "a", "component": "_a"}), "a", "left").join(
                labels.withColumnsRenamed({"id": "b", "component": "_b"}), "b", "left"
            )
            joined = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")), folder, f"components-{step}")
            joined = stored(joined.withColumnsRenamed({"id": "_old", "component": "_new"}), folder, f"joined-{step}")
            moved = labels.join(joined, labels["component"] == joined["_old"], "left").select("id", F.coalesce("_new", "component").alias("component"))
            labels = stored(
                moved.unionByName(joined.select(F.col("_old").alias("id"), F.col("_new").alias("component"))).groupBy("id").agg(F.min("component").alias("component")),
                folder,
                f"labels-{step}",
            )

    # Only classes of several rows, or of a component that begins elsewhere, say more than a row's own id.
    if labels is None:
        told = classes.filter("copies > 1").select(F.col("key").alias("_key"), F.col("id").alias("_component"))
    else:
        told = classes.join(labels, "id", "left").withColumn("_component", F.coalesce("component", "id"))
        told = told.filter((F.col("copies") > 1) | (F.col("_component") != F.col("id"))).select(F.col("key").alias("_key"), "_component")
    out = rows.select("doc_id", "key", "n_shingles").join(told, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return duplicate_classes(docs, run_folder(docs.sparkSession, "near_dup"))


def keep_one(docs: DataFrame, folder: str) -> DataFrame:
    """The rows of ``docs`` but for those that a smaller id stands for; columns unchanged."""
    name = free_name(docs, "_gone")
    gone = stored(duplicate_classes(docs, folder).filter("not kept").select(F.col("doc_id").alias(name)).distinct(), folder, "gone")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


SQL = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM runs x JOIN runs y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= {PERCENT} * (s.n + t.n - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""
