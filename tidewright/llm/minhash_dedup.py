"""Near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

1. One hash per shingle: its high part picks a bin, the least hash of a bin is the bin's value.
   Empty bins borrow the value of another bin, chosen by a hash of (bin, attempt) that is the same in every
   document, so that two documents' bins agree with the probability of their resemblance. Where all attempts meet empty bins
   (few shingles), a bin takes the shingle that is least by the bin's own hash.
2. Documents with equal shingle sets form a class; only its smallest id goes on.
3. ROWS bins make a band, each band's hash a bucket key. In every bucket with two or more classes, the smallest id is the hub
   and gets a candidate edge to each other member: a bucket of m members gives m - 1 edges.
4. Candidates are confirmed on the full shingle sets.
5. Stars alone would lose a link between two members that are both unlike their hub. In buckets whose members are then still in
   different components, the member with the largest share of shingles that more than COMMON of these documents have becomes a second hub.
6. What is then still in different components is settled by tiles. The members of all buckets with one second hub make a group. In a group, the members of its
   largest component and the others are dealt to slots of about TILE, and each slot of the others meets each slot: a task holds the shingles of two
   slots (those that occur in two of these documents or more, as no other can be in an overlap), counts all
   overlaps exactly, and reports a spanning forest of the links between components. So no pair that shares a bucket and could be alike stays untested, rows
   grow with members times slots, and results with members, not with pairs. Documents with too few shared shingles for any link are left out.

With 40 bands of 6 bins, a pair at a similarity of 0.8 shares no bucket with a probability of 5e-6, and less above.
Sets of few shingles are a little worse, as shingles may meet in a bin: 1 of 60,000 random pairs of 4 and 5 shingles with 4 in common was missed, 0 of 30,000 of 5 and 6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.components import components
from tidewright.llm.core import Scratch, Words, binary, col, mix, partitions, prepare, slices, text_blocks
from tidewright.llm.exchange import COUNTED, PACKED, repeated, send, split_answers, with_answers

BANDS, ROWS = 40, 6
#: Candidate edges of one hub that one confirming group takes at most.
STAR = 256
#: Documents that have a shingle which counts as common.
COMMON = 32
#: Members of one slot of a tile, and documents of a tile that have a shingle which is counted pair by pair; more are counted as a matrix.
TILE, FEW = 512, 8
#: Ids that are broadcast to pick texts (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def _probes(bins: int, attempts: int = 64) -> np.ndarray:
    """[attempt, bin]: where an empty bin looks for a value, the same in every document."""
    at = np.arange(attempts * bins, dtype=np.uint64).reshape(attempts, bins)
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def sketch(shingles: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """The bins' values of a sorted, non-empty set of shingle hashes."""
    top = np.uint64((1 << 64) // bins + 1)
    bin_of = (shingles // top).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    values, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    values[bin_of[first]], filled[bin_of[first]] = shingles[first], True
    donor = np.arange(bins)
    open_bins = np.flatnonzero(~filled)
    for row in probes:
        if not len(open_bins):
            break
        hit = filled[row[open_bins]]
        donor[open_bins[hit]] = row[open_bins[hit]]
        open_bins = open_bins[~hit]
    out = values[donor]
    if len(open_bins):  # no attempt met a filled bin, as in sets of few shingles: the shingle that is least by the bin's own hash
        own = mix(shingles ^ mix(open_bins.astype(np.uint64) + np.uint64(1 << 41))[:, None])
        out[open_bins] = shingles[own.argmin(axis=1)]
    return out


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes(bands * rows)
        salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows)
        tag = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 40))
        order = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            for part, data, offsets in slices(batch):
                n, one, two, keys = [], [], [], []
                for x in Words(data, offsets, lower=True).shingles(words):
                    n.append(len(x))
                    if not len(x):
                        one.append(0), two.append(0), keys.append([])
                        continue
                    if len(order) < len(x):
                        order = mix(np.arange(2 * len(x), dtype=np.uint64) + np.uint64(77))
                    one.append(int(mix(x + order[: len(x)]).sum().view(np.int64)))
                    two.append(int(mix(x ^ order[: len(x)]).sum().view(np.int64)))
                    values = sketch(x, bands * rows, probes).reshape(bands, rows)
                    keys.append(mix(mix(values ^ salt).sum(axis=1) ^ tag).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n", "set_a", "set_b", "bands"],
                )

    return run


def _confirm(words: int, percent: int):
    """From rows (hub, salt, role, id, text) in this order, hub's text (role 0) first: the members that are like their hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part, data, offsets in slices(batch):
                u, v = [], []
                columns = [part.column(i).to_pylist() for i in range(4)]
                for a, salt, role, b, x in zip(*columns, Words(data, offsets, lower=True).shingles(words), strict=True):
                    if role == 0:
                        key, hub = (a, salt), x
                    elif key == (a, salt):
                        least, most = sorted((len(hub), len(x)))
                        if 100 * least >= percent * most:
                            both = np.concatenate((hub, x))
                            both.sort()
                            same = int((both[1:] == both[:-1]).sum())
                            if 100 * same >= percent * (len(both) - same):
                                u.append(b), v.append(a)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def pick(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose id is in ids (a table with that column alone, distinct)."""
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) of those pairs (hub, id) whose shingle sets are alike, kept as a table. A hub's members are dealt to groups of about STAR."""
    groups = scratch.keep(pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("groups")), f"{name}-groups")
    members = pairs.join(groups, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("salt"), F.lit(1).alias("role"), "id")
    hubs = groups.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("id"))
    roles = scratch.keep(members.unionByName(hubs), f"{name}-roles")
    rows = roles.join(pick(texts, roles.select("id").distinct()), "id").select("hub", "salt", "role", "id", "text")
    n = partitions(pairs.sparkSession)
    found = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInArrow(_confirm(words, percent), "u long, v long")
    found = scratch.keep(found, name)
    scratch.drop(f"{name}-roles", f"{name}-groups")
    return found


def _send_shingles(words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from send(((batch.column(0)[0].as_py(), x) for batch in batches for _, data, offsets in slices(batch) for x in Words(data, offsets, lower=True).shingles(words)), buckets)

    return run


def _profiles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for _, answers, texts in split_answers(batches):
            if texts is None:
                known = None
                continue
            if known is None:
                known = np.sort(np.frombuffer(b"".join(answers), COUNTED), order="hash")
            for part, data, offsets in slices(texts):
                common, shared = [], []
                for x in Words(data, offsets, lower=True).shingles(words):
                    at = np.minimum(np.searchsorted(known["hash"], x), max(len(known) - 1, 0))
                    here = known["hash"][at] == x if len(known) else np.zeros(len(x), bool)
                    many = here & (known["many"][at] > 0) if len(known) else here
                    common.append(int(many.sum()))
                    shared.append(x[here].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array(common, pa.int64()), binary(shared)], ["id", "common", "shared"])

    return run


def profiles(texts: DataFrame, words: int) -> DataFrame:
    """id, common (number of shingles that more than COMMON of these texts have) and shared (the hashes of those that two or more have, 8 bytes each)."""
    n = partitions(prepare(texts.sparkSession))
    blocks = text_blocks(texts, "id", "text", n)
    answers = repeated(blocks.repartitionById(n, F.col("block")).mapInArrow(_send_shingles(words, n), PACKED), n, COMMON)
    return with_answers(blocks, answers, n, "binary").mapInArrow(_profiles(words), "id long, common long, shared binary")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """[i, j]: how many hashes two sets share, for i < j (elsewhere the entries mean nothing)."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    hashes, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(hashes, kind="stable")  # documents ascend among equal hashes
    hashes, doc = hashes[order], doc[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    times = np.diff(np.r_[first, len(hashes)])
    within = np.repeat(times, times)
    few, pairs = doc[within <= FEW], hashes[within <= FEW]
    for apart in range(1, FEW):
        same = np.flatnonzero(pairs[apart:] == pairs[:-apart])
        np.add.at(out, (few[same], few[same + apart]), 1)
    many, shingle = doc[within > FEW], np.repeat(np.arange(len(first)), times)[within > FEW]
    at = np.unique(shingle, return_inverse=True)[1]
    for begin in range(0, int(at.max(initial=-1)) + 1, 4096):
        these = (at >= begin) & (at < begin + 4096)
        held = np.zeros((n, 4096), np.float32)
        held[many[these], at[these] - begin] = 1
        out += held @ held.T
    return out


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what a symmetric matrix connects, one fewer than the nodes of each part."""
    open_ = np.ones(len(linked), bool)
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not open_[start]:
            continue
        open_[start], stack = False, [start]
        while stack:
            node = stack.pop()
            found = np.flatnonzero(linked[node] & open_)
            open_[found] = False
            for other in found.tolist():
                yield node, other
                stack.append(other)


def _tile(percent: int):
    """From rows (hub, a, b, slot, id, n, component, shared) by tile (hub, a, b): links between members of slots a and b in different components."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        slot, ids, n, component = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        size = n.astype(np.float32)
        same = np.triu(_overlaps([r[4] for r in rows]), 1)
        linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
        linked &= np.triu(component[:, None] != component[None, :], 1)
        if len(np.unique(slot)) > 1:  # pairs within a slot are another tile's
            linked &= slot[:, None] != slot[None, :]
        linked |= linked.T
        found = list(_forest(linked))
        return [int(ids[i]) for i, _ in found], [int(ids[j]) for _, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*columns, batch.column(7), strict=True):
                if row[:3] != key:
                    if len(held) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], ["u", "v"])
                    key, held = row[:3], []
                held.append((*row[3:7], np.frombuffer(row[7].as_buffer(), np.uint64).copy()))
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(held)], ["u", "v"])

    return run


def _tiled(members: DataFrame, known: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between the members (hub, id, n, component; distinct) of a hub's group that are in different components, connecting all that are connected."""
    counts = scratch.keep(members.groupBy("hub", "component").agg(F.count("*").alias("m")), "tile-counts")
    largest = counts.groupBy("hub").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"))
    slots = largest.select("hub", F.col("top.component").alias("largest"), F.ceil((F.col("m") - F.col("top.m")) / TILE).cast("int").alias("outer"), F.ceil(F.col("top.m") / TILE).cast("int").alias("inner"))
    slots = scratch.keep(slots.filter("outer > 0"), "tile-slots")
    rows = members.join(slots, "hub").withColumn("at", F.xxhash64("id", "hub"))
    slot = F.when(F.col("component") == F.col("largest"), F.col("outer") + F.pmod("at", "inner")).otherwise(F.pmod("at", "outer")).cast("int")
    rows = rows.withColumn("slot", slot)
    others = F.sequence(F.lit(0), F.when(F.col("slot") < F.col("outer"), F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.select("hub", F.least("slot", "other").alias("a"), F.greatest("slot", "other").alias("b"), "slot", "id", "n", "component")
    rows = rows.join(known.select("id", "shared"), "id").select("hub", "a", "b", "slot", "id", "n", "component", "shared")
    n = partitions(members.sparkSession)
    dealt = rows.repartition(n, "hub", "a", "b").sortWithinPartitions("hub", "a", "b")
    return scratch.keep(dealt.mapInArrow(_tile(percent), "u long, v long"), "tile-links")


def _unsettled(buckets: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """key, id, n, component of the buckets whose members are in different components."""
    own = buckets.select("key", "id", "n").join(labels.withColumnRenamed("u", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return scratch.keep(own.join(scratch.keep(split, f"{name}-keys"), "key"), name)


def _links(buckets: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """component of every id that has a confirmed link and isn't the smallest of its component, as (u, component)."""
    near_size = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    stars = buckets.filter("id <> hub").select("hub", "id", "n").distinct().join(sizes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n")), "hub")
    tested = scratch.keep(stars.filter(near_size).select("hub", "id"), "stars")
    labels = components(confirm(tested, texts, words, percent, scratch, "links"), scratch, "first")

    own = _unsettled(buckets, labels, scratch, "unsettled")
    ids = scratch.keep(own.select("id").distinct(), "unsettled-ids")
    if ids.isEmpty():
        return labels
    known = profiles(pick(texts, ids), words).dropDuplicates(["id"]).join(own.select("id", "n").distinct(), "id")
    known = scratch.keep(known.filter(f"100 * length(shared) / 8 >= {percent} * n"), "profiles")
    own = own.join(known.select("id", "common"), "id")
    center = F.max(F.struct((F.col("common") / F.col("n")).alias("share"), (-F.col("id")).alias("id"), F.col("n").alias("hub_n"), F.col("component").alias("hub_component"))).alias("top")
    centers = scratch.keep(own.groupBy("key").agg(center).select("key", (-F.col("top.id")).alias("hub"), "top.hub_n", "top.hub_component"), "centers")
    second = own.join(centers, "key").filter("id <> hub and component <> hub_component").filter(near_size).select("hub", "id").distinct()
    both = tested.unionByName(tested.select(F.col("id").alias("hub"), F.col("hub").alias("id")))
    second = scratch.keep(second.join(both, ["hub", "id"], "left_anti"), "second-stars")
    if not second.isEmpty():
        more = confirm(second, texts, words, percent, scratch, "second-links")
        labels = components(labels.withColumnRenamed("component", "v").unionByName(more), scratch, "second")

    own = _unsettled(buckets, labels, scratch, "still-unsettled").join(known.select("id"), "id", "left_semi")
    members = scratch.keep(own.join(centers.select("key", "hub"), "key").select("hub", "id", "n", "component").distinct(), "members")
    more = _tiled(members, known, percent, scratch)
    if not more.isEmpty():
        labels = components(labels.withColumnRenamed("component", "v").unionByName(more), scratch, "third")
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id = component_id), per row of docs.

    Words are runs of bytes other than space and tab to carriage return, A-Z in lower case. A document's set has its distinct
    shingles of `words` words; all words are one shingle where there are fewer. Documents are linked if the
    intersection has at least percent / 100 of the union. Null, empty and blank texts have an empty set and no links. Rows with an id of null keep
    it, with neither links nor a component (kept is null). Rows that share an id must share the text; they give equal rows.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    sketches = scratch.keep(texts.mapInArrow(_sketches(words, bands, rows), "id long, n long, set_a long, set_b long, bands array<long>"), "sketches")
    classes = sketches.filter("n > 0 and id is not null").groupBy("n", "set_a", "set_b").agg(F.min("id").alias("rep"))
    classes = scratch.keep(classes, "classes")
    sizes = classes.select(F.col("rep").alias("id"), "n")
    reps = sketches.join(sizes.select("id"), "id").select("id", "n", "bands").dropDuplicates(["id"])
    bucketed = reps.select("id", "n", F.explode("bands").alias("key"))
    hubs = scratch.keep(bucketed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last").select("key", "hub"), "hubs")
    buckets = scratch.keep(bucketed.join(hubs.hint("merge"), "key").select("key", "hub", "id", "n"), "buckets")
    scratch.drop("hubs")
    labels = _links(buckets, sizes, texts.filter("id is not null"), words, percent, scratch)
    scratch.drop("buckets", "unsettled", "unsettled-keys", "unsettled-ids", "profiles", "centers", "still-unsettled", "still-unsettled-keys", "members", "tile-counts", "tile-slots", "stars", "second-stars")

    out = sketches.select("id", "n", "set_a", "set_b").join(classes, ["n", "set_a", "set_b"], "left")
    out = out.join(labels.withColumnRenamed("u", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near duplicates the one with the smallest id.

    Rows with an id of null stay. Of repeated rows with one id, all stay or none.
    """
    found = near_duplicates(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text", words, percent)
    gone = found.filter("not kept").select("id").distinct()
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select(*[col(c, "row").alias(c) for c in docs.columns])
