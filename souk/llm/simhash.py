"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Each segment is read as a 23-bit word of the
perfect Golay code: its keys are the nearest codeword and, when that is at distance 3, the five
codewords at distance 4. Two words at distance 2 or less always share a key (tests check every
case). Of the three segments, at least two hold 2 or fewer of up to 4 differing bits, so a join
on the keys of two segments meets every link; each meeting is verified by the bit distance.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import partitions, slices, store

SEGMENTS = ((0, 22), (22, 21), (43, 21))        # (shift, bits), each at most 23 bits
GENERATOR = 0b101011100011                      # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MAX_BITS = 4
KEY_ROWS = 85                                   # about so many keys a fingerprint
PART_ROWS = 1_000_000                           # a task makes and is dealt about so many key rows
KEYED = 1024                                    # fingerprints whose keys are made at a time
RUN = 64                                        # longer runs of a key are searched, not paired


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the ``words``-word shingles (repeats count) of text whose A-Z are lower case."""
    ws = text.split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(ws) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(42)),
                             np.uint64, len(ws) - words + 1)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(deltas, count) by syndrome: codeword indices relative to the received 12 bits."""

    def syndrome(x):
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    code = [m << 11 | syndrome(m << 11) for m in range(1 << 12)]
    light = [c for c in code if c.bit_count() == 7]
    deltas, count = np.zeros((1 << 11, 6), np.int64), np.ones(1 << 11, np.int64)
    for weight in range(4):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            s = syndrome(error)
            deltas[s, :] = error >> 11
            if weight == 3:
                near = [c for c in light if c & error == error]
                deltas[s, 1:], count[s] = [(error ^ c) >> 11 for c in near], 6
    return deltas, count


@lru_cache(maxsize=1)
def syndromes() -> np.ndarray:
    """Syndrome of every 23-bit word, made block by block: a worker holds the table and little more."""
    out = np.empty(1 << 23, np.int16)
    for at in range(0, 1 << 23, 1 << 17):
        x = np.arange(at, at + (1 << 17), dtype=np.int32)
        for i in range(22, 10, -1):
            x ^= (x >> i & 1) * np.int32(GENERATOR << (i - 11))
        out[at:at + (1 << 17)] = x
    return out


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (n, 6) codeword indices and how many of each row count."""
    deltas, count = golay()
    s = syndromes()[words]
    return (words >> 11)[:, None] ^ deltas[s], count[s]


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every pair of segments and every pair of their codeword indices."""
    parts = [segment_keys((fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    slot = np.arange(6)
    rows, keys = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        (a, na), (b, nb) = parts[i], parts[j]
        key = (np.int64(n) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        used = (slot[None, :, None] < na[:, None, None]) & (slot[None, None, :] < nb[:, None, None])
        rows.append(np.nonzero(used)[0])
        keys.append(key[used])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is reachable by ``bits`` or fewer among distinct fingerprints:
    each is linked to the one that first reaches it, so a group gives no more links than members."""
    left, right, rest = [], [], fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = np.bitwise_count(rest ^ one) <= bits
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), one))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(keys: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows of equal key: all pairs of short runs, a forest for long ones."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [fps[:0]], [fps[:0]]
    for a, n in zip(starts[sizes > RUN], sizes[sizes > RUN], strict=True):
        one, other = _forest(np.unique(fps[a:a + n]), bits)
        left.append(one)
        right.append(other)
    left_over = np.repeat(np.where(sizes > RUN, 0, starts + sizes), sizes) - np.arange(len(keys)) - 1
    at = np.arange(len(keys))
    for step in range(1, RUN):
        at = at[left_over[at] >= step]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= bits]
        left.append(fps[near])
        right.append(fps[near + step])
    left, right = np.concatenate(left), np.concatenate(right)
    low, high = np.minimum(left, right), np.maximum(left, right)
    pairs = np.unique(np.stack([low, high], axis=1)[low != high], axis=0)
    return pairs[:, 0], pairs[:, 1]


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` with the bigint column ``fp`` (the fingerprint's bits) in place of text."""
    others = [c for c in docs.columns if c != "text"]

    def hashed(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                fps = np.array([fingerprint((t or "").encode().translate(LOWER), words) for t in texts], np.uint64)
                yield pa.record_batch([*[part.column(c) for c in others], pa.array(fps.view(np.int64))], names=[*others, "fp"])

    schema = docs.select(*others).withColumn("fp", F.lit(0).cast("bigint")).schema
    return docs.mapInArrow(hashed, schema)


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b). Alternates
    large and small stars; each round is checkpointed, sums alone reach the driver."""

    def star(e, small):
        ends = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if not small:
            ends = ends.union(ends.select("v", "u"))
        low = ends.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        joined = ends.join(low, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        return out.where("a <> b").distinct()

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = None
    while True:
        edges = star(star(edges, small=False), small=True).checkpoint()
        now = state(edges)
        if now == before or not now[0]:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def key_rows(fps: DataFrame, parts: int) -> DataFrame:
    """(key, fp) of every row of ``fps``. There are about KEY_ROWS times as many, so the fingerprints are
    dealt to ``parts`` tasks first: their few bytes alone would ask for one or two. They are dealt by a
    hash of the column, since by the column itself they may lie dealt already, and be merged again."""

    def keyed(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(all_fps), KEYED):
                own = all_fps[at:at + KEYED]
                rows, keys = fingerprint_keys(own.view(np.uint64))
                yield pa.record_batch([pa.array(keys), pa.array(own[rows])], names=["key", "fp"])

    return fps.repartition(parts, F.xxhash64("fp")).mapInArrow(keyed, "key bigint, fp bigint")


def fingerprint_groups(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for every distinct fingerprint of the column ``fp``. Key rows are dealt to as many
    tasks as their number asks for, sorted there by Spark (which spills), and read run by run, so a
    task holds one batch and one run of equal keys."""
    if bits > MAX_BITS:
        raise ValueError(f"the keys find links of at most {MAX_BITS} bits")
    spark = fps.sparkSession
    distinct = fps.select("fp").distinct()

    def linked(batches):
        # Rows come sorted by key: a batch is cut before its last run, which may go on in the next.
        kept_keys, kept_fps = [], []

        def flush():
            a, b = links(np.concatenate(kept_keys), np.concatenate(kept_fps).view(np.uint64), bits)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if kept_keys and (cut or kept_keys[-1][-1] != key[-1]):
                kept_keys.append(key[:cut])
                kept_fps.append(fp[:cut])
                yield flush()
                kept_keys, kept_fps = [key[cut:]], [fp[cut:]]
            elif cut:
                kept_keys, kept_fps = [key[:cut]], [fp[:cut]]
                yield flush()
                kept_keys, kept_fps = [key[cut:]], [fp[cut:]]
            else:
                kept_keys.append(key)
                kept_fps.append(fp)
        if kept_keys:
            yield flush()

    parts = max(partitions(spark), -(-distinct.count() * KEY_ROWS // PART_ROWS))
    keys = key_rows(distinct, parts).repartition(parts, "key").sortWithinPartitions("key")
    edges = store(keys.mapInArrow(linked, "a bigint, b bigint"), "links")
    roots = components(edges.distinct())
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that
    links of ``bits`` or fewer differing bits reach). Null and empty texts have the fingerprint
    zero; repeated rows stay; null ids are never the smallest, and a component of them alone has
    a null id. Other columns are not read."""
    hashed = store(with_fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    groups = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = store(groups.join(fingerprint_groups(hashed, bits).withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"))
                   .select(F.col("fp").alias("of"), "root", "least"), "groups")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("of", "root").join(named, "root").select("of", "component_id")
    return hashed.join(by_fp, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 4, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of repeated rows
    of it the first stored (null ids last)."""
    rows = store(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    hashed = store(with_fingerprints(rows.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")), words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = hashed.groupBy("fp").agg(first)
    rooted = groups.join(fingerprint_groups(hashed, bits).withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("kept"))
    return rows.join(kept, F.col("row") == F.col("kept"), "left_semi").select("doc.*")
