"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in a ring of three segments. Two fingerprints that differ in at most two bits have, by the
pigeonring principle, a segment from which every chain of consecutive segments stays within its share of the budget: the
segment itself differs in no bit (2/3 of a bit at most), it and the next in at most one (4/3 at most), all three in two.
The second condition is an equi-join key: for each of the 64 bits, the fingerprint's bits of the bit's segment without
that bit, and of the segment before it. Whoever shares such a key passes the chain of two; the full Hamming check follows.

Fingerprints with one key differ in one segment and one bit only, so a group of one key is bounded by construction and,
as a group of 43 equal bits, is small in practice. Of a group only a spanning forest of its links leaves the task, never
all pairs. Equal fingerprints are one vertex before any of this, so a large group of copies costs one row.

Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other fingerprint. Rows
that repeat a doc_id each get a row; a null doc_id never represents its fingerprint unless all its documents lack one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.shared import Store, per_text

SEED, WORDS = 42, 3
SEGMENTS = ((0, 22), (22, 43), (43, 64))
MAX_BITS = 2
#: Shingles counted at once, and fingerprints compared pair by pair; larger groups are linked through masks.
SHINGLES_AT_ONCE, PAIRWISE = 1 << 16, 512

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(WORDS))))) if len(words) >= WORDS else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        part = shingles[at : at + SHINGLES_AT_ONCE]
        h = np.fromiter(map(_hash, part), np.dtype("<u8"), len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def _chain_masks() -> np.ndarray:
    out = []
    for at, (lo, hi) in enumerate(SEGMENTS):
        before = SEGMENTS[at - 1]
        span = sum(1 << b for b in [*range(lo, hi), *range(*before)])
        out += [span & ~(1 << b) for b in range(lo, hi)]
    return np.array(out, np.uint64)


CHAINS = _chain_masks()


def _forest(fps: np.ndarray, reps: np.ndarray, bit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the group's links of at most two bits connect. fps: distinct, all of one key."""
    n = len(fps)
    if n <= PAIRWISE:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= MAX_BITS)
            if len(near):
                yield np.full(len(near), reps[i]), reps[i + 1 + near]
        return
    # who differs in at most two bits agrees once these two are cleared: equal masked values make a star
    free = [b for b in range(64) if not (int(CHAINS[bit]) >> b) & 1]
    masks = [(1 << x) | (1 << y) for k, x in enumerate(free) for y in free[k:]]
    for mask in masks:
        value = fps & ~np.uint64(mask)
        order = np.argsort(value, kind="stable")
        v = value[order]
        first = np.r_[True, v[1:] != v[:-1]]
        head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        yield reps[head[~first]], reps[order[~first]]


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links, those that join parts not joined before."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (r := root(x)) != (s := root(y)):
            up[max(r, s)] = min(r, s)
            kept.append(k)
    return a[kept], b[kept]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bit, key, fp, rep) sorted by key; a group may run over several batches."""
    held: tuple[np.ndarray, ...] | None = None

    def linked(bit, key, fp, rep) -> pa.RecordBatch | None:
        change = np.flatnonzero((bit[1:] != bit[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(bit)]
        size = ends - starts
        two = starts[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        out = [(rep[near], rep[near + 1])]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            if found := list(_forest(fp[s:e], rep[s:e], int(bit[s]))):
                out.append(_spanning(*(np.concatenate(x) for x in zip(*found))))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINKS) if len(a) else None

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        cols[2] = cols[2].view(np.uint64)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1]) + 1 if (cols[0] != cols[0][-1]).any() or (cols[1] != cols[1][-1]).any() else 0
        held = tuple(c[last:] for c in cols)
        if last and (made := linked(*(c[:last] for c in cols))) is not None:
            yield made
    if held is not None and (made := linked(*held)) is not None:
        yield made


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): one row per document."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])
    return docs.select(key, text).mapInArrow(per_text(text, [key], lambda t: (fingerprint(t),), schema), f"`{key}` long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bit", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])
    bits = np.arange(64, dtype=np.int32)
    for batch in batches:
        fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
        key = (fp.view(np.uint64)[:, None] & CHAINS[None, :]).view(np.int64)
        cols = np.tile(bits, len(fp)), key.ravel(), np.repeat(fp, 64), np.repeat(rep, 64)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", store: Store | None = None) -> DataFrame:
    """Per document: key, fingerprint (16 hex digits), component_id (smallest key linked with it through any others)."""
    store = store or Store(docs.sparkSession, "simhash")
    prints = store.put(fingerprints(docs, key, text), "prints")
    reps = store.put(prints.groupBy("fp").agg(F.min(key).alias("rep")), "reps")
    keyed = reps.where("rep IS NOT NULL").mapInArrow(_keys, "bit int, key long, fp long, rep long")
    # repartition by the chain key, so that whoever passes the same chain meets in one task
    met = keyed.repartition("bit", "key").sortWithinPartitions("bit", "key", "fp")
    links = met.mapInArrow(_links, "a long, b long")
    parts = connected_components(links, store)
    of = reps.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
