"""MinHash near-dedup with b-bit signatures.

Documents are sets of five-word shingles. A signature has 128 minima; candidates share all four minima of
one of 32 bands (a pair of similarity 0.75 is missed with probability 5e-6). What is kept of a signature
for the comparison is the lowest two bits of each minimum, packed into four 64-bit integers: agreement is
counted with bit operations and corrected for chance collisions, (agreement - 1/4) / (1 - 1/4). Candidates
whose estimate is five standard deviations below the threshold go; the rest is confirmed on full sets.

Only what components need is compared: documents with one set form one class; in a band's bucket each class is
first compared with the hub; then, for buckets that still hold several components, across them. Large buckets
are split into pairs of blocks; groups and blocks are bounded in documents and in shingles, and sets leave a task
in batches of `BATCH` bytes, so memory depends neither on a bucket's size nor on the documents' lengths (but the longest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, materialise, release, small_batches
from .textbatch import Words, chunks, digests, mix, ngram_hashes, utf8

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 2
BATCH = 2 << 20  # bytes of sets in one Arrow batch
GROUP = 1 << 18  # shingles that are compared with one hub, or that a block holds, at a time
_RNG = np.random.default_rng(7411)
_XOR = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the distinct shingles of document i are hashes[edges[i]:edges[i + 1]], sorted."""
    words = Words(data, offsets, lower=True)
    symbols = words.hashes()
    count = np.diff(words.first)
    full = np.maximum(count - shingle + 1, 0)
    doc = np.repeat(np.arange(len(count)), full)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(words.first[:-1], full)
    value = ngram_hashes(symbols, shingle)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < shingle))
    if len(few):
        doc = np.concatenate([doc, few])
        value = np.concatenate([value, digests(symbols[i:j].tobytes() for i, j in zip(words.first[few], words.first[few + 1]))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(count) + 1))


def set_digests(value: np.ndarray, start: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of each set of shingles, which begin at `start`."""
    return np.add.reduceat(mix(value ^ np.uint64(salt)), start).view(np.int64) if len(start) else np.zeros(0, np.int64)


def signatures(value: np.ndarray, edges: np.ndarray):
    """For each non-empty set: row, 128-bit digest, packed low bits (n x 4) and band keys (n x 32)."""
    size = np.diff(edges)
    rows = np.flatnonzero(size)
    start = edges[:-1][rows]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return rows, none, none, none.reshape(0, 4), none.reshape(0, BANDS)
    low, high = set_digests(value, start), set_digests(value, start, 0x9E3779B97F4A7C15)
    x = (value >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS * ROWS, len(rows)), np.uint32)
    for j in range(BANDS * ROWS):
        h = (x ^ _XOR[j]) * _MUL[j]
        h ^= h >> np.uint32(15)
        least[j] = np.minimum.reduceat(h, start)
    per = 64 // BITS
    packed = np.zeros((len(rows), BANDS * ROWS // per), np.uint64)
    for j in range(BANDS * ROWS):
        packed[:, j // per] |= (least[j] & np.uint32(2**BITS - 1)).astype(np.uint64) << np.uint64(BITS * (j % per))
    keys = np.empty((len(rows), BANDS), np.uint64)
    for band in range(BANDS):
        k = np.full(len(rows), np.uint64(band + 1))
        for j in range(band * ROWS, band * ROWS + ROWS):
            k = mix(k * np.uint64(0x100000001B3) + least[j])
        keys[:, band] = k
    return rows, low, high, packed.view(np.int64), keys.view(np.int64)


def _sign(shingle: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                value, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                size = np.diff(edges)
                rows, low, high, packed, keys = signatures(value, edges)
                n = j - i
                full = [np.zeros(n, np.int64) for _ in range(2)]
                full[0][rows], full[1][rows] = low, high
                bits = np.zeros((n, packed.shape[1]), np.int64)
                bits[rows] = packed
                bands, marks = [None] * n, [None] * n
                for r, k in zip(rows.tolist(), keys):
                    bands[r], marks[r] = k, k.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array(size), pa.array(full[0]), pa.array(full[1]), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["doc_id", "n_shingles", "low", "high", "s0", "s1", "s2", "s3", "bands", "marks"])

    return run


SIGNED = "doc_id long, n_shingles long, low long, high long, s0 long, s1 long, s2 long, s3 long, bands array<long>, marks binary"


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing minima of packed signatures, row by row."""
    x = a ^ b
    x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return BANDS * ROWS - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _least_agreement(percent: int) -> float:
    """Five standard deviations under what is expected at the threshold, chance collisions included."""
    n, p = BANDS * ROWS, percent / 100 + (1 - percent / 100) / 2**BITS
    return n * (p - 5 * (p * (1 - p) / n) ** 0.5)


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate and sizes do not rule them out, with a's number of shingles."""
    bits = [f"s{k}" for k in range(4)]
    one = signed.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"x{c}") for c in bits), F.col("n_shingles").alias("na"))
    two = signed.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"y{c}") for c in bits), F.col("n_shingles").alias("nb"))
    differ = " + ".join(f"bit_count(((x{c} ^ y{c}) | shiftrightunsigned(x{c} ^ y{c}, 1)) & 6148914691236517205L)" for c in bits)
    size = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    return pairs.join(one, "a").join(two, "b").filter(f"{size} AND {BANDS * ROWS} - ({differ}) >= {_least_agreement(percent)}").select("a", "b", "na")


def _open_pairs(percent: int, n, comp, side, sig, marks, bucket: int, split: bool):
    """For each row, which later rows it must still be compared with: likely similar, of another component, and
    not met in an earlier band's bucket. Yields (row, rows).

    marks: the lower halves of the 32 band keys. That a pair is taken for met because halves agree by chance has
    probability 7e-9, far less than that it shares no band.
    """
    least, band = _least_agreement(percent), int(np.flatnonzero(marks[0] == np.uint32(bucket & 0xFFFFFFFF))[0])
    for i in range(len(n)):
        ok = comp[i + 1 :] != comp[i]
        if split:
            ok &= side[i + 1 :] != side[i]
        j = i + 1 + np.flatnonzero(ok)
        if len(j):
            j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
            j = j[_agreement(sig[j], sig[i]) >= least]
            j = j[~(marks[j, :band] == marks[i, :band]).any(axis=1)]
            if len(j):
                yield i, j


def _block(table: pa.Table):
    table = table.sort_by("doc_id")
    n, comp, side = (table.column(c).to_numpy() for c in ("n_shingles", "component", "side"))
    sig = np.stack([table.column(f"s{k}").to_numpy() for k in range(4)], axis=1).view(np.uint64)
    marks = utf8(table.column("marks"))[0].view("<u4").reshape(-1, BANDS)
    bucket, lo, hi = (table.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
    return table, (n, comp, side, sig, marks, bucket, lo != hi)


def _involved(percent: int):
    """The documents of a block pair that have something to be compared with."""

    def run(table: pa.Table) -> pa.Table:
        table, args = _block(table)
        hit = np.zeros(table.num_rows, bool)
        for i, j in _open_pairs(percent, *args):
            hit[i] = True
            hit[j] = True
        return table.select(["doc_id", "bucket", "lo", "hi", "side", "component"]).filter(pa.array(hit))

    return run


def _members(table: pa.Table):
    """Row -> its set (sorted shingle hashes), read from the table's own buffers."""
    data, offsets = utf8(table.column("members"))
    return lambda r: data[offsets[r] : offsets[r + 1]].view("<u8")


def _common(one: np.ndarray, two: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(one) > len(two):
        one, two = two, one
    return int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())


def _settled(percent: int):
    """Links of a block pair: open pairs compared on full sets, unless they have become connected."""

    def run(table: pa.Table) -> pa.Table:
        table, args = _block(table)
        ids, size, comp, members = table.column("doc_id").to_pylist(), args[0], args[1].copy(), _members(table)
        open_pairs = [(i, j) for i, j in _open_pairs(percent, *args)]
        found = []
        for i, j in open_pairs:
            own = members(i)
            for k in j.tolist():
                if comp[k] == comp[i]:  # connected meanwhile
                    continue
                both = _common(own, members(k))
                if 100 * both >= percent * (size[i] + size[k] - both):
                    found.append((ids[i], ids[k]))
                    comp[comp == comp[k]] = comp[i]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _sets(shingle: int, schema: pa.Schema):
    """A row for each group that needs the set: the group's fields, then doc_id (of the set) and members.

    Of several texts with one identifier, only the one whose set's digest is `low` is meant.
    """

    def run(batches):
        for batch in batches:
            groups = batch.column("groups")
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                value, edges = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shingle)
                own = groups.slice(i, j - i)
                meant = np.zeros(j - i, bool)
                rows = np.flatnonzero(np.diff(edges))
                meant[rows] = set_digests(value, edges[rows]) == batch.column("low").slice(i, j - i).to_numpy()[rows]
                at = np.repeat(np.arange(j - i), own.value_lengths().to_numpy(zero_copy_only=False))
                flat, docs = own.flatten().filter(pa.array(meant[at])), batch.column("doc_id").slice(i, j - i)
                at = at[meant[at]]
                volume = np.cumsum(8 * (edges[at + 1] - edges[at])) // BATCH
                cuts = [0, *(np.flatnonzero(np.diff(volume)) + 1).tolist(), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    members = pa.array([value[edges[r] : edges[r + 1]].tobytes() for r in at[a:b]], pa.binary())
                    arrays = [flat.field(f.name).slice(a, b - a) for f in list(schema)[:-2]] + [docs.take(pa.array(at[a:b])), members]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


PAIRED = pa.schema([("b", pa.int64()), ("salt", pa.int32()), ("doc", pa.int64()), ("members", pa.binary())])
BLOCKED = pa.schema([("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("side", pa.int32()), ("component", pa.int64()), ("n_shingles", pa.int64()), *((f"s{k}", pa.int64()) for k in range(4)), ("marks", pa.binary()), ("doc_id", pa.int64()), ("members", pa.binary())])
BLOCKED_DDL = "bucket long, lo int, hi int, side int, component long, n_shingles long, s0 long, s1 long, s2 long, s3 long, marks binary, doc_id long, members binary"


def _linked(percent: int):
    def run(table: pa.Table) -> pa.Table:
        b, found = table.column("b")[0].as_py(), []
        docs, members = table.column("doc").to_pylist(), _members(table)
        hub = members(docs.index(b))
        for r, doc in enumerate(docs):
            if doc != b:
                x = members(r)
                both = _common(x, hub)
                if 100 * both >= percent * (len(x) + len(hub) - both):
                    found.append(doc)
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([b] * len(found), pa.int64())})

    return run


def _sets_of(docs: DataFrame, needs: DataFrame, heads: DataFrame, kernel, ddl: str) -> DataFrame:
    """The sets that `needs` (doc_id, part, groups) asks for, made again from the texts of docs (id, text)."""
    asked = needs.join(heads.select("doc_id", "text_id", "low"), "doc_id")
    return docs.withColumnRenamed("doc_id", "text_id").join(asked.hint("shuffle_merge"), "text_id").select("doc_id", "low", "text", "groups").mapInArrow(kernel, ddl)


def _confirmed(pairs: DataFrame, docs: DataFrame, heads: DataFrame, percent: int, shingle: int, group: int = 256) -> DataFrame:
    """Those pairs (a, b, na), materialised, whose full sets are similar enough.

    Pairs are grouped by b, at most about `group` pairs and `GROUP` shingles to a task's group; a document's set travels
    once to each group that needs it, and a hub's text is read again for each 64 of its groups, so that no row holds a
    list that grows with the corpus. The join with the texts is a sort-merge join on purpose: what it selects grows
    with the corpus, and it should not turn into a broadcast on small inputs.
    """
    salts = pairs.groupBy("b").agg(F.ceil(F.greatest(F.count("*") / group, F.sum("na") / GROUP)).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").withColumn("salt", F.expr("CAST(pmod(xxhash64(a), salts) AS INT)")).select("a", "b", "salt")
    needs = dealt.select(F.col("a").alias("doc_id"), "b", "salt", F.lit(0).alias("part")).union(dealt.select(F.col("b").alias("doc_id"), "b", "salt", F.expr("salt DIV 64").cast("int")).distinct())
    needs = needs.groupBy("doc_id", "part").agg(F.collect_list(F.struct("b", "salt")).alias("groups")).drop("part")
    sets = _sets_of(docs, needs, heads, _sets(shingle, PAIRED), "b long, salt int, doc long, members binary")
    return materialise(sets.groupBy("b", "salt").applyInArrow(_linked(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are ignored).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document's set is its distinct shingles of `shingle`
    words, or the whole word sequence if it has fewer. Documents are linked if 100 * intersection >= percent
    * union; component_id is the smallest doc_id reachable. Null, empty and blank texts have an empty set and
    are linked with nothing. Rows that repeat a doc_id count as one document if their texts agree; if they differ, each
    is compared by its own text, and its component_id says which documents that text is linked with. A row
    without doc_id takes no part and returns with nulls, kept. Empty in, empty out.
    """
    return _grouped(docs, percent, shingle, block).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int, shingle: int, block: int = 512) -> DataFrame:
    """near_duplicates with the digests of each row's set, low and high."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nameless = docs.filter("doc_id IS NULL").select("doc_id", F.lit(True).alias("kept"))
    docs = docs.filter("doc_id IS NOT NULL")
    signed = materialise(docs.mapInArrow(_sign(shingle), SIGNED), "signed", scan=True)
    key = ["low", "high", "n_shingles"]
    traits = ["n_shingles", "s0", "s1", "s2", "s3", "marks"]
    # a class is the rows with one set; it gets a number (doc_id from here on) and is found again by its least identifier, text_id
    classes = signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("text_id"))
    heads = signed.withColumnRenamed("doc_id", "text_id").join(classes, [*key, "text_id"])
    heads = heads.groupBy("text_id", *key).agg(F.min(F.struct(*traits[1:], "bands")).alias("r"))
    heads = heads.select(F.monotonically_increasing_id().alias("doc_id"), "text_id", *key, *(f"r.{c}" for c in traits[1:]), "r.bands")
    heads = materialise(heads, "heads", light=True)
    spread = heads.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    crowd = spread.groupBy("bucket", F.shiftright("bucket", 63).alias("z")).agg(F.count("*").alias("n")).filter("n > 1").drop("z")
    shared = materialise(spread.join(crowd, "bucket"), "shared", light=True)
    release(spark)
    # a bucket's hub is the document with most neighbours: the source of a group of copies is nearer to
    # each than they are to one another
    degree = shared.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = shared.join(degree, "doc_id").select("bucket", "doc_id", F.struct(F.col("degree"), (-F.col("doc_id")).alias("minus")).alias("rank"))
    hubs = ranked.groupBy("bucket", F.shiftright("bucket", 63).alias("z")).agg((-F.max("rank")["minus"]).alias("hub")).drop("z")
    first = shared.join(hubs, "bucket").filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    first = materialise(_likely(first, heads, percent), "first", light=True)
    links = _confirmed(first, docs, heads, percent, shingle)
    found = connected_components(links)
    discard(first)
    release(spark)
    # what is left: pairs across components that share a bucket, in blocks of buckets
    label = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    mixed = label.groupBy("bucket", F.shiftright("bucket", 63).alias("z")).agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), F.sum("n_shingles").alias("volume")).filter("c0 < c1")
    mixed = mixed.select("bucket", F.ceil(F.greatest(F.col("n") / block, F.col("volume") / GROUP)).cast("int").alias("blocks"))
    part = label.join(mixed, "bucket").withColumn("side", F.expr("CAST(pmod(xxhash64(doc_id), blocks) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    part = part.select("doc_id", "bucket", "component", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    part = part.join(heads.select("doc_id", *traits), "doc_id")
    part_of = needs = materialise(part.groupBy("bucket", "lo", "hi").applyInArrow(_involved(percent), "doc_id long, bucket long, lo int, hi int, side int, component long"), "needs")
    if not needs.isEmpty():
        # with these, every candidate pair has been compared or lies inside one component
        needs = needs.join(heads.select("doc_id", *traits), "doc_id").groupBy("doc_id", F.expr("if(side = lo, hi, lo) DIV 4").alias("part"))
        needs = needs.agg(F.collect_list(F.struct("bucket", "lo", "hi", "side", "component", *traits)).alias("groups")).drop("part")
        sets = _sets_of(docs, needs, heads, _sets(shingle, BLOCKED), BLOCKED_DDL)
        more = materialise(sets.groupBy("bucket", "lo", "hi").applyInArrow(_settled(percent), "a long, b long"), "links")
        if not more.isEmpty():
            found = connected_components(links.union(more))
        discard(more)
    discard(links, part_of, shared)
    release(spark)
    named = heads.select("doc_id", "text_id", *key).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    least = named.filter("component IS NOT NULL").groupBy("component", F.shiftright("component", 63).alias("z")).agg(F.min("text_id").alias("least")).drop("z")
    groups = named.join(least, "component", "left").select(*key, F.coalesce("least", "text_id").alias("component"))
    out = signed.select("doc_id", *key).join(groups, key, "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", "low", "high", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(nameless, allowMissingColumns=True)


def minhash_dedup(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns.

    Exactly the rows go that `near_duplicates` marks as not kept: where a doc_id stands before several texts, each row is
    judged by its own. Rows that repeat the doc_id and text of one that stays do too.
    """
    rows = materialise(_grouped(docs, percent, shingle), "near", light=True)
    dropped = rows.filter(~F.col("kept")).select(F.col("doc_id").alias("_near_id"), F.col("low").alias("_near_low"), F.col("high").alias("_near_high")).distinct()
    ids = dropped.select("_near_id").distinct()
    out = docs.join(ids, docs["doc_id"] == ids["_near_id"], "left_anti")
    both = materialise(ids.join(rows.filter("kept").select("doc_id"), F.col("_near_id") == F.col("doc_id"), "left_semi"), "both", light=True)
    if both.isEmpty():
        return out
    # few: rows whose doc_id has a text that stays and one that goes
    mixed = docs.join(both, docs["doc_id"] == both["_near_id"], "left_semi").withColumn("_near_row", F.monotonically_increasing_id())
    mixed = materialise(mixed, "mixed", light=True)
    keys = mixed.select(F.col("_near_row").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sign(shingle), SIGNED)
    keys = keys.select(F.col("doc_id").alias("_near_row"), F.col("low").alias("_own_low"), F.col("high").alias("_own_high"))
    goes = (F.col("doc_id") == F.col("_near_id")) & (F.col("_own_low") == F.col("_near_low")) & (F.col("_own_high") == F.col("_near_high"))
    return out.unionByName(mixed.join(keys, "_near_row").join(dropped, goes, "left_anti").select(docs.columns))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
