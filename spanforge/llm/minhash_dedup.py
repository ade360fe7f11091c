"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct word shingles; two documents are linked if their sets'
Jaccard similarity reaches the threshold.  A signature has CHUNKS x CHUNK_SYMBOLS
symbols of b = 16 bits.  By pigeonhole, of two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols some chunk differs in ERRORS at most; every choice of
ERRORS symbols to leave out of a chunk makes a key, so all such pairs share a key.  A pair
at similarity 0.8 shares one but for about one in 130 million, one at 0.85 but for one in
10^11.  What shares a key is only a candidate: every link is confirmed on full sets.

Groups are never paired off.  Equal sets collapse to their smallest doc_id first.  In a
key's bucket everybody is held against one leader; of the links so confirmed come
components; and only pairs of a bucket that are still in different components are then
compared with each other, which finds any link between different texts that the leaders
missed.  Buckets are summed up before the shuffle, and joins on them are ones that
adaptive execution can split.

Defined cases: a document without words, or with null text, has an empty set, is linked
with nothing and is its own component; one with fewer words than a shingle has its whole
sequence as the only shingle; rows that repeat a doc_id are one document, linked with
each other; a row without doc_id is linked with nothing, has a null component and is kept.
An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import IdFilter, Scratch, text_batches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CHUNKS, CHUNK_SYMBOLS, ERRORS = 14, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Candidates whose signatures differ in more symbols aren't held against each other: seven
#: standard deviations beyond what similarity 0.8 gives, which happens once in 10^9.
SPREAD = 7.0
BLOCK = 2048
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def most_differing(similarity: float) -> int:
    """Symbols in which the signatures of a pair at that similarity differ at the very most."""
    miss = 1 - similarity
    return min(SYMBOLS, int(np.ceil(SYMBOLS * miss + SPREAD * np.sqrt(SYMBOLS * miss * similarity))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes (two of them fall together once in 10^13 texts of thousands of words)."""
    raw = text.encode() if isinstance(text, str) else text or b""
    found = WORD.findall(raw.lower())  # of bytes, so only A-Z change
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(size, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        acc = _mixed(acc * _STEP + h[j : len(h) - size + 1 + j])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> bytes:
    """SYMBOLS symbols of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[at : at + BLOCK, None] * _A + _B).min(0), out=least)
    return (_mixed(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig): set_id is a 128-bit digest of the set, null if empty."""

    def run(batches):
        for batch in batches:
            n, set_id, sig = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                set_id.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(set_id, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "sig"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def bucket_keys(sig: Column) -> Column:
    """All keys of a signature: chunk by chunk, every choice of symbols to leave out."""
    keys = []
    for chunk in range(CHUNKS):
        for out in combinations(range(CHUNK_SYMBOLS), ERRORS):
            kept = [i for i in range(CHUNK_SYMBOLS) if i not in out]
            runs, first = [], kept[0]
            for a, b in zip(kept, [*kept[1:], None], strict=True):
                if b != a + 1:
                    runs.append((first, a))
                    first = b
            parts = [F.substring(sig, 1 + 2 * (chunk * CHUNK_SYMBOLS + a), 2 * (b - a + 1)) for a, b in runs]
            keys.append(F.xxhash64(F.lit(len(keys)), *parts))
    return F.array(*keys)


def _near(pairs: DataFrame, sigs: DataFrame, most: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures differ in `most` symbols at most."""
    left = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, SYMBOLS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x != y).sum(1) <= most, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of the documents asked for (id, set_id), as packed 64-bit hashes.

    Texts aren't shuffled: a Bloom filter picks those that may be asked for where they are read,
    and only their sets move, to the exact join.
    """
    picked = IdFilter(asked, "id")
    shared = picked.words
    named = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")
    ).filter("id IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            places = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            at = np.flatnonzero(IdFilter.hits(shared.value, places))
            packed = [shingle_set(batch.column(2)[int(i)].as_py(), size).tobytes() for i in at]
            columns = [batch.column(0).take(pa.array(at)), pa.array(map(xxhash.xxh3_128_digest, packed), pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "set_id", "shingles"])

    found = named.select("id", picked.probes(F.col("id")), "text").mapInArrow(run, "id long, set_id binary, shingles binary")
    return found.join(asked, ["id", "set_id"]).groupBy("id", "set_id").agg(F.first("shingles").alias("shingles")).select("id", "shingles")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked, confirmed on full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of all ends of the edges (a, b): the smallest id that each reaches.

    Every round takes the smallest label of the neighbours and then jumps to that label's
    own label; only the number of changed labels comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    step = 0
    while True:
        step += 1
        other = labels.select(F.col("id").alias("b"), F.col("component").alias("theirs"))
        least = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(least, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = hooked.join(jump, "component").select("id", "was", F.least("component", "further").alias("component"))
        moved = scratch.save(moved, f"{name}-{step}")
        done = moved.filter("was <> component").isEmpty()
        labels = moved.select("id", "component")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        if done:
            return labels


#: Rows of either side that meet in one group of `_cross_links`, about.
SIDE = 500


#: Parts that the rows of one group are dealt out to where a group's sums are joined to them.
SALTS = 16


def _with_sums(rows: DataFrame, sums: DataFrame, group: str) -> DataFrame:
    """rows with what is known of their groups, one row each; a group's rows go to SALTS tasks."""
    salt = F.pmod(F.xxhash64(F.lit("salt"), "rep"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", salt).join(sums.withColumn("salt", every), [group, "salt"]).drop("salt")


def _mixed_groups(rows: DataFrame, group: str, scratch: Scratch) -> DataFrame:
    """(group, rep, component, home) of the groups that have more than one component; home: the one that most rows are in.

    What is known of the groups is written before rows meet it, so that adaptive execution can
    split a group that many rows are in.
    """
    counts = rows.groupBy(group, "component").agg(F.count("*").alias("n"))
    most = F.max_by("component", F.struct("n", -F.col("component")))
    homes = counts.groupBy(group).agg(most.alias("home"), F.count("*").alias("parts")).filter("parts > 1").select(group, "home")
    return rows.join(scratch.save(homes, f"homes-{group}"), group).select(group, "rep", "component", "home")


def _rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(group, rep, component): members of large homes, dealt out by the shingles of their prefixes.

    A set's shingles are put in order of how many of its home's members have them, rare ones
    first.  Two sets that are alike enough share one of the first n - ceil(n * percent / 100) + 1,
    so no link is lost; what a home's members all have in common brings nobody together.
    """

    def unpacked(batches):
        for batch in batches:
            for home, rep, component, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                shingles = np.frombuffer(packed.as_buffer(), np.int64)
                same = [pa.array(np.full(len(shingles), v, np.int64)) for v in (home, rep, component, len(shingles))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(shingles)], ["home", "rep", "component", "n", "shingle"])

    rows = members.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select("home", "rep", "component", "shingles")
    rows = rows.mapInArrow(unpacked, "home long, rep long, component long, n long, shingle long")
    common = rows.groupBy("home", "shingle").agg(F.count("*").alias("shared_by"))
    place = F.row_number().over(Window.partitionBy("home", "rep").orderBy("shared_by", "shingle"))
    prefix = rows.join(common, ["home", "shingle"]).withColumn("place", place).filter(
        F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    )
    return prefix.filter("shared_by > 1").select(F.xxhash64("home", "shingle").alias("group"), "rep", "component")


def _cross_links(buckets: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, most: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between different components of a bucket, where there are any.

    A bucket's home is the component that most of its documents are in.  The others in
    the bucket are strays of that home.  Of two documents of a bucket in different
    components one is a stray, and the other one of the same home's members or strays; so
    strays are held against all of those, in blocks of bounded size.  Once a stray
    has a link to a component, that component's other documents needn't be looked at.

    With SIDE strays at most, no more than twice the members' sets move.  Homes with more
    strays are first dealt out by their members' rarest shingles, which splits documents that
    have much in common but aren't linked.
    """
    named = labels.select(F.col("id").alias("rep"), "component")
    rows = scratch.save(buckets.join(named, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "named")
    members = scratch.save(_mixed_groups(rows, "key", scratch).select("home", "rep", "component").distinct(), "members")
    strays = members.groupBy("home").agg(F.count_if(F.col("component") != F.col("home")).alias("strays"))
    sized = scratch.save(_with_sums(members, strays, "home"), "sized")
    scratch.drop("named", "members", "homes-key")
    parts = sized.filter(F.col("strays") <= SIDE).select(F.col("home").alias("group"), "rep", "component", "home")
    large = sized.filter(F.col("strays") > SIDE)
    if not large.isEmpty():
        rare = scratch.save(_rare_shingles(large.select("home", "rep", "component"), sets, percent), "rare")
        parts = parts.unionByName(_mixed_groups(rare, "group", scratch).distinct())
    members = scratch.save(parts.withColumn("stray", F.col("component") != F.col("home")).drop("home").withColumnRenamed("group", "home"), "parts")
    scratch.drop("sized", "rare", "homes-group")
    sizes = members.groupBy("home").agg(
        F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"), F.ceil(F.count_if("stray") / SIDE).cast("int").alias("stray_blocks")
    )
    placed = _with_sums(members, sizes, "home")
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("home", "rep", "component", "block", "stray_block")
    whole = placed.withColumn("block", block("m", "blocks")).withColumn(
        "stray_block", every("stray_blocks")
    ).select(*kept, F.lit(False).alias("seeks"))
    seeking = placed.filter("stray").withColumn(
        "stray_block", block("s", "stray_blocks")
    ).withColumn("block", every("blocks")).select(*kept, F.lit(True).alias("seeks"))
    sides = whole.unionByName(seeking).join(classes.select("rep", "sig"), "rep").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    sides = sides.select("home", "block", "stray_block", "seeks", "rep", "component", "sig", "shingles")
    sides = sides.repartition("home", "block", "stray_block").sortWithinPartitions("home", "block", "stray_block", "seeks")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        base, seek = [r for r in group if not r[0]], [r for r in group if r[0]]
        if not base or not seek:
            return []
        ids, parts = np.array([r[1] for r in base]), np.array([r[2] for r in base])
        sigs = np.frombuffer(b"".join(r[3] for r in base), "<u2").reshape(-1, SYMBOLS)
        lengths = np.array([len(r[4].as_buffer()) // 8 for r in base])
        out = []
        for _, rep, part, sig, shingles in seek:
            x = np.frombuffer(shingles.as_buffer(), np.uint64)
            n = len(x)
            differ = (sigs != np.frombuffer(sig, "<u2")).sum(1)
            try_ = np.flatnonzero((differ <= most) & (parts != part) & (100 * np.minimum(lengths, n) >= percent * np.maximum(lengths, n)))
            linked: set[int] = set()
            for i in try_[np.argsort(differ[try_], kind="stable")]:
                if int(parts[i]) in linked:
                    continue
                y = np.frombuffer(base[i][4].as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, n - 1)] == y).sum())
                if 100 * shared >= percent * (n + len(y) - shared):
                    linked.add(int(parts[i]))
                    out.append((rep, int(ids[i])))
        return out

    def run(batches):
        group, of = [], None
        for batch in batches:
            found = []
            for h, b, s, *row, shingles in zip(*(batch.column(i).to_pylist() for i in range(7)), batch.column(7), strict=True):
                if (h, b, s) != of:
                    found += compare(group)
                    group, of = [], (h, b, s)
                group.append((*row, shingles))  # sets stay in the batch until they are needed
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = compare(group)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sides.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; size: words a shingle."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "dedup")
    most = most_differing(percent / 100)
    rows = scratch.save(signatures(docs, size), "rows")
    own = rows.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    classes = scratch.save(own.groupBy("set_id", "sig").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = classes.select("rep", F.explode(bucket_keys(F.col("sig"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").select("key", "leader")
    shared = scratch.save(shared, "shared")
    buckets = scratch.save(keyed.join(shared, "key"), "buckets")
    scratch.drop("shared")

    # full sets of all that share a key with another
    asked = buckets.select(F.col("rep").alias("id")).distinct().join(classes.select(F.col("rep").alias("id"), "set_id"), "id")
    sets = scratch.save(_sets(docs, scratch.save(asked, "asked"), size), "sets")
    scratch.drop("asked")

    # everyone against the leader that it shares most keys with
    votes = buckets.filter("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("n"))
    best = votes.groupBy("rep").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("b")).select(F.col("rep").alias("a"), "b")
    stars = _linked(_near(best, classes, most), sets, percent)

    # rows that repeat a doc_id with another text
    repeated = own.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).filter("lo < hi").select("doc_id", "lo")
    again = own.join(repeated, "doc_id").select("lo", "set_id").distinct().join(classes.select("set_id", F.col("rep").alias("a")), "set_id")
    again = again.join(classes.select(F.col("set_id").alias("lo"), F.col("rep").alias("b")), "lo").select("a", "b").filter("a <> b")
    links = scratch.save(stars.unionByName(again), "links")

    labels = components(links, scratch, "first")
    more = scratch.save(_cross_links(buckets, labels, classes, sets, most, percent, scratch), "more")
    scratch.drop("buckets", "sets", "parts")
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch, "last")

    found = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    joined = rows.select("doc_id", "n_shingles", "set_id").join(found, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates; columns as they were.

    Where doc_ids repeat, rows are told apart by their texts: of rows that repeat an id and
    its text the one that sorts first counts, and each other row is a document by itself.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    named, rest = docs.filter(F.col("doc_id").isNotNull()), [c for c in docs.columns if c not in ("doc_id", "text")]
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows, key = docs, "doc_id"
    else:
        key = "_row"
        first = named.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest")) if rest else named.distinct()
        rows = scratch.save(first.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id()), "rows")
        rows = rows.select(key, "doc_id", "text", *(["_rest.*"] if rest else []))
    gone = scratch.save(
        near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), size, percent).filter("NOT kept").select(F.col("doc_id").alias(key)), "gone"
    )
    # whatever the filter lets by is certainly kept, and isn't moved
    maybe = IdFilter(gone, key).maybe(F.col(key))
    left = rows.filter(~maybe).unionByName(rows.filter(maybe).join(gone, key, "left_anti"))
    return left.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull())) if key == "_row" else left


def oracle_sql(size: int, percent: int = 80) -> str:
    """DuckDB SQL for near_duplicates over documents with ids: every pair that shares a shingle, then all that is reached."""
    shingle = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(size))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: {shingle})
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
r AS (SELECT x AS doc_id, x AS reached FROM link UNION SELECT r.doc_id, y FROM r JOIN link ON x = r.reached),
k AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id,
  coalesce(k.component_id, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
