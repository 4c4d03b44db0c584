"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprints within ``radius`` 2 of 64 bits agree on at least two of four 16-bit blocks, so each distinct
fingerprint goes to the six shards named by its pairs of blocks, and no link is lost. A shard's BK-tree (children
keyed by their integer Hamming distance to the parent) is built and searched where the shard lies: the trees of a
whole corpus have no size bound, so none is broadcast. A shard with more than ``hot`` fingerprints is dealt again by
pairs of the four bytes outside its two blocks; such a part holds 65,536 distinct fingerprints at most. A tree's links are
reduced to one link from each fingerprint to its group's first, and the groups are joined by distributed components.

Null or empty text, or text without words: fingerprint zero. A bit that half the shingles set (a tie) is 0. A null doc_id stays and
gets the component of its fingerprint's smallest doc_id. Very long texts are read whole, in parts of 32,768 shingles. Repeated rows
each get a row; an empty table gives an empty one. Further columns are ignored by the query and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, materialise, rows

#: Shards with more distinct fingerprints or texts than this are dealt again.
HOT_SHARD = 20_000


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle of the ASCII-lower-cased words; of all words where they are fewer."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    if len(words) < k:
        return [xxhash.xxh64_intdigest(joined, 42)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[k - 1 :], strict=False)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows of ``hashes`` (n, w) uint64, as w uint64."""
    n, w = hashes.shape
    total = np.zeros(64 * w, np.int64)
    for s in range(0, n, 1 << 15):
        bits = np.unpackbits(np.ascontiguousarray(hashes[s : s + (1 << 15)]).view(np.uint8).reshape(-1, 8 * w), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    hashes = shingle_hashes(text, k)
    return int(majority(np.array(hashes, np.uint64).reshape(-1, 1))[0]) if hashes else 0


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make(batches):
        for doc_id, text in rows(batches, "doc_id", "text"):
            f = fingerprint(text, k)
            yield doc_id, f - (1 << 64) if f >> 63 else f

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


def bk_groups(shard: np.ndarray, fp: np.ndarray, radius: int, same=None, known: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by ``shard`` with (n, w) uint64 ``fp``: each row's group, as the index of its first row.

    One BK-tree for each shard, all held as one sorted array of (parent, distance) keys. Rows of a shard within
    ``radius`` are of one group, if ``same(a, b)`` confirms the pair; pairs that are of one group already are not asked about.
    Rows with equal ``known`` are of one group from the start.
    """
    n, w = fp.shape
    label = np.arange(n)
    if known is not None and n:
        label = np.unique(known, return_index=True, return_inverse=True)
        label = label[1][label[2]]
    if n < 2:
        return label
    root = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    stride = 64 * w + 1
    most = (1 << 21) // w  # pairs compared at once

    def apart(a, b):
        return np.concatenate([np.bitwise_count(fp[a[s : s + most]] ^ fp[b[s : s + most]]).sum(axis=1, dtype=np.int64) for s in range(0, a.size, most)])

    waiting = np.flatnonzero(root != np.arange(n))
    at, keys, kids = root[waiting], [], []
    while waiting.size:  # each step goes one level down for all rows at once
        d = apart(waiting, at)
        key, first, back = np.unique(at * stride + d, return_index=True, return_inverse=True)
        child = waiting[first]
        keys.append(key)
        kids.append(child)
        rest = np.ones(waiting.size, bool)
        rest[first] = False
        waiting, at = waiting[rest], child[back][rest]
    if not keys:
        return label
    key, kid = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(key)
    key, kid = key[order], kid[order]

    def unite(a, b):
        nonlocal label
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                return
            np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
            while not np.array_equal(deeper := label[label], label):
                label = deeper

    several = np.flatnonzero(np.bincount(root, minlength=n)[root] > 1)
    todo = [(several[s : s + 8192], root[several[s : s + 8192]]) for s in range(0, several.size, 8192)]
    while todo:
        q, node = todo.pop()
        if q.size > min(1 << 18, most):
            half = q.size // 2
            todo += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = apart(q, node)
        near = (d <= radius) & (q > node)
        a, b = q[near], node[near]
        for s in range(0, a.size, 1024):  # what one part unites the next need not ask about
            x, y = a[s : s + 1024], b[s : s + 1024]
            if same is not None:
                new = label[x] != label[y]
                x, y = x[new], y[new]
                alike = same(x, y)
                x, y = x[alike], y[alike]
            if x.size:
                unite(x, y)
        # a child at distance c from its parent can hold a row within the radius only if |c - d| <= radius
        lo, hi = np.searchsorted(key, node * stride + np.maximum(d - radius, 0)), np.searchsorted(key, node * stride + np.minimum(d + radius, stride - 1), side="right")
        many = hi - lo
        if many.any():
            which = np.repeat(np.arange(q.size), many)
            offset = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many)
            todo.append((q[which], kid[lo[which] + offset]))
    return label


def jaccard_at_least(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct values are alike."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    shared = np.intersect1d(x, y, assume_unique=True).size
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def shard_links(dealt: DataFrame, radius: int, words: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) found by the BK-trees of ``dealt(key, sub, node, f0 .. f{words-1})``.

    With ``similarity`` there are ``known``, what groups are known before (null: none), and ``grams``, sorted 32-bit shingle hashes that confirm each pair.
    """

    def make(batches):
        held: list[np.ndarray] = []
        grams: list[np.ndarray] = []

        def link(x, sets):
            shard = np.cumsum(np.r_[0, (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])
            fp = np.ascontiguousarray(x[:, 3 : 3 + words]).view(np.uint64)
            if similarity is None:
                label = bk_groups(shard, fp, radius)
            else:
                # groups known before hold within a shard
                groups = np.unique(np.c_[shard, x[:, 3 + words]], axis=0, return_inverse=True)[1].ravel()
                label = bk_groups(shard, fp, radius, lambda a, b: np.array([jaccard_at_least(sets[i], sets[j], similarity) for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool), groups)
            moved = np.flatnonzero(label != np.arange(len(x)))
            yield from zip(x[moved, 2].tolist(), x[label[moved], 2].tolist(), strict=True)

        size = 0
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - (similarity is not None))], axis=1).astype(np.int64, copy=False)
            held.append(x)
            size += x.nbytes
            if similarity is not None:
                grams += [np.frombuffer(g, np.uint32) for g in batch.column("grams").to_pylist()]
                size += sum(len(g) * 4 for g in grams[-len(x) :])
            if size >= 8 << 20:  # whole shards only: what follows the last change of shard waits
                x = np.concatenate(held)
                change = np.flatnonzero((x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1]))
                cut = change[-1] + 1 if change.size else 0
                if cut:
                    yield from link(x[:cut], grams[:cut])
                held, grams = [x[cut:]], grams[cut:]
                size = held[0].nbytes + sum(len(g) * 4 for g in grams)
        if held and sum(map(len, held)):
            yield from link(np.concatenate(held), grams)

    names = [f"f{i}" for i in range(words)]
    if similarity is not None:
        names += ["known", "grams"]
        dealt = dealt.withColumn("known", F.coalesce("known", "node"))
    ordered = dealt.select("key", "sub", "node", *names).repartition("key", "sub").sortWithinPartitions("key", "sub", "node")
    return map_rows(ordered, make, "a long, b long")


def exact_shards(distinct: DataFrame, hot: int = HOT_SHARD) -> DataFrame:
    """``distinct(node, f0)`` dealt to all shards that two fingerprints within 2 bits share."""
    block = [f"(shiftrightunsigned(f0, {16 * i}) & 65535)" for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = ", ".join(f"shiftleft({n}L, 32) | shiftleft({block[i]}, 16) | {block[j]}" for n, (i, j) in enumerate(pairs))
    dealt = distinct.select("node", "f0", F.explode(F.expr(f"array({keys})")).alias("key"))
    crowded = materialise(dealt.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("crowded")), "crowded")

    def parts(n: int) -> str:
        rest = [b for b in range(4) if b not in pairs[n]]
        byte = [f"(shiftrightunsigned(f0, {16 * b + 8 * h}) & 255)" for b in rest for h in range(2)]
        return "array(" + ", ".join(f"{m << 16}L | shiftleft({byte[i]}, 8) | {byte[j]}" for m, (i, j) in enumerate(pairs)) + ")"

    again = "CASE " + " ".join(f"WHEN shiftright(key, 32) = {n} THEN {parts(n)}" for n in range(6)) + " END"
    return dealt.join(crowded, "key", "left").select("key", "node", "f0", F.explode(F.expr(f"CASE WHEN crowded THEN {again} ELSE array(-1L) END")).alias("sub"))


def link_fingerprints(docs: DataFrame, k: int = 3, radius: int = 2, hot: int = HOT_SHARD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: fingerprints link at ``radius`` 2 or fewer bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the shards hold all links up to radius 2 only")
    marked = materialise(fingerprints(docs, k), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("node"))
    links = shard_links(exact_shards(classes.where("node IS NOT NULL").select("node", F.col("fp").alias("f0")), hot), radius, 1)
    roots = components(links)
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return link_fingerprints(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate documents by similarity -----------------------------------------------------------------

#: 64-bit words of the shingles' long fingerprint; bands of min-hashes that pick the pairs to compare, and min-hashes in a band.
LONG, BANDS, BAND_ROWS = 32, 28, 6
#: Deviations that the radius allows above the mean of pairs at the similarity asked for.
DEVIATIONS = 3.0
#: Bytes of sketches and shingle hashes in a shard that one task gathers.
SHARD_BYTES = 64 << 20
_STEP, _SPREAD, _CHAIN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """(n, width) hashes from n."""
    out = h[:, None] * (np.uint64(_STEP) * np.arange(1, 2 * width, 2, dtype=np.uint64))
    out ^= out >> np.uint64(29)
    out *= np.uint64(_SPREAD)
    return out ^ (out >> np.uint64(32))


def sketch(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Min-hashes (32 bits each), SimHash and sorted 32-bit hashes of the distinct k-word shingles; None without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return None
    h = np.array([digest(w, 42) for w in words], np.uint64)
    n = max(1, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        s = (s ^ (s >> np.uint64(31))) * np.uint64(_CHAIN) + h[j : j + n]
    s = np.unique(s)
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, _mixed(s[at : at + 4096], BANDS * BAND_ROWS // 2).view(np.uint32).min(axis=0))
    return least, majority(_mixed(s, LONG)), np.unique((s >> np.uint64(32)).astype(np.uint32))


def hamming_bound(similarity: float, bits: int) -> int:
    """Bits that shingle sets of this Jaccard similarity differ in, on average and DEVIATIONS more.

    Their cosine is 2J / (1 + J) for equal sizes.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p)))


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, hot: int = HOT_SHARD, room: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, group_id): documents whose k-word shingle sets are alike, group_id the least doc_id of the group.

    Equal texts are one class. Of each class BANDS bands of BAND_ROWS min-hashes of its shingles are taken; classes that
    agree on a band share a BK-tree, whose radius on the 2,048-bit SimHash of the shingles stands for ``similarity`` and some deviations, and
    the Jaccard similarity of the shingle sets confirms each pair before it links. A band agrees with the probability
    J ** BAND_ROWS whatever the edit: at 0.8 a share of 0.9998 of the pairs meets. Bands shared by the same classes give the
    same tree, so one of them is built. A shard of more than ``hot`` classes or ``room`` bytes is searched in parts, see
    ``crowded_links``, with the same groups. Groups are transitive. Texts without words are one group if equal, never linked otherwise.
    """

    def make(batches):
        import xxhash

        for node, text in rows(batches, "node", "text"):
            got = sketch(text, k)
            if got:
                bands = [xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(got[0].reshape(BANDS, BAND_ROWS))]
                yield node, *got[1].view(np.int64).tolist(), [x - (1 << 64) if x >> 63 else x for x in bands], got[2].tobytes()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("same"))
    classes = materialise(keyed.groupBy("same").agg(F.min("doc_id").alias("node")), "classes")
    names = [f"f{i}" for i in range(LONG)]
    # the row that holds a class's least id speaks for it; a repeated row speaks twice and changes nothing
    speakers = keyed.join(classes.where("node IS NOT NULL").select(F.col("node").alias("doc_id"), F.col("same").alias("own")), "doc_id").where("same = own")
    sketched = materialise(map_rows(speakers.select(F.col("doc_id").alias("node"), "text"), make, "node long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>, grams binary", 512), "sketches")
    dealt = sketched.select("node", (F.length("grams") + 8 * LONG).cast("long").alias("bytes"), F.explode("bands").alias("key"))
    # bands with the same members have the same number, exclusive or and sums of hashes
    marks = {"m0": "bit_xor(xxhash64(node))", "m1": "sum(CAST(hash(node) AS BIGINT))", "m2": "sum(CAST(hash(node, 1) AS BIGINT))"}
    counts = dealt.groupBy("key").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"), *[F.expr(e).alias(m) for m, e in marks.items()]).where("count > 1")
    counts = counts.groupBy("count", "bytes", *marks).agg(F.min("key").alias("key"))
    parts = F.ceil(2 * F.greatest(F.col("count") / hot, F.col("bytes") / room)).cast("long")
    counts = materialise(counts.select("key", F.when((F.col("count") > hot) | (F.col("bytes") > room), parts).otherwise(1).alias("blocks")), "bands")
    members = dealt.select("node", "key").join(counts, "key").dropDuplicates(["key", "node"]).withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    sketches = sketched.drop("bands").dropDuplicates(["node"])

    def links(shards: DataFrame) -> DataFrame:
        return shard_links(shards.join(sketches, "node"), hamming_bound(similarity, 64 * LONG), LONG, similarity)

    # each class in one block of its shard: all there is where no shard is crowded
    first = materialise(links(members.select("key", F.col("block").alias("sub"), "node", F.lit(None).cast("long").alias("known"))), "links")
    crowded = members.where("blocks > 1")
    found = first if crowded.isEmpty() else crowded_links(materialise(crowded, "crowded"), first, links, hot)
    named = classes.join(components(found), "node", "left").select("same", F.coalesce("root", "node").alias("group_id"))
    return keyed.select("doc_id", "same").join(named, "same").select("doc_id", "group_id")


def crowded_links(members: DataFrame, first: DataFrame, links, hot: int) -> DataFrame:
    """All links, where ``members(key, node, block, blocks)`` of crowded shards have been linked within their blocks only (``first``).

    One class of each group in a shard goes to that shard's list of leaders, whose links join the pieces that blocks have cut
    a large group into. What is of a shard's largest group by then needs no comparison among itself: each of its members
    goes to its own block, and only the other members go to all blocks. So a large group of near copies costs each of its members
    one more comparison, and only classes outside it are compared with many.
    """

    def labelled(found: DataFrame) -> DataFrame:
        roots = materialise(components(found), "roots")
        return materialise(members.join(roots, "node", "left").select("key", "node", "block", "blocks", F.coalesce("root", "node").alias("known")), "labelled")

    def in_pairs(rows_: DataFrame, n: str) -> DataFrame:
        """Each pair of ``n`` parts is a shard: every two rows meet."""
        part = rows_.withColumn("parts", F.expr(n)).withColumn("part", F.expr("pmod(xxhash64(node, 7), parts)"))
        others = "CASE WHEN parts = 1 THEN array(-1L) ELSE transform(filter(sequence(0L, parts - 1), j -> j <> part), j -> -2 - (least(j, part) * parts + greatest(j, part))) END"
        return part.select("key", F.explode(F.expr(others)).alias("sub"), "node", "known")

    now = labelled(first)
    groups = materialise(now.groupBy("key", "known").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n > 1"), "leaders")
    many = groups.groupBy("key").agg(F.count("*").alias("leaders"))
    leaders = in_pairs(groups.join(many, "key"), f"CASE WHEN leaders > {hot} THEN CAST(ceil(2 * leaders / {hot}) AS BIGINT) ELSE 1L END")
    second = materialise(first.unionByName(links(leaders)), "links")
    now = labelled(second)
    sizes = now.groupBy("key", "known").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "known")).alias("top"), F.sum("n").alias("all"))
    rests = materialise(sizes.select("key", F.col("top.known").alias("largest"), F.expr(f"CASE WHEN all - top.n > {hot} THEN CAST(ceil(2 * (all - top.n) / {hot}) AS BIGINT) ELSE 1L END").alias("rests"), (F.col("all") - F.col("top.n")).alias("left")), "largest")
    split = now.join(rests, "key").where("left > 0")
    large = split.where("known = largest").select("key", F.explode(F.expr("transform(sequence(0L, rests - 1), r -> block * rests + r)")).alias("sub"), "node", "known")
    rest = split.where("known <> largest").withColumn("r", F.expr("pmod(xxhash64(node, 7), rests)"))
    small = rest.select("key", F.explode(F.expr("transform(sequence(0L, blocks - 1), b -> b * rests + r)")).alias("sub"), "node", "known")
    among = in_pairs(rest.where("rests > 1").select("key", "node", "known", "rests"), "rests")  # else they have met beside each block
    third = links(large.unionByName(small).unionByName(among))
    return second.unionByName(third)


def keep_one(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the least doc_id, or one without an id if no row has one.

    Every row is a text of its own, whatever its id; of rows with one id and one group the first as written stays.
    """
    row = f"row-{uuid.uuid4().hex}"  # no table has such a column
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written, so the numbers stay
    number = F.col(f"`{row}`")
    groups = near_groups(numbered.select(number.alias("doc_id"), "text"), k, similarity).select(F.col("doc_id").alias(row), "group_id")
    ids = numbered.select(number, F.col("doc_id").cast("long").alias("own"))
    first = groups.join(ids, row).groupBy("group_id").agg(F.min(F.struct(F.col("own").isNull(), F.col("own"), number)).alias("first"))
    return numbered.join(first.select(F.col(f"first.`{row}`")), row, "left_semi").drop(row)
