"""Near-duplicate documents by b-bit MinHash.

1. Each text is lower-cased (A-Z) and cut into words; its set is that of its five-word
   shingles, hashed to 64 bits.  One kernel returns the set's digest, the low 8 bits of
   256 minima (the packed signature) and 32 band keys of five full minima each.
2. Equal sets are one class (digest of the whole set), represented by the smallest id.
3. Classes that share a band key are candidates.  Inside a band group a kernel counts
   equal signature bytes, corrects the count for the chance agreement of 8 bits,
   and returns a spanning forest of the pairs estimated at ``threshold - SLACK`` or more; small groups,
   nearly all of them, are counted many at a time.
   Groups and, later, neighbourhoods of more than ``BLOCK`` classes are dealt out as
   pairs of blocks, so no task ever holds a whole group.
4. The forest's components are neighbourhoods.  Only their members' texts are cut
   again; in each neighbourhood pairs above the estimate are confirmed on the full sets,
   best estimate first and only between classes not yet linked, and a spanning forest
   of the confirmed links is returned.
5. Components of the confirmed links between classes; every copy takes its class's component.

With 32 bands of five, a pair at similarity 0.85 shares no band with probability 7e-9;
the estimate's deviation there is 0.022, so SLACK is 4.5 deviations.

Defined cases: null, empty and blank texts have an empty set, linked with nothing; fewer
than five words form one shingle; rows with the same id are the same document
only if their sets are equal, else the id stands for all of its sets in links; rows with
a null id keep null as component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_column
from .components import components

SHINGLE = 5
BANDS, ROWS, MINIMA = 32, 5, 256
SLACK = 0.10
#: Classes of one group that a task holds at once (signatures; full sets); larger groups become pairs of blocks.
BLOCK, FULL_BLOCK = 1024, 512
#: Rows of a group up to which groups are estimated together.
SMALL = 16

_RNG = np.random.default_rng(20240501)
_FACTOR = (_RNG.integers(0, 2**31, MINIMA, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_SHIFT = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)
_MIX = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        s ^= s >> np.uint64(29)
        s += h[k:n + k]
        s *= _MIX[k]
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def minima(s: np.ndarray) -> np.ndarray:
    """The 256 smallest values of ``factor * x + shift`` over the set, in slices that fit the cache."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        v = _FACTOR[:, None] * x[None, at:at + 512]
        v += _SHIFT[:, None]
        np.minimum(best, v.min(1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    k = best[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * _BAND[i] + k[:, i]
    return key ^ (key >> np.uint64(32))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, sig, bands`` of every row."""
    def sign(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                s = shingle_set(text)
                if not len(s):
                    rows.append((doc_id, 0, None, None, None))
                    continue
                best = minima(s)
                rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                             best.astype(np.uint8).tobytes(), band_keys(best).view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig", "bands"]).astype(
                {"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).mapInPandas(
        sign, "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>")


def similarity(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal low bytes: (share - 2**-8) / (1 - 2**-8)."""
    return (equal / MINIMA - 1 / 256) / (1 - 1 / 256)


def equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes of every row of ``a`` with every row of ``b``, by counting bits.

    Bytes are compared eight at a time: an xor has zero bytes where they agree; folding each byte's
    bits into its lowest leaves one bit for each byte that differs.
    """
    x, y = a.view(np.uint64), b.view(np.uint64)
    differ = np.zeros((len(x), len(y)), np.uint16)
    ones = np.uint64(0x0101010101010101)
    for k in range(x.shape[1]):
        v = x[:, k, None] ^ y[None, :, k]
        v |= v >> np.uint64(4)
        v |= v >> np.uint64(2)
        v |= v >> np.uint64(1)
        v &= ones
        differ += np.bitwise_count(v)
    return MINIMA - differ.astype(np.int32)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        """Every element's root (and full path compression)."""
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                self.up = up
                return up
            up = nxt

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple]:
    """Row by block of 256: positions and estimates of pairs (x in left, y in right, x < y) at ``least`` or more."""
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        est = similarity(equal_bytes(sig[rows], sig[right]))
        i, j = np.nonzero(est >= least)
        x, y, e = rows[i], right[j], est[i, j]
        ok = x < y if left is right else np.ones(len(x), bool)
        yield x[ok], y[ok], e[ok]


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a pair of blocks (the same rows twice where a block meets itself)."""
    side = pdf["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return (left, right) if len(right) else (left, left)


def _forest_of_estimates(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    ids = pdf["doc_id"].to_numpy(np.int64)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), MINIMA)
    left, right = _sides(pdf)
    forest, links = Forest(len(pdf)), []
    for x, y, _ in _pairs(sig, left, right, least):
        # Of the rows near row a, one of each tree suffices.
        starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else []
        for a, near in zip(x[starts].tolist() if len(x) else [], np.split(y, starts[1:])):
            _, first = np.unique(forest.roots()[near], return_index=True)
            links += [(a, b) for b in near[first].tolist() if forest.join(a, b)]
    u, v = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
    return pd.DataFrame({"u": ids[u], "v": ids[v]})


def _forests_of_small_groups(sig: np.ndarray, group: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of ``_forest_of_estimates`` for many neighbouring groups of at most ``SMALL`` rows at once."""
    forest, u, v = Forest(len(sig)), [], []
    one_block = np.bincount(group, side) == 0  # no second block: the rows meet each other
    for apart in range(1, SMALL):
        x = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(x):
            break
        x = x[one_block[group[x]] | (side[x] != side[x + apart])]
        for at in range(0, len(x), 1 << 14):
            a = x[at:at + (1 << 14)]
            near = a[similarity((sig[a] == sig[a + apart]).sum(1)) >= least]
            for i in near.tolist():
                if forest.join(i, i + apart):
                    u.append(i)
                    v.append(i + apart)
    return np.array(u, np.int64), np.array(v, np.int64)


def _estimated_links(batches, least: float) -> Iterator[pd.DataFrame]:
    """Spanning forests of the groups (key, i, j), whose rows follow each other; small groups together, others one by one."""
    def links(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        of = pdf[["key", "i", "j"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]).any(1))))
        size = np.diff(np.append(starts, len(pdf)))
        for a, n in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
            yield _forest_of_estimates(pdf.iloc[a:a + n], least)
        small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
        if len(small):
            rows = pdf.iloc[small]
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), MINIMA)
            _, group = np.unique(np.repeat(np.arange(len(size)), size)[small], return_inverse=True)
            ids = rows["doc_id"].to_numpy(np.int64)
            u, v = _forests_of_small_groups(sig, group, rows["side"].to_numpy(), least)
            yield pd.DataFrame({"u": ids[u], "v": ids[v]})

    held: list[pd.DataFrame] = []  # the last group may go on in the next batch
    for b in batches:
        if not len(b):
            continue
        last = (b[["key", "i", "j"]] == b[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        ends = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if held and (ends or (held[-1][["key", "i", "j"]].iloc[-1] != b[["key", "i", "j"]].iloc[0]).any()):
            yield from links(pd.concat([*held, b.iloc[:ends]]))
            held = []
        elif ends:
            yield from links(b.iloc[:ends])
        held.append(b.iloc[ends:])
    if held:
        yield from links(pd.concat(held))


def _forest_of_links(pdf: pd.DataFrame, least: float, percent: int) -> pd.DataFrame:
    """Links of 100 * intersection >= percent * union, as a spanning forest: best estimates are confirmed first."""
    ids = pdf["doc_id"].to_numpy(np.int64)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), MINIMA)
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    size = np.array([len(s) for s in sets])
    left, right = _sides(pdf)
    found = list(_pairs(sig, left, right, least))
    if not found:  # the hash left one of the two blocks empty
        return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
    x, y, e = (np.concatenate([f[k] for f in found]) for k in range(3))
    # 100 I >= p (a + b - I) with I <= min(a, b): sizes too far apart can't be linked.
    ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
    x, y, e = x[ok], y[ok], e[ok]
    order = np.argsort(-e, kind="stable")
    x, y = x[order], y[order]
    forest, links = Forest(len(pdf)), []
    step = 256  # confirmed in rounds that grow: pairs that a round has linked are passed over in the next
    while len(x):
        a, b = x[:step], y[:step]
        for i, j in zip(a.tolist(), b.tolist()):
            if forest.root(i) == forest.root(j):
                continue
            s, t = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            common = int((t[at] == s).sum())
            if 100 * common >= percent * (len(s) + len(t) - common):
                forest.join(i, j)
                links.append((i, j))
        roots = forest.roots()
        x, y = x[step:], y[step:]
        apart = roots[x] != roots[y]
        x, y = x[apart], y[apart]
        step *= 2
    u, v = (np.array([p[k] for p in links], np.int64) for k in (0, 1))
    return pd.DataFrame({"u": ids[u], "v": ids[v]})


def _block_pairs(members: DataFrame, key: str, sizes: DataFrame, block: int) -> DataFrame:
    """Members of groups of two or more, as (key, i, j, side): every pair of rows of a group meets in one (i, j).

    ``sizes`` holds ``key, n``.  A group of up to ``block`` rows is (0, 0); larger ones have ``n / block``
    blocks, and a row goes to every pair that its block is part of.
    """
    joined = members.join(sizes.where("n > 1"), key)
    many = joined.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = many.withColumn("other", other)
    return dealt.select(
        *members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; see the module's text."""
    least = percent / 100 - SLACK
    signed = staged(signatures(docs), "signatures")
    ids = signed.select("doc_id", "n_shingles", "digest")
    sets = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = staged(sets.groupBy("digest").agg(
        F.min(F.struct("doc_id", "sig", "bands")).alias("c")).select("c.doc_id", "c.sig", "c.bands", "digest"), "classes")

    banded = classes.select("doc_id", "digest", F.explode("bands").alias("key"))
    members = _block_pairs(banded, "key", banded.groupBy("key").agg(F.count("*").alias("n")), BLOCK)
    near = (members.join(classes.select("digest", "sig"), "digest").select("key", "i", "j", "side", "doc_id", "sig")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInPandas(lambda batches: _estimated_links(batches, least), "u long, v long"))
    hoods = staged(components(near.distinct()), "neighbourhoods")

    confirmed = _confirm(docs, classes, hoods, least, percent)
    rep = classes.select("digest", F.col("doc_id").alias("rep"))
    # An id of several sets links their classes; copies never enter the component steps.
    several = (sets.select("doc_id", "digest").distinct().join(rep, "digest").groupBy("doc_id")
               .agg(F.min("rep").alias("u"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
               .select("u", F.explode("reps").alias("v")))
    linked = components(confirmed.unionByName(several)).withColumnRenamed("node", "rep")
    found = ids.join(rep, "digest", "left").join(linked, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return (found.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _confirm(docs: DataFrame, classes: DataFrame, hoods: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed links inside neighbourhoods, from the full shingle sets of their members' texts."""
    members = hoods.withColumnRenamed("node", "doc_id")
    wanted = classes.select("doc_id", "digest", "sig")
    # An id may stand for several classes: a row for each.
    size = members.join(wanted, "doc_id").groupBy("component").agg(F.count("*").alias("n"))

    def cut(batches):
        for b in batches:
            s = [shingle_set(t).tobytes() for t in b["text"]]
            yield b[["doc_id", "component"]].assign(
                digest=[hashlib.blake2b(x, digest_size=16).digest() for x in s], shingles=s)

    texts = docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).join(members, "doc_id")
    full = texts.mapInPandas(cut, "doc_id long, component long, digest binary, shingles binary").dropDuplicates(
        ["doc_id", "digest"]).join(wanted, ["doc_id", "digest"])  # another id stands for other classes
    return (_block_pairs(full, "component", size, FULL_BLOCK).groupBy("component", "i", "j")
            .applyInPandas(lambda pdf: _forest_of_links(pdf, least, percent), "u long, v long"))


def representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows kept of ``docs``, every column: of each group of linked rows the one with the smallest id.

    Rows with the same id share one fate; rows with a null id stay.
    """
    dropped = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["__dropped"], "left_anti")
