"""N-gram Jaccard join by prefix filters under several global orders, and the classes that its links make.

Two sets with Jaccard similarity of at least t share a token among the first n - ceil(t * n) + 1 of each, under any order
of all tokens, and l tokens among the first n - ceil(t * n) + l. Candidates are found by the first order with one token.
Those that share enough tokens under two more orders, too, are verified on the whole sets. In every order the corpus' rare
tokens come first, within their kind by a hash.

Equal sets are one node. A large bucket of a token isn't expanded into all pairs: each of its documents is first compared
with a hub, one document of the same token and about the same size, by the same filters and verification. Documents that
are similar to their hub are one class. Others with the same hub can only be similar if they differ from it in the same
tokens, so another prefix filter runs over those differences. Its buckets, too, are first compared with one document
each, and pairs are made across the classes that are left. Pairs across hubs, and those of small buckets, are taken as
they are, without pairs inside the largest class of a bucket. No candidate of another class is left out.

Links inside a class aren't needed for the classes, but are for counting or listing links. As no link leaves a class, each
class is then cut into blocks of bounded size and every two of its blocks are compared in one task, set by set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, empty, settle, weighed, written

SHINGLE, PERCENT = 3, 90
#: Tokens in HOT lists or more come last in every order, tokens in several before them: two bitmaps of 2^BITS to 2^MOST_BITS bits
#: (8 to 32 MB, by the number of tokens) go to each task. Of THRESHOLDS, the first from which on tokens fill an eighth of the bits at
#: most tells what "several" is. Any bitmap makes a valid order; in a full one all tokens are frequent, and candidates grow.
HOT, THRESHOLDS, BITS, MOST_BITS, BUCKETS = 33, (2, 3, 5, 9, 33), 26, 28, 256
#: Bytes that a Python worker gets at once.
BATCH_BYTES = 8 << 20
#: Documents of a bucket from which on it has a hub, and rounds in which the buckets of a hub's differences are compared with one document each.
FAMILY, STARS = 8, 2
#: Rows of ids that a join sends to every executor, some 10 MB; above that it shuffles.
BROADCAST_IDS = 200_000
#: Pairs of one document that are compared in a task, and tasks that meet a node with many edges.
GUESTS, SALTS = 512, 16
#: What a block of a class holds about, for counting its links: sets, and tokens of all of them.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = _LOWER[97:123]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, at least n of them."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(0xD6E8FEB86659FD93)))])
    return _POWERS[0]


def _mix(x: np.ndarray, times: np.uint64) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * times
    return x ^ x >> np.uint64(29)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of the whole text, A-Z lower-cased."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.flatnonzero(~_SPACE[b])
    if not len(inside):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)  # where in `inside` words begin
    size = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, size)
    sums = np.add.reduceat(_LOWER[b[inside]] * _powers(int(size.max()))[place], first)
    return _mix(sums + size.astype(np.uint64) * _ODD[3], _ODD[0])


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's k-word shingles; fewer words are one shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = _mix(out + h[i : len(h) - width + 1 + i], _ODD[i % 4])
    return np.unique(out)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


class Frequent:
    """How often a token is listed, by bitmaps over the top bits of its hash: level 1 from one threshold on, 2 from HOT on.

    A token that collides with a frequent one counts as frequent."""

    def __init__(self, *bitmaps: np.ndarray):
        self.bitmaps = bitmaps
        self.drop = np.uint64(62 - len(bitmaps[0]).bit_length())

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int8)
        if len(tokens):
            at = (tokens >> self.drop).astype(np.int64)
            for bits in self.bitmaps:
                out += bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)
        return out


def blobs(tokens: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, sorted 32-bit hashes of listed tokens): one row for each bucket instead of one for each token.

    Neighbours of a sorted list are close, so their distances' high bytes, put side by side, compress to little."""
    if tokens:
        h, squeeze = np.sort((np.concatenate(tokens) >> np.uint64(32)).astype(np.uint32)), zstandard.ZstdCompressor(1)
        edges = np.searchsorted(h, np.arange(BUCKETS, dtype=np.uint32) << np.uint32(32 - BUCKETS.bit_length() + 1))
        for bucket, (i, j) in enumerate(zip(edges, [*edges[1:], len(h)], strict=True)):
            if j > i:
                steps = np.diff(h[i:j], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4)
                yield bucket, squeeze.compress(np.ascontiguousarray(steps.T).tobytes())


def unblob(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def frequent(listed: DataFrame, thresholds: tuple[int, ...], bits: int) -> Frequent:
    """Bitmaps (2^bits bits) of the hashes that (bucket, hashes) rows list as often as the first of thresholds that fills an eighth of
    the bits at most, and as often as the last one. With one threshold there is one bitmap.

    Buckets are counted one after another in an array of fixed size, whatever the number of rows, and lists come to a worker in batches
    of BATCH_BYTES. The driver gets compressed bitmaps."""
    width = 1 << 32 - (BUCKETS.bit_length() - 1)
    fold = 1 << 32 - bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, counts = -1, np.zeros(0, np.uint8)

        def done() -> pd.DataFrame:
            rows = {t: np.packbits((counts >= t).reshape(-1, fold).any(1), bitorder="little") for t in thresholds}
            return pd.DataFrame({"bucket": now, "threshold": list(rows), "filled": [int(np.bitwise_count(r).sum()) for r in rows.values()], "bits": [zstandard.compress(r.tobytes(), 1) for r in rows.values()]})

        for pdf in batches:
            for bucket, hashes in zip(pdf["bucket"], pdf["hashes"], strict=True):
                if bucket != now:
                    if now >= 0:
                        yield done()
                    now, counts = bucket, np.zeros(width, np.uint8)
                at, n = np.unique(unblob(hashes) & np.uint32(width - 1), return_counts=True)
                counts[at] = np.minimum(counts[at].astype(np.int64) + n, 255)
        if now >= 0:
            yield done()

    table = written(listed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(count, "bucket int, threshold int, filled long, bits binary"), "frequent", BATCH_BYTES)
    rows = table.collect()
    discard(table)
    settle(table.sparkSession)
    size, last = (1 << bits - 3) // BUCKETS, thresholds[-1]
    first = next((t for t in thresholds if sum(r["filled"] for r in rows if r["threshold"] == t) <= 1 << bits - 3), last)
    out = {t: np.zeros(1 << bits - 3, np.uint8) for t in (first, last)[: len(thresholds)]}
    for r in rows:
        if r["threshold"] in out:
            out[r["threshold"]][r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(zstandard.decompress(r["bits"]), np.uint8)
    return Frequent(*(out[t] for t in (first, last)[: len(thresholds)]))


def prefix(tokens: np.ndarray, known: Frequent, order: int, size: int) -> np.ndarray:
    """The first `size` tokens: rare ones first, within each level by a hash that differs with the order."""
    key = tokens if order == 0 else _mix(tokens, _ODD[order])
    return tokens[np.lexsort((key, known.levels(tokens)))[:size]]


def _each(docs: DataFrame, k: int, make, schema: str, listed: bool = False) -> DataFrame:
    """Of every row, tokens being its k-word shingles, the first that make(doc_id, tokens) returns.

    With listed, blobs of the tokens that it returns besides follow as rows with bucket and hashes only."""
    names = [c.split()[0] for c in schema.split(", ")]
    more = ["bucket", "hashes"] if listed else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, lists = [], []
            for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                row, tokens = make(d, shingles(t, k))
                rows.append(row)
                lists.append(tokens)
            if more:
                rows = [(*r, None, None) for r in rows] + [(*[None] * len(names), *b) for b in blobs(lists)]
            yield pd.DataFrame(rows, columns=names + more).astype({n: "Int64" for n in ("doc_id", "n", "bucket") if n in names + more})

    return docs.mapInPandas(run, schema + ", bucket int, hashes binary" * bool(listed))


def fits(na, nb, left_a, left_b, percent: int):
    """Whether sets of na and nb tokens can still be similar, with left_a and left_b tokens from the first shared one on."""
    return (100 + percent) * F.least(left_a, left_b) >= percent * (na + nb)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the smallest node reachable. Labels spread and jump until none changes."""
    pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), "edges")
    if both.isEmpty():
        return empty(edges.sparkSession, "node long, root long")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    n = roots.count()
    few = n <= BROADCAST_IDS
    while True:
        if few:
            seen = both.join(F.broadcast(roots.withColumnRenamed("node", "b")), "b")
        else:  # a node with many edges is met in several tasks
            salted = roots.select(F.col("node").alias("b"), "root", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            seen = both.join(salted, ["b", "salt"])
        seen = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = roots.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        if few:
            jumped = closer.join(F.broadcast(over), "root", "left")
        else:  # the root of a large class is met by all of its nodes
            over = closer.groupBy("root").agg(F.count("*").alias("m")).join(over, "root")
            jumped = weighed(closer, over, "root", "m", n, "left")
        new = written(jumped.select("node", "was", F.least("root", F.coalesce("jump", "root")).alias("root")), "roots")
        changed = new.filter("was <> root").limit(1).count()
        discard(roots)
        written_roots, roots = new, new.select("node", "root")
        roots._scratch = written_roots._scratch
        if not changed:
            discard(both)
            settle(edges.sparkSession)
            return roots


def _cut(docs: DataFrame, ids: DataFrame, few: bool, make, shingle: int, schema: str) -> DataFrame:
    """make() of the documents with these ids, which are sent to every executor if they are few; only their texts are cut again."""
    return _each(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), shingle, make, schema)


def _meet(pairs: DataFrame, docs: DataFrame, shingle: int, make, compare, schema: str) -> DataFrame:
    """A written table of what compare(host, guest, blob of host, blob of guest) returns for each pair (host, guest) of a written table; blobs are what make() gives for a set.

    A host's blob goes once to each of its tasks, its guests' blobs follow, and a task holds one host's blob at a time. A host
    of many guests has several tasks."""
    n = pairs.count()
    if not n:
        return empty(docs.sparkSession, schema)
    few = n <= BROADCAST_IDS
    m = F.count("*").over(Window.partitionBy("host"))
    hosted = pairs.select("host", "guest", m.alias("m")).select("host", "guest", F.pmod(F.xxhash64("guest"), F.ceil(F.col("m") / GUESTS)).cast("int").alias("part"))
    both = F.array(F.struct(F.col("guest").alias("doc_id"), F.lit(False).alias("hosts")), F.struct(F.col("host").alias("doc_id"), F.lit(True).alias("hosts")))
    routes = written(hosted.select("host", "part", F.explode(both).alias("x")).select("x.doc_id", "host", "part", "x.hosts").distinct(), "routes")
    blobs = _cut(docs, routes.select("doc_id").distinct(), few, lambda doc, tokens: ((doc, make(tokens)), None), shingle, "doc_id long, blob binary")
    rows = blobs.join(F.broadcast(routes) if few else routes, "doc_id").repartition("host", "part").sortWithinPartitions("host", "part", F.desc("hosts"), "doc_id")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for pdf in batches:
            made = []
            for doc, host, part, hosts, blob in zip(pdf["doc_id"], pdf["host"], pdf["part"], pdf["hosts"], pdf["blob"], strict=True):
                if (host, part) != now:
                    now, held = (host, part), []
                if not hosts:
                    made += [compare(host, doc, x, blob) for x in held]
                elif blob not in held:  # rows that share an id
                    held.append(blob)
            made = [x for x in made if x is not None]
            if made:
                yield pd.DataFrame(made, columns=names)

    out = written(rows.select("doc_id", "host", "part", "hosts", "blob").mapInPandas(run, schema), "met", BATCH_BYTES)
    discard(routes)
    settle(docs.sparkSession)
    return out


class Signature:
    """A set's size and the first tokens, 32 bits of each, under the second and the third order.

    Among the first n - ceil(t * n) + l tokens of each, similar sets share l. more is the largest l that a set has tokens
    for; two sets take the smaller one of theirs. Shorter hashes can only make more of them equal."""

    def __init__(self, blob: bytes):
        self.n, self.base, self.more = np.frombuffer(blob, np.int32, 3).tolist()
        size = self.base + self.more
        self.orders = np.frombuffer(blob, np.uint32, 2 * size, 12).reshape(2, size)
        self.rest = blob[12 + 8 * size :]

    @staticmethod
    def blob(tokens: np.ndarray, known: Frequent, percent: int) -> bytes:
        """The signature as bytes; what is put after them is in .rest."""
        n = len(tokens)
        least = -(-percent * n // 100)
        base, more = n - least, min(least, 1 + (100 - percent) * n // 100)
        firsts = [(prefix(tokens, known, order, base + more) >> np.uint64(32)).astype(np.uint32) for order in (1, 2)]
        return b"".join([np.array([n, base, more], np.int32).tobytes(), *(x.tobytes() for x in firsts)])

    def shared(self, other: Signature, percent: int) -> float:
        """What the two share, of what similar sets share at least, in the order in which that is less; 0 if their sizes are too far apart."""
        if 100 * min(self.n, other.n) < percent * max(self.n, other.n):
            return 0.0
        most = min(self.more, other.more)
        return min(int(np.isin(x[: self.base + most], y[: other.base + most]).sum()) for x, y in zip(self.orders, other.orders, strict=True)) / max(most, 1)


def _filtered(pairs: DataFrame, docs: DataFrame, known, shingle: int, percent: int, least: float = 1.0) -> DataFrame:
    """(host, guest, share), written: the pairs that the second and the third order leave, where similar sets have a share of 1 or more."""

    def compare(host, guest, x, y):
        share = Signature(x).shared(Signature(y), percent)
        return (host, guest, share) if share >= least else None

    return _meet(pairs, docs, shingle, lambda tokens: Signature.blob(tokens, known.value, percent), compare, "host long, guest long, share double")


def _verify(pairs: DataFrame, docs: DataFrame, known, shingle: int, percent: int, at_once: bool = False) -> DataFrame:
    """(a, b), a < b, written: the pairs (host, guest) that pass the filters of the other orders and are similar.

    Whole sets are only sent for pairs that have passed; with at_once, which is for pairs that mostly pass, together with what the filters need."""

    def similar(host, guest, x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return (min(host, guest), max(host, guest)) if 100 * common >= percent * (len(x) + len(y) - common) else None

    def filtered_and_similar(host, guest, x, y):
        x, y = Signature(x), Signature(y)
        return similar(host, guest, x.rest, y.rest) if x.shared(y, percent) >= 1 else None

    if at_once:
        return _meet(pairs, docs, shingle, lambda tokens: Signature.blob(tokens, known.value, percent) + tokens.tobytes(), filtered_and_similar, "a long, b long")
    passed = _filtered(pairs, docs, known, shingle, percent)
    found = _meet(passed, docs, shingle, lambda tokens: tokens.tobytes(), similar, "a long, b long")
    discard(passed)
    return found


def _differences(spokes: DataFrame, docs: DataFrame, known, shingle: int, percent: int) -> DataFrame:
    """(doc_id, hub, n, linked, parts), written, for those (doc_id, hub) of which the orders' filters find half of what similar sets share:
    whether they are similar, and the tokens that only one of them has, if these are fewer than the document's own.

    A link to a hub has passed the filters of all orders, as other links have."""
    pairs = written(spokes.filter("doc_id <> hub").select(F.col("hub").alias("host"), F.col("doc_id").alias("guest")), "pairs")
    close = _filtered(pairs, docs, known, shingle, percent, 0.5)

    def compare(host, guest, x, y):
        x, y = Signature(x), Signature(y)
        a, b = np.frombuffer(x.rest, np.uint64), np.frombuffer(y.rest, np.uint64)
        apart = np.setxor1d(a, b, True)
        common = (len(a) + len(b) - len(apart)) // 2
        linked = x.shared(y, percent) >= 1 and 100 * common >= percent * (common + len(apart))
        return (guest, host, len(b), linked, apart.view(np.int64)) if len(apart) <= len(b) else None

    out = _meet(close, docs, shingle, lambda tokens: Signature.blob(tokens, known.value, percent) + tokens.tobytes(), compare, "doc_id long, hub long, n long, linked boolean, parts array<long>")
    discard(pairs, close)
    return out


def _shared_differences(spokes: DataFrame, percent: int) -> DataFrame:
    """(hub, token, doc_id, n, d, left, weight): the first tokens of the documents' differences from their hub that others of the family have.

    They are ordered by how often the family has them; how many a set needs is bounded by its own size, as a partner's
    size is. weight: how far the document's differences are those of others."""
    cells = spokes.select("hub", "doc_id", "cut", "n", F.size("parts").alias("d"), F.explode("parts").alias("token"))
    often = cells.groupBy("hub", "token").agg(F.count("*").alias("df")).filter("df > 1")
    one = Window.partitionBy("hub", "doc_id", "cut")
    # a token that one document has alone comes before all others of it: what follows is only moved by their number
    rows = cells.join(often, ["hub", "token"]).withColumn("alone", F.col("d") - F.count("*").over(one))
    rows = rows.withColumn("pos", F.col("alone") + F.row_number().over(one.orderBy("df", "token")) - 1).withColumn("weight", (F.col("alone") + F.sum("df").over(one)) / F.col("d"))
    most = F.floor((100 - percent) * (F.col("n") + 100 * F.col("n") / percent) / (100 + percent))
    return rows.filter(F.col("pos") <= most).select("hub", "token", "doc_id", "n", "d", (F.col("d") - F.col("pos")).alias("left"), "weight")


def _crossed(a: DataFrame, b: DataFrame, keys: list[str], largest: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """a and b joined by keys, with fields as ..._a and ..._b, without pairs of two documents of the key's largest class; only keys in largest.

    One join: a second key sends those of a's largest class to what others b has, and the rest of a to all of b."""
    hint = F.broadcast if largest.count() <= BROADCAST_IDS else lambda x: x
    top = F.col("root") == F.col("largest")
    to_others = {"a": top, "b": F.explode(F.when(top, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))}
    sides = [rows.join(hint(largest), keys).withColumn("to_others", to_others[name]).select(*keys, "to_others", *(F.col(f).alias(f"{f}_{name}") for f in fields)) for name, rows in (("a", a), ("b", b))]
    return sides[0].join(sides[1], [*keys, "to_others"])


def _pairs_of_a_hub(rows: DataFrame, roots: DataFrame, percent: int, star: int | None = None) -> DataFrame:
    """Pairs (host, guest) of different classes in the same family that can be similar; with star, only those with one document of each bucket, the host.

    Sets that share nothing of their differences from the hub are similar only if both are similar to the hub, and so of
    its class. Others share one of the tokens in rows."""
    roots = roots.select(F.col("node").alias("doc_id"), "root")
    rows = rows.join(F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    fields, keys = ("doc_id", "n", "d", "root", "left"), ["hub", "token"]
    if star is None:
        classes = rows.groupBy(*keys, "root").agg(F.count("*").alias("m"))
        largest = written(classes.groupBy(*keys).agg(F.count("*").alias("classes"), F.max(F.struct("m", "root")).alias("top")).filter("classes > 1").select(*keys, F.col("top.root").alias("largest")), "largest")
        pairs = _crossed(rows, rows, keys, largest, fields).filter("doc_id_a <> doc_id_b")
    else:
        first = F.col("weight") if star == 0 else F.xxhash64("doc_id", F.lit(star))
        open_ = rows.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct(first.alias("first"), -F.col("doc_id"), *fields)).alias("top")).filter("lo < hi")
        a = rows.select(*keys, *(F.col(c).alias(f"{c}_a") for c in fields))
        pairs = a.join(open_.select(*keys, *(F.col(f"top.{c}").alias(f"{c}_b") for c in fields)), keys)
    near = (100 + percent) * (F.col("d_a") + F.col("d_b") - 2 * F.least("left_a", "left_b")) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    fit = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    pairs = pairs.filter((F.col("root_a") != F.col("root_b")) & fit & near)
    if star is None:
        return pairs.select(F.least("doc_id_a", "doc_id_b").alias("host"), F.greatest("doc_id_a", "doc_id_b").alias("guest")).distinct()
    return pairs.select(F.col("doc_id_b").alias("host"), F.col("doc_id_a").alias("guest")).distinct()


def size_class(n, percent: int):
    """A whole number for a set's size: the classes of similar sets differ by one at most."""
    return F.floor(F.log(n.cast("double")) / (1.001 * math.log(100 / percent))).cast("int")


def _pairs_across_hubs(rows: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (host, guest) of different classes and hubs that share a prefix token where similar sets can.

    a is the smaller set of the two, its size class that of b or the one before."""
    own = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
    fields, keys = ("doc_id", "n", "left", "hub", "root"), ["token", "size"]
    now = rows.select("token", "doc_id", "n", "left", "near", size_class(F.col("n"), percent).alias("own")).join(own, "doc_id")
    both = now.withColumn("size", F.explode(F.array("own", F.col("own") + 1)))
    classes = both.groupBy(*keys, "root").agg(F.count("*").alias("m"), F.min("hub").alias("h1"), F.max("hub").alias("h2"), F.max("near").alias("any"))
    open_ = classes.groupBy(*keys).agg(F.count("*").alias("classes"), F.min("h1").alias("h1"), F.max("h2").alias("h2"), F.max("any").alias("any"), F.max(F.struct("m", "root")).alias("top"))
    largest = written(open_.filter("classes > 1 AND h1 < h2 AND any").select(*keys, F.col("top.root").alias("largest")), "largest")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("doc_id_a") < F.col("doc_id_b")))
    other = (F.col("hub_a") != F.col("hub_b")) & (F.col("root_a") != F.col("root_b"))
    found = _crossed(both.filter("near"), both.filter("size = own"), keys, largest, fields).filter(smaller & other & fits(F.col("n_a"), F.col("n_b"), F.col("left_a"), F.col("left_b"), percent))
    return found.select(F.least("doc_id_a", "doc_id_b").alias("host"), F.greatest("doc_id_a", "doc_id_b").alias("guest")).distinct()


def _links_of_ids(rows: DataFrame, sets: DataFrame, n_rows: int) -> DataFrame:
    """(a, b): rows that share an id are one document, which links with each of its sets."""
    h = F.xxhash64("key")
    odd = rows.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo < hi").select("doc_id")
    odd = written(odd, "odd")
    if odd.isEmpty():
        return odd.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    some = rows.join(F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd, "doc_id", "left_semi").select("doc_id", "key").distinct()
    return weighed(some, sets, "key", "copies", n_rows).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, key, rep, root), written, for every row of (doc_id, text): rep is the smallest id with the same set, root that of its class."""
    spark = docs.sparkSession

    def first_pass(doc, tokens):
        size = prefix_size(len(tokens), percent) if len(tokens) else 0
        return (doc, len(tokens), xxhash.xxh3_128_digest(tokens.tobytes())), tokens[: size + size // 2 + 4]

    shingled = written(_each(docs, shingle, first_pass, "doc_id long, n long, key binary", True), "shingled", BATCH_BYTES)
    base = shingled.filter("bucket IS NULL").select("doc_id", "n", "key")
    some = base.filter("n > 0 AND doc_id IS NOT NULL")
    n_rows = base.count()
    sets = written(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "sets")
    listed = some.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(BITS, int(listed * 3 * (100 - percent) // 100).bit_length()))
    known = spark.sparkContext.broadcast(frequent(shingled.filter("bucket IS NOT NULL").select("bucket", "hashes"), THRESHOLDS, bits))

    def second_pass(doc, tokens):
        first = prefix(tokens, known.value, 0, prefix_size(len(tokens), percent)) if len(tokens) else tokens
        return (doc, len(tokens), first.tobytes()), first

    prefixes = written(_each(docs.filter("doc_id IS NOT NULL"), shingle, second_pass, "doc_id long, n long, first binary", True), "prefixes", BATCH_BYTES)
    # most tokens are in one prefix only: a bitmap leaves them out before any row is made of them
    twice = spark.sparkContext.broadcast(frequent(prefixes.filter("bucket IS NOT NULL").select("bucket", "hashes"), (2,), bits))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            firsts = [np.frombuffer(x, np.uint64) for x in pdf["first"]]
            sizes = np.array([len(x) for x in firsts])
            tokens = np.concatenate(firsts)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(twice.value.levels(tokens))
            n = np.repeat(pdf["n"].to_numpy(np.int64), sizes)[at]
            yield pd.DataFrame({"token": tokens[at].view(np.int64), "doc_id": np.repeat(pdf["doc_id"].to_numpy(np.int64), sizes)[at], "n": n, "left": n - pos[at]})

    rows = prefixes.filter("n > 0").select("doc_id", "n", "first").mapInPandas(spread, "token long, doc_id long, n long, left long")
    reps = sets.select(F.col("rep").alias("doc_id"))
    spread_rows = written(rows.join(reps, "doc_id", "left_semi"), "spread", BATCH_BYTES)
    # the smaller set of a pair has the shared token near its start
    near = (100 + percent) * F.col("left") >= 2 * percent * F.col("n")
    shared = written(spread_rows.groupBy("token").agg(F.count("*").alias("df"), F.count(F.when(near, 1)).alias("near")).filter("df > 1 AND near > 0").select("token", "df"), "tokens")
    rows = written(weighed(spread_rows, shared, "token", "df", spread_rows.count()).withColumn("near", near), "buckets")
    discard(prefixes, spread_rows, shared)
    twice.destroy()

    # a hub for each document: of the largest bucket of its token and size; hubs are documents of which most tokens are frequent
    large = rows.filter(F.col("df") >= FAMILY)
    weight = large.groupBy("doc_id").agg((F.sum("df") / F.max("n")).alias("weight"))
    large = large.join(weight, "doc_id").withColumn("size", F.explode(F.array(size_class(F.col("n"), percent), size_class(F.col("n"), percent) + 1)))
    best = written(large.groupBy("token", "size").agg(F.count("*").alias("m"), F.max(F.struct("weight", -F.col("doc_id"), "doc_id")).alias("top")).filter(F.col("m") >= FAMILY).select("token", "size", "m", F.col("top.doc_id").alias("hub")), "hubs")
    spokes = large.select("token", "size", "doc_id").join(F.broadcast(best) if best.count() <= BROADCAST_IDS else best, ["token", "size"]).groupBy("doc_id").agg(F.max(F.struct("m", "hub")).alias("top"))
    spokes = written(spokes.select("doc_id", F.col("top.hub").alias("hub")), "spokes")
    apart = _differences(spokes, docs, known, shingle, percent)
    # no pair is tested twice, whichever of the two was the host
    sorted_pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    fresh = lambda df: df.join(tested, (F.least("host", "guest") == F.col("a")) & (F.greatest("host", "guest") == F.col("b")), "left_anti")
    tested = sorted_pair(spokes.filter("doc_id <> hub"), "doc_id", "hub")
    links = apart.filter("linked").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    found = []
    roots = components(links)
    if apart.isEmpty():
        family = empty(spark, "hub long, token long, doc_id long, n long, d int, left long, weight double")
    else:
        family = written(_shared_differences(apart.withColumn("cut", F.xxhash64("parts")).dropDuplicates(["doc_id", "hub", "cut"]), percent), "family")
    for star in range(STARS):
        pairs = written(fresh(_pairs_of_a_hub(family, roots, percent, star)), "pairs")
        if pairs.isEmpty():
            break
        found.append(_verify(pairs, docs, known, shingle, percent, True))
        links, tested = links.unionByName(found[-1]), tested.unionByName(sorted_pair(pairs, "host", "guest"))
        discard(roots)
        roots = components(links)
    by_node = roots.withColumnRenamed("node", "doc_id")
    own = rows.select("doc_id").distinct().join(apart.select("doc_id", "hub").distinct(), "doc_id", "left").join(by_node, "doc_id", "left")
    own = written(own.select("doc_id", F.coalesce("hub", "doc_id").alias("hub"), F.coalesce("root", "doc_id").alias("root")), "classes")
    # what the driver compiles, and broadcasts at the same time, grows with a plan: each kind of pairs has its own
    across, inside = written(_pairs_across_hubs(rows, own, percent), "across"), written(_pairs_of_a_hub(family, roots, percent), "inside")
    pairs = written(fresh(across.unionByName(inside).distinct()), "pairs")
    discard(across, inside)
    found.append(_verify(pairs, docs, known, shingle, percent))
    discard(roots)
    roots = components(links.unionByName(found[-1]).unionByName(_links_of_ids(some, sets, n_rows)))

    # copies meet their set's class by its key: keys of many copies don't meet in one task, and other sets have their own id
    roots = F.broadcast(roots) if roots.count() <= BROADCAST_IDS else roots
    multi = written(sets.filter("copies > 1").join(roots.withColumnRenamed("node", "rep"), "rep", "left"), "copied")
    copied = some.join(F.broadcast(multi), "key", "left") if multi.count() <= BROADCAST_IDS else weighed(some, multi, "key", "copies", n_rows, "left")
    single = copied.filter("rep IS NULL").select("doc_id", "n", "key").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    parts = (copied.filter("rep IS NOT NULL"), single.withColumn("rep", F.col("doc_id")), base.filter("n = 0 OR doc_id IS NULL").withColumn("rep", F.lit(None).cast("long")).withColumn("root", F.lit(None).cast("long")))
    out = [x.select("doc_id", "n", "key", "rep", "root") for x in parts]
    known_sets = written(out[0].unionByName(out[1]).unionByName(out[2]), "known")
    discard(shingled, sets, multi, rows, spokes, apart, family, own, pairs)
    known.destroy()
    return known_sets


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set, and the smallest id reachable by links.

    Texts that are null, empty or without words have empty sets and link with nothing. Rows that share an id count as
    one document; rows without an id get no component and link nothing. An empty table gives no rows."""
    found = _classes(_plain(docs, id_col, text_col), shingle, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a has in common with each of b. Tokens of many sets are multiplied as matrices, others matched."""
    out = np.zeros(len(a) * len(b), np.int64)
    tokens, of_a = np.unique(np.concatenate(a), return_inverse=True)
    set_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    set_b, listed = np.repeat(np.arange(len(b)), [len(x) for x in b]), np.concatenate(b)
    of_b = np.minimum(np.searchsorted(tokens, listed), len(tokens) - 1)
    same = tokens[of_b] == listed
    of_b, set_b = of_b[same], set_b[same]
    n_a, n_b = np.bincount(of_a, minlength=len(tokens)), np.bincount(of_b, minlength=len(tokens))
    many = 64 * n_a * n_b > max(len(a) * len(b), 4096)
    for some in np.split(np.flatnonzero(many), np.arange(2048, int(many.sum()), 2048)):
        column = np.full(len(tokens), -1)
        column[some] = np.arange(len(some))
        sides = []
        for at, sets, n in ((of_a, set_a, len(a)), (of_b, set_b, len(b))):
            has = column[at] >= 0
            sides.append(np.zeros((n, len(some)), np.float32))
            sides[-1][sets[has], column[at[has]]] = 1
        out += (sides[0] @ sides[1].T).astype(np.int64).ravel()
    few_a, few_b = ~many[of_a], ~many[of_b]
    order = np.argsort(of_a[few_a], kind="stable")
    in_a, n_a = set_a[few_a][order], np.where(many, 0, n_a)
    first, at, set_b = np.cumsum(n_a) - n_a, of_b[few_b], set_b[few_b]
    ends = np.cumsum(n_a[at])
    for some in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(1 << 22, int(ends[-1]) if len(ends) else 0, 1 << 22))):
        n = n_a[at[some]]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at[some]], n)
        where, times = np.unique(in_a[place] * len(b) + np.repeat(set_b[some], n), return_counts=True)
        out[where] += times
    return out.reshape(len(a), len(b))


def _compared(docs: DataFrame, known: DataFrame, shingle: int, percent: int, schema: str, make) -> DataFrame:
    """What make(sets of a block, sets of another or the same one, which of them are similar) gives, over all blocks of all classes.

    Each set has key, rep and weight, the number of documents that have it."""
    sets = known.filter("rep IS NOT NULL").groupBy("key", "rep", F.coalesce("root", "rep").alias("class"), "n").agg(F.countDistinct("doc_id").alias("weight"))
    sets = written(sets, "sets")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks")
    several = written(sets.groupBy("class").agg(F.count("*").alias("m"), blocks).filter("m > 1").drop("m"), "several")
    members = written(sets.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several, "class"), "members")

    def cut(doc, tokens):
        return (doc, xxhash.xxh3_128_digest(tokens.tobytes()), tokens.tobytes()), None

    full = written(_cut(docs, members.select(F.col("rep").alias("doc_id")), members.count() <= BROADCAST_IDS, cut, shingle, "doc_id long, key binary, tokens binary"), "sets", BATCH_BYTES)
    rows = full.withColumnRenamed("doc_id", "rep").join(F.broadcast(members) if members.count() <= BROADCAST_IDS else members, ["rep", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        parts = [pdf[pdf["block"] == i].sort_values("rep") for i in (pdf["x"].iloc[0], pdf["y"].iloc[0])]
        if not len(parts[0]) or not len(parts[1]):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        a, b = ([np.frombuffer(t, np.uint64) for t in p["tokens"]] for p in parts)
        common = overlaps(a, b)
        either = np.array([len(t) for t in a])[:, None] + np.array([len(t) for t in b])[None, :] - common
        near = 100 * common >= percent * either
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:
            near = np.triu(near, 1)
        return make(*parts, near)

    rows = rows.select("class", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "key", "rep", "weight", "tokens")
    return rows.groupBy("class", "x", "y").applyInPandas(run, schema)


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """similar_documents with set_id, the smallest id with the same set, and n_links: with how many other documents a row's text is similar.

    Documents with equal sets are linked, too. Rows without an id or without words have no set_id and no link."""
    docs = _plain(docs, id_col, text_col)
    known = _classes(docs, shingle, percent)

    def count(a: pd.DataFrame, b: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        links = np.concatenate([near @ b["weight"].to_numpy(np.int64), near.T @ a["weight"].to_numpy(np.int64)])
        return pd.DataFrame({"key": [*a["key"], *b["key"]], "links": links}).query("links > 0")

    links = _compared(docs, known, shingle, percent, "key binary, links long", count).groupBy("key").agg(F.sum("links").alias("links"))
    same = known.filter("rep IS NOT NULL").groupBy("key").agg((F.countDistinct("doc_id") - 1).alias("copies")).filter("copies > 0")
    links = written(links.join(same, "key", "full").select("key", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("links")), "counts")
    rows = known.join(F.broadcast(links) if links.count() <= BROADCAST_IDS else links, "key", "left")
    n_links = F.when(F.col("rep").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"), F.col("rep").alias("set_id"), n_links.alias("n_links"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: every two different sets that are similar, by the set_id of linked_documents. A family of n near copies has up to n (n - 1) / 2."""
    docs = _plain(docs, id_col, text_col)
    known = _classes(docs, shingle, percent)

    def pairs(a: pd.DataFrame, b: pd.DataFrame, near: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(near)
        x, y = a["rep"].to_numpy(np.int64)[i], b["rep"].to_numpy(np.int64)[j]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return _compared(docs, known, shingle, percent, "a long, b long", pairs).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each class, the one with the smallest id; columns stay.

    Rows that share an id are one document, and one row of it stays if it is the one of its class. Rows without an id stay."""
    found = _classes(_plain(docs, id_col, text_col), shingle, percent)
    root = F.coalesce("root", "rep", "doc_id")
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(root).alias("root"), F.count("*").alias("rows"))
    ids = written(ids.filter((F.col("doc_id") != F.col("root")) | (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), (F.col("doc_id") != F.col("root")).alias("_other")), "ids")
    few = F.broadcast if ids.count() <= BROADCAST_IDS else lambda x: x
    kept = docs.join(few(ids), docs[id_col] == ids["_id"], "left_anti")
    twice = ids.filter("NOT _other")
    if twice.isEmpty():
        return kept
    return kept.unionByName(docs.join(few(twice), docs[id_col] == twice["_id"], "left_semi").dropDuplicates([id_col]))


#: The same as the query over `documents`, in DuckDB's SQL.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id < b.doc_id AND 100 * least(na.n, nb.n) >= {PERCENT} * greatest(na.n, nb.n)
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edge.b, root FROM reach JOIN edge ON edge.a = node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
#: The same with the number of links, for linked_documents without set_id.
LINKS_SQL = SQL.replace("component_id FROM documents", "component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY 1) USING (doc_id)")
