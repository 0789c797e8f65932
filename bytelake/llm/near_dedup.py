"""Near duplicates by improved consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.common import discard, small, without, written

SHINGLE_WORDS = 5
#: Buckets of shingle hashes by which document frequencies are kept: their table is of this size for any corpus.
BUCKETS = 1 << 18
BANDS, ROWS = 12, 4
#: Random draws of the sampling are taken from a fixed pool of this size.
POOL = 1 << 16
#: ASCII punctuation and white space part words.
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of a 64-bit hash."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the text's five-word shingles and their counts. A shorter text is one shingle; one without words has none."""
    import xxhash

    words = text.lower().encode().translate(_SPACES).split()
    if not words:
        return np.empty(0, _U), np.empty(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = max(1, len(w) - SHINGLE_WORDS + 1)
    h = np.zeros(n, _U)
    for k in range(min(SHINGLE_WORDS, len(w))):
        h = _mix(h + w[k : k + n])
    return np.unique(h, return_counts=True)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(46)).astype(np.int64)


class Weights:
    """Weights of a text's shingles, for sampling and similarity alike: the count there times an inverse document frequency.

    That is 1 + ln(n / df) / ln n, between 1 and 2, so the many copies of one text, which lower the weight of all that they share, stay similar.
    """

    def __init__(self, frequencies: np.ndarray, n_docs: int):
        log = np.log((n_docs + 1.0) / (np.minimum(frequencies, n_docs) + 1.0))
        self.idf = 1.0 + log / np.log(n_docs + 2.0)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h, n = shingles(text)
        return h, n * self.idf[bucket_of(h)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller weights by sum of larger ones; 0 where both have none."""
    total = a[1].sum() + b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both)) if total else 0.0


class Sampler:
    """BANDS * ROWS consistent weighted samples of a text, as one hash for each band.

    For each sample and shingle, r and c are Gamma(2, 1) and beta is uniform; t = floor(ln w / r + beta) and
    ln a = ln c + r (beta - 1) - r t; the shingle of the least a is sampled together with its t. Two texts agree in a sample with
    the probability of their weighted Jaccard similarity. The draws are taken from a pool by a multiplicative hash for each sample.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        r, c, beta = rng.gamma(2.0, 1.0, POOL), rng.gamma(2.0, 1.0, POOL), rng.random(POOL)
        self.by_r, self.beta, self.r = (1.0 / r).astype(np.float32), beta.astype(np.float32), r.astype(np.float32)
        self.rest = (np.log(c) + r * (beta - 1.0)).astype(np.float32)  # ln a without its term of t
        self.times = rng.integers(1, 2**63, BANDS * ROWS, dtype=_U) * _U(2) + _U(1)

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        k = BANDS * ROWS
        ln_ws = np.log(weights).astype(np.float32)
        least, sample, cols = np.full(k, np.inf, np.float32), np.zeros(k, _U), np.arange(k)
        for s in range(0, len(hashes), 256):  # a block fits the processor's cache
            at = ((hashes[s : s + 256, None] * self.times) >> _U(48)).astype(np.int32)
            t = self.by_r.take(at)
            t *= ln_ws[s : s + 256, None]
            t += self.beta.take(at)
            np.floor(t, out=t)
            ln_a = self.rest.take(at)
            ln_a -= self.r.take(at) * t
            first = ln_a.argmin(axis=0)
            found = ln_a[first, cols]
            got = _mix(hashes[s + first] + _U(0x632BE59BD9B4E019) * t[first, cols].astype(np.int64).astype(_U))
            sample = np.where(found < least, got, sample)
            least = np.minimum(found, least)
        out = np.arange(1, BANDS + 1, dtype=_U)
        for row in sample.reshape(BANDS, ROWS).T:
            out = _mix(out + row)
        return out.astype(np.int64)


def _frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket, the documents with a shingle in it, over all texts; and the number of texts. BUCKETS rows reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[np.unique(bucket_of(shingles(text)[0]))] += 1
                n += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(part, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def _verified(pairs: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """Of pairs (a, b) (a written table), those of at least that weighted Jaccard similarity. b is the side that many pairs share.

    Texts are sought by the pairs, so only those of pairs are moved.
    """
    leaders = written(pairs.select("b").distinct(), "leaders")
    both = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(small(pairs), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(small(leaders), "b", "left_semi"), "b")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, last, of_last = weights.value, None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = []
            for k, leader in enumerate(b.to_pylist()):
                if of_last is None or leader != last:
                    last, of_last = leader, w.of(tb[k].as_py())
                keep.append(weighted_jaccard(w.of(ta[k].as_py()), of_last) >= similarity)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(part, "a long, b long")


#: Bands of at most this many texts are compared pair by pair; larger ones in blocks.
SMALL, BLOCK = 32, 512


def _compact(text: str) -> bytes:
    """The upper halves of a text's shingle hashes, each as often as it occurs, in order: enough for a similarity that is at most a trifle too high."""
    h, n = shingles(text)
    return np.repeat((h >> _U(32)).astype(np.uint32), n).tobytes()


def _compare(mine: list[tuple], others: list[tuple], idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (id, id) of members (id, label, compact hashes, of the largest class) of different labels that may be similar: of mine with others.

    Overlaps are summed up through an index of the others' hashes, so the work is in what two texts share. A pair that is met from both sides, as neither is of
    the band's largest class, is given once.
    """
    hashes = [np.unique(np.frombuffer(m[2], np.uint32), return_counts=True) for m in others]
    owner = np.repeat(np.arange(len(others)), [len(h) for h, _ in hashes])
    flat = np.concatenate([h for h, _ in hashes]) if hashes else np.empty(0, np.uint32)
    weight = np.concatenate([n for _, n in hashes]) * idf[flat >> 14] if len(flat) else np.empty(0)
    total = np.bincount(owner, weight, len(others))
    order = np.argsort(flat, kind="stable")
    flat, owner, weight = flat[order], owner[order], weight[order]
    ids, labels, largest, out = np.array([m[0] for m in others]), np.array([m[1] for m in others]), np.array([m[3] for m in others], bool), []
    for i, label, raw, _ in mine:
        h, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
        w = n * idf[h >> 14]
        lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        length = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(h) else np.empty(0, np.int64)
        both = np.bincount(owner[at], np.minimum(weight[at], np.repeat(w, length)), len(others))
        found = (both >= (similarity - 1e-6) * (total + w.sum() - both)) & (labels != label) & (largest | (ids > i)) & (both > 0)
        out += [(i, int(j)) for j in ids[found]]
    return out


def _all_pairs(active: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """Pairs (a, b) of one band and different labels, for verification: all of them in small bands, and in large ones those that may be similar.

    Of a large band, the members of its largest class are not compared with each other: all others, cut into blocks of some BLOCK texts, meet every block of the whole band, each two
    blocks in one task. So a band of many copies and a few strangers costs its size times the strangers, and no pair is a row before it is found similar.
    """
    classes = active.groupBy("band", "label").agg(F.count("*").alias("n"))
    sizes = written(classes.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top")).select("band", "n", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("others")), "sizes")
    few = active.join(sizes.where(F.col("n") <= SMALL).select("band"), "band")
    other = few.select("band", F.col("id").alias("b"), F.col("label").alias("other"))
    pairs = few.withColumnRenamed("id", "a").join(other, "band").where("label < other").select("a", "b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    probes = F.ceil(F.col("others") / BLOCK).cast("int")
    many = active.join(sizes.where((F.col("n") > SMALL) & (F.col("others") > 0)), "band").withColumn("largest", F.col("label") == F.col("top"))
    many = many.select("band", "id", "label", "largest", F.pmod(F.xxhash64("id"), probes).cast("int").alias("i"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("j"), probes.alias("probes"), blocks.alias("blocks"))
    many = written(many, "large-bands")
    asking = many.where("NOT largest").select("band", "id", "label", "largest", F.lit(True).alias("asks"), "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    asked = many.select("band", "id", "label", "largest", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("probes") - 1)).alias("i"), "j")
    meet = asking.unionByName(asked.select(*asking.columns))
    ids = written(many.select("id").distinct(), "large-ids")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_compact(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "hashes"])

    hashes = texts.join(small(ids), "id", "left_semi").select("id", "text").mapInArrow(compact, "id long, hashes binary")

    def compared(key, table):
        rows = list(zip(*(table.column(c).to_pylist() for c in ("id", "label", "hashes", "largest", "asks")), strict=True))
        got = _compare(sorted(r[:4] for r in rows if r[4]), sorted(r[:4] for r in rows if not r[4]), weights.value.idf, similarity)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    found = meet.join(hashes, "id").groupBy("band", "i", "j").applyInArrow(compared, "a long, b long")
    return pairs.unionByName(found)


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, label) for every id of edges (a, b): label is the least id of its connected component.

    Each round, every node takes the least label around it, and then that label's own; edges are drawn between labels until none is left.
    Each round's tables are written to the shared folder.
    """
    left = edges.where("a <> b").select("a", "b")
    labels, done = None, []
    while True:
        both = written(left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
        discard(*done)
        if both.isEmpty():
            break
        least = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "least")
        up = least.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = written(least.join(up, "label").select("id", F.col("up").alias("label")), "jumped")
        discard(least)
        if labels is None:
            labels = written(jumped, "labels")
        else:
            near = jumped.select(F.col("id").alias("label"), F.col("label").alias("up"))
            old, labels = labels, written(labels.join(near, "label", "left").select("id", F.coalesce("up", "label").alias("label")), "labels")
            discard(old)
        to = jumped.select(F.col("id").alias("a"), F.col("label").alias("la"))
        left = both.where("a < b").join(to, "a").join(to.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b")
        left = left.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        done = [both, jumped]
    return labels if labels is not None else both.select(F.col("a").alias("id"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, rounds: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its class), rep_id (least id of its text), n_copies (rows of its text), n_links.

    Two texts are linked if they share a band of samples and their weighted Jaccard similarity is at least `similarity`; a class is a connected component of
    links. Equal texts are one node, however often a row of them is repeated. n_links counts the links that were needed to find the classes of this text (0: it is alone or has exact copies only).

    Texts that share a band are compared with two leaders of the band, drawn anew in each of `rounds` rounds, unless their classes are already one; after these
    rounds, all texts of a band whose classes still differ are compared, those of large bands block by block. So every link between different classes is found, and a band of many copies
    costs its size times the leaders, and times those of its texts that are not of its largest class. Document frequencies are over all distinct texts, by hash bucket.

    Texts without words (null, empty) are equal only to the same text: null counts as empty. Null ids come back once a row with null class_id, rep_id and n_links 0.
    Rows that repeat an id are classed by their own text. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("near"), "text").alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep_id"), F.count("*").alias("n_copies"))
    # numbers of texts, unique by construction and fixed from here on, as the table is written
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "copies")
    reps = groups.where("rep_id IS NOT NULL").select("h1", "h2", F.col("rep_id").alias("id"), "node")
    texts = written(keyed.join(reps, ["h1", "h2", "id"]).select(F.col("node").alias("id"), "text"), "texts")
    if texts.count() > reps.count():  # rows that repeat both id and text
        texts = written(texts.dropDuplicates(["id"]), "texts")
    frequencies, n_docs = _frequencies(texts)
    weights = docs.sparkSession.sparkContext.broadcast(Weights(frequencies, n_docs))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sampler = weights.value, Sampler()
        for batch in batches:
            ids, got = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = w.of(text)
                if len(x[0]):
                    ids.append(i)
                    got.append(sampler.bands(*x))
            flat = np.concatenate(got) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), BANDS)), pa.array(flat)], names=["id", "band"])

    members = written(texts.mapInArrow(bands, "id long, band long"), "members")
    # what is joined by band is written first: both sides then come from shuffles of their own, and AQE may split a band that very many texts share
    shared = written(members.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band"), "shared-bands")
    active = written(members.join(shared, "band").select("band", "id", F.col("id").alias("label")), "bands")
    # only these are compared: from here on, no text that shares no band is moved
    ids = written(active.select("id").distinct(), "near-ids")
    near = written(texts.join(small(ids), "id", "left_semi"), "near-texts")
    discard(members, texts, ids, shared)
    links: list[DataFrame] = []
    label, stale = None, [active]
    for turn in range(rounds + 1):
        by = lambda side: F.xxhash64(F.lit(turn), side)
        if turn < rounds:
            lead = active.groupBy("band").agg(F.min_by(F.struct("id", "label"), by("id")).alias("p"), F.max_by(F.struct("id", "label"), by("id")).alias("q"))
            lead = written(lead, "leads")
            stale.append(lead)
            tried = active.join(lead, "band").select("id", "label", F.explode(F.array("p", "q")).alias("l"))
            tried = tried.where("label <> l.label").select(F.col("id").alias("a"), F.col("l.id").alias("b"))
        else:
            tried = _all_pairs(active, near, weights, similarity)
        # the same two may meet in several bands and as each other's leaders
        tried = tried.select(F.col("a"), F.col("b"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        tried = tried.groupBy("x", "y").agg(F.max("b").alias("b"))
        tried = tried.select(F.when(F.col("b") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("a"), "b")
        tried = written(tried, "pairs")
        found = written(_verified(tried, near, weights, similarity), "links")
        discard(tried)
        if not found.isEmpty():
            links.append(found)
            if label is not None:
                discard(label)
            label = components(reduce(DataFrame.union, links))
            active = active.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
        if turn < rounds:
            mixed = written(active.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band"), "mixed-bands")
            active = written(active.join(mixed, "band").select("band", "id", "label"), "bands")
            discard(*stale, mixed)
            stale = [active]
            if active.isEmpty():
                break
    discard(near)
    # classes and links are joined to texts, of which a hot one is a single row, and only then to rows: that join is by the text's hashes, and AQE may split it
    found = groups.select("h1", "h2", "rep_id", "n_copies", "node")
    if links:
        every = reduce(DataFrame.union, links)
        ends = every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        linked = label.select(F.col("id").alias("node"), "label").join(ends, "node").join(groups.select("node", "rep_id"), "node")
        least = linked.groupBy("label").agg(F.min("rep_id").alias("class_id"))
        found = found.join(written(linked.join(least, "label").select("node", "class_id", "n_links"), "classes"), "node", "left")
    else:
        found = found.withColumns({"n_links": F.lit(None).cast("long"), "class_id": F.lit(None).cast("long")})
    found = written(found.select("h1", "h2", "rep_id", "n_copies", F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "text-classes")
    rows = keyed.select("id", "h1", "h2").join(found, ["h1", "h2"])
    known = F.col("id").isNotNull()
    return rows.select(
        F.col("id").alias("doc_id"),
        F.when(known, F.col("class_id")).alias("class_id"),
        F.when(known, F.col("rep_id")).alias("rep_id"),
        "n_copies",
        F.when(known, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows whose class has a smaller id: one document of each class stays. Rows with a null id stay."""
    return without(docs, id_col, near_duplicates(docs, id_col, text_col, **how).where("doc_id <> class_id").select("doc_id"))
