"""Bookmarks whose title and address differ by small edits: weighted minhashing over TF-IDF shingles, banded, verified.

1. The shingles of a row are the tokens of its title with their counts; rows with the same tokens and counts form one
   class, so repeated pages count once from here on. The required score is 0.5 Jaccard of title tokens + 0.5 at most for
   the rest, so a pair that reaches it shares at least ``2 * threshold - 1`` of its title tokens; the address enters with
   the score.
2. Shingle counts over all rows go into a count-min sketch of fixed size, from which the smoothed inverse document
   frequency of a shingle follows; its weight is that times its count in the title.
3. Improved consistent weighted sampling draws ``SAMPLES`` samples of each class; the chance that two classes share a
   sample is their weighted Jaccard similarity. A band hashes ``ROWS`` samples; each sample serves two bands, and no two
   bands share more than one sample.
4. Band hashes travel in packed arrays (about 7 bytes each) with the key of the class. Classes that share a bucket are
   candidates.
5. Candidates are verified: first by an upper bound of the Jaccard similarity from 64 bits and the number of tokens, which
   loses nothing, then by Jaccard and weighted Jaccard on the tokens. Class keys have 40 bits; two classes of one
   key are verified each on its own tokens.
6. Texts of the remaining classes are put into units (same title and canonical address), and pairs of units that are not
   copies are scored exactly. ``near_links`` gives scored pairs of units and the members of units, so copies aren't
   expanded; ``near_pairs`` expands them.

A bucket is never expanded in one place: beyond ``BLOCK`` members it goes out block by block, and pairs of block numbers
spread over all tasks. Nothing is capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.functions import urls
from linklake.functions.fixed import STOPWORDS
from linklake.llm.format_copies import copy_key
from linklake.runtime import Workspace, parallelism

#: Samples of a band; bands come in two rounds of GROUP bands, each of which uses all samples once. GROUP is a prime.
ROWS, GROUP = 4, 19
BANDS, SAMPLES = 2 * GROUP, ROWS * GROUP
#: Members of a bucket that are paired in one go.
BLOCK = 512
#: Rows and columns of the count-min sketch; its size is fixed, so it may be broadcast.
DEPTH, WIDTH = 4, 1 << 18
#: A shingle's frequency is smoothed by this share of all rows.
SMOOTH = 1 / 2000
#: Candidates whose weighted Jaccard similarity is below this go. At a Jaccard similarity of 0.4 a title would have to share only
#: words in every fiftieth title and differ in words that are in none besides to come near it.
LEAST_WEIGHTED = 0.15

_FEATURES = "id bigint, cls bigint, t array<int>, n array<tinyint>"


def bands() -> np.ndarray:
    """Samples of each band. Line a of round c holds the points (k * a + shift * c) of ROWS groups; lines of one round have
    no point in common, lines of different rounds one at most."""
    a, c = np.arange(GROUP)[None, :, None], np.arange(2)[:, None, None]
    slope, shift = np.array([1, 3, 4, 7]), np.array([0, 1, 1, 2])
    return (np.arange(ROWS) * GROUP + (slope * a + shift * c) % GROUP).reshape(BANDS, ROWS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    stop = set(STOPWORDS)
    latin, cjk = re.compile(r"[a-z0-9][a-z0-9+#._\-]+"), re.compile("[一-鿿㐀-䶿]{2,}")
    seen: dict[str, int] = {}

    def hashed(w: str) -> int:
        h = seen.get(w)
        if h is None:
            if len(seen) > 400_000:
                seen.clear()
            h = seen[w] = xxhash.xxh32_intdigest(w) - (1 << 31) if len(w) > 1 and w not in stop else 1 << 31
        return h

    for b in batches:
        titles = b.column(1).to_pylist()
        flat: list[int] = []
        lengths = np.zeros(len(titles), np.int64)
        for i, s in enumerate(titles):
            if s:
                s = s.lower()
                words = [w.rstrip("._-") for w in latin.findall(s)]
                if not s.isascii():
                    for r in cjk.findall(s):
                        words += map("".join, zip(r, r[1:]))
                flat += map(hashed, words)
                lengths[i] = len(words)
        row, token = np.repeat(np.arange(len(titles)), lengths), np.array(flat, np.int64)
        row, token = row[token < 1 << 31], token[token < 1 << 31]
        keys, n = np.unique((row << 32) + (token + (1 << 31)), return_counts=True)
        row, token, n = keys >> 32, ((keys & 0xFFFFFFFF) - (1 << 31)).astype(np.int32), np.minimum(n, 127).astype(np.int8)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(starts):
            continue
        # the key of a class is a sum over its shingles, so it doesn't depend on their order
        mixed = _mix(_mix(token.astype(np.int64).astype(np.uint64)) + n.astype(np.uint64))
        cls = (_mix(np.add.reduceat(mixed, starts)) >> np.uint64(24)).astype(np.int64)
        offsets = pa.array(np.append(starts, len(row)).astype(np.int32))
        ids = b.column(0).take(pa.array(row[starts]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(cls), pa.ListArray.from_arrays(offsets, pa.array(token)), pa.ListArray.from_arrays(offsets, pa.array(n))], names=["id", "cls", "t", "n"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(tokens: np.ndarray) -> np.ndarray:
    t = tokens.astype(np.int64).astype(np.uint64)
    return np.stack([(_mix(t + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) % np.uint64(WIDTH)).astype(np.int64) for k in range(DEPTH)])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(pa.compute.list_value_length(column))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros((DEPTH, WIDTH), np.int64)
    for b in batches:
        values, n = np.unique(_flat(b.column(0))[0], return_counts=True)
        for k, cells in enumerate(_cells(values)):
            sketch[k] += np.bincount(cells, n, WIDTH).astype(np.int64)
    if sketch.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH), pa.int32()), pa.array([r.astype("<i8").tobytes() for r in sketch], pa.binary())], names=["k", "counts"])


def _sum(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in t.column("counts"))
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


class Weights:
    """Smoothed inverse document frequency of a shingle from the sketch: log(1 + rows / (count + SMOOTH * rows))."""

    def __init__(self, sketch: np.ndarray, rows: int):
        self.sketch, self.rows = sketch, rows

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        cells = _cells(tokens)
        n = np.min([self.sketch[k][cells[k]] for k in range(DEPTH)], axis=0)
        return np.log1p(self.rows / (np.maximum(n, 1) + SMOOTH * self.rows))


def _samples(tokens: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """log a of improved consistent weighted sampling for every token and sample: the row's least value is its sample."""
    out = np.empty((len(tokens), k), np.float32)
    lanes = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for i in range(0, len(tokens), 8192):
        seed = _mix(tokens[i : i + 8192].astype(np.int64).astype(np.uint64))[:, None] + lanes[None, :]

        def uniform(n: int, seed=seed) -> tuple[np.ndarray, np.ndarray]:
            x = _mix(seed + np.uint64(n * 0xA0761D6478BD642F & (1 << 64) - 1))
            return tuple(((h.astype(np.float32)) + np.float32(0.5)) * np.float32(2**-32) for h in (x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)))

        a, b = uniform(1)
        r = -np.log(a) - np.log(b)
        a, b = uniform(2)
        log_c = np.log(-np.log(a) - np.log(b))
        beta = uniform(3)[0]
        t = np.floor(np.log(weights[i : i + 8192, None]).astype(np.float32) / r + beta)
        out[i : i + 8192] = log_c - r * (t - beta) - r
    return out


def _pack(hashes: np.ndarray, classes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte planes apart and compressed, then five bytes of each class."""
    steps = np.diff(hashes, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    packed = pa.compress(np.ascontiguousarray(steps).tobytes(), codec="zstd", asbytes=True)
    return len(hashes).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + np.ascontiguousarray(classes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8 : 8 + size], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    classes = np.zeros((n, 8), np.uint8)
    classes[:, :5] = np.frombuffer(blob, np.uint8, offset=8 + size).reshape(n, 5)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32), classes.view("<i8").ravel()


def signatures(tokens: np.ndarray, counts: np.ndarray, lengths: np.ndarray, weigh: Weights) -> np.ndarray:
    """SAMPLES samples of each class, as the 32 bits of their values; tokens and counts of all classes in a row."""
    distinct, at = np.unique((tokens.astype(np.int64) << 8) + counts, return_inverse=True)
    token = (distinct >> 8).astype(np.int32)
    table = _samples(token, weigh(token) * (distinct & 255), SAMPLES)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty((len(lengths), SAMPLES), np.float32)
    for i in range(0, len(lengths), 4096):
        j = min(i + 4096, len(lengths))
        out[i:j] = np.minimum.reduceat(table[at[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0)
    return out.view(np.uint32)


def _bands(sketch, rows: int, per_band: int):
    """Packed (hash, class) entries by part = band * per_band + range of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weights(np.stack([np.frombuffer(x, "<i8") for x in sketch.value]), rows)
        edges = (np.arange(1, per_band, dtype=np.uint64) << np.uint64(32)) // np.uint64(per_band)
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cls, first = np.unique(t.column("cls").to_numpy(), return_index=True)
            (tokens, lengths), (counts, _) = (_flat(t.column(c).chunk(0).take(pa.array(first))) for c in ("t", "n"))
            signature = signatures(tokens, counts, lengths, weigh).astype(np.uint64)
            parts, blobs = [], []
            for band, samples in enumerate(bands()):
                h = np.full(len(cls), band, np.uint64)
                for k in samples:
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, k] + np.uint64(1))
                h = (h >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(h, kind="stable")
                x, c = h[order], cls[order]
                cuts = [0, *np.searchsorted(x, edges).tolist(), len(x)]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if j > i:
                        parts.append(band * per_band + k)
                        blobs.append(_pack(x[i:j], c[i:j]))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "entries"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 40_000:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


def _buckets(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Rows of two kinds: lists a and b of classes to be paired place by place; and, for a bucket of more than ``BLOCK``
    classes, its blocks (bucket, i, k, a): block i of k."""
    h, c = map(np.concatenate, zip(*(_unpack(x.as_py()) for x in t.column("entries"))))
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    shared = np.concatenate([[False], h[1:] == h[:-1]])
    shared[:-1] |= shared[1:]
    h, c = h[shared], c[shared]  # most hashes are held by one class only
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    h, c = h[once], c[once]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    sizes = np.diff(np.append(starts, len(h)))
    out: list[tuple] = []
    left, right = [], []
    for n in np.unique(sizes[(sizes > 1) & (sizes <= BLOCK)]):
        members = c[starts[sizes == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        left.append(members[:, i].ravel())
        right.append(members[:, j].ravel())
    if left:
        x, y = np.concatenate(left), np.concatenate(right)  # members are in order, so x < y
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        once = np.ones(len(x), bool)
        once[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        x, y = x[once], y[once]
        for k in range(0, len(x), 65536):
            out.append((x[k : k + 65536].tobytes(), y[k : k + 65536].tobytes(), None, None, None))
    part = key[0].as_py()
    for s, n in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist()):
        k = -(-n // BLOCK)
        for i in range(k):
            out.append((c[s + i * BLOCK : s + min((i + 1) * BLOCK, n)].tobytes(), None, (part << 32) + int(h[s]), i, k))
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["a", "b", "bucket", "i", "k"])


def _placewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in range(2))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in (a, b)], names=["a", "b"])


def _crosswise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs between two blocks, or within a block that is paired with itself."""
    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in range(2))):
            x, y = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")
            i, j = np.triu_indices(len(x), 1) if a == b else (k.ravel() for k in np.indices((len(x), len(y))))
            x, y = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
            for k in range(0, len(x), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 65536]), pa.array(y[k : k + 65536])], names=["a", "b"])


def _verify(sketch, rows: int, least: float):
    """(a, b, j) of the candidates that hold on their tokens; j is the Jaccard similarity of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weights(np.stack([np.frombuffer(x, "<i8") for x in sketch.value]), rows)
        for b in batches:
            if not b.num_rows:
                continue
            column = lambda name, b=b: _flat(b.column(b.schema.get_field_index(name)))
            sides = []
            for c in ("a", "b"):
                (t, lengths), (n, _) = column(f"t{c}"), column(f"n{c}")
                pair = np.repeat(np.arange(len(lengths)), lengths)
                key = (pair << 32) + (t.astype(np.int64) + (1 << 31))
                order = np.argsort(key, kind="stable")
                sides.append((key[order], pair, weigh(t) * n, (weigh(t) * n)[order], lengths))
            (ka, pa_, wa, oa, la), (kb, pb, wb, ob, lb) = sides
            _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
            sums = lambda pair, w, m=b.num_rows: np.bincount(pair, w, m)
            at = ka[i] >> 32
            common = sums(at, None)
            light = sums(at, np.minimum(oa[i], ob[j]))
            jaccard = common / (la + lb - common)
            keep = (jaccard >= least) & (light >= LEAST_WEIGHTED * (sums(pa_, wa) + sums(pb, wb) - light))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(jaccard)], names=["a", "b", "j"]).filter(pa.array(keep))

    return run


def candidate_classes(rows: DataFrame, ws: Workspace, least: float) -> tuple[DataFrame, DataFrame]:
    """``rows``: id, title. Verified pairs (a, b, j) of class keys, a < b, and the features (id, cls, t, n)."""
    spark = rows.sparkSession
    features = ws.put(rows.select("id", "title").mapInArrow(_features, _FEATURES))
    total = features.count()
    sketch = features.select("t").mapInArrow(_count, "k int, counts binary").groupBy("k").applyInArrow(_sum, "k int, counts binary").orderBy("k").collect()
    if not sketch:
        return spark.createDataFrame([], "a bigint, b bigint, j double"), features
    shared = spark.sparkContext.broadcast([bytes(r["counts"]) for r in sketch])
    # parts of about 400,000 entries, so that a part stays small whatever the number of rows
    per_band = max(1, round(total / 400_000), -(-2 * parallelism(spark) // BANDS))
    entries = features.select("cls", "t", "n").mapInArrow(_bands(shared, total, per_band), "part int, entries binary")
    found = ws.put(entries.groupBy("part").applyInArrow(_buckets, "a binary, b binary, bucket bigint, i int, k int"))
    apart = found.where("bucket is null").select("a", "b").mapInArrow(_placewise, "a bigint, b bigint")
    blocks = found.where("bucket is not null")
    numbers = blocks.select("bucket", "i", F.explode(F.sequence("i", F.col("k") - 1)).alias("j"))
    block = lambda place, name: blocks.select("bucket", F.col("i").alias(place), F.col("a").alias(name)).hint("merge")
    crossed = numbers.join(block("i", "a"), ["bucket", "i"]).join(block("j", "b"), ["bucket", "j"]).select("a", "b").repartition(4 * parallelism(spark)).mapInArrow(_crosswise, "a bigint, b bigint")
    # An upper bound of the Jaccard similarity of A and B: bits of A that B lacks stand for at least as many tokens
    one = F.lit(1).cast("bigint")
    mark = F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)))))
    bits = features.select("cls", mark.alias("bits"), F.size("t").alias("m")).distinct()
    marked = lambda c: bits.select(F.col("cls").alias(c), F.col("bits").alias(f"s{c}"), F.col("m").alias(f"m{c}")).hint("merge")
    apart_ = lambda x, y: F.bit_count(F.col(f"s{x}").bitwiseAND(F.bitwise_not(F.col(f"s{y}"))))
    bound = lambda x, y: F.col(f"m{x}") - apart_(x, y) >= least * (F.col(f"m{y}") + apart_(x, y))
    likely = ws.put(apart.union(crossed).join(marked("a"), "a").join(marked("b"), "b").where(bound("a", "b") & bound("b", "a")).select("a", "b").distinct())
    ws.drop(found)
    hit = likely.select(F.col("a").alias("cls")).union(likely.select("b")).distinct()
    each = features.join(hit, "cls", "left_semi").groupBy("cls", "t", "n").agg(F.lit(1)).select("cls", "t", "n")
    side = lambda c: each.select(F.col("cls").alias(c), F.col("t").alias(f"t{c}"), F.col("n").alias(f"n{c}")).hint("merge")
    alike = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "na", "tb", "nb")
    verified = ws.put(alike.mapInArrow(_verify(shared, total, least), "a bigint, b bigint, j double"))
    ws.drop(likely)
    return verified, features


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text without white space, in lower case: length, and all bigrams (row, pair of characters)."""
    plain = [_SPACE.sub("", s.lower()) for s in texts.to_pylist()]
    lengths = np.array([len(s) for s in plain], np.int64)
    flat = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(plain)), lengths)
    inside = row[1:] == row[:-1]
    return lengths, row[1:][inside], ((flat[:-1] << 21) + flat[1:])[inside]


_SPACE = re.compile(r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def dice(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Dice over multisets of character bigrams, pair by pair, as ``functions.text.dice`` has it."""
    (la, ra, ga), (lb, rb, gb) = _grams(a), _grams(b)
    _, code = np.unique(np.concatenate([ga, gb]), return_inverse=True)
    size = int(code.max(initial=0)) + 1
    (ka, na), (kb, nb) = (np.unique(r * size + c, return_counts=True) for r, c in ((ra, code[: len(ra)]), (rb, code[len(ra) :])))
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.bincount(both // size, np.minimum(na[i], nb[j]), len(la))
    out = 2 * common / np.maximum(la + lb - 2, 1)
    for k in np.flatnonzero((la < 2) | (lb < 2)):
        s, t = (_SPACE.sub("", x[k].as_py().lower()) for x in (a, b))
        out[k] = float(s == t != "")
    return out


def _scored(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                j, ta, tb, na, nb = (b.column(i) for i in range(2, 7))
                score = 0.5 * j.to_numpy() + 0.2 * dice(ta, tb) + 0.3 * dice(na, nb)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["rep_a", "rep_b", "score"]).filter(pa.array(score >= threshold))

    return run


def near_links(df: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links (rep_a, rep_b, score), rep_a < rep_b, and members (id, rep) of the rows that have a link.

    Rows with the same title and canonical address, but for case and white space of the title, form a unit, which its
    smallest id stands for. Pairs of units that are not copies of each other (``format_copies``) and reach
    ``threshold`` (0.6 at least) in the pair score are linked. Null counts as empty; a row without title tokens can't
    reach more than 0.5 and has no link. Rows with a null id are left out, repeated rows add nothing, an empty table
    gives no rows. Other columns are not read.
    """
    if threshold < 0.6:
        raise ValueError("the banding is laid out for thresholds of 0.6 and more")
    ws = Workspace(df.sparkSession, "near")
    raw = df.where("id is not null").select("id", "title", "url")
    least = 2 * threshold - 1
    classes, features = candidate_classes(raw, ws, least)
    # a class whose rows differ in their addresses has links inside
    several = features.groupBy("cls").agg(F.min("id").alias("i"), F.max("id").alias("z")).where("i < z").select("cls")
    hit = classes.select(F.col("a").alias("cls")).union(classes.select("b")).union(several).distinct()
    of = features.select("id", "cls").join(hit, "cls", "left_semi").join(raw, "id")
    keyed = of.select("id", "cls", F.lower(F.coalesce("title", F.lit(""))).alias("title"), urls.normalize(F.col("url")).alias("norm"), copy_key(F.col("title"), F.col("url")).alias("k"))
    keyed = ws.put(keyed.select("id", "cls", F.regexp_replace("title", r"\s+", "").alias("title"), "norm", "k.*").withColumn("unit", F.xxhash64("cls", "title", "norm", "k1", "k2")))
    units = ws.put(keyed.groupBy("unit", "cls", "k1", "k2").agg(F.min("id").alias("rep"), F.min(F.struct("title", "norm")).alias("x")).select("rep", "cls", "k1", "k2", "x.*", "unit"))
    side = lambda c: units.select(F.col("cls").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("rep", "title", "norm", "k1", "k2")])
    other = F.expr("not (k1_a = k1_b and k2_a = k2_b)")
    across = classes.join(side("a"), "a").join(side("b"), "b").where(other)
    within = side("a").join(side("b"), F.col("a") == F.col("b")).where(other & (F.col("rep_a") < F.col("rep_b"))).withColumn("j", F.lit(1.0))
    columns = ["rep_a", "rep_b", "j", "title_a", "title_b", "norm_a", "norm_b"]
    scored = across.select(*columns).union(within.select(*columns)).mapInArrow(_scored(threshold), "rep_a bigint, rep_b bigint, score double")
    links = ws.put(scored.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "score").distinct())
    linked = links.select(F.col("rep_a").alias("rep")).union(links.select("rep_b")).distinct()
    members = keyed.select("id", "unit").join(units.select("unit", "rep"), "unit").join(linked, "rep", "left_semi").select("id", "rep").distinct()
    return links, members


def near_pairs(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links of ``near_links``, expanded to rows."""
    links, members = near_links(df, threshold)
    side = lambda c: members.select(F.col("rep").alias(f"rep_{c}"), F.col("id").alias(c))
    pairs = links.join(side("a"), "rep_a").join(side("b"), "rep_b")
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
