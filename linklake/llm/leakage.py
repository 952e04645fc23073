"""Evaluation passages inside a training corpus: latent semantic retrieval, then exact and paraphrase checks.

* Texts become two streams: words (runs of letters and digits, lower-cased) and Han characters. The corpus is cut into
  aligned passages of ``WORDS`` words or ``HAN`` characters, the items into windows of that length at every offset. A
  shared run of 2 * WORDS - 1 words therefore holds a whole passage that equals a window, whatever its offset.
* Passages are TF-IDF vectors over the items' vocabulary (other terms have no product with any item; their share of a
  passage only lowers its chance to be a candidate). A distributed randomised SVD finds the latent space: every split adds
  A'(A Omega) of its passages, the blocks are summed in the cluster, and a Nystrom step on the small result gives the basis.
* Windows are held in cells around centroids. A passage looks into its nearest cells; pairs of a cosine of ``COSINE`` or
  more are candidates for copies. Equal terms give equal vectors, so a literal copy can't be missed by the projection.
  They are checked on the full term sequences for the longest common run.
* Paraphrases don't go through the latent space: edits spread evenly over an item can leave no passage near it, so no
  cosine follows from the share of the subsequence. The rarest terms of the items (their answers) are held as postings,
  which give every pair of a document and an item whose share of them suffices; then come the item's words that the
  document holds, as a bound, and the longest common subsequence. No step drops a pair that reaches the thresholds.

Items are the stated query set; they are broadcast in blocks of at most ``ITEMS`` items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.runtime import Workspace

WORDS, HAN = 8, 12
#: Width of the random range and of the latent space.
RANGE, LATENT = 72, 64
COSINE, PROBES = 0.999, 2
#: Least share of a passage's terms that the items' vocabulary must hold.
KNOWN = 0.6
#: Documents searched in one go, which bounds a task's memory.
SLICE = 1000
#: Items in one broadcast block.
ITEMS = 5000
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]")

_ENCODED = "doc_id bigint, w array<int>, h array<int>"
_FOUND = "item_id bigint, doc_id bigint, run int, han_run int, lcs double, answer double"


def streams(text: str | None) -> tuple[list[str], list[str]]:
    """Words and Han characters of a text; nothing for null."""
    low = (text or "").lower()
    return _WORD.findall(low), _HAN.findall(low)


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for b in batches:
            ids, w, h = b.column(0).to_pylist(), [], []
            for t in b.column(1).to_pylist():
                words, han = streams(t)
                w.append([known.get(x, 0) for x in words])
                h.append([known.get(x, 0) for x in han])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(w, pa.list_(pa.int32())), pa.array(h, pa.list_(pa.int32()))], names=["doc_id", "w", "h"])

    return run


def _passages(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Aligned passages of a list column: (terms of shape n x size, row, place in the row, all terms, row offsets)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.asarray(pa.compute.list_value_length(column))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    n = lengths // size
    row = np.repeat(np.arange(len(n)), n)
    place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
    terms = flat[(offsets[row] + place)[:, None] + np.arange(size)] if len(row) else np.empty((0, size), np.int32)
    return terms, row, place, flat, offsets


def _both(b: pa.RecordBatch):
    for name, size in (("w", WORDS), ("h", HAN)):
        yield name, size, _passages(b.column(b.schema.get_field_index(name)), size)


def _frequencies(v: int):
    """Number of passages that hold each term; place 0 counts all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v, np.int64)
        for b in batches:
            for _, _, (terms, *_rest) in _both(b):
                s = np.sort(terms, axis=1)
                first = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
                total += np.bincount(s[first & (s > 0)], minlength=v)
                total[0] += len(s)
        if total[0]:
            yield _chunk(total[:, None].astype(np.float64))

    return run


def _chunk(matrix: np.ndarray, size: int = 512) -> pa.RecordBatch:
    starts = range(0, len(matrix), size)
    return pa.RecordBatch.from_arrays([pa.array([s // size for s in starts], pa.int32()), pa.array([np.ascontiguousarray(matrix[s : s + size]).tobytes() for s in starts], pa.binary())], names=["chunk", "part"])


def _add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<f8") for x in t.column("part"))
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def _summed(df: DataFrame, width: int) -> np.ndarray:
    """Sum over all splits of a matrix with one row for each term of the items' vocabulary (so its size is bounded)."""
    rows = df.groupBy("chunk").applyInArrow(_add, "chunk int, part binary").orderBy("chunk").collect()
    return np.concatenate([np.frombuffer(bytes(r["part"]), "<f8").reshape(-1, width) for r in rows]) if rows else np.zeros((0, width))


def _range(idf, omega):
    """A'(A Omega) of a split's passages; rows of A are TF-IDF vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, o = idf.value, omega.value
        weighed, total = (w[:, None] * o).astype(np.float32), np.zeros(o.shape)
        for b in batches:
            for _, size, (terms, *_rest) in _both(b):
                for i in range(0, len(terms), 6000):  # so that the images stay in the processor's cache
                    t = terms[i : i + 6000]
                    image = weighed[t[:, 0]]
                    for k in range(1, size):
                        image += weighed[t[:, k]]
                    at = np.flatnonzero(t)
                    flat = t.ravel()[at]
                    order = np.argsort(flat, kind="stable")
                    flat = flat[order]
                    starts = np.flatnonzero(np.diff(flat, prepend=-1))
                    if len(starts):
                        total[flat[starts]] += np.add.reduceat(image[at[order] // size], starts, axis=0)
        total *= w[:, None]
        if total.any():
            yield _chunk(total)

    return run


def latent_basis(y: np.ndarray, omega: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors of A from Y = A'A Omega (Nystrom approximation of A'A)."""
    shift = np.linalg.norm(y) * 1e-9 + 1e-12
    y = y + shift * omega
    c = omega.T @ y
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > values.max() * 1e-10
    b = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    return np.linalg.svd(b, full_matrices=False)[0][:, :k]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centroids(x: np.ndarray, n: int) -> np.ndarray:
    c = x[np.random.default_rng(7).choice(len(x), n, replace=False)]
    for _ in range(8):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


class Windows:
    """The items' windows of one stream, in cells around centroids of the latent space."""

    def __init__(self, sequences: list[np.ndarray], size: int, projection: np.ndarray):
        at = [(i, p) for i, s in enumerate(sequences) for p in range(len(s) - size + 1)]
        self.item, self.place = (np.array(x, np.int64) for x in zip(*at)) if at else (np.empty(0, np.int64),) * 2
        self.terms = np.array([sequences[i][p : p + size] for i, p in at], np.int32).reshape(-1, size)
        vectors = _unit(projection[self.terms].sum(axis=1)) if at else np.empty((0, projection.shape[1]), np.float32)
        self.centroids = _centroids(vectors, max(1, int(len(at) ** 0.5))) if at else vectors
        cell = np.argmax(vectors @ self.centroids.T, axis=1) if at else np.empty(0, np.int64)
        self.order = np.argsort(cell, kind="stable")
        self.starts = np.searchsorted(cell[self.order], np.arange(len(self.centroids) + 1))
        self.vectors = vectors[self.order]

    @classmethod
    def of(cls, state: dict) -> Windows:
        """From the plain arrays that travel in a broadcast."""
        w = cls.__new__(cls)
        w.__dict__ |= state
        return w

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, window) of all pairs of ``COSINE`` or more in the ``PROBES`` nearest cells."""
        left, right = [], []
        near = x @ self.centroids.T
        probes = min(PROBES, near.shape[1])
        cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
        for c in np.unique(cells):
            q = np.flatnonzero((cells == c).any(axis=1))
            s, e = self.starts[c], self.starts[c + 1]
            for i in range(0, len(q), 20_000):
                hit, window = np.nonzero(x[q[i : i + 20_000]] @ self.vectors[s:e].T >= COSINE)
                left.append(q[i : i + 20_000][hit])
                right.append(self.order[s + window])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def common_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Start in a and length of the run of equal known terms through a[i] and b[j]."""
    s = 0
    while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1] > 0:
        s += 1
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] > 0:
        n += 1
    return i - s, s + n


class Subsequences:
    """Longest common subsequences of many pairs of an item and a document at once. The table's row of a pair is a string
    of bits, one for each term of the item; a step takes the next term of every pair's document."""

    def __init__(self, sequences: list[np.ndarray]):
        self.lengths = np.array([len(q) for q in sequences], np.int64)
        self.limbs = max(1, -(-int(self.lengths.max(initial=0)) // 64))
        self.terms, self.masks, self.base = [], [np.zeros((1, self.limbs), np.uint64)], []
        n = 1
        for q in sequences:
            distinct, at = np.unique(q, return_inverse=True)
            mask = np.zeros((len(distinct), self.limbs), np.uint64)
            place = np.arange(len(q))
            np.bitwise_or.at(mask, (at, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
            self.terms.append(distinct)
            self.masks.append(mask)
            self.base.append(n)
            n += len(distinct)
        self.masks = np.concatenate(self.masks)

    def of(self, items: np.ndarray, documents: np.ndarray, texts: list[np.ndarray], v: int) -> np.ndarray:
        """Length for each pair (items[k], texts[documents[k]])."""
        rows: list[np.ndarray] = [np.empty(0, np.int64)] * len(items)
        place = np.zeros(v, np.int64)
        for item in np.unique(items).tolist():
            place[self.terms[item]] = self.base[item] + np.arange(len(self.terms[item]))
            place[0] = 0  # the code of terms that no item has
            for k in np.flatnonzero(items == item).tolist():
                r = place[texts[documents[k]]]
                rows[k] = r[r > 0]
            place[self.terms[item]] = 0
        size = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-size, kind="stable")
        row = np.full((len(items), self.limbs), ~np.uint64(0))
        starts = (np.cumsum(size[order]) - size[order]).astype(np.int64)
        flat = np.concatenate([rows[k] for k in order.tolist()]) if len(order) else np.empty(0, np.int64)
        active = len(order) - np.searchsorted(size[order][::-1], np.arange(size.max(initial=0)), side="right")
        for step, n in enumerate(active.tolist()):
            now = row[:n]
            hit = now & self.masks[flat[starts[:n] + step]]
            carry = np.zeros(n, np.uint64)
            for limb in range(self.limbs):
                a, b = now[:, limb], hit[:, limb]
                plus = a + b
                over = plus < a
                plus += carry
                carry = (over | (plus < carry)).astype(np.uint64)
                row[:n, limb] = plus | (a - b)
        left = np.empty(len(items), np.int64)
        n = self.lengths[items[order]]
        bits = np.clip(n[:, None] - 64 * np.arange(self.limbs), 0, 64)
        full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        left[order] = n - np.bitwise_count(row & full).sum(axis=1)
        return left


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of known terms."""
    v = int(max(a.max(initial=0), b.max(initial=0))) + 1
    return int(Subsequences([a]).of(np.zeros(1, np.int64), np.zeros(1, np.int64), [b], v)[0])


def held_rare(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, posted: np.ndarray, n: int) -> np.ndarray:
    """Number of the rarest terms of each of n items that each row of a list column holds; postings by term."""
    d = len(offsets) - 1
    row, term = np.repeat(np.arange(d), np.diff(offsets)), flat[offsets[0] : offsets[-1]]
    rare = starts[term + 1] > starts[term]
    each = np.unique(row[rare] * len(starts) + term[rare])
    row, term = each // len(starts), each % len(starts)
    counts = starts[term + 1] - starts[term]
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[term], counts)
    return np.bincount(np.repeat(row, counts) * n + posted[at], minlength=d * n).reshape(d, n)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        projection = s["projection"]
        present = np.zeros(len(projection), bool)
        subsequences = {k: Subsequences(q) for k, q in s["sequences"].items()}
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            docs = b.column(0).to_pylist()
            best: dict[tuple[int, int], list] = defaultdict(lambda: [0, 0, 0.0, 0.0])
            for name, size, (terms, row, place, flat, offsets) in _both(b):
                windows, sequences, slot = Windows.of(s[name]), s["sequences"][name], 0 if name == "w" else 1
                if not len(windows.item):
                    continue
                likely = np.flatnonzero((terms > 0).sum(axis=1) >= KNOWN * size)
                for i in range(0, len(likely), 50_000):
                    part = likely[i : i + 50_000]
                    q, window = windows.search(_unit(projection[terms[part]].sum(axis=1)))
                    passage = part[q]
                    same = (terms[passage] == windows.terms[window]).all(axis=1)
                    reached: dict[tuple[int, int, int], int] = {}
                    for p, w in sorted(zip(passage[same].tolist(), window[same].tolist())):
                        d, item, i, j = row[p], windows.item[w], place[p], windows.place[w]
                        key = (d, item, i - j)
                        if i < reached.get(key, -1):
                            continue
                        doc = flat[offsets[d] : offsets[d + 1]]
                        start, n = common_run(doc, sequences[item], i, j)
                        reached[key] = start + n
                        entry = best[d, item]
                        entry[slot] = max(entry[slot], n)
                # paraphrases: first the rarest terms, then all words of the item against the whole document
                lengths = np.array([len(q) for q in sequences])
                held = held_rare(flat, offsets, *s["postings"][name], len(sequences))
                enough = (held / s["rare_count"][name] >= s["min_answer"]) & (lengths >= size)
                pairs, held_of = [], []
                texts: list[np.ndarray] = []
                for d in np.flatnonzero(enough.any(axis=1)).tolist():
                    doc = flat[offsets[d] : offsets[d + 1]]
                    present[doc] = True
                    present[0] = False
                    pairs += [(len(texts), i) for i in np.flatnonzero(enough[d]).tolist() if np.count_nonzero(present[sequences[i]]) >= s["min_lcs"] * lengths[i]]
                    present[doc] = False
                    texts.append(doc)
                    held_of.append(d)
                if not pairs:
                    continue
                at, item = np.array(pairs).T
                lcs = subsequences[name].of(item, at, texts, len(projection)) / lengths[item]
                for k, (d, i) in enumerate(zip(np.array(held_of)[at].tolist(), item.tolist())):
                    entry = best[d, i]
                    entry[2:] = max(entry[2:], [float(lcs[k]), held[d, i] / s["rare_count"][name][i]], key=lambda x: (x[0] >= s["min_lcs"], x))
            out = [(s["items"][item], docs[d], *map(int, e[:2]), *map(float, e[2:])) for (d, item), e in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([x[0] for x in out], [x[1] for x in out], pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32()), [x[4] for x in out], [x[5] for x in out])], names=["item_id", "doc_id", "run", "han_run", "lcs", "answer"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 15, min_han: int = 24, min_lcs: float = 0.7, min_answer: float = 0.5) -> DataFrame:
    """(item_id, doc_id, run, han_run, lcs, answer, kind) of the documents that hold passages of items.

    kind is ``copy`` where the longest shared run has ``min_words`` words or ``min_han`` Han characters, else
    ``paraphrase`` where the shared subsequence covers ``min_lcs`` of the item and ``min_answer`` of its rarest terms are
    there (in words or in Han characters, each on its own, for items of at least ``WORDS`` or ``HAN`` of them). The literal
    search is complete for runs of 15 words or 23 Han characters and more, the search for paraphrases always. Null and blank texts, on
    either side, match nothing; repeated rows give one row; rows with a null id are left out; empty tables give no rows.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "leaks")
    queries = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-queries.count() // ITEMS))
    out = None
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _leaks_of(documents, part.orderBy("item_id", "text").collect(), ws, min_lcs, min_answer)
        out = found if out is None else out.unionByName(found)
    both = out.groupBy("item_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("run", "han_run", "lcs", "answer")])
    kind = F.when((F.col("run") >= min_words) | (F.col("han_run") >= min_han), "copy").when((F.col("lcs") >= min_lcs) & (F.col("answer") >= min_answer), "paraphrase")
    return both.withColumn("kind", kind).where("kind is not null")


def _postings(rare: list[np.ndarray], v: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by term and the items that hold each term among their rarest."""
    terms = np.concatenate(rare).astype(np.int64)
    items = np.repeat(np.arange(len(rare)), [len(x) for x in rare])
    return np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=v))]), items[np.argsort(terms, kind="stable")]


def _leaks_of(documents: DataFrame, items: list, ws: Workspace, min_lcs: float, min_answer: float) -> DataFrame:
    spark = documents.sparkSession
    sc = spark.sparkContext
    if not items:
        return spark.createDataFrame([], _FOUND)
    texts = [streams(r["text"]) for r in items]
    known = {t: i + 1 for i, t in enumerate(sorted({x for w, h in texts for x in (*w, *h)}))}
    sequences = {"w": [np.array([known[x] for x in w], np.int32) for w, _ in texts], "h": [np.array([known[x] for x in h], np.int32) for _, h in texts]}
    encoded = ws.put(documents.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_encode(sc.broadcast(known)), _ENCODED))
    v = len(known) + 1
    n = _summed(encoded.mapInArrow(_frequencies(v), "chunk int, part binary"), 1)[:, 0]
    if not len(n):  # no text is as long as a passage
        n = np.zeros(v)
    idf = np.log1p(n[0] / np.maximum(n, 1))
    idf[0] = 0
    omega = np.random.default_rng(11).standard_normal((v, min(RANGE, v)))
    y = _summed(encoded.mapInArrow(_range(sc.broadcast(idf), sc.broadcast(omega)), "chunk int, part binary"), omega.shape[1])
    if not len(y):
        y = np.zeros(omega.shape)
    projection = (idf[:, None] * latent_basis(y, omega, LATENT)).astype(np.float32)
    rare = {k: [np.unique(q[np.argsort(-idf[q], kind="stable")[: max(1, len(q) // 8)]]) if len(q) else q for q in v] for k, v in sequences.items()}
    postings = {k: _postings(x, v) for k, x in rare.items()}
    rare_count = {k: np.array([max(1, len(x)) for x in v]) for k, v in rare.items()}
    shared = sc.broadcast({"projection": projection, "postings": postings, "rare_count": rare_count, "min_lcs": min_lcs, "min_answer": min_answer, "items": [r["item_id"] for r in items], "sequences": sequences} | {k: vars(Windows(sequences[k], size, projection)) for k, size in (("w", WORDS), ("h", HAN))})
    return encoded.mapInArrow(_search(shared), _FOUND)
