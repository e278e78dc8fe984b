"""Descriptor matching and inverted-index retrieval."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import dot_arrays, hamming_weight

LEAST = 1e-12


#: Descriptors of an image pair that a task holds of each side.
MATCH_BLOCK = 4096


def best_matches(a: DataFrame, b: DataFrame, ratio: float = 0.8, most: float = 0.7) -> DataFrame:
    """One-way best match of each feature of every image pair (pair, idx, descriptor on both sides).

    The best must be within an angle and closer than ``ratio`` times the runner-up;
    a lone candidate competes with similarity 0. Image pairs meet by blocks of their features.
    """
    return _best_of(_best_two(a, b), ratio, most)


def _best_two(a: DataFrame, b: DataFrame, bands: int = 0) -> DataFrame:
    """The two best candidates (pair, idx1, idx2, dot) that each feature has in each block of the other side.

    A pair of more than ``MATCH_BLOCK`` features is dealt to blocks of both sides, which meet all with all, a
    task each: every candidate is scored, none is a row. Only the large pairs' counts are broadcast."""
    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rows = side.select(F.col("pair").alias("pair"), F.col("idx").alias(f"idx{own}"), F.col("descriptor").cast("array<double>").alias(f"descriptor{own}"))
        blocks = lambda n: F.coalesce(F.ceil(F.col(n) / MATCH_BLOCK), F.lit(1)).cast("int")
        rows = rows.join(F.broadcast(large), "pair", "left").withColumn(own, F.pmod(F.xxhash64(f"idx{own}"), blocks(f"n{own}")).cast("int"))
        return rows.select("pair", f"idx{own}", f"descriptor{own}", own, F.explode(F.sequence(F.lit(0), blocks(f"n{other}") - 1)).alias(other))

    count = lambda side, name: side.groupBy("pair").agg(F.count("*").alias(name)).filter(F.col(name) > MATCH_BLOCK)
    large = count(a, "nx").join(count(b, "ny"), "pair", "full")
    keys = ["pair", "x", "y"]
    types = {f.name: f.dataType.simpleString() for f in a.schema.fields} | {"idx2": b.schema["idx"].dataType.simpleString()}

    def kernel(left, right):
        import numpy as np
        import pyarrow as pa

        found = best_two(left.column("descriptorx").to_pylist(), right.column("descriptory").to_pylist(), right.column("idxy").to_pylist(), bands)
        i, j, dot = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        i, j = pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64))
        return pa.table([left.column("pair").take(i), left.column("idxx").take(i), right.column("idxy").take(j), pa.array(dot)], ["pair", "idx1", "idx2", "dot"])

    met = dealt(a, "x", "y").groupBy(*keys).cogroup(dealt(b, "y", "x").groupBy(*keys))
    return met.applyInArrow(kernel, f"pair {types['pair']}, idx1 {types['idx']}, idx2 {types['idx2']}, dot double")


def best_two(left: list, right: list, ids: list, bands: int = 0, chunk: int = 512) -> list[tuple]:
    """Row of the left, row of the right, dot product: for each left vector the two right ones with the greatest product
    over zero, equal ones by id. Products sum in the order of the values. Vectors of different sizes, or
    that hold null, do not meet. With ``bands`` only vectors meet that agree in the signs of some run of values."""
    import numpy as np

    def of_size(vectors: list, size: int):
        at = [k for k, v in enumerate(vectors) if v is not None and len(v) == size and None not in v]
        return np.array(at, int), np.array([vectors[k] for k in at], float).reshape(len(at), size)

    out = []
    for size in sorted({len(v) for v in left if v}):
        (ra, x), (rb, y) = of_size(left, size), of_size(right, size)
        if not len(ra) or not len(rb):
            continue
        order = np.array(sorted(range(len(rb)), key=lambda k: ids[rb[k]]))
        rb, y = rb[order], y[order]
        codes = _sign_runs(np.concatenate((x, y)) > 0, bands) if bands else None
        for start in range(0, len(x), chunk):
            part = x[start : start + chunk]
            dot = np.zeros((len(part), len(y)))
            for k in range(size):
                dot += part[:, k, None] * y[:, k]
            score = np.where(np.isnan(dot), np.inf, dot)  # as in a sort, where NaN is the greatest
            score[~(score > 0)] = -np.inf
            if codes is not None:
                own, others = codes[start : start + len(part)], codes[len(x) :]
                met = np.zeros(score.shape, bool)
                for k in range(bands):
                    met |= own[:, k, None] == others[:, k]
                score[~met] = -np.inf
            rows = np.arange(len(part))
            for _ in range(2):
                top = score.argmax(1)
                good = score[rows, top] > -np.inf
                out.append((ra[start + rows[good]], rb[top[good]], dot[rows[good], top[good]]))
                score[rows, top] = -np.inf
    return out


def _sign_runs(bits, bands: int):
    """A number for the signs of each run of values: equal signs, equal numbers."""
    import numpy as np

    size = -(-bits.shape[1] // bands)
    runs = [bits[:, k * size : (k + 1) * size] for k in range(bands)]
    return np.stack([np.unique(r, axis=0, return_inverse=True)[1].ravel() if r.shape[1] else np.zeros(len(bits), int) for r in runs], 1)


def _best_of(scored: DataFrame, ratio: float, most: float) -> DataFrame:
    """The best of the scored candidates (pair, idx1, idx2, dot) of each feature."""
    order = Window.partitionBy("pair", "idx1").orderBy(F.desc("dot"), "idx2")
    top = scored.withColumn("rn", F.row_number().over(order)).filter("rn <= 2")
    both = top.groupBy("pair", "idx1").agg(
        F.max(F.when(F.col("rn") == 1, F.col("idx2"))).alias("idx2"),
        F.max(F.when(F.col("rn") == 1, F.col("dot"))).alias("best_dot"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("dot"))), F.lit(0.0)).alias("second_dot"),
    )
    angle = lambda c: F.acos(F.least(F.col(c), F.lit(1.0)))
    return both.select("pair", "idx1", "idx2", angle("best_dot").alias("best"), angle("second_dot").alias("second")).filter((F.col("best") <= most) & (F.col("best") < ratio * F.col("second")))


def mutual_matches(a: DataFrame, b: DataFrame, ratio: float = 0.8, most: float = 0.7) -> DataFrame:
    """Matches that are best both ways."""
    there = best_matches(a, b, ratio, most).select("pair", "idx1", "idx2")
    back = best_matches(b, a, ratio, most).select("pair", F.col("idx2").alias("idx1"), F.col("idx1").alias("idx2"))
    return there.join(back, ["pair", "idx1", "idx2"])


def guided(scored: DataFrame, residual: Column, most: float) -> DataFrame:
    """Candidates whose residual under a geometry is small enough."""
    return scored.filter(residual <= most * most)


#: Words that are broadcast at once: 8,192 centroids of 128 numbers are 8 MB.
WORD_BLOCK = 8192


def nearest_words(descriptors: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """The k nearest words of each descriptor. A vocabulary of more than ``WORD_BLOCK`` words is broadcast
    block by block, and the best of all blocks win."""
    blocks = -(-words.count() // WORD_BLOCK)
    order = Window.partitionBy("image_id", "idx").orderBy("d2", "word_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    d2 = F.aggregate(F.zip_with("descriptor", "centroid", lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    found = None
    for block in range(max(1, blocks)):
        own = words if blocks <= 1 else words.filter(F.pmod(F.xxhash64("word_id"), F.lit(blocks)) == block)
        part = best(descriptors.join(F.broadcast(own)).withColumn("d2", d2).drop("centroid"))
        found = part if found is None else found.unionByName(part)
    return (found if blocks <= 1 else best(found)).drop("d2")


def idf(postings: DataFrame) -> DataFrame:
    """ln(images / images with the word)."""
    total = postings.select("image_id").distinct().agg(F.count("*").alias("n"))
    df = postings.select("word_id", "image_id").distinct().groupBy("word_id").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("word_id", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def image_norms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """1 / sqrt(sum of squared idf) of each image, 0 if there is none."""
    sums = postings.join(weights, "word_id").groupBy("image_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))
    return sums.select("image_id", F.when(F.col("s") > 0, 1 / F.sqrt(F.nullif("s", F.lit(0.0)))).otherwise(0.0).alias("norm"))


def image_scores(queries: DataFrame, postings: DataFrame, weights: DataFrame, norms: DataFrame, votes: bool = False) -> DataFrame:
    """Retrieval scores: votes within 24 bits weigh by distance, over the root of
    their number, by word and image; then by squared idf and both norms.

    With ``votes`` also the same sum without idf, over the root of the image's size: it tells images
    apart whose every word all images have, so that no word weighs anything."""
    q = queries.select(F.col("image_id").alias("query_image"), F.col("idx").alias("query_idx"), "word_id", F.col("sig").alias("query_sig"))
    near = q.join(postings.select("word_id", "image_id", "sig"), "word_id").withColumn("h", F.bit_count(F.col("query_sig").bitwiseXOR(F.col("sig")))).filter("h <= 24")
    by_word = near.groupBy("query_image", "query_idx", "word_id", "image_id").agg((F.sum(hamming_weight(F.col("h").cast("double"))) / F.sqrt(F.count("*"))).alias("s"))
    raw = by_word.join(weights, "word_id").groupBy("query_image", "image_id").agg(F.sum(F.col("s") * F.col("idf") * F.col("idf")).alias("s"), *([F.sum("s").alias("votes")] if votes else []))
    if votes:
        sizes = postings.groupBy("image_id").agg(F.count("*").alias("size"))
        raw = raw.join(sizes, "image_id").withColumn("votes", F.col("votes") / F.sqrt("size")).drop("size")
    own = image_norms(queries.select("image_id", "word_id"), weights).select(F.col("image_id").alias("query_image"), F.col("norm").alias("qn"))
    return raw.join(own, "query_image").join(norms, "image_id").select("query_image", "image_id", (F.col("s") * F.col("qn") * F.col("norm")).alias("score"), *(["votes"] if votes else []))


def top_images(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query image; equal scores go by votes where there are any, then by image."""
    order = Window.partitionBy("query_image").orderBy(F.desc("score"), *([F.desc("votes")] if "votes" in scores.columns else []), "image_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def guided_matches(a: DataFrame, b: DataFrame, residual: Column, most: float, ratio: float = 0.8, angle: float = 0.7) -> DataFrame:
    """Best matches among the candidates that a geometry allows: ``residual`` (squared) of x1, y1, x2, y2."""
    x = a.select("pair", F.col("idx").alias("idx1"), F.col("descriptor").alias("d1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    y = b.select("pair", F.col("idx").alias("idx2"), F.col("descriptor").alias("d2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    allowed = guided(x.join(y, "pair"), residual, most)
    return _best_of(allowed.withColumn("dot", dot_arrays(F.col("d1"), F.col("d2"))).filter("dot > 0"), ratio, angle)


def approximate_matches(a: DataFrame, b: DataFrame, ratio: float = 0.8, angle: float = 0.7, bands: int = 16) -> DataFrame:
    """Best matches among candidates that agree in the signs of some run of values; scored exactly."""
    return _best_of(_best_two(a, b, bands), ratio, angle)


def added_images(index: DataFrame, postings: DataFrame) -> DataFrame:
    """An index with the postings of the images that it lacks."""
    return index.unionByName(postings.join(index.select("image_id").distinct(), "image_id", "left_anti"))


def hough_bins(votes: DataFrame, levels: int, top: int) -> DataFrame:
    """The transformation bins of each pair of images that most matches vote for, on grids that are
    halved level by level; a vote of level l counts 1 / 2^l. votes: query_image, image_id, bx, by, bs, ba.

    Votes are dealt by pair once; bins of all levels are summed where they lie."""
    axes = ["bx", "by", "bs", "ba"]
    keys = ["query_image", "image_id"]
    total = votes.repartition(*keys).groupBy(*keys, *axes).agg(F.count("*").alias("n"))
    score = F.col("n").cast("double")
    for level in range(1, levels):
        coarse = Window.partitionBy(*keys, *(F.shiftright(c, level) for c in axes))
        total = total.withColumn(f"_w{level}", F.sum("n").over(coarse) / 2**level)
        score = score + F.col(f"_w{level}")
    total = total.select(*keys, *axes, "n", score.alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), *axes)
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def loop_pairs(scores: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Pairs of the asked images with the k that score best, each pair once and none with itself."""
    best = top_images(scores.filter("query_image <> image_id").join(asked.select(F.col("image_id").alias("query_image")), "query_image", "left_semi"), k)
    return best.select(F.least("query_image", "image_id").alias("image_id1"), F.greatest("query_image", "image_id").alias("image_id2")).distinct()


def hamming_projection(size: int, bits: int = 64, seed: int = 0):
    """Rows of a random orthonormal matrix, the same for every index of a seed."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).T[:bits]


def projected(descriptors: DataFrame, column: str, size: int, bits: int = 64, seed: int = 0) -> DataFrame:
    """Descriptors of a size with ``projected``: what the rows of the Hamming projection make of them, a batch
    at a time. Descriptors of another size, or that hold null, have none."""
    import numpy as np
    import pyarrow as pa

    def kernel(batches):
        rows = hamming_projection(size, bits, seed)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            good = [x is not None and len(x) == size and None not in x for x in lists]
            found = iter((np.array([x for x, ok in zip(lists, good, strict=True) if ok], float).reshape(-1, size) @ rows.T).tolist())
            out = pa.array([next(found) if ok else None for ok in good], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*batch.schema.names[:-1], "projected"])

    others = [c for c in descriptors.columns if c != column]
    kept = descriptors.select(*others, F.col(column).cast("array<double>").alias("_vector"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(kernel, f"{schema}, projected array<double>")


def train_words(descriptors: DataFrame, count: int, rounds: int = 11, seed: int = 0) -> DataFrame:
    """A vocabulary: word_id and centroid of k-means over descriptors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = descriptors.select(array_to_vector(F.col("descriptor").cast("array<double>")).alias("features"))
    model = KMeans(k=count, maxIter=rounds, seed=seed).fit(rows)
    return descriptors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "word_id long, centroid array<double>")


def chosen_once(rows: list[tuple[int, float, int]]) -> list[tuple[int, int, float]]:
    """One-to-one matches (idx1, idx2, distance) among the candidates (idx1, distance, idx2) of one pair."""
    by, users = {}, {}
    for i, d, j in rows:
        by.setdefault(i, []).append((d, j))
        users.setdefault(j, []).append(i)
    count = {i: len(c) for i, c in by.items()}
    heap, taken, out = [(n, i) for i, n in count.items()], set(), []
    heapq.heapify(heap)
    while heap:
        n, i = heapq.heappop(heap)
        if count.get(i) != n:  # chosen, or with fewer candidates by now
            continue
        del count[i]
        d, j = min(c for c in by[i] if c[1] not in taken)
        taken.add(j)
        out.append((i, j, d))
        for other in users[j]:
            if other in count:
                count[other] -= 1
                if count[other]:
                    heapq.heappush(heap, (count[other], other))
    return out


def one_to_one(candidates: DataFrame) -> DataFrame:
    """Matches of an image pair with each feature used once: features with the fewest candidates choose
    first, the nearest of what is left. candidates: pair, idx1, idx2, distance; a pair fits in a task."""
    import pyarrow as pa

    names, kinds = ["pair", "idx1", "idx2", "distance"], [pa.int64(), pa.int32(), pa.int32(), pa.float64()]

    def kernel(batches):
        for batch in batches:
            lists = batch.column(1)
            at, flat = lists.offsets.to_pylist(), lists.values
            rows = list(zip(*(flat.field(c).to_pylist() for c in ("idx1", "distance", "idx2")), strict=True))
            out = [(pair, *m) for k, pair in enumerate(batch.column(0).to_pylist()) for m in chosen_once(rows[at[k] : at[k + 1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    lists = candidates.groupBy("pair").agg(F.collect_list(F.struct("idx1", "distance", "idx2")).alias("c"))
    return lists.mapInArrow(kernel, "pair long, idx1 int, idx2 int, distance double")


