"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook.
Codebooks are trained in turn on the residuals of a bounded sample; a vector's
codes come from a beam search over them. The index stores, in blocks of a
bounded size, the codes, the vectors' norms against those of their sums, what
the corrected sums leave of them, and the vectors. A query looks its products
with all codewords up in a table, adds them along the codes, corrects by the
norms and reranks the best candidates of each block exactly, in double precision.
Then it reranks every other vector that may still belong to the block's answer,
however many: whose guess lies below the answer's last score by no more than
``DEVIATIONS`` of the error that its remainder makes, were it turned at random.

Equal vectors of a block are coded and scored once; the smallest ids stand for
them, as many as an answer can hold. Queries are packed, and each pack is dealt
to every group of blocks, where it passes by the blocks held; a group answers
with its best, and these are merged by query. Nothing of queries or answers
passes through the driver.

Vectors that are null, zero, of another length than most, or with null or
non-finite components take no part, neither do null ids; queries of another
length than the vectors have no answer. Rows of one id are all
candidates for others, but not for a query of that id. Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Codebooks and codewords of each; rows they are trained on; beam width.
BOOKS, WORDS, SAMPLE_ROWS, BEAM = 8, 256, 8000, 4
#: Vectors and bytes of a block, candidates reranked in each at first, queries in a pack.
BLOCK_ROWS, BLOCK_BYTES, RERANKED, QUERY_ROWS = 16_384, 16 << 20, 384, 512
#: Deviations by which a guess may be wrong; vectors whose exact scores are computed at a time.
DEVIATIONS, SCORED = 3.0, 4096


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions): k-means on what the last ones leave."""
    rng, rest = np.random.default_rng(seed), sample.astype(np.float32)
    words = min(words, len(sample))
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for m in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            nearest = (rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            order = np.argsort(nearest, kind="stable")
            filled, starts = np.unique(nearest[order], return_index=True)
            sums = np.add.reduceat(rest[order], starts, axis=0)
            centres[filled] = sums / np.diff([*starts, len(rest)])[:, None]
        nearest = (rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        out[m], rest = centres, rest - centres[nearest]
    return out


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (vectors, books) by beam search for the least squared residual."""
    n = len(vectors)
    rest, codes = vectors.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # squared residual after each word, less what all words of a beam share
        error = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(axis=1)
        flat = error.reshape(n, -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rest = rest[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    return codes[np.arange(n), (rest**2).sum(axis=2).argmin(axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


BLOCK = "ids binary, groups binary, codes binary, ratios binary, left binary, vectors binary"


def build_index(rows: DataFrame, k: int, books: int = BOOKS, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray | None]:
    """Blocks (block, ids, codes, ratios, vectors as bytes) in the shared folder, and the codebooks."""
    kind = "float" if "array<float>" in rows.schema["v"].dataType.simpleString() else "double"
    word = np.dtype("<f4" if kind == "float" else "<f8")
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(2 * sample_rows).collect()
    codebooks = train(np.array([r["v"] for r in sample], np.float32), books) if sample else None
    if codebooks is None:
        codebooks = train(np.array([r["v"] for r in rows.limit(sample_rows).collect()], np.float32), books) if n else None
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)

    def block(ids: np.ndarray, matrix: np.ndarray):
        order = np.lexsort((ids, *matrix.T[::-1]))
        ids, matrix = ids[order], matrix[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (matrix[1:] != matrix[:-1]).any(axis=1)
        group = np.cumsum(fresh) - 1
        # the smallest distinct ids of equal vectors: an answer and the query's own
        new_id = fresh.copy()
        new_id[1:] |= ids[1:] != ids[:-1]
        nth = np.cumsum(new_id)
        kept = new_id & (nth - nth[np.flatnonzero(fresh)][group] <= k)
        distinct = matrix[fresh].astype(np.float32)
        codes = np.concatenate([encode(distinct[a : a + 1024], shared.value) for a in range(0, len(distinct), 1024)])
        own = np.linalg.norm(distinct, axis=1)
        sums = decode(codes, shared.value)
        coded = np.linalg.norm(sums, axis=1)
        ratio = np.where(coded > 0, own / np.maximum(coded, 1e-30), 1).astype("<f4")
        left = np.linalg.norm(distinct - ratio[:, None] * sums, axis=1).astype("<f4")
        return {"ids": ids[kept].astype("<i8").tobytes(), "groups": group[kept].astype("<i4").tobytes(), "codes": codes.tobytes(), "ratios": ratio.tobytes(), "left": left.tobytes(), "vectors": matrix[fresh].astype(word).tobytes()}

    def run(batches):
        ids, parts, held, number = [], [], 0, TaskContext.get().partitionId() << 24

        def flush():
            return pa.RecordBatch.from_pylist([{"block": number} | block(np.concatenate(ids), np.concatenate(parts))])

        for batch in batches:
            own = _matrix(batch.column("v"))
            most = max(1, min(block_rows, BLOCK_BYTES // max(1, own.itemsize * own.shape[1])))
            for a in range(0, batch.num_rows, most):
                some = batch.slice(a, most)
                if held + some.num_rows > most:
                    yield flush()
                    ids, parts, held, number = [], [], 0, number + 1
                ids.append(some.column("id").to_numpy())
                parts.append(own[a : a + most])
                held += some.num_rows
        if held:
            yield flush()

    blocks = rows.mapInArrow(run, f"block long, {BLOCK}")
    return materialize(blocks, "index"), codebooks


def search_block(row: dict, word: np.dtype, books: np.ndarray, tables: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, reranked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id and score of each query's best in one block. tables: products
    of queries with all codewords."""
    ids, groups = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["groups"], "<i4")
    codes = np.ascontiguousarray(np.frombuffer(row["codes"], np.uint8).reshape(-1, len(books)).T)
    ratios, left = np.frombuffer(row["ratios"], "<f4"), np.frombuffer(row["left"], "<f4")
    vectors = np.frombuffer(row["vectors"], word).reshape(len(ratios), -1)
    starts = np.searchsorted(groups, np.arange(len(ratios) + 1))
    out_q, out_i, out_s = [], [], []
    # no error is longer than the remainder itself
    spread = left * min(1.0, DEVIATIONS / vectors.shape[1] ** 0.5)
    lengths = np.linalg.norm(queries, axis=1)

    def others(best, q):
        """Ids and exact scores of the rows of some vectors, without the query's own."""
        exact = np.concatenate([vectors[best[a : a + SCORED]].astype(np.float64) @ queries[q] for a in range(0, len(best), SCORED)] or [np.zeros(0)])
        counts = starts[best + 1] - starts[best]
        at = np.repeat(starts[best] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        found, score = ids[at], np.repeat(exact, counts)
        other = found != query_ids[q]
        return found[other], score[other]

    for q in range(len(queries)):
        guess = tables[q, 0][codes[0]]
        for m in range(1, len(books)):
            guess += tables[q, m][codes[m]]
        guess *= ratios
        best = np.argpartition(guess, len(guess) - reranked)[len(guess) - reranked :] if len(guess) > reranked else np.arange(len(guess))
        found, score = others(best, q)
        if len(best) < len(guess):
            last = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            may = guess + lengths[q] * spread >= last
            may[best] = False
            more = others(np.flatnonzero(may), q)
            found, score = np.r_[found, more[0]], np.r_[score, more[1]]
        top = np.lexsort((found, -score))[:k]
        out_q.append(np.full(len(top), query_ids[q]))
        out_i.append(found[top])
        out_s.append(score[top])
    return tuple(np.concatenate(x) for x in (out_q, out_i, out_s))


def _packed(asked: DataFrame, query_rows: int) -> DataFrame:
    """Queries (ids, vectors as bytes), a bounded number a row."""

    def run(batches):
        for batch in batches:
            ids, own = batch.column("id").to_numpy(), _matrix(batch.column("v")).astype("<f8") if batch.num_rows else None
            for a in range(0, batch.num_rows, query_rows):
                part = slice(a, a + query_rows)
                yield pa.RecordBatch.from_pylist([{"ids": ids[part].astype("<i8").tobytes(), "vectors": own[part].tobytes()}])

    return asked.mapInArrow(run, "ids binary, vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", reranked: int = RERANKED, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` largest inner products found."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id", "v"])
    index, books = build_index(rows, k)
    word = np.dtype("<f4" if "array<float>" in rows.schema["v"].dataType.simpleString() else "<f8")
    shared = spark.sparkContext.broadcast(books)
    groups = max(1, index.count())
    block = index.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("turn", F.lit(0)).drop("block")
    packs = _packed(asked, query_rows).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("turn", F.lit(1))
    dealt = block.unionByName(packs, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "turn")

    def run(batches):
        own, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != own:
                    own, held = row["group"], []
                if not row["turn"]:
                    held.append(row)
                    continue
                if not held:
                    continue
                query_ids = np.frombuffer(row["ids"], "<i8")
                asked = np.frombuffer(row["vectors"], "<f8").reshape(len(query_ids), -1)
                if asked.shape[1] != shared.value.shape[2]:
                    continue
                tables = np.einsum("qd,mwd->qmw", asked.astype(np.float32), shared.value, optimize=True)
                for b in held:
                    q, i, s = search_block(b, word, shared.value, tables, query_ids, asked, k, reranked)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], ["query_id", "id", "score"])

    answers = dealt.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # the same id may be found in several blocks
    best = answers.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
