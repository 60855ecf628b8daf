"""Approximate nearest neighbours by additive quantisation, reranked exactly.

A vector, scaled to unit length, is coded as a sum of ``books`` codewords, each of the full
dimension. Codebooks start as residual k-means and are refitted jointly by least squares; codes
come from a beam search. The norm of the decoded vector is stored beside its code. A query scores
a code by one look-up in each of its tables, -2 q.c summed, plus the stored squared norm; the
best distinct vectors are reranked by the exact cosine in double precision.

How many are reranked is measured, not fixed: for ``probes`` queries the true neighbours are found
by a scan of all vectors, and the places that these have in the order of approximate scores are
counted over all codes. The shortlist is ``slack`` times the place that ``recall`` of them don't
exceed, and ``least`` at least.

How it scales. Codebooks are fitted on a bounded sample (``sample`` distinct vectors of lowest
hash). Every distinct vector is indexed, as blocks of codes; of its equal rows the ``top`` + 1
smallest ids stay beside it, all that can be among the nearest. Queries are dealt into blocks too; a
block of queries meets each group of code blocks in one task, which keeps the best of its group only,
so what leaves it is bounded by queries times shortlist. No vectors but the shortlist's are exchanged.

Edge cases. Null, zero, non-finite vectors, vectors with null components and rows with a null id
take no part. Vectors of different dimensions have no nearness: each dimension is searched apart.
Repeated ids are rows of their own: each is a candidate of all others and, if asked, has its own
neighbours. Ties go to the smaller id. Equal rows take one place of the shortlist; rows that only
nearly equal each other take one each. Empty tables give no rows; columns other than the id and the
vector aren't read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm import _shared as sh

BOOKS, WORDS, BEAM = 16, 256, 4
SAMPLE, ROUNDS, REFITS = 12_000, 6, 2
TOP, PROBES, RECALL, SLACK, LEAST = 5, 128, 0.98, 1.5, 100
CODE_BLOCK, QUERY_BLOCK, GROUP = 8192, 1024, 32


@dataclass
class Codebooks:
    """books x words x dimension."""

    c: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes of unit vectors, by beam search over the codebooks in turn."""
        books, words, dim = self.c.shape
        out = np.empty((len(x), books), np.uint8)
        norms = (self.c**2).sum(2)
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            n = len(part)
            residual = part[:, None, :]
            codes = np.empty((n, 1, 0), np.uint8)
            for m in range(books):
                width = residual.shape[1]
                error = (residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(-1, dim) @ self.c[m].T).reshape(n, width, words) + norms[m]
                flat = error.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                row, word = best // words, best % words
                pick = np.arange(n)[:, None]
                residual = residual[pick, row] - self.c[m][word]
                codes = np.concatenate([codes[pick, row], word[:, :, None].astype(np.uint8)], axis=2)
            best = (residual**2).sum(2).argmin(1)
            out[lo : lo + 512] = codes[np.arange(n), best]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[m][codes[:, m]] for m in range(len(self.c)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x books x words of -2 q.c."""
        return -2 * np.einsum("qd,mwd->qmw", queries, self.c, optimize=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, refits: int = REFITS, seed: int = 5) -> Codebooks:
    """Codebooks of unit vectors: residual k-means, then joint least-squares refits on beam codes."""
    rng = np.random.default_rng(seed)
    words = int(min(words, max(1, len(x) // 4)))
    residual, c = x.copy(), np.zeros((books, words, x.shape[1]), np.float32)
    for m in range(books):
        c[m] = _kmeans(residual, words, rounds, rng)
        at = ((c[m] ** 2).sum(1) - 2 * residual @ c[m].T).argmin(1)
        residual = residual - c[m][at]
    model = Codebooks(c)
    for _ in range(refits):
        codes = model.encode(x).astype(int) + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        right = np.zeros((books * words, x.shape[1]))
        for m in range(books):
            np.add.at(right, codes[:, m], x)
            for n in range(books):
                np.add.at(gram, (codes[:, m], codes[:, n]), 1.0)
        # The ridge holds each codeword near where it was, so rare ones stay put.
        ridge = 0.1
        gram[np.diag_indices_from(gram)] += ridge
        right += ridge * model.c.reshape(books * words, -1)
        model = Codebooks(np.linalg.solve(gram, right).astype(np.float32).reshape(books, words, -1))
    return model


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v of the rows that take part."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok"))
    return rows.where("ok and vec_id is not null").select("vec_id", "v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _exact_units(x: np.ndarray) -> np.ndarray:
    """x scaled to unit length in double precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct_vectors(vectors: DataFrame, keep: int) -> DataFrame:
    """key, v, ids and dim: each vector once, with the keep smallest ids that have it."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    # The limit acts before the exchange too, so a vector with a third of the rows sends few.
    few = vectors.withColumn("place", place).where(F.col("place") <= keep)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.monotonically_increasing_id().alias("key"), "v", "ids", F.size("v").alias("dim"))


def true_neighbours(vectors: DataFrame, probes: list[tuple[int, list[float]]], top: int) -> DataFrame:
    """probe, place, key and v of the top vectors (key, v) of largest cosine to each probe."""
    q = _exact_units(np.array([v for _, v in probes], np.float64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            score = q @ _exact_units(_matrix(batch.column("v"), q.shape[1])).T
            k = min(top, score.shape[1])
            best = np.argpartition(-score, k - 1, axis=1)[:, :k]
            rows = batch.take(pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(q)), k)), rows.column("key"), rows.column("v"), pa.array(np.take_along_axis(score, best, 1).ravel())],
                names=["probe", "key", "v", "score"],
            )

    found = vectors.select("key", "v").mapInArrow(scan, f"probe long, key long, v {vectors.schema['v'].dataType.simpleString()}, score double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= top)


def measured_shortlist(model: Codebooks, vectors: DataFrame, blocks: DataFrame, queries: DataFrame, top: int, probes: int, recall: float, slack: float, least: int, beam: int) -> int:
    """How many codes to rerank, from the places of true neighbours of some queries among all codes."""
    # At most probes queries, and top neighbours of each.
    drawn = [(r.q, r.v) for r in sh.sample(queries, probes, "q").collect()]
    near = true_neighbours(vectors, drawn, top).select("probe", "v").collect()
    x = _units(np.array([r.v for r in near], np.float64))
    codes = model.encode(x, beam)
    asked = np.array([r.probe for r in near])
    tables = model.tables(_units(np.array([v for _, v in drawn], np.float64)))
    books = np.arange(codes.shape[1])
    own = (tables[asked[:, None], books, codes].sum(1) + (model.decode(codes) ** 2).sum(1)).astype(np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((tables, asked, own))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, asked, own = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                norms = np.frombuffer(row["norms"], np.float32)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(norms), -1)
                total = np.zeros(len(own), np.int64)
                for p in range(len(tables)):
                    score = np.sort(sum(tables[p, m][codes[:, m]] for m in range(codes.shape[1])) + norms)
                    at = np.flatnonzero(asked == p)
                    total[at] = np.searchsorted(score, own[at] + 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(total)], names=["at", "n"])

    places = blocks.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    shared.destroy()
    return max(least, int(np.ceil(slack * np.quantile([r.n for r in places], recall))))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE, books: int = BOOKS, beam: int = BEAM, probes: int = PROBES, recall: float = RECALL, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest found of each query row among the other rows.

    vectors and queries have vec_id and v, as usable() gives them; queries are rows of vectors.
    """
    known = sh.written(distinct_vectors(vectors, top + 1), "distinct-vectors")
    asked = queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")).select(F.monotonically_increasing_id().alias("q"), "*")
    asked = sh.written(asked, "queries")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in known.select("dim").distinct().orderBy("dim").collect():
        mine = asked.where(F.size("v") == r.dim)
        if mine.take(1):
            out = out.unionByName(_nearest(known.where(F.col("dim") == r.dim), mine, r.dim, top, sample, books, beam, (probes, recall, slack, least)))
    return out


def _nearest(vectors: DataFrame, queries: DataFrame, dim: int, top: int, sample: int, books: int, beam: int, measure: tuple) -> DataFrame:
    """nearest() of vectors (key, v, ids) and queries (q, vec_id, v, times) of one dimension."""
    spark = vectors.sparkSession
    drawn = sh.sample(vectors.select("key", "v"), sample, "v").collect()
    model = train(_units(np.array([r.v for r in drawn], np.float64)), books)
    shared = spark.sparkContext.broadcast(model)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo in range(0, len(batch), CODE_BLOCK):
                part = batch.slice(lo, CODE_BLOCK)
                ids = part.column("key").to_numpy()
                codes = model.encode(_units(_matrix(part.column("v"), dim)), beam)
                norms = (model.decode(codes) ** 2).sum(1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids.min())]), pa.array([ids.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([norms.tobytes()], pa.binary())], names=["block", "ids", "codes", "norms"])

    blocks = sh.written(vectors.select("key", "v").mapInArrow(index, "block long, ids binary, codes binary, norms binary"), "codes")
    n_queries, n_blocks = queries.count(), blocks.count()
    shortlist = measured_shortlist(model, vectors, blocks, queries.select("q", "v"), top + 1, *measure, beam)
    query_blocks = -(-n_queries // QUERY_BLOCK)
    groups = -(-n_blocks // GROUP)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (qb, kind, ids, codes, norms) in the order of (qb, group, kind): queries, then code blocks."""
        model = shared.value
        key, ids, unit, best = None, None, None, None

        def result() -> Iterator[pa.RecordBatch]:
            for q, (score, vec) in zip(ids.tolist(), best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vec), q)), pa.array(vec), pa.array(score.astype(np.float64))], names=["q", "key", "approx"])

        for batch in batches:
            for row in batch.to_pylist():
                at = (row["qb"], row["g"])
                if row["kind"] == 0:
                    if at != key:
                        if key is not None:
                            yield from result()
                        key, ids, unit, best = at, np.empty(0, np.int64), np.empty((0, dim), np.float32), []
                    new = np.frombuffer(row["ids"], np.int64)
                    ids = np.concatenate([ids, new])
                    unit = np.concatenate([unit, np.frombuffer(row["codes"], np.float32).reshape(-1, dim)])
                    best += [(np.empty(0, np.float32), np.empty(0, np.int64)) for _ in new]
                elif at == key:
                    vec = np.frombuffer(row["ids"], np.int64)
                    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(vec), -1)
                    norms = np.frombuffer(row["norms"], np.float32)
                    tables = model.tables(unit)
                    columns = [np.ascontiguousarray(codes[:, m]) for m in range(codes.shape[1])]
                    for i in range(len(ids)):
                        score = norms.copy()
                        for m, c in enumerate(columns):
                            score += tables[i, m][c]
                        if len(score) > 2 * shortlist:
                            limit = np.partition(score, shortlist)[shortlist]
                            near = np.flatnonzero(score <= limit)
                        else:
                            near = np.arange(len(score))
                        s, v = np.concatenate([best[i][0], score[near]]), np.concatenate([best[i][1], vec[near]])
                        order = np.lexsort((v, s))[:shortlist]
                        best[i] = (s[order], v[order])
        if key is not None:
            yield from result()

    def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            qb = batch.column("qb").to_numpy()
            unit, ids = _units(_matrix(batch.column("v"), dim)) if len(batch) else np.empty((0, dim), np.float32), batch.column("q").to_numpy()
            for b in np.unique(qb).tolist():
                at = qb == b
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([ids[at].tobytes()], pa.binary()), pa.array([unit[at].tobytes()], pa.binary())], names=["qb", "ids", "codes"])

    asked = queries.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks)))
    asked = asked.select("qb", "q", "v").mapInArrow(query_rows, "qb long, ids binary, codes binary")
    left = asked.select("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(0).alias("kind"), "ids", "codes", F.lit(None).cast("binary").alias("norms"))
    right = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.lit(1).alias("kind"), "ids", "codes", "norms")
    met = left.unionByName(right).repartition("qb", "g").sortWithinPartitions("qb", "g", "kind")
    found = met.mapInArrow(search, "q long, key long, approx double")
    by_query = Window.partitionBy("q").orderBy("approx", "key")
    found = found.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= shortlist).select("q", "key")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = _matrix(batch.column("qv"), dim), _matrix(batch.column("v"), dim)
            score = (_exact_units(a) * _exact_units(b)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("key"), pa.array(score), pa.array((a == b).all(1))], names=["q", "key", "score", "own"])

    pairs = found.join(queries.select("q", F.col("v").alias("qv")), "q").join(vectors.select("key", "v"), "key")
    scored = pairs.select("q", "key", "qv", "v").mapInArrow(exact, "q long, key long, score double, own boolean")
    # Each vector stands for one row at least, one of them perhaps the query: top + 1 with their ties suffice.
    by_score = Window.partitionBy("q").orderBy(F.desc("score"))
    best = scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top + 1)
    best = best.join(vectors.select("key", "ids"), "key").join(queries.select("q", F.col("vec_id").alias("query_id"), "times"), "q")
    # Of rows equal to the query's one is the query itself.
    itself = F.when(F.col("own"), F.array_position("ids", F.col("query_id"))).otherwise(F.lit(0))
    others = F.filter("ids", lambda x, i: i + 1 != F.col("itself"))
    rows = best.withColumn("itself", itself).select("q", "query_id", "times", "score", F.explode(others).alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark, sf_dir) -> DataFrame:
    """Contract query: the 5 nearest of each vector whose id is divisible by 50."""
    vectors = usable(sh.documents(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))
