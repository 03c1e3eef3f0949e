"""An index of vectors: k-means cells and product-quantised residuals, re-ranked exactly.

A bounded sample trains the model: the centres of the cells, and for each part
of a vector a codebook for what is left of it after its centre is taken away.
Every vector is stored as its cell and one byte for each part. A search sends
a question to its nearest cells, adds up tabled distances for the codes there,
keeps the best few of each question by that estimate and reads only their
vectors, for the exact distance. With all cells probed and as many re-ranked
as a scope holds, the answer is the exact one.

Vectors are compared by cosine, so they are brought to length 1 first. Null
vectors and those of another length than the model's are not indexed, as they
cannot be compared; all-zero vectors have no direction (their distance is NaN,
after every number) and lie in the cell that comes out. Ties go to the smaller
id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.embedding import cosine_distance
from lodestar.sources.shared import stored

#: Vectors that the model is fitted to, by the smallest hashes of their values.
SAMPLE = 20_000
CELLS, CODES = 1_024, 256
#: Codes of one cell that are compared in one task.
PART_ROWS = 100_000
BROADCAST = 10_000


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length == 0, 1, length)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` centres (or as many as there are different rows), by Lloyd's rounds."""
    rows = np.unique(rows, axis=0)
    random = np.random.default_rng(seed)
    centres = rows[random.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = _squares(rows, centres).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, rows)
        empty = counts == 0
        centres = np.where(empty[:, None], rows[random.choice(len(rows), len(centres))], sums / np.maximum(counts, 1)[:, None])
    return centres


@dataclass(frozen=True)
class Model:
    """``centres``: cells x dim; ``books``: parts x codes x width."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def nearest_cells(self, rows: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(_squares(rows, self.centres), axis=1, kind="stable")[:, :n]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of each row."""
        rows = _unit(rows)
        cells = self.nearest_cells(rows, 1)[:, 0]
        rest = (rows - self.centres[cells]).reshape(len(rows), len(self.books), -1)
        codes = np.stack([_squares(rest[:, p], book).argmin(axis=1) for p, book in enumerate(self.books)], axis=1)
        return cells, codes.astype(np.uint8)

    def estimates(self, cell: int, codes: np.ndarray, questions: np.ndarray) -> np.ndarray:
        """Squared distance of each question to each code of the cell."""
        rest = (questions - self.centres[cell]).reshape(len(questions), len(self.books), -1)
        total = np.zeros((len(questions), len(codes)))
        for p, book in enumerate(self.books):
            total += _squares(rest[:, p], book)[:, codes[:, p]]
        return total

    def state(self) -> tuple[list, list]:
        return self.centres.tolist(), self.books.tolist()

    @staticmethod
    def of(state: tuple[list, list]) -> Model:
        return Model(np.array(state[0]), np.array(state[1]))


def fit(vectors: DataFrame, vector_col: str = "embedding", cells: int | None = None, parts: int = 16, sample: int = SAMPLE) -> Model | None:
    """The model of a sample of ``vectors``; None without any. ``cells``: the square root of the sample's size unless given."""
    held = vectors.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    dims = held.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if dims is None or not dims.dim:
        return None
    chosen = held.where(F.size("v") == dims.dim).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x))).orderBy(F.xxhash64("v")).limit(sample).collect()  # a bounded sample
    rows = _unit(np.array([r.v for r in chosen])) if chosen else np.zeros((1, dims.dim))
    n_cells = min(cells or round(len(rows) ** 0.5), CELLS)
    centres = kmeans(rows, max(n_cells, 1))
    parts = max(p for p in range(1, parts + 1) if dims.dim % p == 0)
    rest = (rows - centres[_squares(rows, centres).argmin(axis=1)]).reshape(len(rows), parts, -1)
    books = [kmeans(rest[:, p], CODES) for p in range(parts)]
    most = max(map(len, books))
    return Model(centres, np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books]))


def coded(vectors: DataFrame, model: Model, keys: list[str], vector_col: str = "embedding") -> DataFrame:
    """``keys``, cell, part (of the cell) and code of every vector of the model's length: the index."""
    shared = vectors.sparkSession.sparkContext.broadcast(model.state())
    held = vectors.select(*keys, F.col(vector_col).cast("array<double>").alias("v")).where(F.size("v") == model.dim).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.of(shared.value)
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, known.dim)
            cells, codes = known.encode(rows)
            columns = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*keys, "cell", "code"])

    schema = held.select(*keys).schema.add("cell", "integer").add("code", "binary")
    found = stored(held.mapInArrow(run, schema), "codes")
    sizes = found.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # a row for each cell
    return found.join(F.broadcast(sizes), "cell").select(*keys, "cell", F.pmod(F.xxhash64(*keys), "parts").cast("int").alias("part"), "parts", "code")


def _asked(questions: DataFrame, model: Model, keys: list[str], probes: int) -> DataFrame:
    """``keys``, cell and the unit vector, for each of the nearest cells of each question that can be compared."""
    shared = questions.sparkSession.sparkContext.broadcast(model.state())
    held = questions.select(*keys, F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") == model.dim).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model.of(shared.value)
        for batch in batches:
            rows = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, known.dim))
            cells = known.nearest_cells(rows, probes)
            of = np.repeat(np.arange(len(rows)), cells.shape[1])
            columns = [batch.column(k).take(pa.array(of)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.ravel().astype(np.int32)), pa.array(list(rows[of]), pa.list_(pa.float64()))], names=[*keys, "cell", "v"])

    return held.mapInArrow(run, held.select(*keys).schema.add("cell", "integer").add("v", held.schema["v"].dataType))


def candidates(index: DataFrame, questions: DataFrame, model: Model, scope: list[str], probes: int, rerank: int, query_id: str = "query_id", doc: str = "id") -> DataFrame:
    """query, ``doc``, estimate: the ``rerank`` best codes of each question among those of its scope in its cells."""
    asked = _asked(questions, model, [query_id, *scope], probes)
    parts = index.groupBy("cell").agg(F.max("parts").alias("parts"))  # a row for each cell
    asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    shared = index.sparkSession.sparkContext.broadcast(model.state())
    out = questions.select(query_id).schema.add(index.schema[doc]).add("estimate", "double")

    def run(codes: pa.Table, rows: pa.Table) -> pa.Table:
        known = Model.of(shared.value)
        found: list[tuple] = []
        if codes.num_rows and rows.num_rows:
            cell = rows.column("cell")[0].as_py()
            at: dict[tuple, list[int]] = {}
            for n, s in enumerate(zip(*[codes.column(c).to_pylist() for c in scope])):
                at.setdefault(s, []).append(n)
            packed = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            ids, names = codes.column(doc).to_pylist(), rows.column(query_id).to_pylist()
            wanted: dict[tuple, list[int]] = {}
            for n, s in enumerate(zip(*[rows.column(c).to_pylist() for c in scope])):
                wanted.setdefault(s, []).append(n)
            vectors = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            for s, asks in wanted.items():
                mine = np.array(at.get(s, []), np.int64)
                for n in range(0, len(asks) if len(mine) else 0, 64):
                    some = asks[n : n + 64]
                    near = known.estimates(cell, packed[mine], vectors[some])
                    best = np.argpartition(near, min(rerank, near.shape[1]) - 1, axis=1)[:, :rerank]
                    found += [(names[q], ids[mine[j]], float(near[i, j])) for i, q in enumerate(some) for j in best[i]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ((), (), ()), (rows.schema.field(query_id).type, codes.schema.field(doc).type, pa.float64()))], names=[query_id, doc, "estimate"])

    near = index.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(run, out)
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy("estimate", doc))
    return near.withColumn("nth", nth).where(F.col("nth") <= rerank).drop("nth")


def approximate_nearest(
    vectors: DataFrame, index: DataFrame, questions: DataFrame, model: Model, scope: list[str], k: int, probes: int = 32, rerank: int | None = None, query_id: str = "query_id", doc: str = "id"
) -> DataFrame:
    """query, ``doc``, semantic_distance and sem_pos of the ``k`` nearest found of each question.

    ``vectors``: scope, ``doc`` and embedding, of which no more than ``rerank``
    (ten times ``k`` unless given) are read for a question.
    """
    chosen = stored(candidates(index, questions, model, scope, probes, rerank or 10 * k, query_id, doc), "vector-candidates")
    chosen = chosen.join(questions.select(query_id, *scope, F.col("embedding").alias("asked")), query_id)
    chosen = F.broadcast(chosen) if chosen.limit(BROADCAST + 1).count() <= BROADCAST else chosen
    found = vectors.select(*scope, doc, "embedding").join(chosen, [*scope, doc]).select(query_id, doc, cosine_distance(F.col("embedding"), F.col("asked")).alias("semantic_distance"))
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("semantic_distance").asc_nulls_last(), doc))
    return found.withColumn("sem_pos", nth).where(F.col("sem_pos") <= k)


def write_model(model: Model, spark, path: str) -> None:
    """The model as a table: a row for each centre and each book."""
    rows = [("centre", n, c) for n, c in enumerate(model.centres.tolist())] + [("book", n, [x for code in b for x in code]) for n, b in enumerate(model.books.tolist())]
    spark.createDataFrame(rows, "kind string, n int, v array<double>").coalesce(1).write.parquet(path)


def read_model(spark, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("n").collect()  # cells and parts
    centres = np.array([r.v for r in rows if r.kind == "centre"])
    books = [np.array(r.v) for r in rows if r.kind == "book"]
    width = centres.shape[1] // len(books)
    return Model(centres, np.stack([b.reshape(-1, width) for b in books]))
