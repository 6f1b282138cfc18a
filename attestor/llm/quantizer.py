"""Vector code compression: product codebooks in whole numbers, by Yinyang Lloyd.

Components become floor(SCALE * x), vectors are cut into PARTS consecutive parts
and each part position has a codebook of ENTRIES entries.  A codebook's
entries are clustered into groups once.  Every row keeps, for each part, an upper
bound of the distance to its entry and one lower bound for each group of the
others.  When entries move, the bounds follow by the drift; a row is looked at
only if a lower bound does not exceed the upper one, and of the groups only
those whose bound fails are scanned.  Bounds are rounded outwards, and what is
scanned is compared by exact squared distances in integers, so ties go to the lower index.

Rows with their bounds are a checkpointed table, one for each round.  Sums of
members are added up in the tasks, then over about the square root of their
number; only these sums, whose size is the codebooks', reach the driver.

Defined cases: rows whose vector is null or holds a null or non-finite component
are dropped.  Vectors of each dimension have codebooks of their own (of ENTRIES
rows at most, so there are fewer entries where there are fewer vectors); part j
of d components begins at floor(j * d / PARTS), and an empty vector has code 0 and
error 0.  Null ids come last among the seeds, and rows of one id are ordered by
their vector; equal rows each get a row.  Components are held within
+-sqrt(2^58 / length of a part), so that distances are whole numbers of 64 bits.
Null labels are one label; a sum of errors beyond 64 bits is null.  An empty
table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm import kernels
from attestor.llm.session import prepare, release

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a group, about; rounds in which groups are found.
GROUP_ENTRIES, GROUP_ROUNDS = 16, 5
#: Parts in which the first rows are found.
SALTS = 64
_FAR = np.int64(2**63 - 1)

#: Of each dimension, the entries of all parts side by side: (entries, dimension).
Codebooks = dict[int, np.ndarray]
#: Of each dimension, the group of each entry of each part: (entries, PARTS).
Groups = dict[int, np.ndarray]

STATE = "vec_id long, label {label}, dim int, vector array<int>, codes binary, upper binary, lower binary"


def cuts(dim: int) -> list[slice]:
    return [slice(j * dim // PARTS, (j + 1) * dim // PARTS) for j in range(PARTS)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * reach) ** 2 < 2**52:  # whole numbers that a double holds exactly
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(np.where(d == _FAR, np.inf, d.astype(float)))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0) * (1 - 1e-12)
    return np.where(np.isinf(x), np.float32(np.inf), np.nextafter(x.astype(np.float32), np.float32(-1)))


def grouped(entries: np.ndarray) -> np.ndarray:
    """A group for each entry, by a few rounds of Lloyd's steps over the entries."""
    number = max(1, len(entries) // GROUP_ENTRIES)
    centres = entries[:: max(1, len(entries) // number)][:number].astype(float)
    of = np.zeros(len(entries), np.int64)
    for _ in range(GROUP_ROUNDS):
        of = ((entries[:, None, :] - centres) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            centres[g] = entries[of == g].mean(0)
    return of


def assign(x: np.ndarray, entries: np.ndarray, group: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entries and new bounds of one part's rows (rows, length).

    code is -1 for rows that have no entry yet; drift is how far each entry moved.
    lower[i, g] bounds the distances of row i to the entries of g other than its own.
    """
    groups = lower.shape[1]
    code, fresh = code.copy(), code < 0
    most = np.array([drift[group == g].max(initial=0) for g in range(groups)])
    upper = np.where(fresh, np.float32(np.inf), _up(upper + drift[code]))
    lower = np.where(fresh[:, None], np.float32(0), _down(lower - most))
    at = np.flatnonzero(upper >= lower.min(1))
    own = np.full(len(at), _FAR)
    known = ~fresh[at]
    own[known] = ((x[at[known]] - entries[code[at[known]]]) ** 2).sum(1)
    upper[at] = _up(_root(own))
    doubtful = upper[at] >= lower[at].min(1)
    at, own = at[doubtful], own[doubtful]
    before, best, least = code[at], np.where(code[at] < 0, len(entries), code[at]), own.copy()
    scans = []
    for g in range(groups):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(lower[at, g] <= _up(_root(least)))
        if not len(members) or not len(rows):
            if not len(members):
                lower[at, g] = np.inf
            continue
        d = squares(x[at[rows]], entries[members])
        first = d.argmin(1)
        d1, i1 = d[np.arange(len(rows)), first], members[first]
        d2 = np.partition(d, 1, axis=1)[:, 1] if len(members) > 1 else np.full(len(rows), _FAR)
        scans.append((g, rows, d1, i1, d2))
        closer = (d1 < least[rows]) | ((d1 == least[rows]) & (i1 < best[rows]))
        least[rows[closer]], best[rows[closer]] = d1[closer], i1[closer]
    # the entry a row had counts among the others of its group now
    left = np.flatnonzero((before >= 0) & (before != best))
    home = group[before[left]]
    lower[at[left], home] = np.minimum(lower[at[left], home], _down(_root(own[left])))
    for g, rows, d1, i1, d2 in scans:
        lower[at[rows], g] = _down(_root(np.where(i1 == best[rows], d2, d1)))
    code[at], upper[at] = best, _up(_root(least))
    return code, upper, lower


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places and vectors of a batch's rows of each dimension."""
    dims, vectors = batch.column("dim").to_numpy(), batch.column("vector")
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, vectors.take(pa.array(at)).flatten().to_numpy().astype(np.int64).reshape(len(at), dim)


def _unpacked(column: pa.Array, at: np.ndarray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1)


def _rows(batch: pa.RecordBatch, codebooks: Codebooks, groups: Groups, drifts: Codebooks | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """dim, places, vectors, codes, upper and lower bounds after an assignment; without drifts the first one."""
    for dim, at, x in _by_dim(batch):
        n, number = len(at), int(groups[dim].max(initial=0)) + 1
        if drifts is None:
            codes, upper, lower = np.full((n, PARTS), -1), np.zeros((n, PARTS), np.float32), np.zeros((n, PARTS * number), np.float32)
        else:
            codes, upper, lower = _unpacked(batch.column("codes"), at, np.uint8).astype(np.int64), _unpacked(batch.column("upper"), at, np.float32).copy(), _unpacked(batch.column("lower"), at, np.float32).copy()
        lower = lower.reshape(n, PARTS, number)
        for j, part in enumerate(cuts(dim)):
            drift = np.zeros(len(codebooks[dim])) if drifts is None else drifts[dim][:, j]
            codes[:, j], upper[:, j], lower[:, j] = assign(x[:, part], codebooks[dim][:, part], groups[dim][:, j], codes[:, j], upper[:, j], lower[:, j], drift)
        yield dim, at, x, codes, upper, lower.reshape(n, -1)


def _stepped(codebooks: Codebooks, groups: Groups, drifts: Codebooks | None) -> Callable:
    """Assigns a table's rows, with their state."""

    @kernels.tidied
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, _, codes, upper, lower in _rows(batch, codebooks, groups, drifts):
                kept = batch.take(pa.array(at))
                state = [pa.array([r.tobytes() for r in part], pa.binary()) for part in (codes.astype(np.uint8), upper, lower)]
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("vec_id", "label", "dim", "vector")] + state, names=["vec_id", "label", "dim", "vector", "codes", "upper", "lower"])

    return task


def _finished(codebooks: Codebooks, groups: Groups, drifts: Codebooks | None) -> Callable:
    """Assigns a table's rows a last time, with their exact errors."""

    @kernels.tidied
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x, codes, _, _ in _rows(batch, codebooks, groups, drifts):
                error = sum(((x[:, part] - codebooks[dim][codes[:, j], part]) ** 2).sum(1) for j, part in enumerate(cuts(dim)))
                kept = batch.take(pa.array(at))
                code = pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), kept.column("dim"), code, pa.array(error, pa.int64())], names=["vec_id", "label", "dim", "code", "error"])

    return task


def _sums_of(state: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each dimension, the sums (entries, dim) and numbers (entries, PARTS) of the members."""

    @kernels.tidied
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, at, x in _by_dim(batch):
                sums, counts = found.setdefault(dim, (np.zeros((sizes[dim], dim), np.int64), np.zeros((sizes[dim], PARTS), np.int64)))
                codes = _unpacked(batch.column("codes"), at, np.uint8)
                for j, part in enumerate(cuts(dim)):
                    np.add.at(sums[:, part], codes[:, j], x[:, part])
                    counts[:, j] += np.bincount(codes[:, j], minlength=sizes[dim])
        yield from _packed(found)

    @kernels.tidied
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                _add(found, row["dim"], row["sums"], row["counts"], sizes)
        yield from _packed(found)

    kind = "dim int, sums binary, counts binary"
    few = max(1, int(state.rdd.getNumPartitions() ** 0.5))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in state.select("dim", "vector", "codes").mapInArrow(summed, kind).repartition(few).mapInArrow(added, kind).toLocalIterator():
        _add(out, row["dim"], row["sums"], row["counts"], sizes)
    return out


def _add(found: dict[int, tuple[np.ndarray, np.ndarray]], dim: int, sums: bytes, counts: bytes, sizes: dict[int, int]) -> None:
    new = np.frombuffer(sums, np.int64).reshape(sizes[dim], dim), np.frombuffer(counts, np.int64).reshape(sizes[dim], PARTS)
    old = found.get(dim)
    found[dim] = (old[0] + new[0], old[1] + new[1]) if old else new


def _packed(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for dim, (sums, counts) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([sums.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["dim", "sums", "counts"])


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and vector (whole numbers) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    reach = F.floor(F.sqrt(F.lit(2.0**58) / F.greatest(F.ceil(F.size("embedding") / PARTS), F.lit(1)))).cast("double")
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, reach), -reach)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long"), "label", F.size("embedding").alias("dim"), whole.alias("vector"))


def seeds(rows: DataFrame) -> Codebooks:
    """The vectors of the ENTRIES smallest ids of each dimension, ascending."""
    first = "row_number() OVER (PARTITION BY dim{} ORDER BY vec_id ASC NULLS LAST, vector)"
    some = rows.select("dim", "vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(SALTS)).alias("_salt"))
    for extra in (", _salt", ""):
        some = some.withColumn("_n", F.expr(first.format(extra))).where(F.col("_n") <= ENTRIES)
    found: dict[int, list[tuple[int, list[int]]]] = {}
    for row in some.select("dim", "_n", "vector").collect():
        found.setdefault(row["dim"], []).append((row["_n"], row["vector"]))
    return {dim: np.array([v for _, v in sorted(own)], np.int64).reshape(len(own), dim) for dim, own in found.items()}


def moved(codebooks: Codebooks, sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[Codebooks, Codebooks]:
    """The codebooks of floored means, unused entries as they were, and how far entries moved."""
    new, drifts = {}, {}
    for dim, old in codebooks.items():
        total, counts = sums[dim]
        new[dim], drifts[dim] = old.copy(), np.zeros((len(old), PARTS))
        for j, part in enumerate(cuts(dim)):
            used = counts[:, j] > 0
            new[dim][used, part] = total[used, part] // counts[used, j][:, None]
            drifts[dim][:, j] = np.sqrt(((new[dim][:, part] - old[:, part]).astype(float) ** 2).sum(1)) * (1 + 1e-12)
    return new, drifts


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks after ``rounds``, and vec_id, label, dim, code and error of each row of integers()."""
    spark = prepare(rows.sparkSession)
    codebooks, drifts, state = seeds(rows), None, rows
    groups = {dim: np.stack([grouped(book[:, part]) for part in cuts(dim)], axis=1) for dim, book in codebooks.items()}
    sizes = {dim: len(book) for dim, book in codebooks.items()}
    kind = STATE.format(label=rows.schema["label"].dataType.simpleString())
    for _ in range(rounds):
        state = state.mapInArrow(_stepped(codebooks, groups, drifts), kind).checkpoint()
        codebooks, drifts = moved(codebooks, _sums_of(state, sizes))
        release(spark)  # the state before this one is spent
    last = state.mapInArrow(_finished(codebooks, groups, drifts), kind.split(" dim ")[0] + " dim int, code string, error long")
    return codebooks, last


def decoded(code: str, codebook: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    at = bytes.fromhex(code)
    return np.concatenate([codebook[at[j], part] for j, part in enumerate(cuts(codebook.shape[1]))])


def text_of(codebook: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(str(c) for part in cuts(codebook.shape[1]) for entry in codebook[:, part].tolist() for c in entry)


def compress(vectors: DataFrame) -> DataFrame:
    """op13: codes and errors of all rows, by label too, and the digest of the codebooks."""
    codebooks, rows = fit(integers(vectors))
    rows = rows.checkpoint()
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    digests = F.create_map(*[F.lit(x) for dim, book in codebooks.items() for x in (dim, hashlib.sha256(text_of(book).encode()).hexdigest())]) if codebooks else F.lit(None).cast("map<int,string>")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", digests[F.col("dim")].alias("codebooks_sha256"))


#: The same in SQL, for vectors of one dimension.
ORACLE = f"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS t(p)),
books AS (
  SELECT 0 AS round, p, r - 1 AS e, x FROM points WHERE r <= {ENTRIES}
  UNION ALL
  SELECT round + 1, p, e, coalesce(means.x, book.x) FROM (SELECT * FROM books) AS book LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS x FROM (
      SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (
        SELECT q.p, q.x, arg_min(b.e, (list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e
        FROM points AS q JOIN books AS b ON q.p = b.p GROUP BY q.r, q.p, q.x), range(1, 65) AS t(i)
      WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e) AS means USING (p, e) WHERE round < {ROUNDS}),
final AS MATERIALIZED (SELECT p, e, x FROM books WHERE round = {ROUNDS}),
coded AS (
  SELECT r, p, min((d, e)) AS best FROM (
    SELECT q.r, q.p, b.e, CAST(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM points AS q JOIN final AS b ON q.p = b.p) GROUP BY r, p),
rows AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM coded JOIN kept USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM final) AS codebooks_sha256
FROM rows
"""
