"""Embedding near-dedup: product quantisation over coarse inverted lists, exact cosine rerank.

Vectors are scaled to length one, so a cosine of ``c`` is a distance of ``sqrt(2 - 2 c)``. Each is
put in the list of its nearest coarse centre; what it differs from the centre is coded in
subspaces. As a query, a vector probes every list whose plane lies within half the threshold's
distance: two vectors of different lists lie on either side of the plane between these, so their
distances to it add up to no more than their own, and one of the two is that near. A pair found from
one end only counts at both. A query compares table-lookup distances, less each code's own error (so
the lookup loses nothing), and reranks what remains by the exact cosine. So no link is lost, however
the vectors lie.

Exact copies are one class before the search. Lists larger than a block are split into blocks, as
are their queries, so no task gets more than a block of either; only link counts and the edges of
each block's components leave it, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COSINE = 0.95
#: Vectors the quantiser is fitted on at most; every vector is indexed.
SAMPLE_ROWS = 20_000
MAX_LISTS = 4_096
SUBSPACES, CODES = 8, 32
BLOCK_ROWS = 2_048
#: Slack of the distance bounds against rounding.
SLACK = 1e-6


class Quantiser(NamedTuple):
    centres: np.ndarray  # lists x dims
    codebooks: np.ndarray  # subspaces x codes x width


class Space(NamedTuple):
    """What vectors of one length are searched by; lists of all lengths are numbered on."""

    quantiser: Quantiser
    margin: float
    first: int


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    out = np.empty(len(x), dtype=np.int64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = (half - x[s : s + 4096] @ centres.T).argmin(1)
    return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
    return centres


def fit(sample: np.ndarray, lists: int, seed: int = 3) -> Quantiser:
    """Coarse centres and one codebook for each subspace of the residuals."""
    rng = np.random.default_rng(seed)
    centres = _kmeans(sample, lists, 8, rng)
    rest = sample - centres[_nearest(sample, centres)]
    books = [_kmeans(part, CODES, 6, rng) for part in np.array_split(rest, SUBSPACES, axis=1)]
    return Quantiser(centres, np.array([np.pad(b, ((0, CODES - len(b)), (0, _width(sample) - b.shape[1]))) for b in books]))


def _width(x: np.ndarray) -> int:
    return -(-x.shape[1] // SUBSPACES)


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, width), zero-padded."""
    parts = np.array_split(x, SUBSPACES, axis=1)
    return np.stack([np.pad(p, ((0, 0), (0, _width(x) - p.shape[1]))) for p in parts], axis=1)


def encode(rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the length of what the codes miss."""
    parts = _parts(rest)
    codes = np.stack([_nearest(parts[:, m], books[m]) for m in range(SUBSPACES)], axis=1)
    miss = parts - books[np.arange(SUBSPACES), codes]
    return codes.astype(np.uint8), np.sqrt((miss**2).sum((1, 2)))


def probe_margin(cosine: float, dims: int, sigmas: float | None = None) -> float:
    """Distance from a plane within which the list behind it is probed: half that of the threshold.

    With ``sigmas``, a smaller one that counts on differences in random directions and can lose links.
    """
    half = (2 - 2 * cosine) ** 0.5 / 2
    return half if sigmas is None else half * min(1.0, sigmas / dims**0.5)


def probes(x: np.ndarray, own: np.ndarray, q: Quantiser, margin: float) -> np.ndarray:
    """(rows, lists): whether a row lies within ``margin`` of the plane between its list and another.

    Its own list is always probed. With a margin of half the distance, one end of every link probes
    the list of the other.
    """
    norms = (q.centres**2).sum(1)
    d2 = (x**2).sum(1)[:, None] + norms - 2 * x @ q.centres.T
    rows = np.arange(len(x))
    gap = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * q.centres[own] @ q.centres.T, 1e-30))
    out = d2 - d2[rows, own][:, None] <= 2 * gap * (margin + SLACK)
    out[rows, own] = True
    return out


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_numpy()).astype(np.float64)
    # by the largest component first, so that no square overflows or vanishes
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


def _index(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (same for batch in batches for _, same in batch.groupby(batch["embedding"].map(len))):
            q, margin, first = shared.value[len(pdf["embedding"].iloc[0])]
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start : start + 1024]
                x = _unit(part["embedding"])
                own = _nearest(x, q.centres)
                codes, miss = encode(x - q.centres[own], q.codebooks)
                cuts = np.array_split(np.arange(len(x)), max(1, len(x) // 128))
                probed = np.concatenate([probes(x[rows], own[rows], q, margin) for rows in cuts])
                yield pd.DataFrame(
                    {"list": first + own, "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "embedding": part["embedding"].to_numpy(), "code": [c.tobytes() for c in codes], "miss": miss, "probed": [np.flatnonzero(p) for p in probed], "own": own, "query": False}
                )
                for rows in cuts:
                    r, c = np.nonzero(probed[rows])
                    r = rows[r]
                    for s in range(0, len(r), 4096):
                        t = r[s : s + 4096]
                        yield pd.DataFrame(
                            {"list": first + c[s : s + 4096], "rep": part["rep"].to_numpy()[t], "copies": part["copies"].to_numpy()[t], "embedding": part["embedding"].to_numpy()[t], "code": None, "miss": None, "probed": None, "own": own[t], "query": True}
                        )

    return run


def block_links(base: pd.DataFrame, queries: pd.DataFrame, q: Quantiser, at: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, base row) pairs of one block with the cosine or more, by lookup, then exactly."""
    reach = np.sqrt(2 - 2 * cosine) + SLACK
    y, x = _unit(base["embedding"]), _unit(queries["embedding"])
    codes = np.frombuffer(b"".join(base["code"]), dtype=np.uint8).reshape(len(base), SUBSPACES)
    bound = (reach + base["miss"].to_numpy(dtype=np.float64)) ** 2 + SLACK
    width = q.codebooks.shape[2]
    left, right = [], []
    for s in range(0, len(x), 256):
        part = _parts(x[s : s + 256] - q.centres[at])
        table = ((part[:, :, None, :] - q.codebooks[None]) ** 2).sum(3) if width else np.zeros((len(part), SUBSPACES, CODES))
        near = np.zeros((len(part), len(y)))
        for m in range(SUBSPACES):
            near += table[:, m][:, codes[:, m]]
        i, j = np.nonzero(near <= bound)
        keep = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 65_536):
            u = slice(k, k + 65_536)
            keep[u] = np.einsum("rd,rd->r", x[s + i[u]], y[j[u]]) >= cosine
        left.append(s + i[keep])
        right.append(j[keep])
    return np.concatenate(left), np.concatenate(right)


def _search(shared, cosine: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "low": pd.Series(dtype="int64")})
        base, queries = pdf[~pdf["query"]], pdf[pdf["query"]]
        if base.empty or queries.empty:
            return empty
        q, _, first = shared.value[len(base["embedding"].iloc[0])]
        i, j = block_links(base, queries, q, int(key[0]) - first, cosine)
        mine, theirs = queries["rep"].to_numpy(), base["rep"].to_numpy()
        other = mine[i] != theirs[j]
        i, j = i[other], j[other]
        if not len(i):
            return empty
        ids, both = np.unique(np.concatenate([mine[i], theirs[j]]), return_inverse=True)
        a, b = both[: len(i)], both[len(i) :]
        links = np.bincount(a, base["copies"].to_numpy()[j], len(ids))
        # the other end doesn't find the pair itself where it doesn't probe the query's own list
        seen = np.zeros((len(base), len(q.centres)), dtype=bool)
        seen[np.repeat(np.arange(len(base)), base["probed"].map(len)), np.concatenate(base["probed"].to_list())] = True
        once = ~seen[j, queries["own"].to_numpy()[i]]
        links = (links + np.bincount(b[once], queries["copies"].to_numpy()[i[once]], len(ids))).astype(np.int64)
        return pd.DataFrame({"rep": ids, "links": links, "low": ids[common.local_roots(len(ids), a, b)]})

    return run


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block_rows: int = BLOCK_ROWS, probe_sigmas: float | None = None) -> DataFrame:
    """(id_col, n_links, component_id) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    components of their own; others link with those of their length, each length searched by its own
    quantiser. Rows with the same vector link with each other. No rows give no rows; other columns are
    ignored. Ids are integers; a null id stays null, alone. Rows that share an id are vectors of their
    own, each with its links and component; the component is called after the smallest id in it.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").alias("embedding"))
    usable = F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = usable & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # a number for each distinct vector, fixed as it is written: an id may have several
    reps = rows.where("usable").groupBy("embedding").agg(F.min("id").alias("low_id"), F.count("*").alias("copies"))
    reps = common.materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "embed-reps")
    # one row a length; a vector alone in its length has nothing to link with
    lengths = reps.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()
    spaces: dict[int, Space] = {}
    first = 0
    for d, n in lengths:
        same = reps.where(F.size("embedding") == d)
        # the sample's size is bounded by its limit
        share = min(1.0, 2.0 * SAMPLE_ROWS / n)
        sample = same.where(F.abs(F.xxhash64("embedding") % 1_000_000) < share * 1_000_000).select("embedding").limit(SAMPLE_ROWS).toPandas()
        sample = _unit(sample["embedding"]) if len(sample) else _unit(same.limit(1).toPandas()["embedding"])
        quantiser = fit(sample, int(min(MAX_LISTS, max(1, 2 * n**0.5, n / 65_536), max(1, len(sample) // 4))))
        spaces[d] = Space(quantiser, probe_margin(cosine, d, probe_sigmas), first)
        first += len(quantiser.centres)
    shared = spark.sparkContext.broadcast(spaces)
    vector = reps.schema["embedding"].dataType.simpleString()
    indexed = common.spread(reps.where(F.size("embedding").isin(list(spaces))), "rep").mapInPandas(
        _index(shared), f"list bigint, rep bigint, copies bigint, embedding {vector}, code binary, miss double, probed array<int>, own bigint, query boolean"
    )
    indexed = common.materialize(indexed, "embed-index")
    # how many blocks a list's members and queries make: one row a list, of which there are a bounded number
    sizes = indexed.groupBy("list").agg(F.count_if(~F.col("query")).alias("b"), F.count_if("query").alias("q"))
    sizes = sizes.select("list", *[F.greatest(F.lit(1), F.ceil(F.col(c) / block_rows)).cast("int").alias(c) for c in "bq"])
    placed = indexed.join(F.broadcast(sizes), "list")
    here = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    row_at = F.when(F.col("query"), F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.array(here("b")))
    col_at = F.when(F.col("query"), F.array(here("q"))).otherwise(F.sequence(F.lit(0), F.col("q") - 1))
    placed = placed.withColumn("bi", F.explode(row_at)).withColumn("qi", F.explode(col_at)).drop("b", "q")
    found = placed.groupBy("list", "bi", "qi").applyInPandas(_search(shared, cosine), "rep bigint, links bigint, low bigint")
    found = common.materialize(found, "embed-found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = common.connected_components(found.select("rep", "low"), "rep", "low")
    each = reps.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    each = each.select("embedding", "low_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    lows = each.groupBy("class").agg(F.min("low_id").alias("component_id"))
    each = each.join(lows, "class").select("embedding", "n_links", "component_id")
    out = rows.where("usable").join(each, "embedding", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    rest = rows.where("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def digest(vectors: DataFrame) -> DataFrame:
    """Links and component of every row, and whether it is the one of its component that stays."""
    return classes(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
