"""Near-duplicate vectors: coarse inverted lists, residual product codes, asymmetric distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, slices, written
from .vectors import column, finite, matrix

#: Most cells, and vectors a cell that they are learnt from: at most MOST_CELLS * PER_CELL vectors reach the driver.
MOST_CELLS, PER_CELL = 4_096, 16
#: Subspaces of a residual code and codes of each (a byte).
SUBSPACES, CODES = 16, 256
#: Members of a list's block and queries of a part that visits it.
MEMBERS, QUERIES = 4_096, 8_192
#: Distance from the centre, in parts of the largest distance of a link, where a list's shells end; the last one is open.
SHELLS = (0.25, 0.32, 0.38, 0.44, 0.5, 0.63, 0.8, 1.0)
#: Cells whose centres are nearer than this part of a link's largest distance are one.
APART = 0.63
#: Rounding errors of distances are far below this.
SLACK = 1e-7


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096))])


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, d], len(centres)) for d in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    """Centres of the cells, codebooks (subspace, code, component) of what is left, and the largest distance of a link."""

    centres: np.ndarray
    books: np.ndarray
    link: float

    @property
    def ends(self) -> np.ndarray:
        return np.array(SHELLS) * self.link

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(SUBSPACES), codes].reshape(len(codes), -1)


def train(sample: np.ndarray, cells: int, cosine: float) -> Index:
    """Fits cells and codebooks to a bounded sample of unit vectors. Where one dense group takes many centres, one of them stays."""
    link = math.sqrt(2 - 2 * cosine)
    centres = k_means(sample, cells)
    full = np.argsort(-np.bincount(_nearest(sample, centres), minlength=len(centres)), kind="stable")
    kept: list[int] = []
    for i in full.tolist():
        if not kept or ((centres[kept] - centres[i]) ** 2).sum(1).min() >= (APART * link) ** 2:
            kept.append(i)
    centres = centres[kept]
    rest = sample - centres[_nearest(sample, centres)]
    wide = -(-sample.shape[1] // SUBSPACES) * SUBSPACES
    rest = np.pad(rest, ((0, 0), (0, wide - sample.shape[1]))).reshape(len(rest), SUBSPACES, -1)
    books = [k_means(np.ascontiguousarray(rest[:, m]), CODES) for m in range(SUBSPACES)]
    return Index(np.pad(centres, ((0, 0), (0, wide - sample.shape[1]))), np.stack(books), link)


def unit(lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, and at length 1; scaled first, so that no square under- or overflows."""
    x = matrix(lists, dims)
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x, x / np.sqrt((x**2).sum(1, keepdims=True))


def _encode(index: Index, reach: float):
    """Cell, distance from its centre, residual code, error of the code, and the later cells to probe with their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            _, x = unit(column(b, "embedding"), index.centres.shape[1])
            squares = np.maximum((x**2).sum(1)[:, None] + (index.centres**2).sum(1) - 2 * x @ index.centres.T, 0)
            cell = squares.argmin(1)
            near = squares[np.arange(len(x)), cell]
            # a link's other end can lie in a cell only if the plane between the two centres is within a link's reach
            wider = squares - near[:, None]
            at, to = np.nonzero((wider <= 4 * reach + SLACK) & (np.arange(len(index.centres)) > cell[:, None]))  # no gap is over 2
            gap = np.sqrt(((index.centres[cell[at]] - index.centres[to]) ** 2).sum(1))
            keep = wider[at, to] <= 2 * reach * gap + SLACK
            at, to = at[keep], to[keep]
            rest = x - index.centres[cell]
            parts = rest.reshape(len(x), SUBSPACES, -1)
            codes = np.stack([_nearest(np.ascontiguousarray(parts[:, m]), index.books[m]) for m in range(SUBSPACES)], axis=1)
            error = np.sqrt(((rest - index.decoded(codes)) ** 2).sum(1))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(x))))).astype(np.int32))
            away = np.sqrt((rest**2).sum(1))
            out = [pa.array(cell), pa.array(away), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(error)]
            out += [pa.ListArray.from_arrays(ends, pa.array(to.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(np.sqrt(squares[at, to])))]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("rep", "copies", "embedding")), *out], ["rep", "copies", "embedding", "cell", "away", "code", "error", "probes", "probe_away"])

    return run, "rep long, copies long, embedding array<double>, cell long, away double, code binary, error double, probes array<int>, probe_away array<double>"


@dataclass
class Lists:
    """What is in each list, by cell and shell: number of vectors, rows that they stand for, smallest id; and visits to a cell."""

    n: np.ndarray
    rows: np.ndarray
    name: np.ndarray
    visits: np.ndarray

    def blocks(self, cell: np.ndarray, shell: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-self.n[cell, shell] // MEMBERS))

    def parts(self, cell: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-self.visits[cell] // QUERIES))


def spread(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


_TRIPS = "cell long, shell int, block int, part int, member boolean, same int, rep long, copies long, embedding array<double>, code binary, error double, away double, links long, other long"


def _trips(index: Index, lists: Lists, certain: bool):
    """Each vector as a member of its list's block, once for each part of its visitors, and as a visitor of the lists it must be
    compared with. Lists that are linked with it whole, by the triangle inequality, are left out there. With `certain`, these
    instead: their rows (links, and the list's first as `other`), and for the list the visitor's copies in a row without rep."""
    ends = np.concatenate(([0.0], index.ends, [np.inf]))
    last = len(SHELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rep, copies, cell, away = (column(b, c).to_numpy() for c in ("rep", "copies", "cell", "away"))
            shell = np.searchsorted(index.ends, away)
            who = np.arange(len(rep))
            # to its own cell's shells from its own on, by the shells' bounds; to others by its distance
            own_at, own_to = np.repeat(who, last + 1), np.tile(np.arange(last + 1), len(rep))
            probes = column(b, "probes")
            sizes = probes.value_lengths().to_numpy()
            cells, far = probes.flatten().to_numpy().astype(np.int64), column(b, "probe_away").flatten().to_numpy()
            at = np.concatenate([own_at, np.repeat(np.repeat(who, sizes), last + 1)])
            to = np.concatenate([own_to, np.tile(np.arange(last + 1), len(cells))])
            there = np.concatenate([cell[own_at], np.repeat(cells, last + 1)])
            dist = np.concatenate([away[own_at], np.repeat(far, last + 1)])
            own = np.arange(len(at)) < len(own_at)
            mine = np.where(own, ends[shell[at] + 1], dist)  # in its own cell by shells, so that both ends of a pair agree
            sure = (mine + ends[to + 1] + SLACK <= index.link) & (lists.n[there, to] > 0)
            low = np.where(own, ends[shell[at]], dist)
            never = (ends[to] - np.where(own, ends[shell[at] + 1], dist) > index.link + SLACK) | (low - ends[to + 1] > index.link + SLACK)
            must = ~sure & ~never & (lists.n[there, to] > 0) & ~(own & (to < shell[at]))
            # certain links: the list's rows, its copies of itself not among them
            if certain:
                s = np.flatnonzero(sure)
                links = lists.rows[there[s], to[s]] - np.where(own[s] & (to[s] == shell[at[s]]), copies[at[s]], 0)
                yield _batch(b, at[s], links=links, other=lists.name[there[s], to[s]], bare=True)
                g = s[~own[s]]
                list_, inverse = np.unique(there[g] * (last + 1) + to[g], return_inverse=True)
                by = np.full(len(list_), np.iinfo(np.int64).max)
                np.minimum.at(by, inverse, rep[at[g]])
                yield _batch(b, None, cell=list_ // (last + 1), shell=list_ % (last + 1), links=np.bincount(inverse, copies[at[g]], len(list_)).astype(np.int64), other=by)
                continue
            # visitors, to every block of the list
            v = np.flatnonzero(must)
            n = lists.blocks(there[v], to[v])
            block, v = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(v, n)
            same = np.where(own[v], 1 + (to[v] == shell[at[v]]), 0)
            part = spread(rep[at[v]]) % lists.parts(there[v])
            for k in range(0, len(v), 8192):
                p = slice(k, k + 8192)
                yield _batch(b, at[v[p]], cell=there[v[p]], shell=to[v[p]], block=block[p], part=part[p], same=same[p], away=dist[v[p]])
            m = np.repeat(who, lists.parts(cell))
            part = np.arange(len(m)) - np.repeat(np.cumsum(lists.parts(cell)) - lists.parts(cell), lists.parts(cell))
            yield _batch(b, m, cell=cell[m], shell=shell[m], block=spread(rep[m] + 1) % lists.blocks(cell[m], shell[m]), part=part, away=away[m], member=True)

    return run


def _batch(b: pa.RecordBatch, at: np.ndarray | None, member: bool = False, bare: bool = False, **said: np.ndarray) -> pa.RecordBatch:
    n = len(at) if at is not None else len(said["links"])
    null = lambda kind: pa.nulls(n, kind)
    kinds = {"cell": pa.int64(), "shell": pa.int32(), "block": pa.int32(), "part": pa.int32(), "same": pa.int32(), "away": pa.float64(), "links": pa.int64(), "other": pa.int64()}
    cols = {c: pa.array(said[c], k) if c in said else null(k) for c, k in kinds.items()}
    take = lambda c: column(b, c).take(pa.array(at))
    cols["member"] = pa.array(np.full(n, member))
    cols |= {c: take(c) if at is not None else null(pa.int64()) for c in ("rep", "copies")}
    full = at is not None and not bare
    cols |= {"embedding": take("embedding") if full else null(pa.list_(pa.float64()))}
    cols |= {"code": take("code") if full and member else null(pa.binary()), "error": take("error") if full and member else null(pa.float64())}
    order = [c.split()[0] for c in _TRIPS.split(", ")]
    return pa.RecordBatch.from_arrays([cols[c] for c in order], order)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        more = root[a] != root[b]
        a, b = a[more], b[more]
    while (root[root] != root).any():
        root = root[root]
    return root


def _compare(index: Index, cosine: float):
    """Compares a block of a list with a part of its visitors: rows that each vector is newly linked with, and one it hangs by."""
    dims = index.centres.shape[1]

    def run(t: pa.Table) -> pa.Table:
        is_member = column(t, "member").to_numpy(zero_copy_only=False)
        members, queries = t.filter(pa.array(is_member)), t.filter(pa.array(~is_member))
        out = {"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)}
        if members.num_rows and queries.num_rows:
            codes = np.frombuffer(b"".join(column(members, "code").to_pylist()), np.uint8).reshape(-1, SUBSPACES).astype(np.int64)
            raw_m, _ = unit(column(members, "embedding"), dims)
            raw_q, x = unit(column(queries, "embedding"), dims)
            mid, mc, error = (column(members, c).to_numpy() for c in ("rep", "copies", "error"))
            qid, qc, away, same = (column(queries, c).to_numpy() for c in ("rep", "copies", "away", "same"))
            norm_m, norm_q = np.sqrt((raw_m**2).sum(1)), np.sqrt((raw_q**2).sum(1))
            p = index.decoded(codes)
            base = (p**2).sum(1) + 2 * p @ index.centres[column(members, "cell")[0].as_py()]
            pairs: list[tuple[np.ndarray, np.ndarray]] = []
            for k in range(0, len(x), 128):
                q = slice(k, k + 128)
                tables = np.einsum("qmd,mcd->mqc", x[q].reshape(-1, SUBSPACES, dims // SUBSPACES), index.books)
                inner = np.zeros((len(x[q]), len(mid)))
                for m in range(SUBSPACES):
                    inner += tables[m][:, codes[:, m]]
                # x is at most this near: its distance from the decoded vector, less the code's own error
                apart = np.sqrt(np.maximum((away[q] ** 2)[:, None] + base - 2 * inner, 0)) - error
                i, j = np.nonzero(apart <= index.link + SLACK)
                i += k
                keep = (same[i] < 2) | (qid[i] < mid[j])  # a list with itself: each pair once
                i, j = i[keep], j[keep]
                for s in range(0, len(i), 65_536):
                    a, c = i[s : s + 65_536], j[s : s + 65_536]
                    linked = np.einsum("ij,ij->i", raw_q[a], raw_m[c]) / (norm_q[a] * norm_m[c]) >= cosine
                    pairs.append((a[linked], c[linked]))
            i, j = (np.concatenate([np.zeros(0, np.int64), *(x[s] for x in pairs)]) for s in (0, 1))
            ids, back = np.unique(np.concatenate([qid, mid]), return_inverse=True)
            a, c = back[i], back[len(qid) + j]
            links = np.bincount(a, mc[j], len(ids)) + np.bincount(c, qc[i], len(ids))
            root, hit = _roots(len(ids), a, c), np.flatnonzero(links)
            out = {"rep": ids[hit], "links": links[hit].astype(np.int64), "other": ids[root[hit]]}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.95, probe: float = 4.0) -> DataFrame:
    """Near duplicates among vectors (vec_id, embedding; other columns are ignored): vec_id, n_links (rows of cosine `cosine` or
    more with it, in double precision), component_id (smallest vec_id reachable by links), kept (vec_id = component_id).

    1. Equal vectors are one, with a number of copies. Cells (4 * sqrt(n), MOST_CELLS at most) and codebooks are fitted to
       PER_CELL vectors a cell, chosen by hash; every vector is in the list of its nearest centre, with the code of what is left.
    2. A vector probes each cell whose dividing plane lies within probe / sqrt(dims) of a link's largest distance: an end of a
       link that lies in a random direction is missed beyond `probe` standard deviations only; probe = sqrt(dims) or more
       misses none. A pair is met once, from the earlier cell.
    3. Lists have shells by distance from the centre. By the triangle inequality a shell is wholly linked with a vector, or not
       at all, or it is visited. A dense group lies in the inner shells of one cell and is counted, never paired.
    4. In a visited block, distances by table lookup drop members that are too far even if the code errs by all its known
       error, so no link is lost there; the rest is decided by the exact cosine. Blocks and parts of visitors are bounded.

    Vectors that are null, of length zero, or hold null or non-finite components, and rows without vec_id, link with nothing.
    Vectors shorter than the longest one end in zeros. Rows that repeat a vec_id are vectors of their own; every other row counts
    as a link, copies included. An empty table gives an empty result. Vectors count as equal if their 64-bit hashes are.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.coalesce(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")).withColumn("rep", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    classes = rows.where("rep is not null").groupBy("rep").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = written(classes, "vector-classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dims")).first()
    cells = max(1, min(MOST_CELLS, int(4 * math.sqrt(size["n"])), size["n"] // 4))
    share = min(1.0, cells * PER_CELL / max(1, size["n"]))
    sample = classes.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("rep").select("embedding").toArrow()
    if not sample.num_rows:  # no vector, or by chance none of very few
        sample = classes.orderBy("rep").limit(PER_CELL).select("embedding").toArrow()
    known = unit(column(sample, "embedding"), size["dims"])[1] if sample.num_rows else np.ones((1, size["dims"]))
    index = train(known, cells, cosine)
    run, schema = _encode(index, index.link * min(1.0, probe / math.sqrt(size["dims"])))
    encoded = written(classes.select("rep", "copies", "embedding").mapInArrow(run, schema), "encoded")
    n = len(index.centres)
    shell = sum((F.col("away") > float(e)).cast("int") for e in index.ends)
    lists = Lists(*(np.zeros((n, len(SHELLS) + 1), np.int64) for _ in range(3)), np.zeros(n, np.int64))
    for r in encoded.groupBy("cell", shell.alias("shell")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows"), F.min("rep").alias("name")).toLocalIterator():
        lists.n[r["cell"], r["shell"]], lists.rows[r["cell"], r["shell"]], lists.name[r["cell"], r["shell"]] = r["n"], r["rows"], r["name"]
    lists.visits += lists.n.sum(1)
    for r in encoded.select(F.explode("probes").alias("cell")).groupBy("cell").count().toLocalIterator():
        lists.visits[r["cell"]] += r["count"]
    trips = encoded.mapInArrow(_trips(index, lists, False), _TRIPS)
    met = trips.groupBy("cell", "shell", "block", "part").applyInArrow(_compare(index, cosine), "rep long, links long, other long")
    met = written(met, "met")
    sure = written(encoded.mapInArrow(_trips(index, lists, True), _TRIPS).select("cell", "shell", "rep", "links", "other"), "certain")
    credit = sure.where("rep is null").groupBy("cell", "shell").agg(F.sum("links").alias("links"), F.min("other").alias("other"))
    credited = encoded.select("rep", "cell", shell.alias("shell")).join(credit, ["cell", "shell"]).select("rep", "links", "other")
    links = met.unionByName(sure.where("rep is not null and links > 0").select("rep", "links", "other")).unionByName(credited)
    groups = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")), "near-vectors")
    counted = links.select("rep", "links").unionByName(classes.select("rep", (F.col("copies") - 1).alias("links"))).groupBy("rep").agg(F.sum("links").alias("n_links"))
    counted = counted.join(classes.select("rep", "first"), "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    counted = written(counted.select("rep", "n_links", "first", F.coalesce("component", "rep").alias("component")), "class-links")
    names = counted.groupBy("component").agg(F.min("first").alias("component_id"))
    named = counted.join(names, "component").select("rep", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    out = rows.select("vec_id", "rep").join(named, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
    found = written(out, "near-vectors-found")
    drop(classes, encoded, met, sure, groups, counted)
    return found
