"""Exact top-k by cosine in tiles: only item tiles that can still help are shipped to the queries.

Items are dealt into tiles around pivots, and tiles whose pivots lie near each other into groups of bounded size. The angle
between a query and a pivot, less the tile's radius, bounds every score in the tile, and the best of a group's tiles bounds the
group. Each query visits groups in the order of these bounds, in three rounds: the first few, some more, all that are left. It carries
its k-th score so far and the groups it has visited from round to round: a group none of whose tiles reaches that score is never visited, and
a query that no group left can help takes no part in further rounds.

At scale: queries that lie near the same pivots lie in one chunk. A chunk's queries travel once a round, and the items of a group travel once to
each chunk of which some query visits the group: what is shipped does not grow with queries times groups. Chunks
hold up to 32,768 queries (``scoring.passes``); with fewer chunks than slots, the items of each are split by their id. A task keeps
the best rows of its queries, one block of scores and the ids of the items that have passed. The driver holds at most ``MAX_TILES``
pivots and radii, however large the catalogue is. Items a query must not get are masked where they are scored, so they widen
nothing; they travel with the query as a list. Rounds are stored, so a lost executor repeats no earlier round.

Defined results, those of ``operators.scoring``: rows without a vector take no part; scores have six decimals, equal ones rank
by id; vectors without a direction score null and rank last, other lengths score -1. Ids are unique.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from affinis import settings
from affinis.operators.blocks import IRREGULAR, MAX_QUERIES, SLACK, nearest_cell, rows_at_once, unit_matrices, unit_rows
from affinis.operators.latest import top_rows
from affinis.operators.scoring import FOUND, _Chunk, _narrow, _numbers, passes
from affinis.session import offered, settled

# Tasks get these functions by value and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_TILES = 4096
_ASKED = "chunk int, id long, vector binary, taken array<long>, visited binary, now binary, least double"
# Groups that a query visits in each of the first rounds; a last round takes all that are left.
_ROUNDS = (2, 8)
# Queries that are scored together.
_SIDE_ROWS = 1024
_WIDE = np.dtype("<f8")


class Plan:
    """Pivots of the tiles, how far each reaches, its group, and the number of blocks of each group.

    ``tiles`` are (tile, radius, blocks); ``group`` has the group of each, by default the tile itself, and then ``blocks`` of the groups."""

    def __init__(self, pivots: np.ndarray, tiles: list[tuple[int, float, int]], group: list[int] | None = None, blocks: dict[int, int] | None = None):
        self.pivots = pivots
        group = np.array([t for t, _, _ in tiles] if group is None else group, np.int64)
        order = np.argsort(group, kind="stable")
        self.member = np.array([t for t, _, _ in tiles], np.int64)[order]
        self.radius = np.array([r for _, r, _ in tiles], np.float64)[order]
        self.tile, self.first = np.unique(group[order], return_index=True)
        self.blocks = blocks if blocks is not None else {t: n for t, _, n in tiles}
        self.group_of = dict(zip(self.member.tolist(), group[order].tolist()))

    def bounds(self, embs) -> np.ndarray:
        """Queries x groups: no score of the group is higher. Nothing is known of odd vectors, on either side."""
        out = np.full((len(embs), len(self.member)), 2.0)
        directed = np.flatnonzero(self.member != IRREGULAR)
        at, m = unit_rows(embs, self.pivots.shape[1])
        if len(at) and len(directed):
            theta = np.arccos(np.clip(m @ self.pivots[self.member[directed]].T, -1, 1))
            out[np.ix_(at, directed)] = np.cos(np.maximum(0.0, theta - self.radius[directed])) + SLACK
        return np.maximum.reduceat(out, self.first, axis=1) if len(self.first) else out


def _grouped(pivots: np.ndarray, sizes: list[tuple[int, int, float]], rows: int) -> Plan:
    """Tiles (tile, rows, radius) in groups of about ``rows`` items: those nearest to the same of a few pivots lie together."""
    few = max(1, -(-sum(n for _, n, _ in sizes) // rows))
    near = {t: int(np.argmax(pivots[:few] @ pivots[t])) if t != IRREGULAR else IRREGULAR for t, _, _ in sizes}
    group, blocks, held = [], {}, 0
    ordered = sorted(sizes, key=lambda x: (near[x[0]], x[0]))
    for t, n, _ in ordered:
        if t == IRREGULAR:
            number = IRREGULAR
        elif not held or held + n > rows:
            number, held = t, n
        else:
            number, held = group[-1], held + n
        group.append(number)
        blocks[number] = blocks.get(number, 0) + n
    return Plan(pivots, [(t, r, 1) for t, _, r in ordered], group, {g: max(1, -(-n // rows)) for g, n in blocks.items()})


def _plan(items: DataFrame, tile_rows: int) -> Plan:
    n = items.count()
    wanted = min(MAX_TILES, max(1, -(-n // tile_rows)))
    # At most MAX_TILES rows.
    rows = items.where(F.exists("emb", lambda x: x != 0.0)).orderBy(F.xxhash64("id"), "id").limit(wanted).select("emb").collect()
    pivots = np.zeros((0, 0))
    if rows:
        pivots = np.array([r["emb"] for r in rows if len(r["emb"]) == len(rows[0]["emb"])], np.float64)
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    sizes = _placed(items, pivots).groupBy("tile").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    return _grouped(pivots, [(r["tile"], r["n"], r["radius"]) for r in sizes], settings.ITEM_BLOCK_ROWS)


def _placed(items: DataFrame, pivots: np.ndarray) -> DataFrame:
    def place(batches):
        for pdf in batches:
            tile, angle = nearest_cell(pdf["emb"].to_numpy(), pivots)
            yield pdf.assign(tile=tile, angle=angle)[["tile", "angle", "id", "emb"]]

    return items.mapInPandas(place, "tile int, angle double, id long, emb array<double>")


def _dealt(plan: Plan, kind: np.dtype, parts: int):
    """Items with the place of their group in the plan, and one of ``parts`` by a hash of the id."""
    def deal(batches):
        for pdf in batches:
            tile, _ = nearest_cell(pdf["emb"].to_numpy(), plan.pivots)
            at = np.searchsorted(plan.tile, [plan.group_of[t] for t in tile.tolist()])
            mixed = (pdf["id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            vectors = [np.asarray(e, kind).tobytes() for e in pdf["emb"]]
            yield pd.DataFrame({"tile": at.astype(np.int32), "part": (mixed % np.uint64(parts)).astype(np.int32), "id": pdf["id"], "vector": vectors})
    return deal


def _near(plan: Plan):
    """The queries with the group of their nearest pivot, and their vectors as bytes."""
    def place(batches):
        for pdf in batches:
            tile, _ = nearest_cell(pdf["emb"].to_numpy(), plan.pivots)
            near = [plan.group_of.get(t, IRREGULAR) for t in tile.tolist()]
            yield pd.DataFrame({"near": near, "id": pdf["id"], "vector": [np.asarray(e, _WIDE).tobytes() for e in pdf["emb"]], "taken": pdf["taken"]})
    return place


def _visits(plan: Plan, first: int, last: int, pack_rows: int):
    """Which queries visit which group in a round, in packs. ``least`` is a query's k-th score so far, null below k; of
    groups already ``visited``, where that is given, none is visited again."""
    def route(batches):
        step = rows_at_once(len(plan.member))
        for pdf in (whole.iloc[s: s + step] for whole in batches for s in range(0, len(whole), step)):
            bounds = plan.bounds(list(pdf["emb"]))
            if "visited" in pdf:
                bounds[np.stack(pdf["visited"])] = -np.inf
            order = np.argsort(-bounds, axis=1, kind="stable")[:, first:last]
            least = pdf["least"].to_numpy(np.float64, na_value=np.nan)
            reached = np.take_along_axis(bounds, order, axis=1)
            reach = ~(reached < least[:, None]) & (reached > -np.inf)
            for place in np.unique(order[reach]):
                rows = np.flatnonzero(((order == place) & reach).any(axis=1))
                for s in range(0, len(rows), pack_rows):
                    yield pd.DataFrame({"tile": [int(plan.tile[place])], "ids": [pdf["id"].to_numpy()[rows[s: s + pack_rows]]]})
    return route


def _bits(column, width: int) -> np.ndarray:
    """Rows of bytes as rows of flags."""
    return np.unpackbits(np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1), axis=1, count=width).astype(bool)


def _bytes(flags: np.ndarray) -> list:
    return [row.tobytes() for row in np.packbits(flags, axis=1)]


def _chosen(plan: Plan, most: int, pack_rows: int):
    """The queries that visit groups ``now``, at most ``most`` of those not ``visited``; the others can't be helped any more."""
    def choose(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            visited = _bits(pdf["visited"].tolist(), len(plan.tile))
            now = np.zeros_like(visited)
            frame = pd.DataFrame({"id": np.arange(len(pdf)), "emb": [np.frombuffer(v, _WIDE) for v in pdf["vector"]], "least": pdf["least"].to_numpy(), "visited": list(visited)})
            for pack in _visits(plan, 0, most, pack_rows)(iter([frame])):
                for tile, rows in zip(pack["tile"], pack["ids"]):
                    now[rows, np.searchsorted(plan.tile, tile)] = True
            out = pdf.assign(visited=_bytes(visited | now), now=_bytes(now))
            yield out[now.any(axis=1)][[c.split()[0] for c in _ASKED.split(", ")]]
    return choose


def _wanted_groups(width: int):
    """The groups that some query of a chunk visits now."""
    def run(batches):
        for pdf in batches:
            for chunk, rows in pdf.groupby("chunk")["now"]:
                found = np.flatnonzero(_bits(rows.tolist(), width).any(axis=0))
                yield pd.DataFrame({"chunk": np.full(len(found), chunk, np.int32), "tile": found.astype(np.int32)})
    return run


class _Side:
    """Queries scored together, and the groups each of them visits."""

    def __init__(self, table: pa.Table, now: np.ndarray, k: int, exclude_self: bool, passed: list):
        self.chunk = _Chunk(table.to_batches(), k, exclude_self, settings.ITEM_BLOCK_ROWS)
        self.chunk.seen = passed
        self.now, self.some, self.all = now, now.any(axis=0), now.all(axis=0)
        least = table.column("least").to_numpy().astype(np.float64)
        # An equal score may still come first by its id.
        known = ~np.isnan(least)
        self.chunk.best.least[known] = np.rint(least[known] * 1e6).astype(np.int64) - 1

    def meet(self, tile: np.ndarray, ids: np.ndarray, units: list, narrow: tuple | None, first: int) -> None:
        found, rows = np.flatnonzero(self.some[tile]), self.chunk.item_rows
        for s in range(0, len(found), rows):
            at = found[s: s + rows]
            some = []
            for width, place, unit in units:
                mine = at if len(place) == len(ids) else np.flatnonzero(np.isin(place, at))
                some += [(width, np.searchsorted(at, place[mine]), unit[mine])] if len(mine) else []
            hidden = None if self.all[tile[at]].all() else ~self.now[:, tile[at]]
            part = None if narrow is None else (narrow[0][at], np.flatnonzero(np.isin(at, narrow[1])))
            self.chunk._block(ids[at], some, part, first + at, hidden)


def _scores(k: int, exclude_self: bool, kind: np.dtype, width: int):
    """Best rows of each query among the items that come to its task, those below the query's k-th score left out. Queries come
    first, then the items in order of id."""
    rows = max(1, min(_SIDE_ROWS, settings.CHUNK_KEYS // k, MAX_QUERIES))

    def runs(batches):
        for batch in batches:
            key = batch.column("place").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(key)]):
                yield int(key[a]) // 2, bool(key[a] % 2), batch.slice(a, b - a)

    def side_by_side(asked, passed):
        """Queries that visit the same groups first lie together."""
        table = pa.Table.from_batches(asked)
        now = _bits(table.column("now").to_pylist(), width)
        order = np.lexsort(now.T[::-1])[::-1] if width < 64 else np.argsort(now.argmax(axis=1), kind="stable")
        table, now = table.take(pa.array(order)), now[order]
        return [_Side(table.slice(s, rows), now[s: s + rows], k, exclude_self, passed) for s in range(0, len(now), rows)]

    def score(batches):
        number, asked, sides, passed, n = None, [], [], [], 0
        for at, item, part in runs(batches):
            if at != number:
                for side in sides:
                    yield from side.chunk.found()
                number, asked, sides, passed, n = at, [], [], [], 0
            if not item:
                asked.append(part)
                continue
            if asked:
                sides, asked = side_by_side(asked, passed), []
            if not sides:
                continue
            # A copy: what the worker got is not held.
            ids, tile = np.array(part.column("id")), part.column("tile").to_numpy()
            units = unit_matrices(*_numbers(part.column("vector"), kind))
            narrow = _narrow(units[0][2]) if len(units) == 1 and units[0][0] else None
            for side in sides:
                side.meet(tile, ids, units, narrow, n)
            passed.append(ids)
            n += len(ids)
        for side in sides:
            yield from side.chunk.found()
    return score


def top_k_tiles(
    queries: DataFrame, items: DataFrame, k: int, exclude: DataFrame | None = None, exclude_self: bool = False,
    tile_rows: int = settings.ITEM_BLOCK_ROWS, pack_rows: int = settings.QUERY_BLOCK_ROWS, queries_per_task: int = settings.QUERIES_PER_TASK,
) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` most similar items of each query."""
    items = settled(items.where(F.col("emb").isNotNull()).select("id", "emb"))
    plan = _plan(items, tile_rows)
    width = len(plan.tile)
    wanted = queries.where(F.col("emb").isNotNull()).select("id", "emb")
    if exclude is None:
        wanted = wanted.withColumn("taken", F.lit(None).cast("array<long>"))
    else:
        pairs = exclude.where(F.col("query_id").isNotNull() & F.col("item_id").isNotNull())
        wanted = wanted.join(pairs.groupBy(F.col("query_id").alias("id")).agg(F.collect_set("item_id").alias("taken")), "id", "left")
    asked = settled(wanted.mapInPandas(_near(plan), "near int, id long, vector binary, taken array<long>"))
    slots, n = items.sparkSession.sparkContext.defaultParallelism, asked.count()
    # Rows of a query id that comes more than once share one list.
    repeated = asked.agg(F.count_distinct("id")).first()[0] < n
    chunks = max(passes(n, _SIDE_ROWS, k, slots), -(-n // queries_per_task))
    parts = max(1, slots // chunks)
    exact = F.forall("emb", lambda x: x.cast("float").cast("double") == x)
    kind = np.dtype("<f4") if items.agg(F.coalesce(F.min(exact), F.lit(False))).first()[0] else _WIDE
    dealt = settled(items.mapInPandas(_dealt(plan, kind, parts), "tile int, part int, id long, vector binary"))

    def begin(batches):
        for pdf in batches:
            nothing = bytes(-(-width // 8))
            yield pdf.assign(visited=[nothing] * len(pdf), now=[nothing] * len(pdf), least=np.nan)[
                [c.split()[0] for c in _ASKED.split(", ")]]

    # Along the nearest groups; a large group is spread over several chunks by a hash of the id.
    dealt_out = asked.repartitionByRange(chunks, "near", F.xxhash64("id")).withColumn("chunk", F.spark_partition_id())
    asked = dealt_out.mapInPandas(begin, _ASKED)
    order = [F.col("score").desc_nulls_last(), F.col("item_id")]
    best, left = None, width
    for most in (*_ROUNDS, width):
        if left <= 0:
            break
        left -= most
        if best is not None:
            # The k-th score of queries that have k; a null one bounds nothing.
            least = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            asked = asked.drop("least").join(least, "id", "left").select(*asked.columns)
        asked = settled(asked.mapInPandas(_chosen(plan, most, pack_rows), _ASKED))
        groups = offered(settled(asked.select("chunk", "now").mapInPandas(_wanted_groups(width), "chunk int, tile int").distinct()))
        place = (F.col("chunk") * parts + F.col("part")).alias("place")
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        nobody = [F.lit(None).cast(t).alias(c) for c, t in (("taken", "array<long>"), ("now", "binary"), ("least", "double"))]
        passing = dealt.join(groups, "tile").select(place, F.lit(1).alias("kind"), "id", "vector", "tile", *nobody)
        asking = asked.select("*", part).select(place, F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("int").alias("tile"), "taken", "now", "least")
        together = asking.unionByName(passing).repartitionById(chunks * parts, "place").sortWithinPartitions("place", "kind", "id")
        found = together.mapInArrow(_scores(k, exclude_self, kind, width), FOUND)
        if best is not None or parts > 1 or repeated:
            hits = found.drop("rank") if best is None else found.drop("rank").unionByName(best.drop("rank"))
            found = top_rows(hits, "query_id", order, k)
        best = settled(found)
    if best is None:
        return items.sparkSession.createDataFrame([], FOUND)
    return best.select("query_id", "item_id", "score", "rank")
