"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). A flow
network routes the words of each pattern to the quotas of its sources: the k-th repetition of a pattern
has its words as capacity and a cost that is convex in k, so first passes are used up before anything
is repeated. A plan for each pattern follows: so many whole passes and a remainder, which goes to
documents in seeded order. The order is that of a hash of the document's id: a fixed number of hash
buckets is summed for each pattern, and only the bucket that the remainder ends in is ordered row by row.

Sources that no chain of shared patterns joins don't compete, so each connected set of sources is a flow of its own. Up to
`max_patterns` patterns are solved on the driver; beyond that, patterns stay in a table and each
connected set is solved in a task. The driver holds a row per source, with its size and quota.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._common import materialize
from evigraph.llm.near_dedup import components

#: Hash buckets of a pattern: three hexadecimal digits.
BUCKETS = 4096


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap times its size; what is over is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources.

    patterns: (sources, words). The k-th pass over a pattern costs 2k-1 a word, so the cost of a pattern
    is convex (quadratic at whole passes). The primal-dual method: shortest distances give potentials, then blocking flows fill
    all edges of reduced cost 0 at once, so there are as many rounds as there are different costs of a path.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(u: int, v: int, capacity: int, price: int) -> int:
        for a, b, c, p in ((u, v, capacity, price), (v, u, 0, -price)):
            graph[a].append(len(to))
            to.append(b)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    routes = []
    for i, (members, words) in enumerate(patterns):
        for k in range(1, repeats + 1):
            edge(start, i, words, 2 * k - 1)
        routes.append({s: edge(i, n_p + s, words * repeats, 0) for s in members})
    for s, q in enumerate(quotas):
        edge(n_p + s, end, q, 0)
    potential = [0] * len(graph)

    def distances() -> list[int | None]:
        best: list[int | None] = [None] * len(graph)
        best[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in graph[u]:
                if room[e] > 0:
                    far = d + cost[e] + potential[u] - potential[to[e]]
                    if best[to[e]] is None or far < best[to[e]]:
                        best[to[e]] = far
                        heapq.heappush(heap, (far, to[e]))
        return best

    def levels() -> list[int]:
        level, queue = [-1] * len(graph), deque([start])
        level[start] = 0
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                v = to[e]
                if room[e] > 0 and level[v] < 0 and cost[e] + potential[u] == potential[v]:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def fill(level: list[int]) -> None:
        """A blocking flow along edges of reduced cost 0 to the next level."""
        nxt, path = [0] * len(graph), []
        while True:
            u = to[path[-1]] if path else start
            if u == end:
                pushed = min(room[e] for e in path)
                for e in path:
                    room[e] -= pushed
                    room[e ^ 1] += pushed
                path = path[: next(i for i, e in enumerate(path) if room[e] == 0)]
            elif nxt[u] < len(graph[u]):
                e = graph[u][nxt[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1 and cost[e] + potential[u] == potential[to[e]]:
                    path.append(e)
                else:
                    nxt[u] += 1
            elif path:
                path.pop()
                nxt[to[path[-1]] if path else start] += 1
            else:
                return

    while (best := distances())[end] is not None:
        potential = [p + (b if b is not None else best[end]) for p, b in zip(potential, best, strict=True)]
        while (level := levels())[end] >= 0:
            fill(level)
    return [{s: room[e ^ 1] for s, e in r.items()} for r in routes]


def connected(patterns: Sequence[tuple[Sequence[int], int]]) -> list[list[int]]:
    """Numbers of the patterns of each connected set of sources, in order."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for members, _ in patterns:
        for s in members[1:]:
            a, b = find(members[0]), find(s)
            parent[max(a, b)] = min(a, b)
    sets: dict[int, list[int]] = {}
    for i, (members, _) in enumerate(patterns):
        if members:
            sets.setdefault(find(members[0]), []).append(i)
    return list(sets.values())


def _plan(patterns: list[tuple[list[str], int]], quotas: dict[str, int], repeats: int) -> list[tuple[list[str], int, int]]:
    """(sources, whole passes, words of the remainder) of each pattern of one connected set, by min_cost_flow."""
    patterns = sorted(patterns)
    names = sorted({s for members, _ in patterns for s in members})
    at = {s: i for i, s in enumerate(names)}
    sent = min_cost_flow([([at[s] for s in members], words) for members, words in patterns], [quotas[s] for s in names], repeats)
    return [(members, *(divmod(sum(x.values()), words) if words else (0, 0))) for (members, words), x in zip(patterns, sent, strict=True)]


_PLAN = "members array<string>, passes long, rest long"


def _plan_on_driver(patterns: list[tuple[list[str], int]], quotas: dict[str, int], repeats: int) -> list[tuple[list[str], int, int]]:
    names: dict[str, int] = {}
    numbered = [([names.setdefault(s, len(names)) for s in members], words) for members, words in patterns]
    return [row for group in connected(numbered) for row in _plan([patterns[i] for i in group], quotas, repeats)]


def _plan_in_tasks(patterns: DataFrame, quotas: DataFrame, repeats: int) -> DataFrame:
    """The same for a table of patterns (members, words) and one of quotas (source, quota): a task for each connected set of sources."""
    first = F.col("members")[0]
    labels = components(patterns.select(first.alias("node"), F.explode("members").alias("pivot")).distinct())
    labelled = patterns.where(F.size("members") > 0).join(labels, first == F.col("node")).select("label", "members", "words")
    wanted = labelled.select("label", F.explode("members").alias("source")).distinct().join(quotas, "source").select("label", F.array("source").alias("members"), F.lit(None).cast("long").alias("words"), "quota")
    rows = labelled.withColumn("quota", F.lit(None).cast("long")).unionByName(wanted)

    def solve(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        own = {r["members"][0]: r["quota"] for r in found if r["quota"] is not None}
        plan = _plan([(r["members"], r["words"]) for r in found if r["words"] is not None], own, repeats)
        columns = list(zip(*plan, strict=True))
        kinds = (pa.list_(pa.string()), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["members", "passes", "rest"])

    return materialize(rows.groupBy("label").applyInArrow(solve, _PLAN), "mix-plan")


def mix_sources(
    docs: DataFrame,
    members: Column,
    size: Column,
    quotas: Callable[[dict[str, int]], dict[str, float]],
    id_col: str = "doc_id",
    seed: str = "mix",
    repeats: int = 2,
    max_patterns: int = 20_000,
) -> DataFrame:
    """Adds members, size and taken (words taken, repeats counted) to every row of docs.

    members: array<string> column of a row's sources (no element may be null; an empty or null array takes part in
    no quota). size: its words, a long (null: 0). quotas(sizes): given {source: words of all rows in it}, the words
    wanted of each source. A row's taken is k or k+1 times its size, but for one row of each pattern, at
    the end of the remainder, of which the first words are taken. Order and so the result depend on id
    and seed only; rows of equal id (or of none) are told apart by their size and are else alike. An empty table
    gives an empty result. Columns named members, size and taken in the input are replaced; others stay, whatever their names.
    max_patterns: up to so many the plan is made on the driver and broadcast.
    """
    spark = docs.sparkSession
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    kept = [c for c in docs.columns if c not in ("members", "size", "taken")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    own = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    rows = docs.select(row.alias("row"), own.alias("members"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), digest.alias("order"))
    rows = rows.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    per_bucket = materialize(rows.groupBy("members", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    patterns = per_bucket.groupBy("members").agg(F.sum("words").alias("words"))
    found = patterns.limit(max_patterns + 1).collect()
    few = len(found) <= max_patterns
    if few:
        sizes: dict[str, int] = {}
        for r in found:
            for s in r["members"]:
                sizes[s] = sizes.get(s, 0) + r["words"]
    else:
        sizes = {r["s"]: r["w"] for r in patterns.select(F.explode("members").alias("s"), "words").groupBy("s").agg(F.sum("words").alias("w")).collect()}  # a row per source
    wanted = quotas(sizes)
    own_quotas = {s: round(wanted.get(s, 0)) for s in sizes}
    if few:
        plan = F.broadcast(spark.createDataFrame(_plan_on_driver([(list(r["members"]), r["words"]) for r in found], own_quotas, repeats), _PLAN))
    else:
        plan = _plan_in_tasks(patterns, spark.createDataFrame(list(own_quotas.items()), "source string, quota long"), repeats)
    before = F.sum("words").over(Window.partitionBy("members").orderBy("bucket")) - F.col("words")
    cut = (
        per_bucket.withColumn("before", before)
        .join(plan, "members")
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        .groupBy("members")
        .agg(F.min(F.struct("bucket", "before")).alias("cut"))
    )
    steps = materialize(plan.join(cut, "members", "left").select("members", "passes", "rest", F.col("cut.bucket").alias("at"), F.col("cut.before").alias("before")), "mix-steps")
    rows = rows.join(F.broadcast(steps) if few else steps, "members", "left")
    whole = F.when(F.col("bucket") < F.col("at"), 1).otherwise(0)
    plain = rows.where(F.col("at").isNull() | (F.col("bucket") != F.col("at"))).withColumn("taken", F.col("size") * (F.coalesce("passes", F.lit(0)) + whole))
    order = Window.partitionBy("members", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = rows.where(F.col("bucket") == F.col("at")).withColumn("taken", F.col("size") * F.col("passes") + F.least(F.greatest(room, F.lit(0)), F.col("size")))
    return plain.unionByName(part).select(*[F.col("row")[c].alias(c) for c in kept], "members", "size", "taken")
