"""Mixing sources to target weights by a min-cost flow over membership patterns.

Texts are aggregated by the set of sources they occur in, their further copies within a source
by that source and the order of magnitude of their number. A flow routes their tokens to the
sources' quotas; each further repetition of a text costs more than the one before. The
flow is solved over the few patterns; documents are then selected in a seeded order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from polka.llm.tokenise import VOCABULARY, token_counts
from polka.session import cut, salted_join

BUCKETS = 1024


class Flow:
    """Min-cost flow by successive shortest paths (Bellman-Ford potentials are not needed: costs are small)."""

    def __init__(self, n: int):
        self.graph: list[list[list]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> list:
        forward = [b, capacity, cost, len(self.graph[b])]
        self.graph[a].append(forward)
        self.graph[b].append([a, 0, -cost, len(self.graph[a]) - 1])
        return forward

    def run(self, s: int, t: int) -> int:
        total, h = 0, [0] * len(self.graph)
        while True:
            dist = [float("inf")] * len(self.graph)
            dist[s], back, queue = 0, {}, [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u]:
                    continue
                for i, (v, cap, cost, _) in enumerate(self.graph[u]):
                    nd = d + cost + h[u] - h[v]
                    if cap > 0 and nd < dist[v]:
                        dist[v], back[v] = nd, (u, i)
                        heapq.heappush(queue, (nd, v))
            if dist[t] == float("inf"):
                return total
            h = [x + (d if d < float("inf") else 0) for x, d in zip(h, dist, strict=True)]
            push, v = None, t
            while v != s:
                u, i = back[v]
                push = self.graph[u][i][1] if push is None else min(push, self.graph[u][i][1])
                v = u
            v = t
            while v != s:
                u, i = back[v]
                e = self.graph[u][i]
                e[1] -= push
                self.graph[v][e[3]][1] += push
                v = u
            total += push


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern that go to each source; repetition k of a pattern's texts costs k.

    A pattern's text may be taken ``repeats[s]`` times for the source s.
    """
    flow = route_copies({(0, p): n for p, n in patterns.items()}, quotas, repeats)
    return {(p, s): n for ((_, p), s), n in flow.items()}


def route_copies(patterns: dict[tuple[int, tuple[str, ...]], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[int, tuple[str, ...]], str], int]:
    """As ``route`` for patterns with a rank (0, or that of further copies) that every repetition costs more."""
    names, keys = sorted(quotas), sorted(patterns)
    deepest = max(repeats.values(), default=1) * max(1, len(names))
    node = {p: 1 + i for i, p in enumerate(keys)} | {s: 1 + len(keys) + i for i, s in enumerate(names)}
    sink = 1 + len(keys) + len(names)
    flow, arcs = Flow(sink + 1), {}
    for p in keys:
        rank, sources = p
        most = min(deepest, sum(repeats[s] for s in sources))
        for k in range(most):
            flow.add(0, node[p], patterns[p], rank + k)
        for s in sources:
            arcs[p, s] = flow.add(node[p], node[s], patterns[p] * repeats[s], 0)
    for s in names:
        flow.add(node[s], sink, quotas[s], 0)
    flow.run(0, sink)
    return {ps: patterns[ps[0]] * repeats[ps[1]] - arc[1] for ps, arc in arcs.items() if patterns[ps[0]] * repeats[ps[1]] > arc[1]}


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total for which every source can reach its share, by bisection over flows."""
    shares = {s: x for s, x in shares.items() if x > 0}

    def reachable(total: int) -> bool:
        quotas = {s: int(total * x) for s, x in shares.items()}
        return sum(route(patterns, quotas, repeats).values()) >= sum(quotas.values())

    low, high = 0, sum(n * max(repeats[s] for s in p) for p, n in patterns.items()) + 1
    while high - low > max(1, high // 100_000):
        mid = (low + high) // 2
        low, high = (mid, high) if reachable(mid) else (low, mid)
    return low


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(taken, shares)``.

    ``taken``: ``doc_id, source, tokens, times``; every document of a listed source, ``times`` 0
    for those left out. Each document may be taken ``max_repeats`` times, copies of a text too; as
    repetitions of the text they cost more the more there are (the smallest id of a text and
    source is no copy). A text of several sources may be taken for each. ``shares``: ``source, target_share, max_repeats, tokens, actual_share, documents,
    most_times``. ``total_tokens`` defaults to the largest total all shares can reach. Texts
    without tokens, and sources NULL or not listed, are never taken.
    """
    listed = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where(F.col("source").isNotNull())
    goals = {r["source"]: (r["target_share"], r["max_repeats"]) for r in listed.collect()}  # one row per source, a fixed list
    own = docs.select("doc_id", "source", "text").dropDuplicates(["doc_id"]).where(F.col("source").isin(*goals) if goals else F.lit(False))
    sized = token_counts(own, vocabulary=vocabulary).withColumn("sig", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    sized = cut(sized, "sized")
    members = cut(sized.where("tokens > 0").groupBy("sig", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"), F.count("*").alias("copies")), "members")
    texts = members.groupBy("sig").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.max("tokens").alias("tokens"))  # at most one row per source
    texts = texts.select("sig", F.lit(None).cast(sized.schema["doc_id"].dataType).alias("copy"), F.lit(0).alias("rank"), "pattern", "tokens")
    # a further copy is a document of its own; its rank grows with the doublings of the text's copies
    often = members.where("copies > 1").select("sig", "source", F.col("doc_id").alias("first"), F.ceil(F.log2("copies")).cast("int").alias("rank"))
    further = salted_join(sized, often, ["sig", "source"], F.col("doc_id")).where("doc_id != first")
    texts = texts.unionByName(further.select("sig", F.col("doc_id").alias("copy"), "rank", F.array("source").alias("pattern"), "tokens"))
    texts = texts.withColumn("at", F.xxhash64("sig", "copy", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("at", 54).cast("int"))
    texts = cut(texts, "texts")
    by_bucket = texts.groupBy("rank", "pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = by_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("rank", "pattern").orderBy("bucket")) - F.col("n"))
    patterns = {(r["rank"], tuple(r["pattern"])): r["n"] for r in by_bucket.groupBy("rank", "pattern").agg(F.sum("n").alias("n")).collect()}  # sets of listed sources, a few ranks each
    shares = {s: x for s, (x, _) in goals.items()}
    repeats = {s: max(1, r or 1) for s, (_, r) in goals.items()}
    together: dict[tuple[str, ...], int] = {}
    for (_, p), n in patterns.items():
        together[p] = together.get(p, 0) + n
    total = largest_total(together, shares, repeats) if total_tokens is None else total_tokens
    flow = route_copies(patterns, {s: int(total * x) for s, x in shares.items()}, repeats)
    # each source gets an interval on the circle of the pattern's tokens, in seeded order
    rows, at = [], {}
    for (p, s), n in sorted(flow.items()):
        rows.append((p[0], list(p[1]), s, at.get(p, 0), at.get(p, 0) + n, patterns[p]))
        at[p] = at.get(p, 0) + n
    spark = docs.sparkSession
    intervals = F.broadcast(spark.createDataFrame(rows, "rank int, pattern array<string>, source string, a bigint, b bigint, around bigint"))  # patterns x sources rows
    inner = Window.partitionBy("rank", "pattern", "bucket").orderBy("at", "sig", "copy")
    placed = texts.withColumn("within", F.sum("tokens").over(inner) - F.col("tokens")).join(before.drop("n"), ["rank", "pattern", "bucket"])
    placed = placed.withColumn("c", F.col("before") + F.col("within")).join(intervals, ["rank", "pattern"])
    times = F.ceil((F.col("b") - F.col("c")) / F.col("around")) - F.ceil((F.col("a") - F.col("c")) / F.col("around"))
    chosen = placed.select("sig", "copy", "source", times.cast("int").alias("times"))
    stand = members.join(chosen.where("copy is null"), ["sig", "source"]).select("doc_id", "times")
    stand = stand.unionByName(chosen.where("copy is not null").select(F.col("copy").alias("doc_id"), "times"))
    taken = cut(sized.select("doc_id", "source", "tokens").join(stand, "doc_id", "left").withColumn("times", F.coalesce("times", F.lit(0))), "taken")
    sums = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.sum((F.col("times") > 0).cast("bigint")).alias("documents"), F.max("times").alias("most_times"))
    all_tokens = sums.agg(F.sum("tokens").alias("all"))
    report = listed.join(sums, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    report = report.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0)).alias("actual_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"))
    return taken, report
