"""Ways of any number of edges."""

import heapq

from trenchwork.plans import catalogue


def test_nearest_sources_is_dijkstra(spark, tmp_path):
    keys = [*range(1, 40), *range(90, 200)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    near = {}
    for k in keys:
        for b, m in ((k // 2, k % 30 + 1.0), *(((k - 7, k % 11 + 3.0),) if k >= 7 else ())):
            near.setdefault(k, []).append((b, m))
            near.setdefault(b, []).append((k, m))
    best, heap = {}, [(0.0, k, k, 0) for k in keys if k % 97 == 0]
    longest = 0
    while heap:
        metres, source, node, hops = heapq.heappop(heap)
        if node not in best:
            best[node], longest = (metres, source), max(longest, hops)
            for b, m in near.get(node, []):
                heapq.heappush(heap, (metres + m, source, b, hops + 1))
    got = {r["node"]: (r["metres"], r["source"]) for r in catalogue.QUERIES["nearest_sources"](spark, str(tmp_path)).collect()}
    assert longest > 5 and got == best
