"""Tables that grow with the corpus aren't broadcast because Spark takes them for small."""

from gridlight.llm import near_duplicates as near
from gridlight.operators import graph
from gridlight.sources.shared import written


def test_exploded_and_packed_tables_of_near_duplicates_stay_on_executors(spark, monkeypatch):
    plans = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, tag, **options):
        plans.setdefault(tag, []).append(plan(df))
        return written(df, tag, **options)

    for module in (near, graph):
        monkeypatch.setattr(module, "written", seen)
    words = [f"w{k}" for k in range(400)]
    rows = [(10 * g + k, " ".join([*words[g : g + 200], f"end{g}x{k}"])) for g in (0, 100) for k in range(3)]  # small buckets
    rows += [(5000 + k, " ".join([*reversed(words), f"tail{k}"])) for k in range(60)] + [(9000, "alone in the world of these words")]  # a large one
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0, 1000, 5000, 9000} and found.count() == 67
    own = {tag: p for tag, all_of in plans.items() for p in all_of if "Join" in p}
    assert {"members", "sets", "labels", "edges", "jump"} <= set(own)
    for tag, p in own.items():
        assert "BroadcastExchange" not in p and "SortMergeJoin" in p, tag  # "members" was broadcast before, for one
    assert "BroadcastExchange" not in plan(near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
