import math
import random

from pyspark.sql import functions as F

from ledgerline.functions import similarity as S

GOLDEN = [
    ("", "", 0, 0, 0, 0, 0), ("abc", "", 0, 0, 0, 0, 0), ("abc", "abc", 100, 100, 100, 100, 100), ("kitten", "sitting", 57, 57, 57, 67, 67), ("hello world", "world hello", 27, 100, 100, 27, 100),
    ("love me", "love me do", 70, 70, 100, 100, 100), ("red red wine", "red wine", 67, 67, 100, 100, 100), ("wrld", "hello world", 36, 36, 36, 75, 75), ("beatles", "beetles", 86, 86, 86, 86, 86), ("abcd", "wxyz", 0, 0, 0, 0, 0),
]
MEASURES = ("ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "best_ratio")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(a, b):
    """The measures by their definitions, in the order of MEASURES."""

    def ratio(x, y):
        return 0 if not x or not y else math.floor((1 - distance(x, y) / max(len(x), len(y))) * 100 + 0.5)

    sa, sb = a.split(" "), b.split(" ")
    shared, da, db = (" ".join(sorted(x)) for x in (set(sa) & set(sb), set(sa), set(sb)))
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    parts = [ratio(a, b), ratio(" ".join(sorted(sa)), " ".join(sorted(sb))), max(ratio(shared, da), ratio(shared, db), ratio(da, db)), max(ratio(short, long[k : k + len(short)]) for k in range(len(long) - len(short) + 1))]
    return (*parts, max(parts))


def scored(spark, pairs):
    return [tuple(r) for r in spark.createDataFrame(pairs, "a string, b string").select(*(getattr(S, m)("a", "b") for m in MEASURES)).collect()]


def test_golden_values(spark):
    assert scored(spark, [g[:2] for g in GOLDEN]) == [g[2:] for g in GOLDEN]


def test_against_the_definitions(spark):
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abcé ж") for _ in range(rng.randrange(0, 14))).strip()
    pairs = [(" ".join(text().split()), " ".join(text().split())) for _ in range(1500)]
    got = scored(spark, pairs)
    assert got == [plain(a, b) for a, b in pairs]
    assert all(0 <= x <= 100 and r[4] >= x for r in got for x in r)
    assert [r[:3] for r in scored(spark, [(b, a) for a, b in pairs])] == [r[:3] for r in got]


def test_distinct_pairs_are_scored_alike(spark):
    pairs = spark.createDataFrame([(k, ["x y", "y", "", None][k % 4], ["x", None, ""][k % 3]) for k in range(60)], "k int, a string, b string")
    got = S.score_distinct(pairs, "a", "b", "s").orderBy("k").select("s").collect()
    assert got == pairs.withColumn("s", S.best_ratio("a", "b")).orderBy("k").select("s").collect() and len(got) == 60
    plan = S.score_distinct(pairs, "a", "b", "s").groupBy().agg(F.sum("s"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
