import random

import pytest
from hinoki.llm import neardup
from hinoki.llm.components import components
from hinoki.llm.scratch import Scratch

from .util import SCHEMA, SF, awkward_rows, edited, near_components, prose


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, **options).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in near_components(rows).items()}
    assert got == want
    return want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward(spark):
    check(spark, [(r[0], r[1]) for r in awkward_rows()])


@pytest.mark.parametrize("short", [2, 64])
def test_groups_chains_and_passages(spark, short):
    """A large group around a base, a chain of drifting copies, a passage shared by all."""
    rng = random.Random(short)
    passage = prose(rng, 40)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.choice((0.005, 0.01, 0.02, 0.04))) for _ in range(60)]
    chain = [prose(rng, 200)]
    for _ in range(15):
        w = chain[-1].split(" ")
        i = rng.randrange(len(w) - 20)
        chain.append(" ".join(w[:i] + prose(rng, 18).split(" ") + w[i + 18 :]))
    texts += chain + [prose(rng, 100) + " " + passage for _ in range(60)] + [base] * 30
    texts += [passage, passage + " " + prose(rng, 8), passage + " " + prose(rng, 12)]
    rng.shuffle(texts)
    want = check(spark, list(enumerate(texts)), short=short)
    assert len({c for _, c, _ in want.values()}) > 60


def test_repeats_nulls_and_clashing_columns(spark):
    text = "a b c d e f g h i j k l m n"
    df = spark.createDataFrame([(1, text, 7), (1, text, 8), (None, text, 9), (2, text + " o", 1), (3, None, 2)], "doc_id long, text string, node long")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 10, 1, True), (1, 10, 1, True), (None, 10, None, True), (2, 11, 1, False), (3, 0, 3, True)], key=str)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "1", "3", "None"]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for per_task in (10_000, 60):
        got = {r["node"]: r["label"] for r in components(links, Scratch(spark, "t"), len(edges), per_task).collect()}
        assert got == {x: find(x) for x in parent if find(x) != x}


def test_differences_give_exact_similarity(spark):
    """w(x) + w(y) against the overlap of the differences decides links as Jaccard does."""
    rng = random.Random(5)
    base = list(range(100, 140))
    sets = [sorted(set(rng.sample(base, rng.randint(28, 40))) | {rng.randint(0, 60) for _ in range(rng.randint(0, 6))}) for _ in range(30)] + [base, []]
    count = {}
    for s in sets:
        for v in s:
            count[v] = count.get(v, 0) + 1
    known = [[v for v in s if count[v] > 1] for s in sets]
    for pivot in (0, 7, 30, 31):
        rows = [(pivot, a, len(s), known[a], [count[v] for v in known[a]], known[pivot], [count[v] for v in known[pivot]]) for a, s in enumerate(sets)]
        df = spark.createDataFrame(rows, "p long, a long, n long, vs array<long>, cs array<long>, pvs array<long>, pcs array<long>")
        got = {r["a"]: (r["w"], set(r["es"])) for r in neardup._differences(df, 3, 4).collect()}
        for x in range(31):
            for y in range(x):
                both = len(set(sets[x]) & set(sets[y]))
                linked = 4 * both >= 3 * (len(sets[x]) + len(sets[y]) - both)
                assert linked == (got[x][0] + got[y][0] <= 14 * len(got[x][1] & got[y][1]))
