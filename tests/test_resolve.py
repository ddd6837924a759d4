"""Similar names against all pairs, and the references that blocks used to lose."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import resolve
from tessera.functions.text import ratio

SF = "/root/testdata/sf0.001"


def all_pairs(left, right, threshold):
    out = {}
    for a in left:
        for b in right:
            score = resolve.INSIDE if a in b or b in a else ratio(a, b)
            if score > threshold:
                out[a, b] = score
    return out


def pairs(spark, left, right, threshold):
    frame = lambda names: spark.createDataFrame([(1, n) for n in names], "k int, plain string")
    rows = resolve.similar_names(frame(left), frame(right), ["k"], threshold).collect()
    assert len(rows) == len({(r["plain"], r["other"]) for r in rows})
    return {(r["plain"], r["other"]): r["score"] for r in rows}


def misspelt(r, name):
    name = list(name)
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(name) + 1)
        how = r.randrange(4)
        if how == 0:
            name.insert(i, r.choice("aeinst -."))
        elif name and how == 1:
            del name[i % len(name)]
        elif name and how == 2:
            name[i % len(name)] = r.choice("aeinst")
        elif len(name) > 1:
            i %= len(name) - 1
            name[i], name[i + 1] = name[i + 1], name[i]
    return "".join(name)


@pytest.mark.parametrize("threshold", [0.85, 0.9, 5 / 6])
def test_no_similar_pair_is_lost(spark, threshold):
    r = random.Random(11)
    base = ["".join(r.choice("aeinstrl ") for _ in range(r.randint(1, 22))) for _ in range(120)] + ["aaaa", "aaaaaaa", "abab", "ababab", "a", "b", "", "漢字漢字", "🙂🙂a"]
    left = sorted({misspelt(r, n) for n in base for _ in range(2)})
    right = sorted(set(base) | {misspelt(r, n) for n in base})
    want = all_pairs(left, right, threshold)
    assert pairs(spark, left, right, threshold) == pytest.approx(want)
    assert len(want) > 200


def test_two_thousand_names_of_the_tables(spark):
    r = random.Random(5)
    names = [x[0].lower() for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name")) for x in spark.read.parquet(f"{SF}/{t}.parquet").select(c).distinct().collect()]
    names = sorted(set(names) | {misspelt(r, r.choice(names)) for _ in range(2000 - len(names))})[:2000]
    asked = sorted({misspelt(r, n) for n in r.sample(names, 150)})
    found, want = pairs(spark, asked, names, 0.85), all_pairs(asked, names, 0.85)
    assert found == pytest.approx(want)


def test_references_that_blocks_lost(spark):
    known = ["alphabet", "microsoft", "ecommerce", "jpmorgan", "nvidia"]
    asked = ["lphabet", "soft", "e-commerce", "j.p.morgan", "vidia", "unknown thing"]
    refs = spark.createDataFrame([(1, 1, x) for x in asked], "d int, s int, ref string")
    k = spark.createDataFrame([(1, 1, x, "ORG") for x in known], "d int, s int, name string, label string")
    got = {x["ref"]: (x["name"], x["how"]) for x in resolve.resolve_entities(refs, k, "d", "s").collect()}
    assert got == {**{a: (b, "sentence") for a, b in zip(asked, known, strict=False)}, "unknown thing": ("unknown thing", "new")}
    away = {x["ref"]: x["how"] for x in resolve.resolve_entities(refs.withColumn("s", F.lit(2)), k, "d", "s").collect()}
    assert away == {"lphabet": "document", "soft": "document", "e-commerce": "document", "j.p.morgan": "new", "vidia": "document", "unknown thing": "new"}


def test_thresholds_that_could_lose_pairs_are_refused(spark):
    with pytest.raises(ValueError):
        pairs(spark, ["ab"], ["ba"], 0.8)
