"""The collage plan on seeded posts; the sweep and the chances against plain computations."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import collage, evaluate, learn
from orrery.operators.pack import TEMPLATES

RULES = collage.Rules({"a": 2, "b": 1}, {"a": ["lead", "grid", "pair", "stack"], "b": ["grid", "halves"]}, {"grid": 1}, {"pair": {"portrait"}})


def post(seed, n=60):
    rng = random.Random(seed)
    items = [{"id": i, "chapter": "ab"[i * 2 // n], "us": i * 60_000_000, "aspect": rng.choice([0.67, 0.8, 1.5]), "kind": rng.choice(["portrait", "far"]), "score": rng.random(), "strength": rng.random(), "code": rng.getrandbits(64)} for i in range(n)]
    leads = sorted(rng.sample(range(n), 10))
    slides = [{"slide": k, "item": items[i], "solo": rng.random() < 0.15} for k, i in enumerate(leads, 1)]
    return slides, [x for x in items if x["id"] not in leads]


def last(made):
    return {k: {"chapter": next(x["chapter"] for x in held if x["id"] == k), "template": t, "items": [x["id"] for x in held]} for k, (t, held) in made.items()}


@pytest.mark.parametrize("seed", range(25))
def test_plan_properties(seed):
    slides, pool = post(seed)
    made = collage.plan(slides, pool, RULES)
    ids = [x["id"] for _, held in made.values() for x in held]
    lead = {s["item"]["id"]: s for s in slides}
    assert len(ids) == len(set(ids)) and all(k in [x["id"] for x in held] and len(held) == len(TEMPLATES[t]) for k, (t, held) in made.items())
    assert not any(lead[k]["solo"] for k in made) and Counter(t for t, _ in made.values())["grid"] <= 1
    upright = Counter(lead[k]["item"]["chapter"] for k in made if lead[k]["item"]["aspect"] <= collage.WIDE)
    assert all(upright[c] <= RULES.quota[c] for c in "ab")
    for k, (t, held) in made.items():
        assert len({x["chapter"] for x in held}) == 1
        assert all((x["code"] ^ y["code"]).bit_count() >= collage.LEAST_BITS for x, y in itertools.combinations(held, 2))
        others = [x for x in held if x["id"] != k]
        assert all(x["score"] >= collage.LEAST_SCORE and (t not in collage.STACKED or x["aspect"] >= collage.WIDE) for x in others)
    again = collage.plan(slides, pool, RULES, last(made))
    assert last(again) == last(made)


def test_undone_collages_do_not_move():
    for seed in range(25):
        slides, pool = post(seed)
        before = last(collage.plan(slides, pool, RULES))
        lead = {s["item"]["id"]: s["item"] for s in slides}
        for key in [k for k in before if lead[k]["aspect"] <= collage.WIDE]:
            undone = [s | {"solo": s["solo"] or s["item"]["id"] == key} for s in slides]
            after = last(collage.plan(undone, pool, RULES, before))
            kept = {k: v for k, v in before.items() if k != key}
            assert {k: after[k] for k in kept} == kept and key not in after
            assert not [k for k in set(after) - set(kept) if lead[k]["aspect"] <= collage.WIDE and lead[k]["chapter"] == lead[key]["chapter"]]


def test_company_is_unlike_and_whole():
    slides, pool = post(1)
    item = slides[0]["item"] | {"v": [1.0, 0.0]}
    assert collage.company(item, [x | {"v": [1.0, 0.0]} for x in pool], "pair", RULES) == []
    assert len(collage.company(item, [x | {"v": [0.0, 1.0]} for x in pool], "pair", RULES)) == 1
    assert collage.company(item, [], "pair", RULES) == [] and collage.plan([], [], RULES) == {}


def test_fixed_groups():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 6)
        items = [{"id": i, "aspect": rng.choice([0.67, 1.5]), "score": rng.random()} for i in range(n)]
        found = collage.fixed_group(items, None, ["pair", "lead"])
        if n == 5:
            assert found is None
            continue
        assert len(TEMPLATES[found[0]]) == n and sorted(x["id"] for x in found[1]) == list(range(n))
        assert found[0] not in collage.STACKED or min(x["aspect"] for x in items) > 1.2
    assert collage.fixed_group(items[:2] + [{"id": 9, "aspect": 0.67, "score": 2.0}], "stack")[0] == "stack"


def test_order_of_cells_against_all():
    cells = TEMPLATES["lead"]
    aspects = [0.67, 1.5, 1.0]
    for hero in range(3):
        best = min(sum(abs(math.log(aspects[p[c]] / (w / h))) for c, (_, _, w, h) in enumerate(cells)) / 3 + (0 if p[0] == hero else collage.LARGEST_COST) for p in itertools.permutations(range(3)))
        assert collage.order_cells(aspects, hero, "lead")[0] == pytest.approx(best, abs=1e-8)


def test_chance_of_moments_against_draws(spark):
    us = [0, 10, 15, 200, 230, 500, 501, 502, 900]
    rows = spark.createDataFrame([("x", i, t) for i, t in enumerate(us)], "album string, item_id long, t long").withColumn("taken", F.timestamp_micros("t").cast("timestamp_ntz"))
    got = {r.item_id: r for r in evaluate.moments_by_chance(rows, F.lit(3), "album", 20).collect()}
    for i, t in enumerate(us):
        draws = list(itertools.combinations(us, 3))
        assert got[i].exact_chance == pytest.approx(3 / 9)
        assert got[i].moment_chance == pytest.approx(np.mean([min(abs(t - d) for d in draw) <= 20 for draw in draws]))
    assert {r.moment_chance for r in evaluate.moments_by_chance(rows, F.lit(9), "album", 20).collect()} == {1.0}
    assert {r.moment_chance for r in evaluate.moments_by_chance(rows, F.lit(0), "album", 20).collect()} == {0.0}


def test_leave_one_out_is_the_single_fits(spark):
    """Fits of all penalties over one standardisation equal a fit each; albums without a choice have no scores."""
    rng = random.Random(3)
    data = [(g, k, [rng.gauss(y, 1) for _ in range(3)], bool(y)) for g in "ab" for k in range(30) for y in [k % 3 == 0]] + [("c", k, [0.1 * k] * 3, False) for k in range(5)]
    rows = spark.createDataFrame(data, "album string, k int, f array<double>, y boolean")
    got = {(r.album, r.k, r.penalty): r.preference for r in learn.leave_one_out(rows, "album", "f", "y", 3, [1.0, 30.0]).collect()}
    assert len(got) == 120 and {g for g, _, _ in got} == {"a", "b"}
    for l2 in (1.0, 30.0):
        one = learn.score_preference(rows.filter("album = 'a'"), "f", *learn.train_preference(rows.filter("album <> 'a'"), "f", "y", 3, l2))
        for r in one.collect():
            assert r.preference == pytest.approx(got["a", r.k, l2], abs=1e-9)
