"""Properties of the sequential operators, on seeded items."""

import itertools
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.functions import exprs as x
from orrery.operators import dedup, pack, segment, select, temporal
from orrery.sources import tables


def test_cuts_keep_apart():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(2, 120)
        gaps = [rng.choice([5, 30, 60, 61, 400, 4000]) for _ in range(n - 1)]
        out = segment.cuts(gaps, 8, 60)
        assert out == sorted(set(out)) and len(out) <= 7 and all(0 < c < n for c in out)
        apart = max(1, int(0.03 * n))
        assert all(b - a >= apart for a, b in zip(out, out[1:]))
    assert segment.cuts([1, 500, 1, 1, 900, 1], 3, 60) == [2, 5]
    assert segment.cuts([70, 70, 1], 2, 60) == [2]


def test_spill():
    assert select.spill([5, 5], [2, 20]) == [2, 8]
    assert select.spill([5, 5], [2, 6]) == [2, 6]
    assert select.spill([3, 3, 3], [1, 9, 9]) == [1, 4, 4]
    assert select.spill([0, 4], [5, 1]) == [1, 1]


def brute_pack(n, slides, cost):
    best = {0: {0: 0.0}}
    for i in range(1, n + 1):
        best[i] = {}
        for k in range(1, min(pack.MOST, i) + 1):
            for s, c in best[i - k].items():
                if s < slides:
                    best[i][s + 1] = min(best[i].get(s + 1, 1e9), c + cost[i - k + 1, i])
    return min(best[n].values()) if best[n] else None


def test_packing_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        n, slides = rng.randrange(1, 30), rng.randrange(1, 9)
        cost = {(a, b): rng.random() for b in range(1, n + 1) for a in range(max(1, b - 5), b + 1)}
        out = pack.cheapest(n, slides, cost)
        want = brute_pack(n, slides, cost)
        if want is None:
            assert out == []
        else:
            assert [a for a, _ in out] == [1] + [b + 1 for _, b in out[:-1]] and out[-1][1] == n and len(out) <= slides
            assert sum(cost[p] for p in out) == pytest.approx(want)


def test_diverse_pick_properties():
    rng = random.Random(3)
    rows = pd.DataFrame([{"unit": u, "quota": 3, "score": rng.random(), "kind": rng.choice("ab"), "hash": rng.getrandbits(63), "v": [rng.random() for _ in range(8)]} for u in range(4) for _ in range(10)])
    at = select.pick_diverse(rows)
    assert len(at) == len(set(at)) <= 12
    codes = [int(rows["hash"][i]) for i in at]
    assert all((a ^ b).bit_count() >= select.LEAST_BITS for i, a in enumerate(codes) for b in codes[i + 1 :])
    assert rows.iloc[at].groupby("unit").size().max() <= 3


def test_commands():
    slides = [{"slide": i, "items": [i * 10, i * 10 + 1]} for i in range(1, 5)]
    names = {"99": {"item_id": 99}}
    out, errors = pack.fold_commands(slides, [(1, "out"), (2, "SOLO"), (3, "99"), (9, "out"), (4, "x")], names)
    assert [s["items"] for s in out] == [[20], [99], [40, 41]] and [s["slide"] for s in out] == [1, 2, 3]
    assert len(errors) == 2
    assert pack.fold_commands(out, [], names) == (out, [])


@pytest.mark.parametrize("share,n,want", [(1.0, 10, 6), (0.0, 10, 5), (0.4, 20, 11), (0.4, 55, 20), (1.0, 3, 2), (1.0, 1, 1), (0.0, 0, 0)])
def test_auto_slides(spark, share, n, want):
    v = round(n * share)
    got = spark.range(1).select(x.auto_slides(F.lit(v), F.lit(n - v)).alias("s")).first().s
    assert abs(got - want) <= 1


def test_gap_and_hamming_edges(spark):
    rows = [("a", 1, "2024-01-01 00:00:00", 0), ("a", 2, "2024-01-01 00:00:04", 0), ("a", 3, "2024-01-01 00:00:08.000001", 0), ("a", 4, None, 0), ("a", 5, "2024-01-01 00:00:09", (1 << 14) - 1), ("a", 6, "2024-01-01 00:00:10", -1)]
    df = spark.createDataFrame(rows, "album string, item_id long, t string, hash long").withColumn("taken", F.col("t").cast("timestamp_ntz"))
    edges = {(r.prev_id, r.item_id) for r in temporal.burst_edges(df, 4_000_000, 14).collect()}
    assert edges == {(1, 2), (3, 5)}


def test_ranges_hold_all_candidates(spark):
    """Places from first to last give the pairs of the join by buckets, with equal times, repeated ids and rows without id or
    time; a group of many equal times has a row for each of its rows, not for each pair."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i if i % 19 else i // 19 % 3, rng.choice([rng.randrange(4_000), 700, None])) for i in range(200)]
    rows += [("b", None, 700), ("c", 500, 0), ("c", 501, 60), ("c", 502, 121), ("c", 502, 121), ("c", 502, 180)]
    rows = spark.createDataFrame(rows, "album string, item_id long, s long").withColumn("taken", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)"))
    out = temporal.range_links(rows, "album", 60_000_000).collect()
    assert sorted(((r.album, r.item_id) for r in out), key=str) == sorted(((r.album, r.item_id) for r in rows.collect()), key=str)
    at = {(r.album, r.place): r for r in out if r.place is not None}
    got = sorted((r.album, r.item_id, at[r.album, p].item_id) for r in at.values() for p in range(r.first_place, r.last_place + 1) if at[r.album, p].item_id != r.item_id)
    want = sorted((r.album, r.hero_id, r.item_id) for r in temporal.range_candidates(rows, rows, "album", 60_000_000).collect())
    assert got == want and len(want) > 500 and sum(r.links for r in out) == len(want)
    links = {}
    for album, hero, _ in want:
        links[album, hero] = links.get((album, hero), 0) + 1
    assert links == {k: n for k in {(r.album, r.item_id) for r in out} if (n := sum(r.links for r in out if (r.album, r.item_id) == k))}
    assert sorted((r.item_id, r.class_id, r.links) for r in out if r.album == "c") == [(500, 500, 1), (501, 500, 1), (502, 502, 0), (502, 502, 0), (502, 502, 0)]
    many = spark.range(30_000).select(F.lit("a").alias("album"), F.col("id").alias("item_id"), F.lit(datetime(2024, 1, 1)).alias("taken"))
    assert temporal.range_links(many, "album", 60_000_000).agg(F.count("*"), F.min("links"), F.max("links")).first()[:] == (30_000, 29_999, 29_999)


def test_bands_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    rows = [(i, rng.choice(base) ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9)))) for i in range(250)]
    rows = [(i, h & (2**63 - 1)) for i, h in rows]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, hash long"), "id", 8).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= 8}
    assert got == want and want


def test_groups_of_albums_without_joined_pairs(spark):
    """Groups as a plain search finds them: with copies, ids in two albums, rows without an id, hash or album; no pair of rows
    is ever joined."""
    rng = random.Random(6)
    base = [rng.getrandbits(32) for _ in range(40)]
    rows = []
    for i in range(300):
        album = rng.choice(["a", "b", "c", None])
        code = rng.choice(base) ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(7)))
        rows.append((album, i if i % 23 else i // 23 % 2, i * 7, None if i % 17 == 0 else code, rng.random(), rng.random()))
    df = spark.createDataFrame(rows, "album string, item_id long, s long, hash long, score double, value double").withColumn("taken", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)"))
    out = dedup.burst_groups(df, 20_000_000, 10, same_bits=4, width=32).select("album", "s", "grp", "group_size", "rank_in_group")
    near = {i: {i} for _, i, *_ in rows}
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by.setdefault(r[0], []).append(r)
    for album, mine in by.items():
        for n, x in enumerate(mine):
            for k, y in enumerate(mine[:n]):
                if x[3] is not None and y[3] is not None:
                    bits = (x[3] ^ y[3]).bit_count()
                    if album is not None and bits <= 4 or k == n - 1 and x[2] - y[2] <= 20 and bits <= 10:
                        near[x[1]].add(y[1])
                        near[y[1]].add(x[1])
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += near[k]
    want = set()
    for album, mine in by.items():
        place, size = {}, {}
        for x in mine:
            place.setdefault(root[x[1]], len(place))
            size[root[x[1]]] = size.get(root[x[1]], 0) + 1
        for g in place:
            for rank, x in enumerate(sorted((x for x in mine if root[x[1]] == g), key=lambda x: (-x[4], -x[5], x[2], x[1]))):
                want.add((album, x[2], place[g], size[g], rank))
    assert set(map(tuple, out.collect())) == want and max(w[3] for w in want) > 5
    alone = df.filter("album is not null and item_id > 1")
    assert "Join" not in dedup.burst_groups(alone, 20_000_000, 10, same_bits=4, width=32)._jdf.queryExecution().optimizedPlan().toString()


def test_near_codes_in_blocks(spark):
    """Codes that are near each other, once each pair, in one block or in many, with bits above those in bands."""
    rng = random.Random(7)
    codes = {rng.getrandbits(24) for _ in range(60)}
    codes |= {c ^ 1 << rng.randrange(24) ^ 1 << rng.randrange(24) for c in codes} | {c | 1 << 40 for c in list(codes)[:9]}
    want = {(a, b) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(c,) for c in codes], "hash long")
    for size in (dedup.CODES, 50):
        got = [tuple(sorted(r)) for r in dedup.near_codes(df, 2, 24, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert dedup.near_codes(df.limit(0), 2, 24).count() == 0
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([*codes, *list(codes)[:5]])] + [(-1, None)], "id long, hash long")
    ids = {(r.id, r.hash) for r in rows.filter("hash is not null").collect()}
    pairs = {(i, j, (a ^ b).bit_count()) for i, a in ids for j, b in ids if i < j and (a ^ b).bit_count() <= 2}
    assert {tuple(r) for r in dedup.near_pairs(rows, "id", 2, bits=24).collect()} == pairs


@pytest.mark.parametrize("strip,batch", [(1 << 14, 1 << 18), (7, 20)])
def test_near_codes_by_all_ways(monkeypatch, strip, batch):
    """Each pair in one way only, whatever is held against each other at a time, also where a block of bits is the same in many
    codes; and that of two sets of codes."""
    monkeypatch.setattr(dedup, "STRIP", strip)
    monkeypatch.setattr(dedup, "BATCH", batch)
    rng = random.Random(12)
    for bits, most in ((63, 8), (32, 4), (16, 1), (64, 2)):
        base = [rng.getrandbits(bits) for _ in range(30)] + [rng.getrandbits(8) for _ in range(30)]
        codes = sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(most + 2))) for _ in range(400)})
        want = {(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= most}
        ways = dedup.masks(len(codes), most, bits)
        for one, two in ((codes, None), (codes[::2], codes[1::2])):
            sides = [None if x is None else np.array(x, np.uint64) for x in (one, two)]
            got = [tuple(sorted((int(a), int(b)))) for w in ways for x, y in dedup.met(*sides, w, most, len(w[0]) - most - (bits < 64)) for a, b in zip(x, y)]
            assert len(got) == len(set(got)) and set(got) == {p for p in want if two is None or (p[0] in one) != (p[1] in one)}
        assert len(want) > 100


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in dedup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 31 for i in range(31, 61)}, 100: 100, 101: 100}


def test_unsigned_hash(spark):
    rows = spark.createDataFrame([("18446744073709551615",), ("9223372036854775808",), ("5",)], "h string")
    got = [r.h for r in rows.select(x.unsigned_to_signed(F.col("h")).alias("h")).collect()]
    assert got == [-1, -(2**63), 5]


def test_list_grammar(spark):
    lines = ["# note", "@slides 12", "DSC_1.jpg solo", "dsc_1.JPG", "DSC_2 group=a template=grid # x", "", "DSC_3"]
    df = spark.createDataFrame(list(enumerate(lines)), "pos int, line string")
    names, settings = tables.parse_list(df)
    assert [(r.name, r.solo, r.grp, r.template) for r in names.orderBy("pos").collect()] == [("DSC_1.jpg", True, None, None), ("DSC_2", False, "a", "grid"), ("DSC_3", False, None, None)]
    assert settings.first().slides == "12"
    good, bad = tables.parse_changes(spark.createDataFrame([(1, "7 DSC_01"), (2, "12 out"), (3, "x y"), (4, "7")], "pos int, line string"))
    assert good.count() == 2 and bad.count() == 2


def test_tables_round_trip(spark, tmp_path):
    known = spark.createDataFrame([("a", 1.0, 10), ("b", 1.0, 10), ("c", 1.0, 10)], "rel string, mtime double, size long")
    found = spark.createDataFrame([("a", 1.0, 10), ("b", 2.0, 10), ("d", 1.0, 1)], "rel string, mtime double, size long")
    kept, todo = tables.split_changed(found, known)
    assert {r.rel for r in kept.collect()} == {"a"} and {r.rel for r in todo.collect()} == {"b", "d"}
    path = f"file://{tmp_path}/index"
    assert tables.read_index(spark, path, 1, known.schema).count() == 0
    tables.write_index(known, path, 1)
    assert tables.read_index(spark, path, 1, known.schema).count() == 3
    assert tables.read_index(spark, path, 2, known.schema).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"slide": 1}\nnot json\n{"slide": 2}\n')
    assert tables.read_log(spark, str(log), "slide int").count() == 2
    old = spark.createDataFrame([("x", 1), ("y", 2)], "album string, v int")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([("y", 9)], old.schema)).collect())) == [("x", 1), ("y", 9)]


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "_cache").mkdir()
    for n in ("a.JPG", "sub/b.png", "sub/c.txt", "_cache/d.jpg"):
        (tmp_path / n).write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1] for r in tables.scan_files(spark, str(tmp_path), reserved=["_cache"]).select("path").collect()}
    assert got == {"a.JPG", "b.png"}


def test_order_of_rows_does_not_matter(spark):
    i = tables.items(spark, "/root/testdata/sf0.001")
    once = dedup.burst_groups(i, 120_000_000, 14).select("item_id", "grp", "rank_in_group")
    again = dedup.burst_groups(i.repartition(7).orderBy(F.rand(3)), 120_000_000, 14).select("item_id", "grp", "rank_in_group")
    assert once.exceptAll(again).count() == 0


def test_keep_apart():
    from orrery.plans.extras import keep_apart

    boxes = pd.DataFrame([(0, 0, 10, 10, 0.9), (1, 1, 10, 10, 0.8), (20, 20, 5, 5, 0.1), (6, 0, 10, 10, 0.7)], columns=["x", "y", "w", "h", "score"])
    assert keep_apart(boxes) == [0, 3, 2]
    assert keep_apart(boxes.iloc[:0]) == []


def test_merge_keeps_order_and_first(spark):
    from orrery.operators import joins

    base = spark.createDataFrame([(1, "B"), (2, "a")], "pos int, name string")
    added = spark.createDataFrame([(1, "A"), (2, "c"), (3, "C"), (4, "d")], "pos int, name string")
    got = joins.merge_ordered(base, added, F.lower("name")).orderBy("pos").collect()
    assert [r.name for r in got] == ["B", "a", "c", "d"]


def test_nearest_time_ties_and_ends(spark):
    at = lambda rows, c: spark.createDataFrame(rows, f"g string, {c} long, t string").withColumn("taken", F.col("t").cast("timestamp_ntz"))
    left = at([("x", 1, "2024-01-01 00:00:05"), ("x", 2, "2024-01-01 00:01:00"), ("x", 3, "2023-12-31 23:59:59"), ("y", 4, "2024-01-01 00:00:00"), ("x", 5, "2024-01-01 00:00:10")], "l")
    right = at([("x", 10, "2024-01-01 00:00:00"), ("x", 11, "2024-01-01 00:00:10"), ("x", 12, "2024-01-01 00:00:10")], "r_id")
    got = {r.l_id: r.r_id for r in temporal.asof_nearest(left.withColumnRenamed("l", "l_id"), right, "g", "l_id", "r_id").collect()}
    assert got == {1: 10, 2: 11, 3: 10, 4: None, 5: 11}


def packable(n, seed, share=0.4):
    rng = random.Random(seed)
    return [{"id": i, "block": i * 4 // n, "wide": rng.random() > share, "us": i * 240_000_000, "score": round(rng.uniform(0.3, 1), 3), "strong": rng.random() < 0.3} for i in range(n)]


def brute_packing(units, fixed, solo, slides):
    """Least cost over all ways to cut the units."""
    best = float("inf")
    for cuts in itertools.product((0, 1), repeat=len(units) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(units)]
        if len(at) - 1 > slides:
            continue
        cost = 0.0
        for a, b in zip(at, at[1:]):
            if any(fixed[a:b]):
                cost += 0.0 if b - a == 1 else float("inf")
            else:
                cost += pack.piece_cost([x for u in units[a:b] for x in u], solo)
        best = min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_partition_against_all_cuts(seed):
    rows = packable(10, seed)
    units, fixed = [[x] for x in rows[:7]] + [rows[7:9], [rows[9]]], [False] * 7 + [True, False]
    for slides in (2, 4, 9):
        plan = pack.partition(units, fixed, {2}, slides)
        want = brute_packing(units, fixed, {2}, slides)
        if plan is None:
            assert want == float("inf")
            continue
        got = sum(0.0 if p == rows[7:9] else pack.piece_cost(p, {2}) for p in plan)
        assert abs(got - want) < 1e-9 and [x for p in plan for x in p] == rows


def test_pack_album_relaxes_in_order():
    rows = packable(55, 1)
    plan, left = pack.pack_album(rows, {3, 9}, {20: "a", 21: "a", 22: "a", 40: "b"}, 20)
    assert not left and len(plan) <= 20 and sorted(x["id"] for p in plan for x in p) == list(range(55))
    assert [x["id"] for x in next(p for p in plan if any(x["id"] == 3 for x in p))] == [3]
    assert {x["id"] for x in next(p for p in plan if any(x["id"] == 21 for x in p))} == {20, 21, 22}
    rows = packable(140, 4, 1.0)  # over what 20 slides hold: the weakest go, marks and groups are released
    plan, left = pack.pack_album(rows, {1, 2}, {30: "a", 31: "a"}, 20)
    assert len(left) == 20 and {x["id"] for x in left} == {x["id"] for x in sorted(rows, key=lambda x: x["score"])[:20]}
    assert sum(map(len, plan)) == 120 and all(len(p) == 6 for p in plan)
    assert pack.pack_album([], set(), {}, 3) == ([], [])


def test_fold_orders_and_their_replay():
    names = {f"n{i}" for i in range(9)}
    chosen = [{"name": f"n{i}", "solo": False, "group": None, "template": None} for i in range(6)]
    slides = {1: ["n0"], 2: ["n1", "n2"], 3: ["n3"], 4: ["n4", "n5"]}
    lines = ["# note", "1 out", "2 solo", "3 join 4", "4 template pair", "9 out", "2 N7", "slides 12", "slides 99", "+ n8", "- N3", "+ zz", "what is this thing", "3 template grid"]
    rows, wanted, said, out = pack.fold_orders(lines, chosen, slides, names)
    by = {x["name"]: x for x in rows}
    assert set(by) == {"n7", "n2", "n4", "n5", "n8"} and wanted == 12
    assert by["n7"]["solo"] and by["n2"]["solo"] and by["n4"]["group"] == by["n5"]["group"] is not None and by["n4"]["template"] == "pair"
    assert "9: no such slide" in said and "no item zz" in said and any("not understood" in x for x in said)
    assert out[0] == "# note" and all(x.startswith(pack.APPLIED) for x in out[1:])
    assert pack.fold_orders(out, rows, slides, names) == (rows, None, [], out)


def test_models_and_indexes_keep_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    assert tables.load_model(spark, path, 1) is None
    tables.save_model(spark, path, 1, weights=[1.0, 2.5], albums=["a"])
    tables.save_model(spark, path, 1, weights=[3.0], albums=[])
    assert tables.load_model(spark, path, 1) == {"weights": [3.0], "albums": []} and tables.load_model(spark, path, 2) is None
    assert "2.5" in spark.read.parquet(f"{path}/before").first().model
    again = spark.read.parquet(f"{path}/version=1")
    tables.write_index(again.union(again), path, 1)  # reads what it replaces
    assert spark.read.parquet(f"{path}/version=1").count() == 2


@pytest.mark.parametrize("size", [256, 7])
def test_companions_as_a_plain_search_takes_them(size):
    import numpy as np

    rng = random.Random(9)
    n = 240
    us, ids = np.array([rng.randrange(3000) for _ in range(n)]), np.array(rng.sample(range(10_000), n))
    codes = np.array([rng.choice([0, 2**64 - 1, rng.getrandbits(64)]) for _ in range(n)], np.uint64)
    score, pool = np.array([rng.randrange(9) / 9 for _ in range(n)]), np.array([rng.random() < 0.4 for _ in range(n)])
    want = {}
    for i in range(n):
        taken = []
        for j in sorted((j for j in range(n) if pool[j] and j != i and abs(us[i] - us[j]) <= 200), key=lambda j: (-score[j], ids[j])):
            if len(taken) < 3 and all((int(codes[j]) ^ int(codes[k])).bit_count() >= 30 for k in [i, *taken]):
                taken.append(j)
        if len(taken) == 3:
            want[ids[i]] = [ids[j] for j in taken]
    heroes, got = pack.album_companions(us, ids, codes, score, pool, 3, 200, 30, size)
    assert {h: list(t) for h, t in zip(heroes, got)} == want and 50 < len(want) < n


def test_companions_join_no_pairs(spark):
    from orrery.plans import catalog

    out = catalog.QUERIES["companions"](spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and set(out.columns) == {"album", "hero_id", "item_id", "place"}
