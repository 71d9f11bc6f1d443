"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from orrery.operators import joins, learn
from orrery.plans import catalog
from orrery.plans.flows import sides

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DIR)
    rel = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([plain(r[names.index(c)]) for c in df.columns] for r in rel.fetchall())
    got = sorted([plain(v) for v in r] for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pack_slides_places_up_to_capacity(spark):
    """Each album's slides hold all its items, or as many as 20 slides can."""
    d = "/root/testdata/sf0.01"
    sizes = {r.album: r["count"] for r in catalog.QUERIES["capacity_trim"](spark, d).groupBy("album").count().collect()}
    held = {}
    for r in catalog.QUERIES["pack_slides"](spark, d).collect():
        held[r.album] = held.get(r.album, 0) + r.last - r.first + 1
    assert max(sizes.values()) > 55
    assert held == sizes


def test_near_dup_bands_of_all_events(spark, tmp_path):
    """Events of any id are linked: the links between codes and within them hold the pairs of brute force, each copy once; also
    where an id has two codes."""
    ks = [(i * 37 % 9) if i < 60 else 5 for i in range(70)]
    k, near, far = (c * pow(40503, -1, 65536) % 65536 for c in (5 * 40503 % 65536, 5 * 40503 % 65536 ^ 8, 5 * 40503 % 65536 ^ 24))
    ks += [near] * 9 + [far]
    for at, more in (("one", []), ("two", [(-1, k), (-1, near), (-1, near), (0, far), (997, 9), (None, 5)])):
        rows = [(i * 997, f'{{"k": {k}}}') for i, k in enumerate(ks)] + [(i, f'{{"k": {k}}}') for i, k in more] + [(7, None)]
        spark.createDataFrame(rows, "event_id long, props string").write.parquet(f"{tmp_path}/{at}/events.parquet")
        codes = [(i * 997, k * 40503 % 65536) for i, k in enumerate(ks)] + [(i, k * 40503 % 65536) for i, k in more if i is not None]
        want = {(a, b, (x ^ y).bit_count()) for a, x in codes for b, y in codes if a < b and (x ^ y).bit_count() <= 1}
        out = [tuple(r) for r in catalog.QUERIES["near_dup_bands_whole"](spark, f"{tmp_path}/{at}").select("a", "b", "bits").collect()]
        assert max(b for _, b, _ in want) > 3000 and sum(n for *_, n in want) > 100 and (more or len(want) > 4 * len(out))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{at}/events.parquet/*.parquet'")
        assert sorted(out) == sorted(con.execute(catalog.ORACLES["near_dup_bands_whole"]).fetchall())
        # What a link says of the rows of its ends' codes; an id with two codes is tried with both.
        mine = {i: {x for j, x in codes if j == i} for i, _ in codes}
        got = {(*sorted((p, q)), n) for a, b, n in out for x in mine[a] for y in mine[b] if (x ^ y).bit_count() == n for p, u in codes for q, v in codes if u == x and v == y and p != q}
        got |= {(p, q, 0) for p, u in codes for q, v in codes if u == v and p < q}
        assert got == want


def test_near_dup_eight_of_copies(spark, tmp_path):
    """Copies whose ids give the same code are linked with the least of them only; codes of a scene are linked once."""
    ids = [i + n * 3 * 2**31 for n in range(20) for i in range(30)] + [None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    out = sorted(map(tuple, catalog.QUERIES["near_dup_eight"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert out == sorted(con.execute(catalog.ORACLES["near_dup_eight"]).fetchall())
    assert {(a, b) for a, b, n in out if not n} == {(i % (3 * 2**31), i) for i in ids[30:-1]}
    assert {(a, b) for a, b, n in out if n} >= {(i, j) for i in range(30) for j in range(i + 1, i // 3 * 3 + 3)} and len(out) < 700


def test_blocks_of_references_agree(spark):
    """The nearest references are the same whether they come in one block or in many."""
    q, r = sides(spark, DIR)
    one, many = (sorted(map(tuple, joins.nearest(q, r, 3, np.negative, size=s).select("q_id", "r_id", "rank").collect())) for s in (50_000, 17))
    assert one == many and len(one) == 3 * q.count()
    assert joins.nearest(q, r.limit(0), 3, np.negative).count() == 0


def test_identities_one_after_another(spark):
    """Each vector joins the first group that has one like it, as a plain loop over groups finds."""
    got = {(r.owner, r.vec_id): r.identity for r in catalog.QUERIES["identity_groups"](spark, DIR).collect()}
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{DIR}/embeddings.parquet' ORDER BY vec_id").fetchall()
    groups = {}
    for i, v in rows:
        mine = groups.setdefault(i // 20, [])
        place = next((n for n, g in enumerate(mine) if any(np.dot(v, w) >= 0.2 for w in g)), len(mine))
        mine[place:] = [[*mine[place], v], *mine[place + 1 :]] if place < len(mine) else [[v]]
        assert got.pop((i // 20, i)) == place
    assert not got
    assert joins.first_alike(np.zeros((0, 3)), 0.5) == []


@pytest.mark.parametrize("size", [joins.BLOCK, 37])
def test_likeness_is_to_all_references(spark, monkeypatch, size):
    """Distances to the nearest three of all references, as brute force finds them, also where differences are clipped."""
    monkeypatch.setattr(learn.StyleModel, "MOST", 20, raising=False)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(160, 6)) * np.where(rng.random((160, 6)) < 0.1, 9, 1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, f array<double>")
    model = learn.StyleModel.fit(df.filter("id < 100"), df.filter("id >= 100"), "f", "id")
    z = (v - model.center) / model.scale
    d = np.sqrt(((np.clip(z[:, None] - z[None, :100], -5, 5) * model.weight) ** 2).mean(2))
    want = np.round(np.exp(-np.sort(d, 1)[:, :3].mean(1) / model.typical), 4)
    got = {r.id: r.style for r in model.score(df, "f", "id").collect()}
    assert [got[i] for i in range(160)] == pytest.approx(list(want), abs=1.1e-4) and len(got) == 160
    own = np.where(np.eye(100, dtype=bool), np.inf, d[:100])
    assert model.typical == pytest.approx(np.median(np.sort(own, 1)[:, :3].mean(1)))
    near = {r.id: r.d for r in model.distances(df.filter("id < 100"), "f", "id", True, size).collect()}
    assert [near[i] for i in range(100)] == pytest.approx(list(np.sort(own, 1)[:, :3].mean(1)))


def test_cosines_of_an_album_without_joined_vectors(spark):
    """All pairs of an album in one block or in many; vectors are never joined, and rows without an album have no pairs."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 5))
    album = [i % 4 if i % 13 else None for i in range(90)]
    df = spark.createDataFrame([(i * 3, a, [float(x) for x in r]) for i, (a, r) in enumerate(zip(album, v))], "id long, album int, v array<float>")
    f = v.astype(np.float32).astype(float)
    cos = f @ f.T / np.outer(*[np.linalg.norm(f, axis=1)] * 2)
    want = {(i * 3, j * 3): round(cos[i, j], 5) for i in range(90) for j in range(i + 1, 90) if album[i] is not None and album[i] == album[j]}
    for size in (joins.BLOCK, 20):
        out = joins.cosines(df, "id", "album", "v", 5, size)
        got = out.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.cosine for r in got} == pytest.approx(want, abs=1.1e-5)
    assert "Join" not in catalog.QUERIES["cosine_pairs"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
