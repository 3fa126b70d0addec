"""Window triples against brute force, on odd values, in small steps, and by a plan that sends no pairs of windows."""

import math
import random
from itertools import product

import pyarrow as pa
import pytest

from veriframe.operators import relations, triples
from veriframe.plans import audit, catalog

BASES = ["A + B", "A - B", "B - A", "A * B", "A / B", "B / A", "A / (A + B)", "B / (A + B)"]


def base(k, x, y):
    over = lambda p, q: p / q if abs(q) > 1e-9 else math.nan
    return [lambda: x + y, lambda: x - y, lambda: y - x, lambda: x * y, lambda: over(x, y), lambda: over(y, x), lambda: over(x, x + y), lambda: over(y, x + y)][k]()


def differs(v):
    return all(map(math.isfinite, v)) and f"{min(v):.9e}" != f"{max(v):.9e}"


def close(x, y):
    return all(abs(p - q) <= 1e-9 for p, q in zip(x, y)) or all(abs(p - q) <= 1e-6 * max(abs(p), abs(q), 1e-9) for p, q in zip(x, y))


def ratio(s, t):
    both = [(x, y) for x, y in zip(s, t) if abs(x) > 1e-9]
    square = sum(x * x for x, _ in both)
    c = sum(x * y for x, y in both) / square if len(both) >= 3 and square > 1e-9 else 0.0
    return c if abs(c) > 1e-9 else math.nan


def first(a, b, t):
    vecs = [[base(k, x, y) for x, y in zip(a, b)] for k in range(8)]
    for k, v in enumerate(vecs[:6]):
        if differs(v) and close(t, v):
            return f"target = {BASES[k]}", 1.0
    for k, v in enumerate(vecs):
        if differs(v) and abs((c := ratio(v, t)) - 1) > 1e-6 and close(t, [x * c for x in v]):
            return "target = constant * " + (f"({BASES[k]})" if k < 3 else BASES[k]), c
    for x, y, own, other in (("A", "B", a, b), ("B", "A", b, a)):
        rest = [p - q for p, q in zip(t, own)]
        if differs(rest) and abs(abs(c := ratio(other, rest)) - 1) > 1e-6 and close(t, [p + c * q for p, q in zip(own, other)]):
            return f"target = {x} + constant * {y}", c
    return None


def brute(sheets, shortest=3, longest=6):
    out = {}
    for blocks in sheets.values():
        keys = sorted(blocks)
        for x, y, z in zip(keys, keys[1:], keys[2:]):
            for (a, b, t), n in product(((x, y, z), (y, z, x), (x, z, y)), range(shortest, longest + 1)):
                w = {k: [(p, v) for p in range(len(blocks[k] or []) - n + 1) if differs(v := [math.nan if c is None else c for c in blocks[k][p : p + n]])] for k in (a, b, t)}
                for (i, va), (j, vb), (k, vt) in product(w[a], w[b], w[t]):
                    if hit := first(va, vb, vt):
                        out[a, b, t, i, j, k, n] = hit
    return out


def fixture():
    """Sheets of three or four blocks: small integers, planted relations, nearly constant, huge and tiny values, zeros, nulls, NaN, short and missing blocks."""
    rng = random.Random(5)
    some = lambda n=8: [round(rng.uniform(-50, 50), 2) for _ in range(n)]
    a, b, c, d = some(), some(), some(7), [1e8 + x for x in some()]
    return {
        1: {"1a": [float(rng.randrange(4)) for _ in range(7)], "1b": [float(rng.randrange(4)) for _ in range(7)], "1c": [float(rng.randrange(5)) for _ in range(7)]},
        2: {"2a": a, "2b": b, "2c": [x + y for x, y in zip(a, b)], "2d": [3 * x * y for x, y in zip(b, a)]},
        3: {"3a": c, "3b": [x - 2.5 * y for x, y in zip(c, b)], "3c": b[1:], "3d": [7.25 * x / (x + y) for x, y in zip(c, b[1:])]},
        4: {"4a": d, "4b": [2e8 - x for x in d], "4c": [1 + k * 1e-11 for k in range(8)]},
        5: {"5a": [x * 1e200 for x in a], "5b": [x * 1e200 for x in b], "5c": [(x + y) * 1e200 for x, y in zip(a, b)]},
        6: {"6a": [k * 1e-200 for k in range(5)], "6b": [0.0, 1e-170, 0.0, 3e-12, 1.0], "6c": [2e-200 * k for k in range(5)]},
        7: {"7a": [1.0, None, 3.0, 4.0, 6.0, 2.0], "7b": [2.0, 5.0, math.nan, 4.0, 1.0, 7.0], "7c": [3.0, 1.0, 9.0, 8.0, 7.0, 9.0]},
        8: {"8a": [1.0, 2.0], "8b": a, "8c": [2 * x for x in a], "8d": None, "8e": b},
    }


@pytest.fixture(scope="module")
def wanted():
    return brute(fixture())


def test_triples_equal_brute_force(spark, wanted):
    """Values whose squares are 0 or infinite are among them."""
    df = spark.createDataFrame([(s, k, v) for s, blocks in fixture().items() for k, v in blocks.items()], "sheet int, block string, vals array<double>")
    rows = relations.window_triples(df, "block", ["sheet"]).collect()
    got = {tuple(r)[:7]: (r["relation"], r["constant"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == wanted.keys() and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(math.isclose(got[k][1], c, rel_tol=1e-9, abs_tol=1e-12) for k, (_, c) in wanted.items())
    assert {k[0][0] for k in got} >= set("12356") and len({v[0] for v in got.values()}) >= 7
    best = {tuple(r[c] for c in ("a", "b", "t", "pa", "pb", "pt", "length")) for r in relations.maximal_triples(spark.createDataFrame(rows)).collect()}
    inside = lambda x, y: x[6] < y[6] and all(0 <= p - q <= y[6] - x[6] for p, q in zip(x[3:6], y[3:6]))
    groups = {}
    for k, (name, c) in got.items():
        groups.setdefault((*k[:3], name, round(c, 6)), []).append(k)
    assert best == {x for g in groups.values() for x in g if not any(inside(x, y) for y in g)}


def test_triples_in_small_steps(monkeypatch, wanted):
    """The same, once each, however few pairs and meetings are held at once."""
    names, rows = ["key_x", "key_y", "key_z", "vals_x", "vals_y", "vals_z"], []
    for blocks in fixture().values():
        keys = sorted(blocks)
        rows += [(*k, *(blocks[x] for x in k)) for k in zip(keys, keys[1:], keys[2:])]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k < 3 else pa.list_(pa.float64())) for k, x in enumerate(zip(*rows))], names)
    monkeypatch.setattr(triples, "PAIRS", 11)
    monkeypatch.setattr(triples, "MET", 3)
    found = [tuple(r.values()) for b in triples.search(iter([batch.slice(0, 3), batch.slice(3)]), 3, 6, 1e-6) for r in b.to_pylist()]
    assert len(found) == len({x[:7] for x in found}) and {x[:7]: triples.RELATIONS[x[7]] for x in found} == {k: v[0] for k, v in wanted.items()}


def test_groups_across_batches():
    rows = [(3, 0, 0, True), (6, 5, 5, False), (3, 6, 7, False), (3, 9, 9, False), (3, 5, 5, True), (3, 5, 5, False), (4, 1, 1, True), (3, 1, 1, False), (3, 1, 3, False)]
    names = ["length", "pa", "pb", "__first"]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)
    want = [(3, 0, 0), (6, 5, 5), (3, 9, 9), (3, 5, 5), (4, 1, 1), (3, 1, 3)]
    for step in (1, 2, 4, 9):
        parts = [whole.slice(k, step) for k in range(0, len(rows), step)]
        assert [tuple(r.values()) for b in triples.keep_largest(iter(parts), ["pa", "pb"]) for r in b.to_pylist()] == want


def test_triples_plan(spark):
    """No windows or pairs of windows are sent: earlier plans had dozens of exchanges, which filled disk and the driver."""
    plan = catalog.QUERIES["window_triples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 4 and plan.count("Scan parquet") == 1 and "Join" not in plan


@pytest.mark.parametrize("share,band", [(1, 2), (3, 1), (7, 5)])
def test_triples_in_shares_and_bands(spark, monkeypatch, wanted, share, band):
    """Blocks longer than a share, and relations across bands, give the same rows, each once."""
    monkeypatch.setattr(relations, "BAND", band)
    df = spark.createDataFrame([(s, k, v) for s, blocks in fixture().items() for k, v in blocks.items()], "sheet int, block string, vals array<double>")
    rows = relations.window_triples(df, "block", ["sheet"], share=share).collect()
    assert len(rows) == len(wanted) and {tuple(r)[:7]: r["relation"] for r in rows} == {k: v[0] for k, v in wanted.items()}
    best = relations.maximal_triples(spark.createDataFrame(rows)).collect()
    inside = lambda x, y: x["length"] < y["length"] and all(0 <= x[c] - y[c] <= y["length"] - x["length"] for c in ("pa", "pb", "pt"))
    groups = {}
    for r in rows:
        groups.setdefault((r["a"], r["b"], r["t"], r["relation"], round(r["constant"], 6)), []).append(r)
    want = [tuple(r[c] for c in best[0].__fields__) for g in groups.values() for r in g if not any(inside(r, x) for x in g)]
    assert sorted(map(tuple, best)) == sorted(want)
    with pytest.raises(ValueError, match="one position"):
        relations.window_triples(df, "block", ["sheet"], share=0)


def test_long_blocks_take_part(spark):
    """Blocks of more values than AuditConfig.window_values were left out, and their neighbours met instead."""
    rng, n = random.Random(6), 130
    cols = [[round(rng.uniform(1, 99), 3) for _ in range(n)] for _ in range(2)]
    cols.append([round(a + b, 3) for a, b in zip(*cols)])
    rows = [("w", "s", 1, c + 1, name) for c, name in enumerate(("ctrl", "drug", "both"))] + [("w", "s", r + 2, c + 1, str(v)) for c, vals in enumerate(cols) for r, v in enumerate(vals)]
    made = audit.screens(spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, raw string"))
    got = [r for r in made["window_triples"]().collect() if r["length"] == 6]
    assert {(r["pa"], r["pb"], r["pt"]) for r in got if r["relation"] == "target = A + B"} == {(p, p, p) for p in range(n - 5)}
    assert {r["relation"] for r in got} == {"target = A + B", "target = B - A"} and len(got) == 3 * (n - 5)
    assert audit.preflight(spark, audit.AuditConfig(window_values=0)) == ["a share of a block has one position at least"]
