import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veriframe.functions import numbers as N
from veriframe.operators import formulas, groups, hashes, sequences
from veriframe.sources.workbooks import workbook_cells


def one(spark, raw, f):
    return spark.createDataFrame([(raw,)], "raw string").select(f(F.col("raw"))).first()[0]


@pytest.mark.parametrize("raw,value,places,last,first", [("1,234.50", 1234.5, 2, "0", "1"), ("12.5%", 12.5, 1, "5", "1"), ("0.05", 0.05, 2, "5", "5"), ("1e-3", 0.001, 3, "3", "1"), ("1.5e-3", 0.0015, 4, "3", "1"), ("100", 100.0, 0, "0", "1")])
def test_scalars(spark, raw, value, places, last, first):
    assert one(spark, raw, N.to_number) == pytest.approx(value)
    assert (one(spark, raw, N.decimal_places), one(spark, raw, N.last_digit), one(spark, raw, N.first_digit)) == (places, last, first)


def test_not_numbers(spark):
    assert not any(one(spark, x, N.is_number) for x in ("NA", "inf", "", "abc", "1d", "1f"))


def test_a1(spark):
    df = spark.createDataFrame([(1, 1), (3, 28), (10, 703)], "r int, c int")
    assert [x[0] for x in df.select(N.a1(F.col("r"), F.col("c"))).collect()] == ["A1", "AB3", "AAA10"]


CELLS = {(1, 1): 1.0, (2, 1): 2.0, (3, 1): 3.0}


@pytest.mark.parametrize("formula,want", [("AVERAGE(A1:A3)", 2), ("STDEV(A1:A3)", 1), ("STDEV.P(A1:A3)", 0.816496580927726), ("A1+A2*A3", 7), ("SUM(A1:A3)/SUM(A1:A3)", 1), ("-A1+(A2-1)", 0), ("A1^2", "UNSUPPORTED_EXPRESSION_CHARACTERS"), ("IF(A1>1,2,3)", "UNSUPPORTED_FUNCTION_IF")])
def test_formula(formula, want):
    x, why = formulas.recalculate(formula, CELLS)
    assert why == want if isinstance(want, str) else x == pytest.approx(want)


def test_shared_formula_and_recheck(spark):
    rows = [("w", "s", r, 1, str(r), "n", None, None, None) for r in (1, 2, 3)] + [("w", "s", 1, 2, "2", "n", "A1*2", "0", "B1:B2"), ("w", "s", 2, 2, "4", "n", "", "0", None), ("w", "s", 3, 2, "2.1", "n", "AVERAGE(A1:A3)", None, None)]
    df = spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, raw string, cell_type string, formula string, shared_index string, shared_ref string")
    assert {r["row"]: r["verdict"] for r in formulas.recheck(df).collect()} == {1: "MATCH", 2: "MATCH", 3: "MISMATCH"}


def test_workbook():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml" Type="x/worksheet"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>he</t><t>y</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", '<w><c r="A1" t="s"><v>0</v></c><c r="B2"><v>1.5</v><f>A1*2</f></c><c r="C1" t="inlineStr"><is><t>q</t></is></c></w>')
    got = {(r[2], r[3]): (r[4], r[6]) for r in workbook_cells("w", buf.getvalue())}
    assert got == {(1, 1): ("hey", None), (2, 2): ("1.5", "A1*2"), (1, 3): ("q", None)}


def test_tests_and_distribution(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 6)] + [("y", float(v)) for v in range(2, 7)], "g string, v double")
    got = {r["test"]: r for r in groups.tests(df, "g", "v", ("x", "y")).collect()}
    assert got["welch_t"]["statistic"] == pytest.approx(-1) and got["welch_t"]["df1"] == pytest.approx(8)
    assert got["welch_t"]["p_value"] == pytest.approx(0.346593507, abs=1e-6)
    d = groups.distribution(spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 8, 16)], "g string, value double"), ["g"]).first()
    assert (d["median"], d["iqr"]) == (4, 6) and d["skewness"] == pytest.approx(0.636151, abs=1e-5) and d["excess_kurtosis"] == pytest.approx(-1.511398, abs=1e-5)
    assert groups.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8) and groups.f_p(4.25649473, 2, 9) == pytest.approx(0.05, abs=1e-6)


def vectors(spark, *vals):
    return spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(vals)], "sheet int, block int, vals array<double>")


def test_relations(spark):
    got = sequences.window_relations(vectors(spark, (0.8, 1.3, 0.9), (1.2, 0.7, 1.1)), "block", ["sheet"]).collect()
    assert [(r["relation"], r["constant"]) for r in got] == [("target = constant - source", 2.0)]
    assert sequences.window_relations(vectors(spark, (1, 3, 2), (6, 8, 7)), "block", ["sheet"]).first()["constant"] == 5
    assert sequences.scaled_vectors(vectors(spark, (1, 3, 2), (2, 6, 4)), "block", ["sheet"]).first()["ratio"] == 2
    run = sequences.shared_runs(vectors(spark, (5, 1, 2, 3, 9), (1, 2, 3)), "block").first()
    assert (run["length"], run["offset_a"], run["offset_b"]) == (3, 2, 1)
    assert sequences.shared_runs(vectors(spark, (5, 5, 5), (5, 5, 5)), "block").count() == 0


def test_constant_pair_sums(spark):
    rng, rows = random.Random(2), []
    for block, n_rows, n_pairs, jitter in (("whole", 6, 3, 0.0), ("jitter", 6, 3, 4e-10), ("few rows", 3, 5, 0.0), ("one pair", 15, 1, 0.0), ("mixed", 6, 3, 5.0)):
        for r in range(n_rows):
            for k in range(n_pairs):
                x = rng.randint(1, 9)
                rows += [(block, r, 2 * k, float(x)), (block, r, 2 * k + 1, 10.0000005 - x + rng.uniform(-jitter, jitter))]
    got = {r["block"]: r for r in groups.constant_pair_sums(spark.createDataFrame(rows, "block string, r int, c int, value double"), ["block"], "r", ["c"]).collect()}
    assert {k: r["candidate"] for k, r in got.items()} == {"whole": True, "jitter": True, "few rows": False, "mixed": False}
    assert (got["jitter"]["matching"], got["jitter"]["rows"], got["jitter"]["row_matches"]) == (18, 6, 6)


@pytest.mark.parametrize("target,want", [((7.5, 2.5, 22.5, 10, 5, 13), ("target = source * constant", 2.5, None)), ((8.5, 3.5, 23.5, 11, 6, 14), ("target = source * constant + offset", 2.5, 1.0)), ((4, 12, 4 / 3, 3, 6, 2.3), ("target = constant / source", 12.0, None)), ((1000003.4, 1000001.2, 1000009.1, 1000003.9, 1000002.2, 1), ("target = source + constant", None, None))])
def test_window_families(spark, target, want):
    source = (3, 1, 9, 4, 2, 50)
    got = [r for r in sequences.window_relations(vectors(spark, source, target), "block", ["sheet"]).collect() if r["relation"] == want[0]]
    assert {(r["pa"], r["pb"], r["length"]) for r in got} >= {(p, p, n) for n in (3, 4, 5) for p in range(6 - n)}
    assert want[1] is None or {(r["constant"], r["offset"]) for r in got if r["pa"] == r["pb"]} == {want[1:]}


def test_scaled_vectors_equal_brute_force_on_decimals(spark):
    rng, vals = random.Random(1), []
    for _ in range(60):
        v = [2000.0, *(round(rng.uniform(1, 9000), 2) for _ in range(9))]
        vals += [v, [3 * x for x in v], [round(-7.31 * x, 2) for x in v]]
    for _ in range(60):
        v = [round(rng.uniform(1e4, 1e5), 2) for _ in range(5)]
        vals += [v, [round(1.37 * x, 2) for x in v]]
    vals += [[1e-6 * x for x in (1, 3, 2)], [2.0001e-6 * x for x in (1, 3, 2)], [0.0, 0.0, 0.0], [1e-7, 3.004e-7, 2e-7]]

    def passes(a, b):
        if len(a) != len(b) or max(a) == min(a) or max(b) == min(b):
            return False
        r = sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a)
        return abs(r - 1) > 1e-6 and all(abs(y - r * x) <= max(1e-9, 1e-6 * abs(y)) for x, y in zip(a, b))

    want = {(i, j) for j in range(len(vals)) for i in range(j) if passes(vals[i], vals[j])}
    got = sorted((r["a"], r["b"]) for r in sequences.scaled_vectors(vectors(spark, *vals), "block", ["sheet"]).collect())
    assert len(want) >= 150 and got == sorted(want)


def test_near_hashes(spark):
    df = spark.createDataFrame([(1, 0xF, 0), (2, 0, 0), (3, 0x3F << 20, 0)], "k int, dhash long, ahash long")
    assert [(r["a"], r["b"], r["dhash_distance"]) for r in hashes.near_pairs(df, "k").collect()] == [(1, 2, 4)]
