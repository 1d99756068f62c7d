"""Window operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells as X
from gridloom.operators import bands, body, header, names, profile


def loop_bands(rows, run=2):
    out, start, last = [], None, None
    for r in sorted(rows):
        if start is None:
            start = r
        elif r - last - 1 >= run:
            out.append((start, last))
            start = r
        last = r
    return out + [(start, last)] if start is not None else out


def test_bands_match_a_loop(spark):
    rng = random.Random(1)
    sets = {g: {r for r in range(1, 60) if rng.random() < 0.5} or {1} for g in range(40)}
    df = spark.createDataFrame([(g, r) for g, rs in sets.items() for r in rs], "g int, row int")
    got = {}
    for x in bands.band_extents(df, ["g"]).orderBy("g", "band_no").collect():
        got.setdefault(x["g"], []).append((x["start_row"], x["end_row"]))
    assert got == {g: loop_bands(rs) for g, rs in sets.items()}
    with pytest.raises(ValueError):
        bands.split_bands(df, ["g"], blank_run=0)


def loop_body(cells):
    """(start, end, skips, clamped) by a forward scan."""
    start = end = flat = None
    skips, pending, blanks, trailing, inner, thin = [], [], 0, [], False, False
    for r, (c, m) in enumerate(cells, 1):
        if c == "B":
            blanks += 1
            if blanks >= 2:
                break
            skips.append(r)
            pending.append(r)
            continue
        blanks, pending = 0, []
        if c == "S":
            skips.append(r)
            thin = True
            continue
        start, end = start or r, r
        if m:
            trailing.append(r)
        else:
            inner = inner or bool(trailing)
            trailing, flat = [], r
    if pending:
        skips = [s for s in skips if s not in pending]
    clamped = bool(trailing) and not inner and flat is not None
    if start is None and thin:
        skips = []
    return start, flat if clamped else end, skips, clamped


def test_body_scan_matches_a_loop(spark):
    rng = random.Random(2)
    bodies = {g: [(rng.choice("BBSDDDD"), rng.random() < 0.3) for _ in range(rng.randint(1, 14))] for g in range(400)}
    df = spark.createDataFrame([(g, r, c, m, "x") for g, b in bodies.items() for r, (c, m) in enumerate(b, 1)], "g int, row int, cls string, merged boolean, label string")
    got = {x["g"]: (x["data_start"], x["data_end"], list(x["skip_rows"]), x["clamped"]) for x in body.scan_body(df, ["g"]).collect()}
    for g, b in bodies.items():
        want = loop_body(b)
        assert got.get(g, (None, None, [], False)) == want, b


def test_longest_run_prefers_the_left(spark):
    df = spark.createDataFrame([(1, c) for c in (1, 2, 5, 6, 9)] + [(2, 4)], "g int, col int")
    got = {r["g"]: (r["left_col"], r["right_col"], r["gapped"]) for r in bands.longest_run(df, ["g"]).collect()}
    assert got == {1: (1, 2, True), 2: (4, 4, False)}


@pytest.mark.parametrize("n,size", [(1, 200), (199, 200), (200, 200), (201, 200), (999, 200), (50, 7)])
def test_even_sample(spark, n, size):
    df = spark.range(n).withColumn("g", F.lit(1))
    got = sorted(r["id"] for r in profile.even_sample(df, ["g"], ["id"], size).collect())
    s = min(size, n)
    assert got == sorted({i * n // s for i in range(s)})


def test_predicates(spark):
    texts = ["Q:4T:C:A", "plain label", "2020-03-31", "Mar 31, 2020", "2020Q1", "2020년 3월", " Period : ", "update", "Total sum", "합계", "계정", "1_000.5", "1d", "nan"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s, n = F.col("s"), F.lit(None).cast("long")
    kind = F.lit("string")
    r = {x["s"]: x for x in df.select("s", X.code_like(s).alias("code"), X.axis_value_gate(kind, s, n, n.cast("double")).alias("gate"), X.axis_value_rows(kind, s, n, n.cast("double")).alias("rows"), X.axis_value_bonus(kind, s).alias("bonus"), X.axis_label_gate(s).alias("label"), X.axis_label_rows(s).alias("token"), X.keyword_hit(s).alias("key"), X.float_like(s).alias("float")).collect()}
    yes = lambda c: {t for t in texts if r[t][c]}
    assert yes("code") == {"Q:4T:C:A", "2020-03-31"} - {"2020-03-31"}
    assert yes("gate") == {"2020-03-31", "2020Q1"}
    assert yes("rows") == {"2020-03-31", "Mar 31, 2020", "2020년 3월"}
    assert yes("bonus") == {"2020-03-31", "2020Q1"}
    assert yes("label") == {" Period : "} and yes("token") == {" Period : "}
    assert yes("key") == {"Total sum", "합계"}
    assert yes("float") == {"1_000.5", "nan"}


def test_column_letters(spark):
    want = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    df = spark.createDataFrame([(k,) for k in want], "n int")
    assert {r["n"]: r["l"] for r in df.select("n", X.column_letters(F.col("n")).alias("l")).collect()} == want


def test_names(spark):
    for given, want in ((["a", "a", "a.1", "a"], ["a", "a.1", "a.1.1", "a.2"]), (["a", "a.1", "a"], ["a", "a.1", "a.2"]), ([], []), (["", ""], ["", ".1"])):
        assert names.dedupe(given) == want
        assert spark.range(1).select(names.deduped(F.lit(given).cast("array<string>"))).first()[0] == want
    assert names.column_names(["a", None, ""]) == ["a", "Unnamed: 1", "Unnamed: 2"]
    assert names.column_names([None, None], True) == ["col_0", "col_1"]


def test_first_of_equal_scores_wins(spark):
    s = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.9), (1, 3, 0.9)], "g int, row int, score double")
    none = s.limit(0).select("g", "row", *[F.lit(v).alias(k) for k, v in {"dense": True, "axis_below": 0, "axis_next": False, "label": False, "blank": False, "width": 0}.items()])
    assert header.pick_header(s, none, ["g"]).collect()[0]["header_row"] == 2
