"""Every query against its SQL text on the smallest tables."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from gridloom.plans import catalogue_cells as catalogue


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in glob.glob(tiny + "/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, con, tiny, name):
    df = catalogue.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    result = con.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in result.fetchall()), key=str)
    assert got == want and got


def brute_scores(text):
    """Scores of the first 20 lines with every field, by the formula; rows from 1."""
    grid = {}
    for r, line in enumerate(text.split("\n")[:20], 1):
        for c, v in enumerate(line.split(" "), 1):
            if v:
                grid[r, c] = ("number" if v.isdigit() else "date" if len(v) % 5 == 0 else "string", len(v))
    n, w = max((r for r, _ in grid), default=0), max((c for _, c in grid), default=0)
    out = {}
    for r in range(1, n + 1):
        texts = cons = apart = 0
        for c in range(1, w + 1):
            here = grid.get((r, c))
            below = [grid[q, c] for q in range(r + 1, r + 6) if (q, c) in grid]
            texts += here is not None and here[0] == "string"
            if below:
                kinds = [k for k, _ in below]
                main = max(kinds, key=lambda k: (kinds.count(k), -kinds.index(k)))
                mean, size = sum(x for _, x in below) / len(below), here[1] if here else 0
                cons += kinds.count(main) / len(below)
                apart += ((here is None or here[0] != main) + abs(size - mean) / max(size, mean, 1)) / 2
            elif here:
                apart += 1
        nb = min(5, n - r)
        out[r] = min(1, 0.5 * texts / w + 0.3 * cons / w * nb / 5 + (0.2 * apart / w if nb else 0))
    return out


def test_headers_of_all_fields_by_brute_force(spark, tmp_path):
    texts = {
        1: "1 2 3 4 5 6 seven eight nine name of all\nab cd ef gh ij kl 1 2 3 4 5 6\nab cd ef gh ij kl 7 8 9 10 11 12\n1 2 3 4 5 6 7 8 9 0 1 2",
        2: "one  three\n\n4 5 6 7 8 9 10 11",
        3: "\n".join(" ".join(str(i * j) if (i + j) % 3 else "w" * ((i * j) % 7) for j in range(i % 4 + 9)) for i in range(25)),
        4: None,
        5: "",
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: brute_scores(t or "") for i, t in texts.items()}
    got = {(r["g"], r["row"]): r["score"] for r in catalogue.QUERIES["header_score_all_fields"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(i, r): x for i, s in want.items() for r, x in s.items()}, abs=2e-6)
    picks = {r["g"]: r["header_row"] for r in catalogue.QUERIES["header_pick_all_fields"](spark, str(tmp_path)).collect()}
    assert picks == {i: max(s, key=lambda r: (round(s[r], 6), -r)) for i, s in want.items() if s}
    first = {r["g"]: r["header_row"] for r in catalogue.QUERIES["header_pick"](spark, str(tmp_path)).collect()}
    assert first[1] != picks[1] == 1


def test_names_are_unique(spark, tiny):
    rows = catalogue.QUERIES["dedupe_names"](spark, tiny).collect()
    assert len({r["unique_name"] for r in rows}) == len(rows)


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
