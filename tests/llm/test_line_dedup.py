import duckdb
import pandas as pd
import pytest

from ordermart.llm import line_dedup

COLUMNS = ["doc_id", "text", "n_lines", "n_removed", "removed_chars", "all_shared"]


def corpus():
    nav, foot, own = "home | about | help", "all rights reserved", "a line of its own, number {} and then some more words"
    rows = [(k, f"{nav}\n{own.format(k)}\n\n{foot} \n{own.format(-k)}", f"site{k % 7}") for k in range(40)]
    rows += [(100 + k, f"four sites only\n{own.format(k + 500)}", f"site{k}") for k in range(4)]
    rows += [(200 + k, f"five sites with null\n{own.format(k + 600)}", f"site{k}" if k < 4 else None) for k in range(5)]
    rows += [(300 + k, "copy line one\ncopy line two\nmore", f"site{k % 6}") for k in range(30)]
    rows += [(400, None, "site1"), (401, "", None), (402, "\n \n", "x"), (403, "\n".join([nav, foot] * 3000) + "\n" + own * 4000, "x"), (3, f"{nav}\n{own.format(3)}\n\n{foot} \n{own.format(-3)}", "site3"), (None, f"é\n{foot}\n{own * 2}", "x")]
    return rows


def test_equals_exact_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'z' as line", "1 as pos", "2 as key")
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    expected = con.execute(line_dedup.oracle()).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for near in (line_dedup.NEAR, 0.9):
        got = [tuple(r) for r in line_dedup.line_dedup(df, near=near).select(COLUMNS).collect()]
        assert sorted(got, key=key) == sorted([tuple(r) for r in expected], key=key)
    assert sum(r[3] for r in got) > 100
    assert any(r[5] for r in got)


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.line_dedup(df).count() == n


def test_only_documents_without_own_lines_keep_shared_ones(spark):
    menu = "\n".join(f"a long shared line, number {k}, on every site" for k in range(20))
    rows = [(k, f"{menu}\nown {k}", f"site{k}") for k in range(8)] + [(50, menu + "\n ", "site1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed, r.all_shared) for r in line_dedup.line_dedup(df).collect()}
    assert got == {**{k: (f"own {k}", 20, False) for k in range(8)}, 50: (menu + "\n ", 0, True)}
