"""The stages against brute force, each on its own input."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as P
from ordermart.llm import bpe, line_dedup, mixing, toxicity

from .test_simhash import groups, plain_fingerprint

COLUMNS = list(P.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    vocabulary = ["".join(rnd.choice("aeioutnrslm") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for k in range(500):
        text = "\n".join(prose(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 5)))
        if k % 3 == 0:
            text = f"Home | About | Contact\n{text}\nMore words {k} at the end of this one"
        if k % 9 == 0:
            text += f" you {rnd.choice(['zvile', 'zawful'])} thing"
        labels.append((k, None, int(k % 9 == 0)))
        rows.append((k, text, rnd.choice(["en", "de", None]), "src0" if k % 3 == 1 else f"src{k % 11}", len(text)))
    for k in range(60):  # copies and near copies
        old = rows[k * 3 + 1]
        rows.append((1000 + k, old[1] + rnd.choice(["", "", " tail"]), old[2], f"src{k % 7}", 0))
    rows += [(2000 + k, rows[10][1] + f" {k}", "en", f"src{k % 7}", 1) for k in range(40)]
    rows += [(3000, None, "en", "src1", None), (3001, "", None, None, 0), (3002, " \n", "en", None, 2), (3003, prose(30_000), "en", "src2", 9), (5, rows[5][1], *rows[5][2:]), (None, prose(40), "en", "src3", 1)]
    out = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, out = P.table(spark, folder, "documents"), []
    for _, stage in P.STAGES:
        after = P.written(stage(spark, docs, folder))
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_columns(steps):
    assert len(P.STAGES) == 5
    for _, after in steps[:-1]:
        assert after.columns == COLUMNS


def test_toxicity_stage(spark, folder, steps):
    docs, after = steps[0]
    chain = toxicity.learn(toxicity.documents(docs), P.table(spark, folder, "labels"))
    assert rows(after) == [r for r in rows(docs) if chain.tag(r[1] or "")[0] < 0.7]
    kept = {r[0] for r in rows(after)}
    assert kept & set(range(500)) == {k for k in range(500) if k % 9}


def test_line_stage(steps):
    docs, after = steps[1]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows(docs), columns=COLUMNS).astype({"doc_id": "Int64"}))
    expected = sorted([(r[0] is None, r[0], r[1], len(r[1])) for r in con.execute(line_dedup.oracle()).fetchall()], key=repr)
    assert sorted([(r[0] is None, r[0], r[1], r[4]) for r in rows(after)], key=repr) == expected
    assert sum(len(r[1]) for r in rows(after)) < sum(len(r[1] or "") for r in rows(docs))


def test_simhash_stage(steps):
    docs, after = steps[2]
    prints = {r: plain_fingerprint(r[1]) for r in rows(docs)}
    values = sorted(set(prints.values()))
    label = groups(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    first = {}
    for r, f in prints.items():
        first.setdefault(label[f], []).append(r[0])
    kept = rows(after)
    assert set(kept) <= set(prints)
    assert sorted(label[prints[r]] for r in kept) == sorted(first)
    for r in kept:
        assert r[0] == min((k for k in first[label[prints[r]]] if k is not None), default=None)
    assert sum(r[0] is None for r in kept) == 1


def test_mixing_stage(steps):
    docs, after = steps[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, of = Counter(), Counter()
    texts = {r[0]: r[1] for r in rows(docs)}
    for r in rows(after):
        taken[r[0]] += size(r[1])
        of[r[3]] += size(r[1])
        assert r[4] == len(r[1])
        assert all(line in texts[r[0]] for line in r[1].split("\n"))
    planned = mixing.plan(docs).collect()
    assert {r.doc_id: r.taken for r in planned if r.taken} == dict(taken)
    for source, target in {(r.source, r.target) for r in planned}:
        assert abs(of[source] - target) <= 2 * mixing.BLOCK
    cut = sum(r[1] != texts[r[0]] for r in rows(after))
    assert cut <= 4 * len(of)


def test_bpe_stage(steps):
    docs, after = steps[4]
    v = bpe.vocabulary(bpe.default_path())
    expected = []
    for r in rows(docs):
        ids = v.library.encode(r[1], add_special_tokens=False).ids
        expected.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(v.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(expected, key=repr)


def test_run_equals_the_stages(spark, folder, steps):
    assert sorted(map(tuple, P.run(spark, folder).collect()), key=repr) == sorted(map(tuple, steps[-1][1].collect()), key=repr)


def test_empty_documents(spark, folder, tmp_path):
    P.table(spark, folder, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    P.table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
