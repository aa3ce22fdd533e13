"""The two jobs on small and growing copies: results against plain Python, reruns, new files only, broken runs."""

import math
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import queries, residualize, tuple_ledger

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def plain_residuals(rows):
    """{doc_id: (word_length residual, variety residual)} by dense weighted least squares."""
    use = []
    for doc_id, text, lang, source in rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        if doc_id is not None and words:
            use.append((doc_id, source or "", lang or "", len(words).bit_length(), len(words), sum(map(len, words)) / len(words), len(set(words)) / len(words)))
    levels = [sorted({u[i] for u in use}, key=repr) for i in (1, 2, 3)]
    b = np.array([[float(u[i + 1] == x) for i in range(3) for x in levels[i]] for u in use])
    root = np.sqrt([u[4] for u in use])
    out = []
    for k in (5, 6):
        y = np.array([u[k] for u in use])
        out.append(y - b @ np.linalg.lstsq(b * root[:, None], y * root, rcond=None)[0])
    return sorted((u[0], round(float(p), 6) + 0.0, round(float(q), 6) + 0.0) for u, p, q in zip(use, *out, strict=True))


def written(spark, folder, *columns):
    return sorted(tuple(r) for r in spark.read.parquet(folder).select(*columns).collect())


def test_residualize_equals_dense_least_squares_and_reruns(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("ab"[: 1 + int(x)] * (1 + i % 3) + str(int(x) * (i % 2)) for x in rng.integers(0, 2, rng.integers(1, 40))), ["en", "fr", None][i % 3], f"s{rng.integers(0, 5)}") for i in range(120)]
    rows += [(500, None, "en", "s1"), (501, " \n", "en", "s1"), (None, "no id here", "en", "s1"), (7, "the same id again", "de", None), (7, "the same id again", "de", None), (502, "word " * 5000, "xx", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"k0": F.lit(1), "tid": F.lit(2), "q": F.lit("x")})
    docs.write.parquet(f"{tmp_path}/in")
    got = []
    for _ in range(2):
        counts = residualize.residualize(spark, f"{tmp_path}/in", f"{tmp_path}/out", residualize.read_config())
        assert counts == {"read": 126, "used": 123, "written": 123}
        residuals = [F.round(f"{t}_residual", 6) + F.lit(0.0) for t in ("word_length", "variety")]
        got.append(written(spark, f"{tmp_path}/out/rows", "row_id", *residuals))
    assert got[0] == got[1]
    want = plain_residuals(rows)
    assert [r[0] for r in got[0]] == [r[0] for r in want] and np.allclose([r[1:] for r in got[0]], [r[1:] for r in want], atol=2e-6)
    assert {p.name for p in (tmp_path / "out/rows").iterdir() if p.is_dir()} >= {"lang=en", "lang=fr", "lang=de", "lang=xx"}
    report = spark.read.parquet(f"{tmp_path}/out/report").collect()
    assert {r.target for r in report} == {"word_length", "variety"} and all(r.accepted for r in report)
    # the effects make up the fitted values
    effects = {(r.target, r.factor, r.level): r.effect for r in spark.read.parquet(f"{tmp_path}/out/effects").collect()}
    for r in spark.read.parquet(f"{tmp_path}/out/rows").limit(20).collect():
        lang = "" if r.lang is None else r.lang  # an empty folder name reads back as null
        parts = [effects["variety", "source", r.source], effects["variety", "lang", lang], effects["variety", "size_class", str(r.size_class)]]
        assert abs(sum(parts) - r.variety_fitted) < 1e-9


def test_residualize_refuses(spark, tmp_path):
    config = residualize.read_config()
    docs = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/in")
    docs.where("false").write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError, match="empty problem"):
        residualize.residualize(spark, f"{tmp_path}/none", f"{tmp_path}/out", config)
    with pytest.raises(ValueError, match="invalid weights"):
        residualize.residualize(spark, f"{tmp_path}/in", f"{tmp_path}/out", config | {"weight": "-1"})
    with pytest.raises(RuntimeError, match="not certified"):
        residualize.residualize(spark, f"{tmp_path}/in", f"{tmp_path}/out", config | {"accept": -1.0})
    assert not (tmp_path / "out").exists()


LINES = "l_suppkey long, l_returnflag string, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, note string"


def lines(spark, rows, folder):
    frame = spark.createDataFrame([(*r, "n") for r in rows], "l_suppkey long, l_returnflag string, day string, l_quantity double, l_extendedprice double, l_discount double, note string")
    frame.withColumn("l_shipdate", F.to_timestamp("day")).select([c.split()[0] for c in LINES.split(", ")]).coalesce(2).write.mode("append").parquet(folder)


def plain_tuples(rows):
    sums = defaultdict(list)
    for s, flag, day, w, price, discount in rows:
        if None not in (s, flag, day, w, price, discount) and 0 < w < math.inf and math.isfinite(price):
            sums[s, flag, int(day[5:7]), int(day[:4])].append((w, w * price, w * discount))
    return sorted((*k, len(v), *(math.fsum(x) for x in zip(*v, strict=True))) for k, v in sums.items())


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    rng, config = np.random.default_rng(5), tuple_ledger.read_config()
    source, output = f"{tmp_path}/in", f"{tmp_path}/out"
    columns = ("supplier", "returned", "month", "year", "n_rows", "weight", "w_price", "w_discount")

    def some(n, years):
        return [(int(rng.integers(0, 4)), "ANR"[rng.integers(0, 3)], f"{rng.choice(years)}-0{rng.integers(1, 4)}-02", float(rng.integers(1, 50)), float(rng.integers(1, 10**7)) / 100, float(rng.integers(0, 10)) / 100) for _ in range(n)]

    first = some(300, [1997, 1998]) + [(1, "A", "1997-01-02", 1e16, 1.0, 0.0), (1, "A", "1997-01-02", 1.0, 1.0, 0.0)]
    bad = [(None, "A", "1997-01-02", 1.0, 1.0, 0.0), (1, "A", "1997-01-02", 0.0, 1.0, 0.0), (1, "A", "1997-01-02", 1.0, float("nan"), 0.0), (1, "A", None, 1.0, 1.0, 0.0)]
    lines(spark, first + bad, source)
    counts = tuple_ledger.update_ledger(spark, source, output, config)
    assert counts["taken"] == len(first) + 4
    assert sorted(tuple(r) for r in tuple_ledger.read_current(spark, output, config).select(*columns).collect()) == plain_tuples(first)
    assert spark.read.parquet(f"{output}/rejected").count() == 4
    old = {p for p in (tmp_path / "out/current").rglob("*.parquet")}
    assert tuple_ledger.update_ledger(spark, source, output, config) == {"taken": 0, "written": 0}
    assert {p for p in (tmp_path / "out/current").rglob("*.parquet")} == old
    # the second files touch 1998 and open 1999; 1997 stays as it is
    second = some(200, [1998, 1999])
    lines(spark, second, source)
    counts = tuple_ledger.update_ledger(spark, source, output, config)
    assert counts["taken"] == 200
    assert sorted(tuple(r) for r in tuple_ledger.read_current(spark, output, config).select(*columns).collect()) == plain_tuples(first + second)
    assert {p for p in old if "year=1997" in str(p)} <= {p for p in (tmp_path / "out/current").rglob("*.parquet")}
    # a run that breaks off after the stream is made good by the next, and a batch that runs again writes over itself
    third = some(50, [1997])
    lines(spark, third, source)
    assert tuple_ledger.take_new(spark, source, output, config) == 50
    assert sorted(tuple(r) for r in tuple_ledger.read_current(spark, output, config).select(*columns).collect()) == plain_tuples(first + second)
    number = max(r.batch for r in spark.read.parquet(f"{output}/ledger").select("batch").distinct().collect())
    again = spark.createDataFrame([(*r[:2], r[2], *r[3:], "n") for r in third], "l_suppkey long, l_returnflag string, day string, l_quantity double, l_extendedprice double, l_discount double, note string").withColumn("l_shipdate", F.to_timestamp("day")).drop("day")
    tuple_ledger.add_batch(again, number, output, config)
    assert tuple_ledger.update_ledger(spark, source, output, config)["taken"] == 0
    assert sorted(tuple(r) for r in tuple_ledger.read_current(spark, output, config).select(*columns).collect()) == plain_tuples(first + second + third)


def test_ledger_of_one_file_a_batch_equals_one_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    table.repartition(5).write.parquet(f"{tmp_path}/in")
    got = []
    for files in (1, 1000):
        config = tuple_ledger.read_config() | {"files_per_batch": files}
        tuple_ledger.update_ledger(spark, f"{tmp_path}/in", f"{tmp_path}/out{files}", config)
        got.append(sorted(tuple(r) for r in tuple_ledger.read_current(spark, f"{tmp_path}/out{files}", config).drop("through_batch").collect()))
    assert got[0] == got[1] and sum(r[3] for r in got[0]) == table.count()
    assert spark.read.parquet(f"{tmp_path}/out1/ledger").select("batch").distinct().count() == 5


def test_ledger_of_nothing(spark, tmp_path):
    config = tuple_ledger.read_config()
    spark.read.parquet(f"{SF}/lineitem.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/in")
    assert tuple_ledger.update_ledger(spark, f"{tmp_path}/in", f"{tmp_path}/out", config) == {"taken": 0, "written": 0}
    lines(spark, [(None, "A", "1997-01-02", 1.0, 1.0, 0.0)], f"{tmp_path}/bad")
    assert tuple_ledger.update_ledger(spark, f"{tmp_path}/bad", f"{tmp_path}/out2", config) == {"taken": 1, "written": 0}


def test_command_line(tmp_path):
    for job in ("tuple_ledger", "residualize"):
        table = {"tuple_ledger": "lineitem.parque[t]", "residualize": "documents.parquet"}[job]
        run = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", f"{SF}/{table}", "--output", f"{tmp_path}/{job}"], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
        assert run.returncode == 0 and "wrote" in run.stderr, run.stderr[-2000:]


def test_queries_keep_the_session_as_it_was(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert queries.job2_tuple_ledger(spark, SF).count() > 0
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before
    assert not spark.streams.active
