"""CSV folders whose files differ in their columns."""

import gzip
import os

from ledgerlens.sources import files as A


def folder(tmp_path, files):
    path = f"{tmp_path}/csv"
    os.makedirs(f"{path}/sub")
    for name, text in files.items():
        with (gzip.open if name.endswith(".gz") else open)(f"{path}/{name}", "wt") as f:
            f.write(text)
    return path


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    path = folder(tmp_path, {"a.csv": "x;y\n1;2\n", "b.csv": "y;x\n20;10\n", "c.csv.gz": " y ;z\n200;zz\n", "sub/d.csv": "﻿x;y;x\n3;4;99\n", "e.csv": "", "f.csv": "x;y\n", "_SUCCESS": ""})
    got = A.read_csv(spark, path, "x int, y int, w string").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, None), (10, 20, None), (None, 200, None), (3, 4, None)], key=str)


def test_malformed_values_are_null_and_counted(spark, tmp_path):
    path = folder(tmp_path, {"a.csv": "x;y;t\n1;2;a\nno;3;b\n;1e3;c\n", "b.csv": "y;x\nnever;many\n"})
    assert A.read_csv(spark, path, "x int, y double, t string").where("x is null").count() == 3
    got = {r.column: (r.malformed, r.example) for r in A.malformed_values(spark, path, "x int, y double, t string").collect()}
    assert got == {"x": (2, "many"), "y": (1, "never")}


def test_no_files(spark, tmp_path):
    path = folder(tmp_path, {})
    assert A.read_csv(spark, path, "x int").collect() == [] and A.read_or_empty(spark, path + "-absent", "x int").collect() == []
