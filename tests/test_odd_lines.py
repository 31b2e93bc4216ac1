"""Queries over the lines of texts that the test tables don't have: null, empty, with white space of all kinds, with what the
parser reads within a line."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quill.catalogue import ORACLE_SQL, QUERIES

from .oracle import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n"]
TEXTS = [None, "", " ", "|", "\n", "x\n\ny\n| |\n", "a\r\nb\r\n"]
TEXTS += ["\n".join(f"{c}kata {'x' * i}{c}{c}lagi {c}" for i in range(25)) for c in SPACES]
TEXTS += ["\n".join(f"{line} {'x' * i}" for i in range(25)) for line in ("dari https://www.jdih.ojk.go.id/a", "demi  Agar setiap orang mengetahuinya, ya", "AGAR  SETIAP ORANG MENGETAHUINYA", "pada ayat")]
TEXTS += ["x" * 2300 + "\n\n" + "y" * 40 + "\n \n" * 20]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SF}/{t}.parquet", f"{root}/{t}.parquet")
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no\nid")]
    made = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": ["en"] * len(rows), "source": ["web-1"] * len(rows), "n_chars": [len(r[1] or "") for r in rows]}
    pq.write_table(pa.table(made), f"{root}/documents.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["parse_units", "rebuilt_units"])
def test_odd_lines_give_the_rows_of_sql(spark, tables, name):
    assert compare(spark, connect(tables), tables, QUERIES[name], ORACLE_SQL[name]) > len(TEXTS)


def test_a_list_with_an_unnamed_file_leaves_none(spark, tables, tmp_path):
    for t in TABLES:
        if t != "labels":
            os.symlink(f"{tables}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, None], pa.int64()), "quality": [1, 1], "toxic": [1, 1]}), f"{tmp_path}/labels.parquet")
    assert compare(spark, connect(tmp_path), str(tmp_path), QUERIES["rebuilt_units"], ORACLE_SQL["rebuilt_units"]) == 0
