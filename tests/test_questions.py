"""The query of factual questions: odd ends of texts against its SQL, long lines in time."""

import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tamizal.queries import questions


def facts(spark, where, texts):
    where.mkdir()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), where / "documents.parquet")
    began = time.time()
    got = sorted(map(tuple, questions.e_facts(spark, str(where)).collect()))
    return got, time.time() - began


def test_facts_of_odd_texts_match_sql(spark, tmp_path):
    said = "La bomba norte vale $ 30 y pesa 45 kilos.\n"
    ends = ["", "\n", "\r\n", "  \n\n ", "\t", "\f\n", "\x0b", "\n\x0b", "\n\x85", "\n ", "\r", "\x85\n", "\nplain", "\n \n plain \n"]
    asked = ["precio de la bomba norte?", "precio de la turbina", "cve", "endpoint de la api", "€ñ precio", "plain", ""]
    texts = [None, "", " ", "\n\n", " \n\n x"] + [before + a + e for before in ("", said, said + "\n", "\n \n") for a in asked for e in ends]
    got, _ = facts(spark, tmp_path / "odd", texts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/odd/documents.parquet'")
    assert got == sorted(con.execute(questions.SQL["e_facts"]).fetchall())
    assert {r[2] for r in got} == {"short", "evidence", "subject", "pass"}


def test_facts_of_long_lines_take_linear_time(spark, tmp_path):
    texts = lambda n: ["precio: 30 " + "x" * n + "\nprecio de 30?", "y" * n, "z\n" * n]
    want = [(0, "precio", "pass")]
    assert facts(spark, tmp_path / "short", texts(50))[0] == want  # the code is compiled
    got, took = facts(spark, tmp_path / "long", texts(150_000))
    assert got == want and took < 15
