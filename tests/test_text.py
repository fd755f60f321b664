"""Folding, slugs and chunking against plain Python."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamizal.functions import text as X
from tamizal.operators import documents as T


def fold(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn").split())


def test_fold_matches_unicode_rule(spark):
    words = ["  Ñandú ÁÉÍ\tö ", "", "İstanbul", "éà", "ŻÓŁĆ", " x y", "ßø", "ÅNGSTRÖM ｘ"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.fold(F.col("w"))).collect()]
    assert got == [fold(w) for w in words]


def test_fold_random(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20), min_size=1, max_size=40))
    def check(words):
        got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(X.fold(F.col("w"))).collect()]
        assert got == [fold(w) for w in words]

    check()


def test_slug_defaults(spark):
    rows = spark.createDataFrame([("Guía  de Red.pdf",), ("",), (None,), ("¡!",)], "n string")
    assert [r[0] for r in rows.select(X.slug(F.col("n"))).collect()] == ["guia-de-red-pdf", "unknown", "unknown", "unknown"]
    assert rows.select(X.doc_slug(F.col("n"))).first()[0] == "doc:guia-de-red"


def test_token_chunks_cover_text_with_overlap(spark):
    text = " ".join(str(i) for i in range(1000))
    rows = T.token_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id long, text string"), 350, 50).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in rows if r["doc_id"] == 1]
    assert [r["text"].split()[0] for r in mine] == ["0", "300", "600", "900"]
    assert {r["doc_id"] for r in rows} == {1, 4}
    assert set(" ".join(r["text"] for r in mine).split()) == set(text.split())


def chunks_of(text, budget):
    """The fold as a plain loop."""
    done = []
    for paragraph in filter(None, (p.strip() for p in (text or "").split("\n"))):
        for part in [paragraph] if len(paragraph) <= budget else re.split(r"(?<=[.!?])\s+", paragraph):
            if done and len(done[-1]) + 1 + len(part) <= budget:
                done[-1] += " " + part
            else:
                done.append(part)
    return done


def test_chunks_match_a_plain_fold(spark):
    texts = ["First one. Second one is here.\n" + "A long sentence goes on. " * 40 + "\nLast.", None, "", " \n\n ", "x" * 900, "a\u00a0b\u00a0\nc! d", "word. " * 20_000]
    got = T.semantic_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 200).orderBy("doc_id", "chunk_index").collect()
    for i, text in enumerate(texts):
        assert [r["text"] for r in got if r["doc_id"] == i] == chunks_of(text, 200)
        assert [r["chunk_index"] for r in got if r["doc_id"] == i] == list(range(len(chunks_of(text, 200))))


def test_answers_are_cut(spark):
    from tamizal.operators import language as L

    steps = "\n".join(f"{i}. open the valve of the pump" for i in range(1, 60))
    rows = ["short", None, "", "p" * 500 + "\n\n" + "q" * 300, "z" * 2000, "A sentence. " * 200, steps]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", L.condense(F.col("t")).alias("c"), L.cut_safely(F.col("t")).alias("s"), L.lists_steps(F.col("t")).alias("l")).orderBy("i")
    got = df.collect()
    assert [r["c"] for r in got[:5]] == ["short", None, "", "p" * 500, "z" * 600]
    assert [r["s"] for r in got[:3]] == ["short", "", ""] and got[4]["s"] == "z" * 1000 + "…" and got[5]["s"].endswith("sentence.") and 980 < len(got[5]["s"]) <= 1000
    assert steps.startswith(got[6]["s"] + "\n") and len(got[6]["s"]) <= 1000 and [r["l"] for r in got] == [False] * 6 + [True]
    cited = ["[Doc 1 - a.pdf p.1] Paso uno\n[Doc 2 - b.pdf p.3] x", "[Doc 1 - a.pdf p.1] paso [Doc 2 - a.pdf p.2]", "[Doc 1 - a p.1] x [Doc 2 - b p.2]", None]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cited], "c string").select(L.procedure_backed(F.col("c"))).collect()] == [True, False, False, False]


def test_json_repair(spark):
    rows = ['Sure:\n```json\n{"k": 1,}\n```', '{"k": 2', '{"k": 3}']
    got = spark.createDataFrame([(r,) for r in rows], "raw string").select(F.from_json(T.repair_json(F.col("raw")), "k int")["k"]).collect()
    assert [r[0] for r in got] == [1, 2, 3]


def test_greedy_dedup_is_order_dependent(spark):
    from tamizal.operators.ranking import greedy_dedup

    rows = [(1, 1, 1, "a b c d e f g", 0.9), (1, 1, 2, "a b c d e f g", 0.8), (1, 1, 3, "x y z", 0.7), (1, 2, 4, None, None)]
    hits = spark.createDataFrame(rows, "run_id long, query_id long, hit_id long, text string, final_score double")
    assert sorted(r["hit_id"] for r in greedy_dedup(hits).collect()) == [1, 3, 4]
