"""Rules with fixed values, on small fixtures."""

import random

import numpy as np
from pyspark.sql import functions as F

from tamizal.operators import evaluation as V
from tamizal.operators import knowledge as K
from tamizal.operators import metrics as M
from tamizal.operators import ranking as R
from tamizal.operators import retrieval as T


def test_extractors_are_weighed(spark):
    rows = [("deterministic:equivalences-text", 0.95), ("deterministic:entity-aliases-dict", 0.9), ("deterministic:doc-cards", 0.7), ("llm:granite-4.1-3b", 0.85), ("other", 0.5)]
    got = spark.createDataFrame(rows, "e string, w double").select(K.extractor_weight(F.col("e")).alias("x"), "w").collect()
    assert all(r["x"] == r["w"] for r in got)
    two = spark.createDataFrame([(0.9, "deterministic:doc-cards"), (0.5, "llm:granite-4.1-3b"), (0.0, "other")], "p double, e string")
    assert abs(two.agg(K.combined_confidence("weighted", F.col("p"), F.col("e"))).first()[0] - (0.9 * 0.7 + 0.5 * 0.85) / 1.55) < 1e-12


def test_predicates_fall_back_in_two_steps(spark):
    want = {"contains": "contains", "Is Part Of": "contains", "requires": "depends_on", "enables": "references", "sings": "references", "aligned_with": "equivalent_to", "is_utilized_by": "uses"}
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", K.map_predicate(F.col("p")).alias("m")).collect()
    assert {r["p"]: r["m"] for r in got} == want
    roles = spark.createDataFrame([("threat_intel",), ("procedure",), ("x",), (None,)], "r string").select(K.wider_role(F.col("r"))).collect()
    assert [r[0] for r in roles] == ["analysis", "guide", "other", "other"]


def test_types_and_best_names(spark):
    df = spark.createDataFrame([("ISO 27001",), ("Pump",), ("OSPF and DNS",)], "n string").select(K.infer_types(F.col("n")).alias("t"))
    assert [r["t"] for r in df.collect()] == [["framework", "standard"], ["concept"], ["protocol"]]
    names = spark.createDataFrame([(["ISMS", "Information Security Management", "isms x"],), (["AB", "CD"],)], "n array<string>").select(K.best_name(F.col("n")))
    assert [r[0] for r in names.collect()] == ["Information Security Management", "AB"]


HIT = "run_id long, query_id long, hit_id long, source string, page int, text string, hybrid_score double, rerank_score double, final_score double"


def test_pages_before_reranking_are_kept(spark):
    # by hybrid score: a1 b2 c3 d4; reranked: d4 c3 a1 b2; two kept of the pages a1, b2, then what is lost
    rows = [(1, 1, 1, "A.pdf", 1, "", 0.9, None, 0.3), (1, 1, 2, "b.pdf", 2, "", 0.8, None, 0.2), (1, 1, 3, "c.pdf", 3, "", 0.7, None, 0.8), (1, 1, 4, "d.pdf", 4, "", 0.6, None, 0.9), (1, 1, 5, "a.PDF", 1, "", 0.1, None, 0.95)]
    got = R.preserve_top(spark.createDataFrame(rows, HIT), 2).orderBy("place").collect()
    assert [(r["hit_id"], r["filled"]) for r in got] == [(5, 0), (2, 1)]


def test_assess_adds_up(spark):
    base = "run_id long, query_id long, n long, sources long, chars long, best_rerank double, best_hybrid double, best_final double, good long, density double, factual boolean, covered long, total long"
    rows = [
        (1, 1, 3, 2, 4000, 0.5, 0.4, 0.4, 2, 0.5, True, 1, 2), (1, 2, 0, 0, 0, None, 0.0, 0.0, 0, 0.0, None, None, None), (1, 3, 3, 1, 10, 0.5, 0.4, 0.4, 2, 0.5, None, None, None),
        (1, 4, 3, 1, 900, 0.05, 0.4, 0.4, 2, 0.5, None, None, None), (1, 5, 3, 1, 900, 0.05, 0.6, 0.4, 2, 1.0, None, None, None), (1, 6, 3, 1, 900, 0.5, 0.4, 0.4, 2, 0.5, False, 1, 1), (1, 7, 3, 1, 900, 0.5, 0.4, 0.4, 2, 0.5, True, 0, 2),
    ]
    got = {r["query_id"]: (r["gate"], round(r["score"], 6)) for r in V.assess(spark.createDataFrame(rows, base)).collect()}
    assert got[1] == ("pass", round(0.2 + 0.2 + 0.4 + 0.075 + 0.06 + 0.025, 6)) and got[2][0] == "no hits" and got[3][0] == "too short"
    assert got[4] == ("weak", 0.05) and got[5][0] == "pass" and got[6] == ("factual", 0.0) and got[7] == ("no entity", 0.0)


def test_sources_match_either_way(spark):
    hits = [(1, 1, 1, "docs/Guide.pdf", 5, "", 0.9, None, 0.9), (1, 1, 2, "guide", 9, "", 0.8, None, 0.8), (1, 1, 3, "other.pdf", 1, "", 0.7, None, 0.7), (1, 1, 4, None, 1, "", 0.6, None, 0.6)]
    questions = spark.createDataFrame([(1, True, ["guide.pdf", "missing.pdf"], [[4], None])], "query_id long, is_answerable boolean, expected_sources array<string>, expected_pages array<array<int>>")
    df = spark.createDataFrame(hits, HIT)
    assert sorted((r["hit_id"], r["page_hit"]) for r in V.relevance(df, questions).collect()) == [(1, True), (2, False)]
    m = V.retrieval_metrics(df, questions).first()
    assert (m["doc_hit"], m["page_hit"], m["first_rank"], m["mrr"], m["recall"], m["precision"], m["recall_1"]) == (1, 1, 1, 1.0, 0.5, 0.5, 1)


def test_claims_and_signals(spark):
    long = "The relay of the north yard was replaced by the field crew in version 2.1 of the plan."
    rows = [(1, long, long, 3, True), (2, "No se menciona en los documentos.", "x", 3, True), (3, "No se menciona en los documentos.", "x", 3, False), (4, "The pump runs at 77 units now.", "the pump runs", 3, True), (5, "", "x", 3, True), (6, f"{long} [Doc 9 - a p.1]", long, 3, True), (7, f"{long} [Doc 2 - a p.1]", long, 3, True)]
    got = {r["id"]: (r["reason"], r["passed"], r["signal"]) for r in V.verify(spark.createDataFrame(rows, "id long, answer string, context string, n_results int, assess_passed boolean")).collect()}
    assert got[1] == ("supported", True, 1.0) and got[2] == ("unjustified hedge", False, 0.0) and got[3] == ("hedge", True, 0.5)
    assert got[4][:2] == ("unsupported", False) and got[5][:2] == ("empty", False) and got[6][0] == "contradicted" and got[7][0] == "supported"


def test_order_statistics_match_sorting(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([1.0, 2.0, 2.0, rnd.random() * 9])) for g in ("a", "b") for _ in range(300 if g == "a" else 7)]
    at = {"low": lambda n: F.floor((n + 1) / 2), "last": lambda n: n, "first": lambda n: F.lit(1)}
    got = {r["g"]: (r["low"], r["last"], r["first"]) for r in M.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at, ranges=8).collect()}
    for g in ("a", "b"):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == (v[(len(v) + 1) // 2 - 1], v[-1], v[0])


def test_gaps_over_windows(spark):
    from datetime import datetime, timedelta

    t0, rnd = datetime(2024, 1, 1), random.Random(4)
    times = [t0 + timedelta(seconds=rnd.randrange(200_000)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(times)], "event_id long, ts timestamp_ntz, k string")
    got, s = M.gaps(df, F.col("k")).first(), sorted(times)
    long = [int((b - a).total_seconds()) for a, b in zip(s, s[1:]) if (b - a).total_seconds() > 300]
    assert (got["gaps"], got["down_s"], got["span_s"]) == (len(long), sum(long), int((s[-1] - s[0]).total_seconds()))


def test_cell_index_recalls_exact_neighbours(spark):
    rnd = np.random.default_rng(5)
    centers = rnd.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centers[i % 20] + 0.6 * rnd.normal(size=16)]) for i in range(2000)] + [(5000 + i, [float(x) for x in centers[3]]) for i in range(300)] + [(9000, None), (9001, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.where("id % 20 = 0 and id < 2000")
    exact = {(r["query_id"], r["doc_id"]) for r in T.cosine_top(df, asked, 10).collect()}
    near = {(r["query_id"], r["doc_id"]) for r in T.CellIndex(df).top(asked, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and len(near) == len(exact) == 1000
    assert T.CellIndex(df.limit(0)).top(asked, 10).count() == 0


def test_dedup_matches_the_sequential_rule(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for q in range(4):
        base = [rnd.sample(words, 20) for _ in range(3)]
        for i in range(25):
            b = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                b[rnd.randrange(20)] = rnd.choice(words)
            rows.append((1, q, 100 * q + i, "s", 1, " ".join(b), 0.0, 0.0, rnd.random()))
    want = set()
    for q in range(4):
        kept = []
        for r in sorted((r for r in rows if r[1] == q), key=lambda r: -r[8]):
            w = set(r[5].split())
            if not any(len(w & k) / len(w | k) >= 0.85 for k in kept):
                kept.append(w)
                want.add(r[2])
    assert {r["hit_id"] for r in R.greedy_dedup(spark.createDataFrame(rows, HIT)).collect()} == want


def test_budgets_are_handed_out_in_turn(spark):
    rows = [(1, 1, k, f"s{k}.pdf", 1, "x" * size, 0.0, 0.0, 1.0 - k / 10) for k, size in enumerate((3000, 100, 5000, 200), 1)]
    got = {r["hit_id"]: r["chars"] for r in R.dynamic_budget(spark.createDataFrame(rows, HIT), budget=2000, least=600).collect()}
    used, want = 0, {}
    for k, size in enumerate((3000, 100, 5000, 200), 1):
        want[k] = min(max(600, (2000 - used) // (4 - k + 1)), size)
        used += want[k]
    assert got == want


def test_kinds_of_questions(spark):
    from tamizal.operators import questions as Q

    want = {
        "Explica en detalle el documento de respaldo": {"detailed", "doc_explanation"}, "lista de controles de acceso": {"listing"}, "Dame una lista completa de 20 palabras con todo": {"detailed", "multi_document"},
        "¿cómo funciona una bomba en general?": {"conceptual", "procedural"}, "y su alarma": {"follow_up"}, "Diferencia entre Norte y Sur": {"multi_document", "comparison", "direct_comparison"},
        "cuantos requisitos hay en total": {"multi_document", "aggregation", "specific_count", "sum", "follow_up"} - {"follow_up"}, "¿Cuántos motores tiene Presa?": {"simple_numeric"}, "por qué falla la bomba": {"multi_document", "troubleshooting"},
        "revisa cada documento": {"multi_document", "full_coverage"},
    }
    rows = [(t, ["Presa"] if "Presa" in t else []) for t in want] + [(None, None), ("", [])]
    df = spark.createDataFrame(rows, "t string, e array<string>")
    got = {r["t"]: {k for k, v in r.asDict().items() if v is True} for r in df.select("t", *[c.alias(n) for n, c in Q.question_flags(F.col("t"), F.col("e")).items()]).collect()}
    assert {t: got[t] for t in want} == want and got[None] == got[""] == set()


def test_gate_of_factual_questions(spark):
    from tamizal.operators import questions as Q

    pad = " The rest of this context is long enough."
    rows = [
        ("What is the price of the valve?", "The valve costs USD 40." + pad, "precio", "evidence"), ("What is the price of the valve?", "price: 40 a valve" + pad, "precio", "pass"), ("price?", "40 USD", "precio", "short"),
        ("What does RFC 2119 say?", "As in RFC 8174." + pad, "rfc", "rfc"), ("What does RFC 2119 say?", "As in RFC 2119." + pad, "rfc", "pass"), ("precio de la bomba norte?", "Vale $ 30." + pad, "precio", "subject"),
        ("precio de la bomba norte?", "La bomba vale $ 30." + pad, "precio", "pass"), ("Which pump runs?", None, None, None), (None, "x", None, None), ("cve?", None, "cve", "short"), ("How many employees?", "About 45 employees." + pad, "empleados", "pass"),
    ]
    got = spark.createDataFrame(rows, "q string, c string, t string, v string").select(Q.factual_type(F.col("q")).alias("type"), Q.factual_verdict(F.col("q"), F.col("c")).alias("verdict"), "t", "v").collect()
    assert [(r["type"], r["verdict"]) for r in got] == [(r["t"], r["v"]) for r in got]


def test_several_documents(spark):
    from tamizal.operators import questions as Q

    hits = [(1, q, 10 * q + i, s, None, "t", 0.0, r, 1.0 - i / 10) for q, n in ((1, 0.5), (2, 0.1), (3, 0.5), (4, 0.1), (5, 0.5)) for i, (s, r) in enumerate((("a", 0.1), ("b", 0.1 + n), ("c", None)))]
    asked = [(1, "which pump", None, False), (2, "which pump", None, False), (3, "instalar la bomba", None, False), (4, "alarma y protocolo", ["x", "y"], True), (5, "alarma tras protocolo", ["x", "y"], None)]
    got = Q.several_documents(spark.createDataFrame(hits, HIT), spark.createDataFrame(asked, "query_id long, question string, roles array<string>, one_annex boolean")).collect()
    assert {r["query_id"]: r["reason"] for r in got} == {1: None, 2: "spread", 3: "procedure", 4: None, 5: "aspects"}


def test_scores_by_role_and_mention(spark):
    from tamizal.operators import boosting as B

    hits = spark.createDataFrame([(1, q, 10 * q + i, s, None, t, 0.0, 0.0, 1.0) for q in (1, 2) for i, (s, t) in enumerate((("Anexo D.pdf", "the Presa pump"), ("anexo d.pdf", "x"), ("Manual Presa.pdf", "x"), (None, None)))], HIT)
    ents = spark.createDataFrame([(1, ["presa"]), (2, [])], "query_id long, entities array<string>")
    assert {r["hit_id"]: round(r["boosted"], 6) for r in B.mention_boost(hits, ents).collect()} == {10: 1.7, 11: 0.25, 12: 0.8, 13: 0.65}
    docs = hits.withColumn("canonical_doc_id", F.col("source"))
    cards = spark.createDataFrame([("Anexo D.pdf", "guide", 0.5, ["risk"]), ("anexo d.pdf", "procedure", 0.0, []), ("Manual Presa.pdf", "other", None, None)], "canonical_doc_id string, role string, centrality double, attributes array<string>")
    got = B.role_boost(docs, cards, ["guide"], attribute="risk", specific=spark.createDataFrame([(1,)], "query_id long"))
    assert {r["hit_id"]: round(r["boosted"], 6) for r in got.collect()} == {10: 1.4, 11: 0.8, 12: 1.0, 13: 1.0, 20: 1.4, 21: 1.0, 22: 1.0, 23: 1.0}
