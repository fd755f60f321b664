"""Numbered operators against brute force on small inputs, and their behaviour on odd ones."""

import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tamizal.llm import capping, components, incremental, leaks, mixing, names, residue, scans, survivors


def fold(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if unicodedata.category(c) != "Mn").split())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


CLAIMS = "claim_id long, alias string, canonical_name string, key int, rank string"


class Find:
    def __init__(self):
        self.up = {}

    def __call__(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self(a), self(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("block", [3, 40, 100_000])
def test_groups_match_union_find(spark, block):
    rnd = random.Random(block)
    pairs = [(f"n{rnd.randrange(160)}", f"N{rnd.randrange(160)} ") for _ in range(150)]
    pairs += [(f"m{i:03}", f"m{i + 1:03}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(60)]  # a chain in name order, a hub
    claims = [(i, a, b, 0, "x") for i, (a, b) in enumerate(pairs)] + [(900, None, "a", 0, ""), (901, " ", "a", 0, ""), (902, "Unknown", "a", 0, ""), (903, "Self", "sélf", 0, ""), (904, "hub", "leaf1", 0, "")]
    find = Find()
    for _, a, b, *_ in claims:
        if fold(a) and fold(b) and fold(a) != "unknown":
            find.join(fold(a), fold(b))
    want = sorted((i, find(fold(a))) for i, a, b, *_ in claims if fold(a) and fold(b) and fold(a) != "unknown")
    df = spark.createDataFrame(claims, CLAIMS).repartition(3)
    assert rows_of(components.alias_groups(df, block)) == want


def test_groups_of_nothing(spark):
    assert rows_of(components.alias_groups(spark.createDataFrame([], CLAIMS))) == []


ENTITIES = "record_id long, canonical_name string, types array<string>, confidence double, extractor_ids array<string>, built_at timestamp_ntz, key string, place int"


def test_survivor_order_and_edges(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [
        (1, "Red-Hub 2", ["tool"], 0.5, ["a"], new, "", 0), (2, "redhub_2", ["tool", "x"], 0.5, ["a", " A ", None, ""], old, "", 0), (3, "RÉD HUB 2", None, 0.5, ["a", "b"], None, "", 0),
        (4, "red hub 3", ["tool"], 0.9, ["a"], new, "", 0),  # another number: alone
        (5, "Pump", ["t"], float("nan"), ["a"], old, "", 0), (6, "pump.", ["t"], 95.0, ["a"], old, "", 0), (7, "«pump»", ["t"], None, None, new, "", 0),
        (8, None, None, None, None, None, "", 0), (9, None, None, None, None, None, "", 0), (10, "--", [], 0.1, [], None, "", 0), (11, " ", [], 0.1, [], None, "", 0),
        (12, "same", ["t"], 0.3, ["a"], old, "", 0), (13, "same", ["t"], 0.3, ["a"], old, "", 0),
    ]
    out = survivors.survivors(spark.createDataFrame(rows, ENTITIES))
    assert rows_of(out.select("record_id", "n_records")) == [(3, 3), (5, 3), (12, 2)]
    assert rows_of(survivors.survivors(spark.createDataFrame([], ENTITIES)).select("record_id")) == []


def test_two_sided_model_keeps_what_good_sources_say(spark):
    rnd = random.Random(1)
    rows, truth = [], {}
    for g in range(300):
        true = {v for v in "abcd" if rnd.random() < 0.5} or {"a"}
        truth[f"g{g}"] = true
        for source, sens, false in (("good1", 0.95, 0.03), ("good2", 0.9, 0.05), ("bad", 0.3, 0.4)):
            rows.append((f"g{g}", [source], [v for v in "abcd" if rnd.random() < (sens if v in true else false)]))
    df = spark.createDataFrame(rows, "key string, sources array<string>, values array<string>")
    out = {r["key"]: set(r["values"]) for r in survivors.true_values(survivors.Scratch(spark), df).collect()}
    right = sum(len(out.get(k, set()) ^ t) for k, t in truth.items())
    votes = {k: {v for v in "abcd" if sum(v in r[2] for r in rows if r[0] == k) >= 2} for k in truth}
    assert right <= sum(len(votes[k] ^ t) for k, t in truth.items())
    assert right / (4 * len(truth)) < 0.1


HITS = "hit_id long, run_id long, source string, final_score double, score int, id string"


def test_cap_matches_sorting(spark):
    rnd = random.Random(5)
    spell = ["Guía A.pdf", "guia a.PDF", "data/x/Guia_A.pdf", " inbox\\GUÍA A.pdf "]
    rows = [(i, rnd.randrange(2), rnd.choice([*spell, "b.pdf", None, " "]), rnd.choice([0.1, 0.5, 0.5, None, float("nan"), 0.9]), 0, "") for i in range(300)]
    groups = {}
    for h, run, source, score, *_ in rows:
        if source and source.strip():
            name = "guia a" if "a.p" in fold(source).replace("_", " ") else "b"
            groups.setdefault((run, name), []).append((-(score if score is not None and score == score else float("-inf")), h))
    want = sorted((h,) for v in groups.values() for _, h in sorted(v)[20:])
    df = spark.createDataFrame(rows, HITS)
    assert rows_of(capping.capped_hits(df)) == want
    parts = [F.col("hit_id") % 3 == k for k in range(3)]  # arrivals in any order give the same state
    by_parts = capping.cap(df, [F.col("run_id"), capping.file_key(F.col("source"))], "final_score", "hit_id", 20, parts)
    assert rows_of(by_parts) == want
    assert rows_of(capping.capped_hits(spark.createDataFrame([], HITS))) == []


REGISTRY = "entry_id long, batch_no int, content_hash string, filename string, filepath string, total_pages int, attempted_chunks int, chunks_indexed int, key string"


def test_registry_links(spark):
    h = lambda i: f"{i:064x}"
    names_ = [
        (1, 0, h(1), "Guía Motores - Fapro v1.0.pdf", 9), (2, 0, h(2), "Guía Motores - Fapro v1.1.pdf", 8), (3, 0, h(3), "Anexo A - Minuta - Loruta.pdf", 7), (4, 0, h(4), "Anexo B - Minuta - Loruta.pdf", 6),
        (5, 1, h(5), "x/Guia_Motores_-_Fapro%20v1.0 - copia (2).PDF", 9), (6, 1, "SHA256:" + h(2).upper() + " ", "scan001.pdf", 8), (7, 1, h(7), "Anexo A - Mintua - Loruta.pdf", 7),
        (8, 2, h(8), "Plan Planta Este 1.pdf", 5), (9, 2, h(9), "Plan Planta Oeste 1.pdf", 4), (10, 2, h(10), "Copy of scan001.pdf", 3), (11, 2, None, None, None), (12, 3, None, "", None),
    ]
    rows = [(e, b, c, f, None, p, (p or 0) * 3 if p else None, p, "") for e, b, c, f, p in names_]
    rows += [(20 + i, 3, incremental.EMPTY_HASH, f"empty{i}zz{'q' * i}.pdf", None, 0, 0, 0, "") for i in range(3)]
    out = incremental.registry_repeats(spark.createDataFrame(rows, REGISTRY))
    assert rows_of(out) == [(1, 5), (2, 6), (2, 10), (3, 7)]
    assert rows_of(incremental.registry_repeats(spark.createDataFrame([], REGISTRY))) == []


def test_registry_goes_on_in_a_later_session(spark, tmp_path):
    import os

    h = lambda i: f"{i:064x}"
    row = lambda e, b, c, f, p: (e, b, h(c), f, None, p, p * 3, p, "")
    batches = [
        [row(1, 0, 1, "Guía Motores Fapro.pdf", 9), row(2, 0, 2, "Anexo Loruta.pdf", 7), row(3, 0, 3, "Plan Guias 1.pdf", 5)],
        [row(4, 1, 4, "guia_motores_fapro.PDF", 9), row(5, 1, 5, "Minuta Zarvol.pdf", 4)],
        [row(6, 2, 5, "scan7.pdf", 4), row(7, 2, 7, "Anexo Lorutta.pdf", 7), row(8, 2, 8, "scan7 (2).pdf", 3), row(9, 2, 9, "Plan Guia 1.pdf", 11)],
        [row(10, 3, 1, "x.pdf", 9), row(11, 3, 11, "Plan Guia 1.pdf", 22)],
    ]
    home = f"{tmp_path}/registry"
    for k, rows in enumerate(batches):
        state = incremental.Registry(incremental.Scratch(spark, "t"), home)  # opened anew for each batch
        assert state.state.batches == k
        state.add(spark.createDataFrame(rows, REGISTRY))
    got = rows_of(incremental.Registry(incremental.Scratch(spark, "t"), home).repeats())
    assert {(1, 4), (1, 10), (5, 6), (5, 8), (2, 7)} <= set(got)
    assert (9, 11) in got or (3, 9) in got and (3, 11) in got  # equal names link whatever a guess decides
    one = incremental.Registry(incremental.Scratch(spark, "t"), f"{tmp_path}/one")
    one.add(spark.createDataFrame([r for b in batches for r in b], REGISTRY))
    assert {(1, 4), (1, 10), (5, 6), (5, 8)} <= set(rows_of(one.repeats()))
    # a look-up reads the buckets of its keys only
    state = incremental.Registry(incremental.Scratch(spark, "t"), home)
    found = state.state.look_up("keys", spark.createDataFrame([("n:anexoloruta",)], "key string"), "key")
    assert found.count() >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and len(os.listdir(f"{home}/keys/batch=1")) > 2


def test_cap_state_goes_on(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(3), f"f{rnd.randrange(4)}.pdf", rnd.choice([0.1, 0.5, None, 0.9]), 0, "") for i in range(400)]
    df, keys = spark.createDataFrame(rows, HITS), [F.col("run_id"), capping.file_key(F.col("source"))]
    home, gone = f"{tmp_path}/cap", []
    for k in range(4):  # a fresh state for each batch, as in a later session
        gone += rows_of(capping.cap(df.where(F.col("hit_id") % 4 == k), keys, "final_score", "hit_id", 20, home=home))
    assert sorted(gone) == rows_of(capping.cap(df, keys, "final_score", "hit_id", 20))
    # a batch that broke before its commit is replaced
    state = capping.CapState(capping.Scratch(spark, "t"), 20, home)
    assert state.batches == 4 and state.kept().count() == 20 * 12


def test_one_slip_against_osa(spark):
    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 5)))
    pairs = [(word(), word()) for _ in range(400)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", incremental.one_slip(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(r["a"], r["b"], r["x"]) for r in got] == [(a, b, osa(a, b) == 1) for a, b in pairs]


def test_name_variants(spark):
    people = ["theodore nuladega", "nuladega, theodore", "t. nuladega", "tnuladega", "theodore k. nuladega", "dr. theodore nuladega", "ted nuladega", "theodore nuladgea", "dolores nuladega", "d. nuladega"]
    firms = ["laplacifi seguridad industrial s.a.", "seguridad industrial, laplacifi", "laplacifi seg. ind.", "laplacifi servicios electricos ltd.", "laplacifi servicios electricos"]
    surnames = "bordequi calmetro dunforsa egristal fulpenco gromisat holtrani ispendru jurbelot kemastri lodrupel mirquans norbetil ospragun putrekam".split()
    noise = [f"{f} {s}" for f, s in zip(["theodore", "dolores", "henry", "isabel"] * 4, surnames)]
    noise += [f"{b} {a}" for b in ("brontegas", "climudor", "drosparel") for a in ("seguridad industrial", "servicios electricos")]
    df = spark.createDataFrame([(n,) for n in [*people, *firms, *noise, people[0], None, "", "unknown"]], "name string")
    groups = {}
    for r in names.name_variants(df).collect():
        groups.setdefault(r["entity"], set()).add(r["name"])
    sets = [v for v in groups.values() if len(v) > 1]
    assert set(people[:8]) in sets and {"dolores nuladega", "d. nuladega"} in sets
    assert set(firms[:3]) in sets and set(firms[3:]) in sets
    assert not any(set(noise) & s for s in sets)
    assert rows_of(names.variant_pairs(spark.createDataFrame([], "name string"))) == []


def test_names_reordered_and_crowded_surnames(spark):
    same = ["juan carlos bordega zulimat", "zulimat bordega, juan carlos", "bordega zulimat, juan carlos"]
    crowd = [f"{f} gomerlo" for f in ("alba", "bruno", "celia", "david", "elena", "fausto", "greta", "hugo", "irene", "jorge")]
    df = spark.createDataFrame([(n,) for n in [*same, *crowd]], "name string")
    groups = {}
    for r in names.name_variants(df).collect():
        groups.setdefault(r["entity"], set()).add(r["name"])
    sets = [v for v in groups.values() if len(v) > 1]
    assert sets == [set(same)]


def test_chains_of_slips_reach_their_end(spark):
    chain = ["pelargonda"]
    for k, c in enumerate("bcdfghjkmn"):  # each a slip of the one before, each rarer
        w = chain[-1]
        chain.append(w[:k] + c + w[k + 1 :])
    tokens = spark.createDataFrame([(w, 6 ** (len(chain) - i)) for i, w in enumerate(chain)], "token string, n long")
    got = dict(rows_of(names.usual_spellings(names.Scratch(spark, "t"), tokens)))
    assert got == {w: chain[0] for w in chain[1:]}


ITEMS = "item_id long, question string, passage string, weights string"


def test_leaks_by_tiles(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rnd.sample(vocabulary, 20)), " ".join(rnd.sample(vocabulary, 60)), "") for k in range(20)]
    items.append((99, None, "", ""))
    filler = lambda n: " ".join(f"f{rnd.randrange(5000)}" for _ in range(n))
    cut = lambda k, a, b: " ".join(items[k][2].split()[a:b])
    docs = [
        (1, f"{filler(50)} {items[3][1]} {filler(9)}"), (2, f"{filler(5)} {cut(4, 10, 34)} {filler(50)}"), (3, f"{filler(30)} {cut(5, 0, 12)} {filler(30)} {cut(5, 40, 48)}"),
        (4, filler(40)), (5, None), (6, ""), (7, "two words"), (8, "<b>" + items[6][1].upper().replace(" ", "</b>\n<b>") + "</b>"), (9, cut(7, 20, 40) + " " + cut(7, 0, 20)),
    ]
    tenth = items[8][2].split()
    tenth[5], tenth[17], tenth[31] = "other", "changed", "words"
    docs.append((10, " ".join(tenth)))
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, part string")
    got = rows_of(leaks.leaks(df, spark.createDataFrame(items, ITEMS)))
    assert got == [(1, 3), (2, 4), (8, 6), (9, 7), (10, 8)]
    assert rows_of(leaks.leaks(df.limit(0), spark.createDataFrame(items, ITEMS))) == []
    assert rows_of(leaks.leaks(df, spark.createDataFrame([], ITEMS))) == []


def test_leaks_with_rare_words_changed(spark):
    frame = "who besides the {} may open locker {} of {} when the badge readers show a late reading at the site today"
    items = [(k, frame.format(role, 10 + k, f"name{k}x"), f"p{k}a p{k}b p{k}c", "") for k, role in enumerate(["vendor", "auditor", "operator", "owner"] * 5)]
    asked = items[3][1]
    docs = [
        (1, asked.replace("name3x", "almost").replace(" 13 ", " then ")),  # the two rarest words changed
        (2, asked.replace("name3x", "zubrefo").replace(" 13 ", " 77 ")),  # a look-alike
        (3, asked.replace("name3x", "almost").replace("may", "did")), (4, asked.replace("owner", "x").replace("open", "y").replace("name3x", "z").replace("late", "w")),
    ]
    df = spark.createDataFrame([(i, f"before it all {t} after it all", "x") for i, t in docs], "doc_id long, text string, part string")
    assert rows_of(leaks.leaks(df, spark.createDataFrame(items, ITEMS)).where("item_id = 3")) == [(1, 3), (3, 3)]


def test_short_items_shared_items_and_long_documents_leak(spark):
    rnd = random.Random(12)
    questions = ["alpha beta gamma delta epsilon zeta eta", "who keeps the brass key of the ninth river gate", "one two three four five six seven eight nine ten eleven twelve", "six words only in this item", "quorum sensing"]
    items = [(k, q, None, "") for k, q in enumerate(questions)]
    shared = " ".join(f"s{i}" for i in range(40))
    items += [(20 + k, None, shared, "") for k in range(12)]  # a passage that many items share
    filler = lambda n: " ".join(f"f{rnd.randrange(5000)}" for _ in range(n))
    docs = [
        (1, f"x {questions[0]} y"), (2, questions[1].replace("brass", "iron")), (3, questions[2]), (4, f"the {questions[3]}."), (5, "on Quorum-Sensing in films"),
        (6, questions[0].replace("gamma", "x").replace("zeta", "y")), (7, f"{filler(4000)} {shared[:100]} {filler(3000)} {' '.join(shared.split()[5:30])} {filler(4000)}"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)] + [(7, 20 + k) for k in range(12)]
    assert rows_of(leaks.leaks(df, spark.createDataFrame(items, ITEMS))) == want


def test_tiles_are_longest_first_and_disjoint():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = [rnd.randrange(6) for _ in range(25)], [rnd.randrange(6) for _ in range(30)]
        place = leaks.tile(a, b, 2)
        used = [p for p in place if p >= 0]
        assert len(used) == len(set(used)) and all(a[i] == b[p] for i, p in enumerate(place) if p >= 0)


def test_residue_kinds(spark):
    docs = [
        (1, "404 Not Found\nThe requested URL /x was not found on this server."), (2, "Please enable JavaScript to continue."), (3, "Lorem ipsum dolor sit amet consectetur."), (4, "Item 1\nHeading 2\nPoint 3\nColumn 4"),
        (5, "The site ${owner} keeps one copy.\nOrdinary words follow here."), (6, "The site {{ area }} keeps one copy."), (7, "The site harbor keeps one copy."), (8, "Field <owner> of the schema is mandatory."),
        (9, "The proxy answers 404 Not Found to unknown agents, and that is right."), (10, "Readers should disable JavaScript in viewers."), (11, None), (12, ""), (13, "blah blah blah blah blah blah"), (14, "x " * 50_000), (2, "Please enable JavaScript to continue."),
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["kind"] for r in residue.residue(df).collect()}
    assert {k: v for k, v in got.items() if k != 14} == {1: "error", 2: "notice", 3: "filler", 4: "outline", 5: "slot", 6: "slot", 13: "filler"}
    assert rows_of(residue.residue(df.limit(0))) == []


def test_residue_of_other_wording_and_length(spark):
    long_notice = "Please enable JavaScript in the settings of your browser so that this page can show the whole of the content that was prepared for readers of every region and language."
    docs = [
        (1, "HTTP 503 upstream connect error or disconnect before headers"), (2, "Veuillez patienter pendant la vérification."), (3, "We are sorry, but the page that you tried to open is gone."),
        (4, "Sorry, this content isn't available right now."), (5, long_notice), (6, "Dear [Name of customer], we write about {{topic}}."), (7, "Review date: ________"), (8, "zxcv asdf qwer hjkl asd"),
        (9, "The harbor crew replaced the pump. The valve is open. The log is complete. The new shift waits. When the page that you need is gone, the keeper writes a note."),
        (10, "Scripts under ${HOME}/bin run at night. Status TBD is not accepted by the tracker."), (11, "Approved by: the audit office"),
        (12, "Home > Files\nxxx xxx xxx xxx xxx xxx\nHome > Files"), (13, "Loading... If nothing happens, allow JS for this domain.\n© Portal. All rights reserved"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 12, 13}


TOKENIZER = mixing.TOKENIZER


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="needs the tokenizer")
def test_mix_holds_shares_and_caps(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["word"] * rnd.randint(5, 40)), rnd.choice(["Big ", "big", "big", "small"]) if i % 9 else "tiny", "es", "2024", 100, 1) for i in range(1200)]
    rows += [(5000, None, "big", None, None, None, 1), (5001, "", "big", None, None, None, 1), (5002, "other words", None, None, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, doc_date string, n_chars long, tokens int")
    targets = spark.createDataFrame([("big", 0.3, 1), ("SMALL", 0.4, 2), ("tiny", 0.3, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and not {5000, 5001, 5002} & {r["doc_id"] for r in got}
    caps = {"big": 1, "small": 2, "tiny": 4}
    assert all(r["copies"] <= caps[r["source"]] for r in got)
    for source, share in {(r["source"], r["actual_share"]) for r in got}:
        assert abs(share - {"big": 0.3, "small": 0.4, "tiny": 0.3}[source]) < 0.02
    short = {r["source"]: r["actual_share"] for r in mixing.mix(docs, targets, total_tokens=10**7).collect()}
    assert abs(sum(short.values()) - 1) < 1e-9  # every source at its cap, shares as they then are
    assert mixing.mix(docs.limit(0), targets).count() == 0


def test_truth_prior_and_field_fallback(spark):
    from datetime import datetime

    day = datetime(2024, 5, 1)
    rows = [(1, "A b", ["t"], 0.9, ["x"], None, "", 0), (2, "a-b", ["t"], 0.5, ["x"], day, "", 0), (3, "A.B", ["t"], 0.7, ["y"], None, "", 0)]
    got = survivors.survivors(spark.createDataFrame(rows, ENTITIES)).collect()
    assert [(r["record_id"], r["built_at"], r["confidence"]) for r in got] == [(1, day, 0.9)]


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "same text here", "a", "es", "d", 1) for i in range(2000)], "doc_id long, text string, source string, lang string, doc_date string, n_chars long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets, quality=F.when(F.col("doc_id") < 1000, 4.0).otherwise(1.0), total_tokens=3 * 500).collect()
    heavy = sum(r["doc_id"] < 1000 for r in got)
    mixing.RANGE_ROWS, rows = 50, mixing.RANGE_ROWS  # many small ranges give the same sample
    again = mixing.mix(docs, targets, quality=F.when(F.col("doc_id") < 1000, 4.0).otherwise(1.0), total_tokens=3 * 500).collect()
    mixing.RANGE_ROWS = rows
    assert {r["doc_id"] for r in again} == {r["doc_id"] for r in got}
    assert heavy > 0.7 * len(got) > 0


def scan_text(k):
    rnd = random.Random(k)
    words = "the field crew opens the alarm matrix and verifies every badge reader before each outage so that records survive a restart of the remote terminal units in the valley station during maintenance windows".split()
    pages = []
    for p in range(1, 4):
        lines = [" ".join(rnd.choices(words, k=8)) for _ in range(8)]
        pages.append((p, lines))
    return pages


def test_scan_flaws(spark):
    texts, want = [], set()
    for k in range(60):
        out = ["=== f.pdf ===", ""]
        for p, lines in scan_text(k):
            out += [f"--- Página {p} ---", "Recovery Handbook Drane"]
            want.add((k, len(out), "furniture"))
            for n, line in enumerate(lines):
                if k % 3 == 0 and n == 2:
                    line = line.replace("e", "c", 1) if "terminal" in line else line.split(" ")[0] + " rnaintenance " + line.split(" ", 1)[1]
                    out.append(line)
                    want.add((k, len(out), "misread"))
                elif k % 3 == 1 and n == 4:
                    out.append(line + " mainte-")
                    want.add((k, len(out), "broken"))
                    lines[5] = "nance " + lines[5]
                else:
                    out.append(line)
            out.append(f"- {p} -")
            want.add((k, len(out), "furniture"))
        texts.append((k, "\n".join(out), "x"))
    texts += [(900, None, ""), (901, "", ""), (902, "=== only ===", "")]
    df = spark.createDataFrame(texts, "text_id long, text string, line string")
    got = set(rows_of(scans.flaws(df)))
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    assert rows_of(scans.flaws(df.limit(0))) == []


def test_scans_are_repaired(spark):
    texts, want = [], {}
    for k in range(60):
        out, pages = ["=== f.pdf ===", ""], []
        for p, lines in scan_text(k):
            out += [f"--- Página {p} ---", "Recovery Handbook Drane"]
            clean, typed = [*lines], [*lines]
            clean[3], typed[3] = f"maintenance {lines[3]}.", f"{'rnaintenance' if (k % 20, p) == (0, 2) else 'maintenance'} {lines[3]}."
            clean[4], typed[4], typed[5] = lines[4] + " maintenance", lines[4] + " mainte-", "nance " + lines[5]
            out += [*typed[:4], "", *typed[4:], f"- {p} -"]
            pages += [" ".join(clean[:4]), " ".join(clean[4:])]
        texts.append((k, "\n".join(out)))
        # pages end within a sentence, so that paragraphs go on over them
        want[k] = "\n\n".join([pages[0], f"{pages[1]} {pages[2]}", f"{pages[3]} {pages[4]}", pages[5]])
    texts += [(900, None), (901, ""), (902, "=== only ===")]
    got = dict(rows_of(scans.repaired(spark.createDataFrame(texts, "text_id long, text string"))))
    assert got.pop(901) == got.pop(902) == "" and set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) > 0.9 * len(want), (got[1], want[1])
    assert all(got[k] == want[k] for k in (0, 20, 40)), (got[0], want[0])  # those with a misread word


def test_letters_lost_added_and_long_words(spark):
    long_word = "transmission" * 6
    lines = ["the crew restores the maintenance report before the outage and signs the historian"] * 60 + [f"the code {long_word} stands on the label"] * 30
    noisy = ["the crew restores the mantenance reeport here", "the code " + long_word.replace("mission", "rnission", 1) + " stands"]
    texts = [(k, "=== f ===\n--- Página 1 ---\nfirst line\n" + "\n".join(f"{x} {k} {j}" for j, x in enumerate(lines)) + "\nlast line\nend") for k in range(3)]
    bad = "=== f ===\n--- Página 1 ---\nfirst line\nmore words\n" + "\n".join(noisy) + "\nand more\nlast line\nend"
    texts += [(10 + k, bad) for k in range(8)]  # copies of a misreading do not make it usual
    got = set(rows_of(scans.flaws(spark.createDataFrame(texts, "text_id long, text string")).where("flaw = 'misread'")))
    assert {(10 + k, n, "misread") for k in range(8) for n in (5, 6)} <= got
    assert len(got) <= 20


def test_furniture_of_three_lines():
    pages = {p: list(range(10 * p, 10 * p + 8)) for p in range(4)}
    skel = [f"s{i}" for i in range(40)]
    for p in pages:
        skel[10 * p], skel[10 * p + 1], skel[10 * p + 2] = "org", "title", "section"
    place = {i: (k, 7 - k) for ids in pages.values() for k, i in enumerate(ids)}
    scans.edge_depths(pages, skel, place, 0)
    assert [place[k][0] for k in range(5)] == [0, 1, 1, 3, 4]


def test_paragraphs_keep_compounds_and_case():
    line = lambda no, page, words, **x: {"line_no": no, "page": page, "furniture": False, "words": words.split(), "whole": None, "border": None, "compound": None, "place": None, "fixed": None} | x
    lines = [line(1, 1, "An off-", whole="offline", border=3, compound=True), line(2, 1, "Header", furniture=True), line(3, 2, "line Mainte-", whole="rnaintenance", border=7, compound=False), line(4, 2, "nance ends."), line(6, 2, "New one.")]
    assert scans.paragraphs(lines) == "An off-line Maintenance ends.\n\nNew one."
    assert scans.corrected("«Rnaintenance»,", "Rnaintenance", "maintenance") == "«Maintenance»,"


def test_perceptron_learns_a_rule():
    rows = [([f"a{i % 7}", f"b{i % 5}", "bias"], int(i % 7 in (1, 2))) for i in range(500)]
    model = scans.Perceptron().fit(rows)
    assert sum((model.score(f) > 0) == bool(y) for f, y in rows) > 0.9 * len(rows)
    assert re.fullmatch(r"\d+", scans.edits("3l")[-1][0])
