import hashlib
import tracemalloc
import zipfile
from decimal import Decimal
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import core, identity, numbers, text
from quillspark.operators import entities, matching, meta, ordered, package, retrieval
from quillspark.operators.graph import components
from quillspark.sources import records, sinks
from quillspark.streaming import events


@pytest.mark.parametrize(("a", "b", "mismatch"), [("0", "0", False), ("100", "101", False), ("100", "103", True), ("0", "0.000001", False), ("0", "1", True), ("0.0000001", "0.0000002", False)])
def test_tolerance(spark, a, b, mismatch):
    row = spark.range(1).select(core.tolerance(F.lit(a).cast("decimal(28,8)"), F.lit(b).cast("decimal(28,8)"), F.lit("0"), F.lit("0")).alias("t")).first()
    assert row["t"]["mismatch"] is mismatch


def test_half_even_and_money(spark):
    rows = spark.createDataFrame([(5, 2), (7, 2), (8, 3), (0, 4)], "t long, n long").select(core.half_even_mean(F.col("t"), F.col("n")).alias("m")).collect()
    assert [r["m"] for r in rows] == [2, 4, 3, 0]
    assert spark.range(1).select(core.money(F.lit("2.675")).alias("m")).first()["m"] == Decimal("2.68")


def test_content_id_keeps_null_places(spark):
    row = spark.range(1).select(core.content_id("x", F.lit("a"), F.lit(None), F.lit("b")).alias("i"), core.content_id("x", F.lit("a"), F.lit("b")).alias("j")).first()
    assert row["i"] != row["j"] and row["i"].startswith("x__") and len(row["i"]) == 15


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("mass 12,5 kg", [("12.5", "kg", None)]), ("in 2021 we", [("2021", None, "bare_year_like")]), ("on 12.05.2021", [("12052021", None, "date")]),
        ("code 007 x", [("7", None, "zero_padded_code")]), ("1 234,50 t", [("1234.50", "t", None)]), ("-3 %", [("-3", "%", None)]), ("ID 55 kg", [("55", "kg", "reference_identifier")]),
        ("", []), ("no digits", []),
    ],
)
def test_scan(line, expected):
    got = [(v, u, w) for _, _, _, v, _, u, w, _ in numbers.scan(line)]
    if expected and expected[0][2] == "date":
        assert [w for _, _, w in got] == ["date"]
    else:
        assert [(Decimal(v), u, w) for v, u, w in got] == [(Decimal(v), u, w) for v, u, w in expected]


def test_ambiguous_numeral():
    assert numbers.read_numeral("1.234")[2] == ["ambiguous_decimal_grouping"]
    assert numbers.read_numeral("0.234")[2] == []


def test_labels(spark):
    df = spark.createDataFrame([("  Straße—ABC_ё ", "1.2. Title!"), (None, None)], "a string, b string")
    rows = df.select(text.normalize_label("a").alias("a"), text.normalize_title("b").alias("b"), text.similarity("a", "a").alias("s")).collect()
    assert rows[0]["a"] == "strasse abc_е" and rows[0]["b"] == "title" and rows[0]["s"] == 1.0 and rows[1]["a"] is None


def test_raised_digits_and_numbering(spark):
    df = spark.createDataFrame([("10⁵ м³, 47⁰ 5 %", "2.1 (Ёлка) — план_1"), ("", "3)")], "a string, b string")
    rows = df.select(text.normalize_label("a").alias("a"), text.normalize_title("b").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [("10 5 м3 47 5 %", "елка план_1"), ("", "")]
    words = spark.createDataFrame([("Ёмкость для воды — 25 м3, Әуе и the tank",), (None,)], "t string")
    assert [r[0] for r in words.select(text.tokens(F.col("t"))).collect()] == [["емкость", "воды", "25", "м3", "әуе", "tank"], []]


def test_levels_and_projects_without_documents(spark):
    scores = spark.createDataFrame([(24,), (25,), (50,), (75,)], "s long")
    assert [r[0] for r in scores.select(core.level(F.col("s"))).collect()] == ["low", "moderate", "elevated", "high"]
    findings = spark.createDataFrame([("q", None, "high")], "project_id string, document_id long, severity string")
    documents = spark.createDataFrame([("p", 1)], "project_id string, document_id long")
    from quillspark.operators import scoring

    assert {r["project_id"]: (r["n_documents"], r["score"]) for r in scoring.score_projects(documents, findings).collect()} == {"p": (1, 0), "q": (0, 25)}


def test_cosine_links_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 6))
    m[7] = 0
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)] + [(None, [1.0] * 6), (99, None)], "k long, v array<double>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    s = unit @ unit.T
    want = {(i, j) for i in range(0, 60, 10) for j in range(60) if i != j and s[i, j] >= 0.3}
    got = entities.cosine_links(rows.where("k % 10 = 0"), rows, "k", "v", 0.3, block=2)
    assert {(r["query_id"], r["k"]) for r in got.collect()} == want
    assert entities.cosine_links(rows.limit(0), rows, "k", "v", 0.3).count() == 0

def test_cosine_links_hold_little():
    rng = np.random.default_rng(3)
    vectors, wanted = list(rng.normal(size=(8_000, 16)).astype(np.float32)), entities._unit(list(rng.normal(size=(4096, 16))))
    tracemalloc.start()
    n = sum(len(ids) for ids, _, _ in entities._met(np.arange(8_000) + 10_000, vectors, np.arange(4096), wanted, 0.9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == (entities._unit(vectors) @ wanted.T >= 0.9).sum() and peak < 40 << 20  # all cosines are 262 MB


@pytest.mark.parametrize("few", [1 << 20, 0])  # one task; rounds, hubs apart
def test_components(spark, monkeypatch, few):
    from quillspark.operators import graph

    monkeypatch.setattr(graph, "FEW", few)
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (10, 1), (2, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4}
    chain = spark.range(1, 60).selectExpr("id as a", "id - 1 as b")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settle_drops_what_was_cut_on_the_way(spark):
    from quillspark.functions import lineage

    held = []

    def build():
        held.append(lineage.cut(spark.range(5)))
        held.append(lineage.settle(spark, lambda: lineage.cut(held[0]).where("id > 1")))
        return held[1].where("id > 2")

    done = lineage.settle(spark, build)
    assert sorted(r["id"] for r in done.collect()) == [3, 4] and not lineage._OPEN
    exists = lambda df: Path(urlparse(df.inputFiles()[0]).path).exists()
    assert exists(done) and not any(map(exists, held))


def test_cut_leaves_no_shuffle_files(spark):
    import time

    from quillspark.functions import lineage

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    before, set_before = held(), spark.conf.get(lineage._CLEANUP, None)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    again = lineage.cut(sums.join(sums.selectExpr("k", "n as m").hint("merge"), "k"))
    end = time.time() + 10
    while held() - before and time.time() < end:  # Spark removes them in another thread
        time.sleep(0.1)
    assert not held() - before and again.where("n = m").count() == 7 and sums.count() == 7
    assert spark.conf.get(lineage._CLEANUP, None) == set_before


def test_roots_by_brute_force():
    from quillspark.operators.graph import roots

    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400):
        a, b = rng.integers(-n, n, (2, n))
        label = {int(x): int(x) for x in (*a, *b)}
        for _ in label:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[x] = label[y] = min(label[x], label[y])
        nodes, least = roots(a, b)
        assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == label


def test_near_clusters_by_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(5)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(63), rng.choice([0, 1, 3, 5, 9]))) for b in base for _ in range(12)]
    got = {r["node"]: r["cluster"] for r in entities.near_clusters(spark.createDataFrame(list(enumerate(hashes)), "node long, h long")).collect()}
    label = list(range(len(hashes)))
    for _ in hashes:
        label = [min(label[j] for j in range(len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= 4) for i in range(len(hashes))]
    assert got == dict(enumerate(label))


def test_guarded_pairs_suppress_large_groups(spark):
    rows = spark.createDataFrame([("a", k) for k in range(3)] + [("b", k) for k in range(20)], "g string, k long")
    pairs, large = matching.guarded_pairs(rows, ["g"], "k", [])
    assert pairs.count() == 3 and [(r["g"], r["n"]) for r in large.collect()] == [("b", 20)]


def test_backstop(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "zzz")], "query_id long, text string")
    c = spark.createDataFrame([(7, "alpha gamma"), (8, "delta")], "requirement_id long, text string")
    got = retrieval.retrieve(q, c)
    ensured = spark.createDataFrame([(1, 7), (1, 8)], "query_id long, requirement_id long")
    rows = {(r["query_id"], r["requirement_id"]): r["rank"] for r in retrieval.with_backstop(got, ensured).collect()}
    assert rows == {(1, 7): 1, (1, 8): None}


def test_runs(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("aabba")], "g int, k int, v string")
    assert [r["run"] for r in ordered.runs(rows, "g", "k", F.col("v") == F.col("_before.v")).orderBy("k").collect()] == [1, 1, 2, 2, 3]


def test_manifest(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"project_id": "p", "documents": [{"document_id": "d1", "file_format": "PDF", "role": "model_input", "use_as_model_feature": true, "label_timing": "pre_review"}, {"document_id": "d2", "file_format": "rar", "role": "model_input"}, {"document_id": "d3", "file_format": "pdf", "role": "label_source"}]}\n')
    selected, skipped = records.select_documents(records.load_manifest(spark, str(good)))
    assert [r["document_id"] for r in selected.collect()] == ["d1"]
    assert {r["document_id"]: r["reason"] for r in skipped.collect()} == {"d2": "auxiliary_archive_never_ingested", "d3": "excluded_by_leakage_boundary"}
    asked, _ = records.select_documents(records.load_manifest(spark, str(good)), include_label_sources=True)
    assert sorted(r["document_id"] for r in asked.collect()) == ["d1", "d3"]
    zipped = spark.createDataFrame([("7Z", "model_input"), ("pdf", "auxiliary_archive"), ("docx", None), ("xls", "model_input")], "f string, r string")
    assert [r[0] for r in zipped.select(records.route(F.col("f"), F.col("r"))).collect()] == ["skip_archive", "skip_archive", "docx", "skip_unsupported"]
    good.write_text("\n" + good.read_text() + "  \n")
    assert records.load_manifest(spark, str(good)).count() == 3
    assert records.select_documents(records.load_manifest(spark, str(good)), document_id="d9")[0].count() == 0
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no project records"):
        records.load_manifest(spark, str(tmp_path / "empty.jsonl"))
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"project_id": "p"}\n')
    with pytest.raises(Exception, match="not a valid record"):
        records.load_manifest(spark, str(bad)).collect()


def test_inventory_and_template(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", "y")
    assert [r["media_type"] for r in records.inventory(spark, str(tmp_path)).collect()] == ["application/zip"]
    current = spark.createDataFrame([("f1",), ("f2",)], "finding_id string")
    edited = spark.createDataFrame([("f1", "ok"), ("f9", "no")], "finding_id string, expert_decision string")
    merged, stale = sinks.merge_template(current, edited)
    assert {r["finding_id"]: r["expert_decision"] for r in merged.collect()} == {"f1": "ok", "f2": None}
    assert [r["finding_id"] for r in stale.collect()] == ["f9"]
    listed = spark.createDataFrame([("p", "d", "a.zip"), ("p", "e", "gone.pdf")], "project_id string, document_id string, local_path string")
    assert {r["document_id"]: r["media_type"] for r in records.listed_inventory(spark, listed, str(tmp_path)).collect()} == {"d": "application/zip", "e": None}
    key = spark.range(1).select(sinks.cache_key(F.lit("s"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("")), F.lit("auto"), F.lit("1")).alias("k")).first()["k"]
    assert key == hashlib.sha256(b"s|a=unknown|b=2|ocr=auto|schema=1").hexdigest()
    done = spark.createDataFrame([("k1", "success", list(sinks.CORE_FILES)), ("k2", "failed", list(sinks.CORE_FILES)), ("k3", "partial", ["document.json"])], "cache_key string, extraction_status string, files array<string>")
    assert {r[0] for r in sinks.unfinished(spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",)], "cache_key string"), done).collect()} == {"k2", "k3", "k4"}
    sinks.write_jsonl(current, str(tmp_path / "out"), "finding_id")
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"))
    got = events.run_once(events.windowed_counts(stream), "w", "complete", str(tmp_path / "c1"))
    assert got.agg(F.sum("n")).first()[0] == 300


def test_combined_review(spark):
    rows = [("p", "P1", "x", 40.0, None), ("p", "P2", "y", 16.0, 0.5), ("p", "P2", "z", 4.0, 0.5), ("p", "P3", "v", 0.0, None), ("q", "P9", "w", 3.0, None)]
    made = spark.createDataFrame(rows, "project_id string, part string, feature string, contribution double, ratio double").withColumn("contribution", F.col("contribution").cast("decimal(12,2)"))
    got = {(r["project_id"], r["part"]): (float(r["factor"]), float(r["cap"]), float(r["subtotal"])) for r in meta.part_scores(made, F.col("ratio")).collect()}
    assert got == {("p", "P1"): (1, 35, 35), ("p", "P2"): (0.675, 11.5, 11.5), ("p", "P3"): (1, 25, 0)}
    assert {r["project_id"]: float(r["score"]) for r in meta.total_scores(meta.part_scores(made, F.col("ratio"))).collect()} == {"p": 46.5}
    assert [r["feature"] for r in meta.top_factors(made, 2).where("project_id = 'p'").orderBy("rank").collect()] == ["x", "y"]
    seen = spark.createDataFrame([("p", "P1", 1.0), ("p", "P3", 0.5)], "project_id string, part string, coverage double")
    assert float(meta.coverage(seen).first()["coverage"]) == 0.375
    assert meta.part_scores(made.limit(0)).count() == 0


def test_tables_and_numerals(spark):
    from quillspark.operators import tables

    rows = [(1, 1, 2.0, "row"), (1, 2, 3.0, "row"), (1, 3, 6.0, "total"), (1, 4, 9.0, "row"), (1, 5, None, "divider"), (1, 6, 1.0, "row"), (1, 7, None, "row"), (1, 8, 1.0, "total"), (2, 1, 4.0, "row"), (2, 2, 4.0, "row"), (2, 3, 4.0, "total"), (None, 1, 1.0, None)]
    cells = spark.createDataFrame(rows, "t long, r long, v double, kind string")
    kind = F.col("kind")
    got = tables.totals_above(cells, "t", "r", F.col("v"), kind == "total", kind == "divider", kind == "subset").collect()
    assert [(r["t"], r["total_row"], float(r["abs_diff"]), r["mismatch"]) for r in got] == [(1, 3, 1.0, True)]
    texts = spark.createDataFrame([("1,5 and 2,25 and 3.5",), ("1,234",), ("0,123 1.234.567",), ("",), (None,)], "text string")
    assert [tuple(r) for r in texts.select(*tables.numeral_styles(F.col("text"))).collect()] == [("comma", False, False), (None, False, False), ("comma", False, True), (None, False, False), (None, False, False)]
    raw = spark.createDataFrame([("1,234", "comma"), ("1,234", "dot"), ("1.234", None)], "raw string, style string")
    assert [None if r[0] is None else float(r[0]) for r in raw.select(tables.settle_numeral(F.col("raw"), F.col("style"))).collect()] == [1.234, 1234.0, None]
    pairs = [("hearings", "hearing", True), ("zone", "zona", True), ("control", "contract", False), ("cat", "cats", False), ("", "", True), ("same", "same", True)]
    words = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in words.select(tables.token_matches(F.col("a"), F.col("b"))).collect()] == [x for *_, x in pairs]
    concepts = spark.createDataFrame([("public hearing", "the publics hearings were held"), ("", "x"), ("water", None)], "c string, t string")
    assert [r[0] for r in concepts.select(tables.concept_in(F.col("c"), F.col("t"))).collect()] == [True, False, False]
    grids = spark.createDataFrame([(1, 2, [["a", None]]), (2, 2, [["a"]]), (1, 1, [[" "]]), (None, 1, None)], "r int, c int, cells array<array<string>>")
    assert [r[0] for r in grids.select(tables.table_errors(F.col("r"), F.col("c"), F.col("cells"))).collect()] == [[], ["row_count", "row_width"], ["blank"], ["malformed"]]


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("ТОО «Синтез  Урал»", ("ТОО Синтез Урал", "синтез урал", "ТОО")), ("«СИНТЕЗ\u00a0УРАЛ»", ("СИНТЕЗ УРАЛ", "синтез урал", None)), ("ИП КХ Алга", ("ИП КХ Алга", "алга", "ИП КХ")),
        ("Товарищество с ограниченной ответственностью \"А\"", ("Товарищество с ограниченной ответственностью А", "а", "ТОО")), ("АО", ("АО", "ао", "АО")), ("Аоки", ("Аоки", "аоки", None)),
        ("", ("", "", None)), (None, (None, None, None)),
    ],
)
def test_organisation(spark, name, expected):
    assert tuple(spark.createDataFrame([(name,)], "n string").select(identity.organisation(F.col("n")).alias("o")).first()["o"]) == expected


def test_identifiers_periods_and_labels(spark):
    rows = spark.createDataFrame([("БИН 010140-000143", "2024", " 2026 ", "итого по цеху"), ("123", "2026", "2024", "в том числе"), ("", "x", "2024", ""), (None, None, None, None), ("1" * 13, "1999", "2001", "сверх того")], "raw string, a string, b string, label string")
    got = rows.select(identity.identifier(F.col("raw")), identity.period(F.col("a"), F.col("b")), identity.begins_with_any(F.col("label"), identity.TOTALS), identity.begins_with_any(F.col("label"), identity.SUBSETS)).collect()
    assert [tuple(r) for r in got] == [("010140000143", "2024-2026", True, False), (None, None, False, True), (None, None, False, False), (None, None, False, False), (None, None, False, False)]


def test_safe_names(spark):
    n = F.col("n")
    rows = spark.createDataFrame([("a/b.png",), ("a/../b",), ("/a",), ("..",), ("a\\b",), (".a",), ("a..b",), ("",), (None,)], "n string")
    got = [tuple(r) for r in rows.select(identity.safe_path(n), identity.safe_posix_path(n), identity.safe_component(n), identity.safe_identifier(n)).collect()]
    yes, no = True, False
    assert got == [(yes, yes, no, no), (no, no, no, no), (no, no, no, no), (no, no, no, no), (yes, no, no, no), (yes, yes, yes, no), (yes, yes, no, no), (yes, no, no, no), (no, no, no, no)]


def test_confidence(spark):
    cases = [("conflicting_operator", None), ("conflicting_operator", ["ocr_source", "ocr_source", "other"]), ("unresolved_entity_identity", ["ocr_source", "address_partial", "single_document"]), ("unknown", [])]
    rows = spark.createDataFrame(cases, "k string, f array<string>")
    assert [str(r[0]) for r in rows.select(core.confidence(F.col("k"), F.col("f"))).collect()] == ["0.85", "0.70", "0.05", "0.50"]
    assert str(rows.limit(1).select(core.confidence(F.col("k"), F.col("f"), extra=F.lit("0.3"))).first()[0]) == "0.95"


def test_period_findings(spark):
    claims = [("p", 1, "c1", "2024-2026", True), ("p", 2, "c2", "2025-2026", True), ("p", 2, "c0", "2025-2026", True), ("p", 3, "c3", "2020-2021", False), ("p", 4, "c4", "2020-2021", None), ("q", 1, "c5", "2024-2026", True), ("q", 1, "c6", "2025-2026", True), ("r", 1, "c7", None, True), ("s", 1, "c8", "2024-2026", False)]
    schema = "project_id string, document_id long, claim_id string, period string, core boolean"
    rows = entities.period_findings(spark.createDataFrame(claims, schema)).collect()
    assert [tuple(r) for r in rows] == [("p", "2024-2026, 2025-2026", "c1|c0", 1)]
    assert entities.period_findings(spark.createDataFrame([], schema)).count() == 0


def test_identity_findings(spark):
    operators = [("conflicting_identifier", 1, 1, 1), ("conflicting_identifier", 2, 1, 1), ("unresolved_names", 2, 1, 5), ("unresolved_names", 2, 2, 5), ("absent", 0, 0, 1), ("absent", 0, 0, 2), ("confirmed_by_name", 1, 2, 2), (None, None, None, None)]
    rows = entities.identity_findings(spark.createDataFrame(operators, "status string, n_names long, n_named long, n_documents long")).collect()
    assert [(r["finding_type"], r["severity"]) for r in rows] == [("conflicting_operator", "medium"), ("conflicting_operator", "low"), ("unresolved_entity_identity", "info"), ("insufficient_cross_document_context", "info")]


def test_retrieval_shuffles_queries_once(spark):
    queries = spark.createDataFrame([(k, f"alpha beta word{k}") for k in range(50)] + [(1, "gamma")], "query_id long, text string")
    corpus = spark.createDataFrame([(1, "alpha gamma"), (2, "beta delta"), (3, "other")], "requirement_id long, text string")
    found = retrieval.retrieve(queries, corpus)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and {r["requirement_id"] for r in found.where("query_id = 1").collect()} == {1, 2}


def test_sections_are_matched_in_place(spark, monkeypatch):
    headings = spark.createDataFrame([("1", "Alpha beta gamma"), ("2", "xx alpha beta gamma delta"), ("2", "xx alpha beta gamma delta"), ("3", "beta beta"), ("4", None), ("5", "alpha beta gamma one two"), ("6", "preform plan b")], "heading_id string, title string")
    rules = spark.createDataFrame([(1, "alpha  beta gamma"), (2, "beta"), (3, "form plan"), (4, None), (5, "delta gamma other")], "rule_id long, alias string")
    found = package.match_sections(headings, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    expected = [("1", 1, 1), ("1", 2, 3), ("2", 1, 2), ("2", 1, 2), ("2", 2, 3), ("2", 2, 3), ("3", 2, 3), ("5", 1, 2), ("5", 2, 3), ("6", 3, 2)]
    assert rows(found) == expected
    monkeypatch.setattr(package, "INDEX_ROWS", 0)
    assert rows(package.match_sections(headings, rules)) == expected
