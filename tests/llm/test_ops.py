"""Corpus operators against brute force and on awkward rows."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import chunking, fingerprints, langid, lines, mixing, pieces, quality, queries, rules, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
#: Nulls, empty and blank texts, ties, repeated rows, a long text, and names that helper columns might have.
ROWS = [
    (1, "a b c d e f g. " * 30, "en", "s1", 9), (1, "a b c d e f g. " * 30, "en", "s1", 9), (2, None, None, None, 9), (3, "", "en", "", None), (4, " \n\t ", None, "s1", 1),
    (5, "12 34 !!", "de", None, 1), (None, "no id here but some words", "en", "s2", 1), (6, "ünï ▁▁x  y\x00😀 <s>", "de", "s2", 1), (7, "x" * 70_000, "de", "s2", 1), (8, "one\n\none\none", "en", "s1", 1),
    (9, "long text of words " * 20_000, "en", "s1", 1), (10, "a b c d e f g. " * 30, "en", "s2", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    extra = {c: F.lit(1) for c in ("n", "fp", "key", "class", "size", "rate", "src", "host", "hashes", "first", "node", "_all", "_kept", "_w", "_base", "target", "salt", "_packed", "_lines", "_sets", "_site", "_h", "_id", "pick", "text_hash", "_pieces", "_p", "digest", "place")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra).withColumns({"a.b": F.lit(1), "c`d": F.lit(2)})


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def marks(d):
    return d.sparkSession.createDataFrame([(k, k % 2, k % 2) for k in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d: quality.classify(d, marks(d)), "toxicity": lambda d: toxicity.classify(d, marks(d)),
    "simhash": simhash.near_duplicates, "langid": langid.identify, "mix": mixing.mix, "pieces": lambda d: pieces.digests(pieces.encode(d)), "lines": lines.strip_lines,
    "neighbours": fingerprints.neighbours, "rules": lambda d: rules.judged(rules.rated(rules.measured(d.select("doc_id", "text", "lang", "source")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_come_back_once_each(spark, awkward, name):
    ids = lambda rows: sorted(r["doc_id"] or 0 for r in rows)
    assert ids(OPERATORS[name](awkward).collect()) == ids(awkward.collect())
    assert OPERATORS[name](awkward.limit(0)).collect() == []


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_awkward_rows_are_scored(spark, awkward, classify):
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for some in (marks, marks.limit(0)):
        rows = classify(awkward, some).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert classify(awkward.limit(0), marks).count() == 0


KEEPERS = {
    "rules": rules.keep_good, "simhash": simhash.keep_first, "mix": mixing.apply_mix, "lines": lines.strip_lines, "shingles": lambda d: __import__("quillspark.llm.shingles").llm.shingles.keep_distinct(d),
    "substrings": lambda d: substrings.cut_spans(d, substrings.repeated_spans(d)),
}


@pytest.mark.parametrize("name", KEEPERS)
def test_row_keeping_operators_keep_columns(awkward, name):
    f = KEEPERS[name]
    assert f(awkward).columns == awkward.columns
    assert {r["a.b"] for r in f(awkward).collect()} <= {1}
    assert f(awkward.limit(0)).count() == 0


def test_near_copies_of_one_doc_id(awkward, spark):
    assert simhash.keep_first(awkward).count() < awkward.count()
    rows = [(1, "first text " * 30), (1, "quite another one here " * 30), (1, "first text " * 30), (2, "first text " * 30), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (simhash.keep_first, KEEPERS["shingles"]):  # two texts under one id are two documents
        assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in f(docs).collect()) == [(0, "x"), (0, "x"), (1, "first"), (1, "quite")]
        assert f(docs.repartition(3)).count() == 4


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    import corpus_pipeline as p

    for docs in (awkward, awkward.limit(0)):
        for name, stage in p.STAGES:
            out = p.cut(stage(spark, docs, SF))
            if name != "tokens":
                assert out.columns == docs.columns
            if name == "line_dedup":
                assert out.count() == docs.count()
            assert docs.limit(1).count() or not out.count()


def plain_fingerprint(t, width=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark, real):
    rows = simhash.near_duplicates(real).collect()
    text = {r["doc_id"]: r["text"] for r in real.collect()}
    fp = {d: plain_fingerprint(t) for d, t in text.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in fp.items()}
    label = {d: d for d in fp}
    for _ in range(20):
        label = {d: min(label[e] for e in fp if (fp[d] ^ fp[e]).bit_count() <= 3) for d in fp}
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


@pytest.mark.parametrize("crowd", [1 << 16, 0])  # plain joins; the other half's segments meet as well
def test_simhash_links_by_brute_force(spark, monkeypatch, crowd):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    base += [base[0] ^ rng.getrandbits(32) for _ in range(4)]  # one half in common
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 3, 4, 5, 6, 7)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from quillspark.operators.graph import components

    monkeypatch.setattr(simhash, "CROWD", crowd)
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    label = {f: f for f in signed}
    for _ in signed:
        label = {f: min(label[g] for g in signed if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3) for f in signed}
    assert {f: got.get(f, f) for f in signed} == label


def broadcast_rows(spark, run):
    """The rows of the largest broadcast of what run() executes."""
    jvm = spark.sparkContext._jvm
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = [0]
    for e in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())[done:]:
        values = jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionMetrics(e.executionId()))
        for node in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.planGraph(e.executionId()).allNodes()):
            if node.name().startswith("BroadcastExchange"):
                found += [int(values[m.accumulatorId()].replace(",", "")) for m in jvm.scala.jdk.javaapi.CollectionConverters.asJava(node.metrics()) if m.name() == "number of output rows" and m.accumulatorId() in values]
    return max(found)


@pytest.mark.parametrize("crowd", [1 << 16, 0])
def test_probes_are_not_broadcast(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(500)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for b in base for x in (b, b ^ 0b111 << rng.randrange(60))})
    rows = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert broadcast_rows(spark, lambda: simhash.links(rows).collect()) <= 2 * len(fps)


def test_language_of_held_out_texts(spark, real):
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_without_letters_or_lessons(spark, awkward):
    got = {r["doc_id"]: r for r in langid.identify(awkward).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4, 5))
    assert {r["lang_pred"] for r in langid.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_models(texts):
    """{lang: f(context, char)}: interpolated Kneser-Ney by the textbook, with dictionaries and recursion."""
    models = {}
    for lang, own in texts.items():
        grams = [{}, {}, {}, {}, {}]
        for t in own:
            u = "".join(chr(c) for c in langid.codes(t))
            u = "   " + u
            for k in range(3, len(u)):
                g = u[k - 3 : k + 1]
                grams[4][g] = grams[4].get(g, 0) + 1
        for o in (3, 2, 1):
            for g in grams[o + 1]:
                grams[o][g[1:]] = grams[o].get(g[1:], 0) + 1
        d = {}
        for o in (1, 2, 3, 4):
            n1, n2 = (sum(c == k for c in grams[o].values()) for k in (1, 2))
            d[o] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

        def p(context, char, o=4, grams=grams, d=d):
            if o == 0:
                return 1 / 65536
            h = context[len(context) - o + 1 :]
            of = {g: c for g, c in grams[o].items() if g[:-1] == h}
            if not of:
                return p(context, char, o - 1, grams, d)
            total = sum(of.values())
            return max(of.get(h + char, 0) - d[o], 0) / total + d[o] * len(of) / total * p(context, char, o - 1, grams, d)

        models[lang] = p
    return models


@pytest.mark.parametrize("most", [langid.CELLS, 60, 0])  # all weights in the arrays; some of them; none
def test_kneser_ney_by_brute_force(spark, most):
    texts = {"de": ["der hund und die katze", "sind da, und der rest"], "en": ["the cat sat on the mat", "with that hat"]}
    counts = langid.count_grams(spark.createDataFrame([(k, False, t) for k, own in texts.items() for t in own], "lang string, test boolean, text string")).drop("test")
    model = langid.kneser_ney(counts).withColumn("place", F.when(F.col("lang") == "en", 1).otherwise(0)).drop("lang")
    asked = ["the hat", "und", "xyz the", "Der Rest? qq", "", None, "123"]
    rows = langid.scored(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), model, ["de", "en"], most).collect()
    plain = plain_models(texts)
    for r in rows:
        u = "   " + "".join(chr(c) for c in langid.codes(asked[r["k"]]))
        if len(u) == 3:
            assert r["best"] is None
            continue
        h = [-sum(math.log(plain[x](u[k - 3 : k], u[k])) for k in range(3, len(u))) / (len(u) - 3) for x in ("de", "en")]
        assert r["best"] == int(h[1] < h[0]) and math.isclose(r["entropy"], min(h), rel_tol=1e-5) and math.isclose(r["margin"], abs(h[0] - h[1]), rel_tol=1e-4, abs_tol=1e-5)
    assert math.isclose(sum(plain["en"]("the", chr(c)) for c in range(32, 65536) if chr(c).isalpha() or c == 32), 1, abs_tol=0.5)


def test_languages_have_no_limit(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        alphabet = rng.sample("abcdefghijklmnopqrstuvwxyz", 4)
        rows += [(10 * k + j, " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(12)), f"l{k}") for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, None, 5000).collect()
    assert len(got) == len(rows) and len({r["lang_pred"] for r in got}) > 130


def test_mix_meets_targets(spark, real):
    rows = mixing.mix(real).collect()
    sizes = {}
    for r in rows:
        sizes[r["src"]] = sizes.get(r["src"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s == "n", s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, capped = {}, set()
    while True:  # reshare until none is above
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        want = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if want[s] > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    taken = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and math.isclose(r["target"], want[r["src"]], rel_tol=1e-9) and r["source_size"] == sizes[r["src"]]
        taken[r["src"]] = taken.get(r["src"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 30 for s in names)
    for s in names:  # the tilt, by bisection
        own = [r for r in rows if r["src"] == s and r["size"]]
        mean = sizes[s] / sum(r["src"] == s for r in rows)
        lo, hi = -60.0, 60.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(r["size"] * min(2, math.exp(min(600, lam * r["size"] / mean))) for r in own) < want[s] else (lo, lam)
        if want[s] < 2 * sizes[s] * (1 - 1e-9):
            assert all(math.isclose(r["rate"], min(2, math.exp(min(600, lam * r["size"] / mean))), rel_tol=1e-4) for r in own)
        for size in {r["size"] for r in own}:
            part = [r["copies"] for r in own if r["size"] == size]
            assert max(part) - min(part) <= 1
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(real.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


@pytest.mark.parametrize("most", [pieces.TABLE_BYTES, 20_000, 0])  # the whole table at every worker; the frequent chunks; none
def test_pieces_are_the_librarys(spark, real, awkward, most):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for docs in (real, awkward.where("doc_id > 1")):
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        rows = pieces.encode(docs, most=most).collect()
        assert len(rows) == docs.count()
        for r in rows:
            ids = model.encode(text[r["doc_id"]])
            assert r["ids"] == ids and r["decoded"] == model.decode(ids)


def test_each_chunk_is_segmented_once(spark, real):
    calls = spark.sparkContext.accumulator(0)

    def segment(keys):
        calls.add(len(keys))
        return pieces.segmenter(None)(keys)

    docs = real.unionByName(real)
    want = {k for r in docs.collect() for k in pieces.chunks(r["text"])}
    assert sorted(r["chunk"] for r in pieces.segmented(pieces.distinct_chunks(docs), segment).collect()) == sorted(want)
    assert calls.value == len(want)


def test_neighbours_by_brute_force(spark, real):
    rows = {r["doc_id"]: r for r in fingerprints.neighbours(real).collect()}
    text = dict(sorted((r["doc_id"], r["text"]) for r in real.collect()))
    ids = list(text)
    for k, d in enumerate(ids):
        t, after = text[d], text[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.spelled(fingerprints.chunk_set(t)) and r["near_next"] == fingerprints.containment(fingerprints.chunk_set(t), fingerprints.chunk_set(after))
        assert r["near_edited"] == fingerprints.containment(fingerprints.chunk_set(t), fingerprints.chunk_set(edited))


def plain_cuts(raw, sizes):
    """Ends of chunks, byte by byte."""
    strict, loose = sizes.masks
    ends, at, h, hashes = [], 0, 0, []
    for b in raw:
        h = (h * 2 + int(chunking.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    whole = lambda e: e == len(raw) or raw[e] & 0xC0 != 0x80
    while len(raw) - at > sizes.least:
        for e in range(at + sizes.least, len(raw)):
            mask = strict if e < at + sizes.normal else loose
            if e == at + sizes.normal and whole(e) and not hashes[e - 1] & strict:
                break
            if e <= at + sizes.most and whole(e) and not hashes[e - 1] & mask:
                break
            if e >= at + sizes.most and whole(e):
                break
        else:
            break
        ends.append(e)
        at = e
    return [*ends, len(raw)] if at < len(raw) else ends


def test_cuts_by_brute_force(real):
    for r in real.limit(60).collect():
        raw = (r["text"] or "").encode()[:6000].decode(errors="ignore").encode()
        for sizes in (substrings.SIZES, fingerprints.SIZES):
            assert chunking.cuts(raw, sizes) == plain_cuts(raw, sizes)


def test_spans_by_brute_force(spark, real):
    """Chunks, first occurrences and runs with plain dictionaries."""
    text = {r["doc_id"]: r["text"] or "" for r in real.collect()}
    first, want = {}, []
    for d in sorted(text):
        raw, at, run = text[d].encode(), 0, []
        for e in [*plain_cuts(raw, substrings.SIZES), None]:
            piece = raw[at:e] if e else None
            if e and piece in first:
                run.append((at, piece))
            else:
                got = b"".join(x for _, x in run).decode()
                begun = sum(not chr(raw[k]).isspace() and (k == 0 or raw[k - 1 : k].isspace()) for k in range(run[0][0], run[0][0] + len(got.encode()))) if run else 0
                if run and (len(got) >= substrings.PASSAGE or begun >= substrings.PASSAGE_WORDS):
                    want.append((d, len(raw[: run[0][0]].decode()), len(got), first[run[0][1]]))
                run = []
                if e:
                    first[piece] = d
            at = e
    rows = substrings.repeated_spans(real).collect()
    assert sorted((r["doc_id"], r["span_start"], r["span_chars"], r["first_doc_id"]) for r in rows) == sorted(want)


def test_chunks_resist_shifts_and_blocks(monkeypatch):
    rng = random.Random(1)
    raw = "".join(rng.choice("abcdefgh äöü") for _ in range(20_000)).encode()
    sizes = chunking.Sizes(16, 32, 96)
    ends = chunking.cuts(raw, sizes)
    assert ends[-1] == len(raw) and b"".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)) == raw
    assert all(16 <= b - a <= 99 for a, b in zip([0, *ends], ends[:-1], strict=False))
    own, moved = (set(chunking.digests(x, chunking.cuts(x, sizes)).tolist()) for x in (raw, b"inserted " + raw))
    assert len(own & moved) > 0.98 * len(own)
    monkeypatch.setattr(chunking, "BLOCK", 1000)
    assert chunking.cuts(raw, sizes) == ends


def test_repeated_passages_are_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(55) for _ in range(40)]
    holders = [(k, f"{prose(rng.randint(20, 90))} {passages[k % 40]} {prose(rng.randint(20, 90))}") for k in range(80)]
    clean = [(100 + k, prose(150)) for k in range(40)]
    docs = spark.createDataFrame([*holders, *clean, (200, None), (201, "")], "doc_id long, text string")
    spans = substrings.repeated_spans(docs).collect()
    assert {r["doc_id"] for r in spans} == set(range(40, 80))
    text = dict(holders)
    for r in spans:
        found = text[r["doc_id"]][r["span_start"] : r["span_start"] + r["span_chars"]]
        assert found in passages[r["doc_id"] % 40] or passages[r["doc_id"] % 40] in found or found.strip() in text[r["first_doc_id"]]
        assert r["first_doc_id"] == r["doc_id"] - 40
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_spans(docs, substrings.repeated_spans(docs)).collect()}
    for r in spans:
        t = text[r["doc_id"]]
        assert cut[r["doc_id"]] == t[: r["span_start"]] + t[r["span_start"] + r["span_chars"] :]
    assert cut[200] is None and cut[0] == text[0]
    assert substrings.repeated_spans(docs.limit(0)).count() == 0


def test_repeats_of_one_doc_id(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared, a, b = words(60), words(80), words(80)
    docs = spark.createDataFrame([(1, shared), (2, f"{a} {shared}"), (2, f"{shared} {b}"), (2, f"{a} {shared}"), (None, f"{b} {shared}")], "doc_id long, text string")
    spans = substrings.repeated_spans(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in spans)[:1] == [0] and len({(r["doc_id"], r["text_hash"]) for r in spans}) == 3
    left = [(r["doc_id"], r["text"]) for r in substrings.cut_spans(docs, substrings.repeated_spans(docs)).collect()]
    assert len(left) == 5 and all(len(t) < len(shared) + 560 - 300 for d, t in left if d == 2)


def plain_score(model, text):
    x = quality.features(text)
    at = lambda e, v: sum(v >= k for k in e)
    z = model.base + sum(t[at(e, v)] for e, v, t in zip(model.edges, x, model.tables, strict=True))
    z += sum(t[at(model.coarse[i], x[i]), at(model.coarse[j], x[j])] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def held(f, docs, marks, column):
    rows = f(docs, marks).join(marks, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r[column] for r in rows)
    return hit / max(1, sum(r[column] for r in rows)), hit / max(1, sum(r["predicted"] for r in rows)), np.mean([r["predicted"] == r[column] for r in rows])


def test_toxicity_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    recall, precision, _ = held(toxicity.classify, docs, marks, "toxic")
    assert recall >= 0.9 and precision >= 0.95


def test_quality_on_held_out_rows(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    recall, precision, right = held(quality.classify, docs, marks, "quality")
    most = marks.where("quality = 1").count() / marks.count()
    assert right > most + 0.02 and recall > 0.95 and precision > 0.95
    model = quality.train(docs.join(marks, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "quality", F.udf(quality.features, "array<double>")("text").alias("x")), "quality")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, marks).collect()}
    for r in docs.limit(50).collect():
        assert math.isclose(got[r["doc_id"]], plain_score(model, r["text"]), rel_tol=1e-6)


def test_trees_by_brute_force():
    rng = np.random.default_rng(2)
    g, w = rng.normal(size=9), rng.uniform(0.1, 1, 9)
    term = lambda a, b: g[a:b].sum() ** 2 / (w[a:b].sum() + 1)
    first = max(range(1, 9), key=lambda c: term(0, c) + term(c, 9))
    two = quality._tree(g, w, 2)
    for a, b in ((0, first), (first, 9)):
        assert np.allclose(two[a:b], g[a:b].sum() / (w[a:b].sum() + 1))


def test_logit_by_brute_force():
    rng = np.random.default_rng(1)
    model = toxicity.Machine(-0.5, rng.normal(size=toxicity.SPACE).astype(np.float32), rng.normal(size=(toxicity.FACTORS, toxicity.SPACE)).astype(np.float32))
    texts = ["you are a fool", "", None, "Fools and fools, again fools! 12", "ärger über ärger"]
    for text, got in zip(texts, model.score(texts), strict=True):
        words = (text or "").encode().translate(toxicity._BYTES).split()
        value = {}
        for w in words:
            for t in [w, *(b"%s-" % w[:n] for n in toxicity.STEMS if len(w) > n)]:
                k = zlib.crc32(t) % toxicity.SPACE
                value[k] = value.get(k, 0) + 1
        x = {k: math.sqrt(n * toxicity.PER / max(toxicity.PER, len(words))) for k, n in value.items()}
        z = -0.5 + sum(float(model.weight[k]) * v for k, v in x.items())
        z += sum(float(model.factor[:, i] @ model.factor[:, j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert math.isclose(got, 1 / (1 + math.exp(-min(30, max(-30, z)))), rel_tol=1e-4)


@pytest.mark.parametrize("both", [True, False])  # toxic with both words; with both or neither
def test_factor_machine_learns_a_pair(spark, both):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    rows, toxic = [], []
    for k in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(vocabulary, k=rng.randint(10, 40)) + ["zinsult"] * a + ["ygroup"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        toxic.append((k, int((a and b) if both else a == b)))
    recall, precision, right = held(toxicity.classify, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(toxic, "doc_id long, toxic int"), "toxic")
    assert right > 0.95 and recall > 0.95


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline_stages(spark, real):
    import corpus_pipeline as p

    docs = real
    for name, stage in p.STAGES:
        before, docs = docs, p.cut(stage(spark, docs, SF))
        if name != "tokens":
            assert docs.columns == real.columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in queries.QUERIES["op10_quality_rules"](spark, SF).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        elif name == "source_mix":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == want
        elif name == "tokens":
            assert docs.count() == before.count() and sum(r["n_tokens"] for r in docs.collect()) > 0


def plain_shingles(t):
    w = (t or "").split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("pairs", [8, 0])  # compared in full; merged around members first
def test_pipeline_drops_near_copies(spark, monkeypatch, pairs):
    import corpus_pipeline as p
    from quillspark.llm import shingles

    monkeypatch.setattr(shingles, "PAIRS", pairs)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows = []
    for k in range(30):
        base = [word() for _ in range(rng.randint(150, 400))]
        rows.append((100 * k, " ".join(base)))
        for j in range(1, 8):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 25))):
                copy[at] = word()
            rows.append((100 * k + j, " ".join(copy)))
    rows += [(9001, None), (9002, " "), (9003, "a b"), (9004, "a b"), (9005, "a c")]
    sets = {d: plain_shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    alike = {d: [e for e in sets if (not sets[d] and not sets[e]) or len(sets[d] & sets[e]) * 5 >= len(sets[d] | sets[e]) * 4 > 0] for d in sets}
    for _ in range(10):
        label = {d: min(label[e] for e in alike[d]) for d in sets}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.keep_distinct(docs).collect()) == sorted(set(label.values()))
    if pairs:
        docs = dict(p.STAGES)["near_dedup"](spark, docs, SF)
        left = {r["doc_id"] for r in docs.collect()}
        assert left and not any(e in left for d in left for e in alike[d] if e != d)
    between = [len(sets[100 * k] & sets[100 * k + j]) / len(sets[100 * k] | sets[100 * k + j]) for k in range(30) for j in range(1, 8)]
    assert sum(0.8 <= x <= 0.95 for x in between) > 50


def test_prefixes_lose_no_pair(spark):
    """All pairs of random sets around a few centres, some of one class already, against brute force."""
    from quillspark.llm import shingles

    rng = random.Random(4)
    sets = {}
    for centre in range(4):
        base = rng.sample(range(1000 * centre, 1000 * centre + 400), rng.choice([9, 40, 90]))
        for _ in range(40):
            kept = rng.sample(base, rng.randint(int(len(base) * 0.7), len(base)))
            sets[len(sets)] = sorted({*kept, *rng.sample(range(5000), rng.randint(0, len(base) // 6))})
    classes = {k: k if k % 3 else k % 4 - 10 for k in sets}
    live = spark.createDataFrame([(k, len(v), classes[k]) for k, v in sets.items()], "fp long, n int, class long")
    table = spark.createDataFrame(list(sets.items()), "fp long, hashes array<long>")
    want = {(a, b) for a in sets for b in sets if a > b and classes[a] != classes[b] and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    met = shingles._by_prefix(live, table).selectExpr("greatest(fp, b) as a", "least(fp, b) as b", "class as class_a", "class_b").distinct()
    got = {(r["a"], r["b"]) for r in shingles._similar(met, table).collect()}
    assert got == want and len(want) > 300


def plain_components(ids, alike):
    label = {d: d for d in ids}
    for _ in range(20):
        label = {d: min([label[d], *(label[e] for e in ids if alike(d, e))]) for d in ids}
    return {d for d in ids if label[d] == d}


def test_run_by_brute_force(spark):
    """Rules and lines by SQL in DuckDB, both dedup stages and the tokens in plain Python; the mix's copies are mix()'s, which has its own test."""
    import corpus_pipeline as p
    import sentencepiece

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TABLE good AS SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({rules.SQL}) WHERE kept)")
    gone = set(con.execute(f"WITH {lines.GONE_SQL.format(docs='good')} SELECT source, k FROM gone").fetchall())
    bare = " \t\n\v\f\r"
    docs = {d: ("\n".join(x for x in t.split("\n") if (s, x.strip(bare)) not in gone), g, s) for d, t, g, s in con.execute("SELECT doc_id, text, lang, source FROM good").fetchall()}
    sets = {d: plain_shingles("".join(c.lower() if "A" <= c <= "Z" else c for c in r[0])) for d, r in docs.items()}
    fp = {d: plain_fingerprint(r[0], 5) for d, r in docs.items()}
    docs = {d: docs[d] for d in plain_components(docs, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)}
    docs = {d: docs[d] for d in plain_components(docs, lambda a, b: len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4)}
    rows = spark.createDataFrame([(d, *r, len(r[0])) for d, r in docs.items()], SCHEMA)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((r["doc_id"], docs[r["doc_id"]][1], docs[r["doc_id"]][2], model.encode(docs[r["doc_id"]][0])) for r in mixing.mix(rows).collect() for _ in range(r["copies"]))
    got = p.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["lang"], r["source"], r["ids"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
