"""The training-data operators: brute force, exact round trips, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import catalogue, mixing, neardup, packing, parties, scans, subjects, tokens, trie

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


# Near-duplicates.


def brute_pairs(texts: dict[int, str | None], run: int, threshold: float, least: int) -> set[tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        if len(w) >= least and len(w) >= run:
            sets[i] = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(25, 90))] for _ in range(25)]
    texts: dict[int, str | None] = {}
    for words in base:
        for edits in (0, 0, 2, 6, 14):
            w = list(words)
            for _ in range(edits):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [f"x{rng.randint(0, 99)}"]
            texts[len(texts) + 1] = " ".join(w)
    texts |= {1001: None, 1002: "", 1003: "corto", 1004: " ".join(base[0][:19]), 1005: "z " * 30_000, 1006: ("z " * 30_000).upper()}
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "page_id bigint, page_text string").selectExpr("*", "1 as id", "'a' as text", "2 as rep")
    got = {tuple(r) for r in neardup.near_duplicates(df, "page_id", "page_text", run=3, threshold=0.5, min_words=20).collect()}
    assert got == brute_pairs(texts, 3, 0.5, 20) and (1005, 1006) in got


def test_near_duplicates_default_is_five_words(spark):
    words = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(words), 2: " ".join(words[:98]), 3: " ".join(words[:50])}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "i bigint, t string"), "i", "t")
    assert {tuple(r) for r in got.collect()} == brute_pairs(texts, 5, 0.8, 1) == {(1, 2)}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "i bigint, t string"), "i", "t").count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2))
    both = np.concatenate([a, b])
    assert (neardup.registers(both, 256) == np.maximum(neardup.registers(a, 256), neardup.registers(b, 256))).all()
    half = np.concatenate([a[:300], b[:100]])
    same = (neardup.registers(a, 2048) == neardup.registers(half, 2048)).mean()
    assert abs(same - 300 / 500) < 0.06


@pytest.mark.parametrize("rows_in_band", [1, 3, 4, 5])
def test_bands_agree_where_all_their_registers_do(rows_in_band):
    k = np.random.default_rng(4).integers(0, 65_535, 40 * rows_in_band).astype(np.uint16)
    other = k.copy()
    other[7 * rows_in_band] ^= 1
    same = neardup.band_values(k, 40, rows_in_band) == neardup.band_values(other, 40, rows_in_band)
    assert not same[7] and same.sum() == 39 and len(set(neardup.band_values(np.zeros_like(k), 40, rows_in_band))) == 40


# Parties.


def test_trie_equals_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)]

    def distance(x, y):
        d = {(i, 0): i for i in range(len(x) + 1)} | {(0, j): j for j in range(len(y) + 1)}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    t = trie.Trie(words)
    for w in words[:40]:
        assert dict(t.neighbours(w, 2)) == {x: distance(w, x) for x in set(words) if distance(w, x) <= 2}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Olga Prolarna", "prolarna, olga", True), ("Prolrna, Olga", "Olga Prolarna", True), ("Victoria Federico Meroriz", "MERORIZ, VICTORIA", True),
        ("Zuhhallolva J.", "José Zuhhallolva", True), ("Vero Fopiqalde", "Verónica Fopiqalde", True), ("Julio Cecilia Taprucha", "Julio Patricia Taprucha", False),
        ("Susana Rudimbre", "Francisco Rudimbre", False), ("Agrop. Laservo SA", "Distribuidora Laservo del Valle y Cía.", False),
        ("Repuestos Lechudrovela y Cía.", "Rep. Leshudrovela & Cía", True), ("Corr. Vuqolva Soc. de Resp. Ltda.", "Corralón Vuqolva Norte SRL", True),
        ("Imprenta Digucha SA", "IMPRENTA DIGUCHA S. A.", True), ("Textil Qusesanzo Sur SA", "Textil Qusesanzo Sur SRL", False),
    ],
)
def test_names(a, b, same):
    assert (parties.decide(a, b, None, None) > 0) == same


def test_numbers_confirm_and_refute():
    assert parties.decide("Olga Prolarna", "Olga María Prolarna", "70000001", "70000002") > 0  # one digit mistyped
    assert parties.decide("Olga Prolarna", "Olga María Prolarna", "70000001", "81234567") < 0


def test_link_parties(spark, rows):
    names = [
        ("c", "Olga Prolarna", "70081982"), ("c", "prolarna, olga", None), ("c", "Prolrna Olga", None), ("c", "Susana Prolarna", None), ("c", "OLGA PROLARNA", None),
        ("d", "Olga Prolarna", None), ("c", "Julio Taprucha", None), ("c", "Julio Cecilia Taprucha", None), ("c", "Julio Patricia Taprucha", None), ("c", "García", None), ("c", "x" * 5000, None), ("c", "...", None),
    ]
    df = spark.createDataFrame(names, "case_id string, name string, number string")
    olga = sorted(["Olga Prolarna", "prolarna, olga", "Prolrna Olga", "OLGA PROLARNA"])
    # "Julio Taprucha" fits two different persons and stays alone.
    assert rows(parties.link_parties(df)) == [("c", a, b) for a, b in itertools.combinations(olga, 2)]
    small = parties.trie_join(df.selectExpr("case_id", "lower(name) as word").where("length(word) < 40").distinct(), shard_words=2)
    whole = parties.trie_join(df.selectExpr("case_id", "lower(name) as word").where("length(word) < 40").distinct())
    assert rows(small) == rows(whole)


def test_names_of_cases(spark, rows):
    lines = spark.createDataFrame([("c", "A", "29-70081982-3")] * 2 + [("c", "A", "29-70081989-3"), ("c", None, None), (None, "B", None), ("c", "  ", None)], "case_id string, supplier_name string, supplier_tax_id string")
    fields = spark.createDataFrame([("c", "nombre", "A"), ("c", "monto", "9")], "case_id string, field_name string, literal string")
    aliases = spark.createDataFrame([("c", "Z", "DNI:70000001")], "case_id string, name_literal string, strong_key string")
    assert rows(parties.names_of_cases(lines, fields, aliases)) == [("c", "A", "70081982"), ("c", "Z", "70000001")]
    assert parties.link_parties(spark.createDataFrame([], "case_id string, name string, number string")).count() == 0


# Catalogue.

ITEMS = [(1, "Caño PVC cloacal 40 mm"), (2, "Caño PVC cloacal 110 mm"), (3, "Disco sólido 240 GB"), (4, "Yerba mate con palo"), (5, "Yerba mate sin palo"), (6, "Cal hidratada aérea"), (7, "Cal hidratada aérea"), (8, None)]


@pytest.mark.parametrize(
    ("text", "item"),
    [
        ("cafio pvc cloacla 40mm", 1), ("Tubo PVC cloacal - 110 mm marca: Zeta", 2), ("CAÑO PVC CLOACAL 63 MM", 0), ("ssd 240gb", 3), ("yerba mate co npalo", 4), ("Yerba mate sin palo (contenido 2 kg)", 5),
        ("Cal hidr. aérea, presentación 30 kilo", 6), ("aérea Cal hidratada bolsa de 25 kg", 6), ("Silla", 0), ("", 0), (None, 0), ("-", 0), ("x" * 10_000, 0), ("yerba mate", 0),
    ],
)
def test_catalogue(text, item):
    assert catalogue.Catalogue([(i, n, 0) for i, n in ITEMS if n]).match(text) == item


def test_assigned_more_often_wins_ties():
    assert catalogue.Catalogue([(6, "Cal hidratada aérea", 1), (7, "Cal hidratada aérea", 5)]).match("cal hidratada aerea") == 7


def test_match_catalogue(spark, rows):
    lines = spark.createDataFrame([(1, "ssd 240gb", None), (1, "ssd 240gb", None), (2, None, None), (3, "Cal", 6), (None, "ssd 240 gb", None)], "line_id bigint, description string, item_id bigint").selectExpr("*", "'a' as n", "1 as item_name")
    items = spark.createDataFrame(ITEMS, "item_id bigint, item_name string")
    assert rows(catalogue.match_catalogue(lines, items)) == [(1, 3), (2, 0)]
    assert rows(catalogue.match_catalogue(lines, items.where("false"))) == [(1, 0), (2, 0)]
    assert catalogue.match_catalogue(lines.where("false"), items).count() == 0
    with pytest.raises(ValueError):
        catalogue.match_catalogue(lines, items, max_entries=2)


@needs_tables
def test_catalogue_agrees_with_people(spark):
    p = spark.read.parquet(f"{FOLDER}/price_lines.parquet").where("item_id is not null and description is not null").select("description", "item_id").collect()
    entries = [(r.item_id, r.item_name, 0) for r in spark.read.parquet(f"{FOLDER}/catalog_items.parquet").collect()]
    c = catalogue.Catalogue(entries)
    assert sum(c.match(r.description) == r.item_id for r in p) >= 0.98 * len(p)


# Scans.


@pytest.mark.parametrize("text", ["2/6", "fs. 1", "1", "Foja 7", "Folio 279 vta.", "Hoja N° 145", "Pág. 94 de 97", "- 3 -", "fs. l2"])
def test_page_numbers(text):
    assert scans.is_page_number(text)


@pytest.mark.parametrize("text", ["CLÁUSULA PRIMERA", "457.", "de 2016", "A4", "a fojas 457", "", "2016."])
def test_no_page_numbers(text):
    assert not scans.is_page_number(text)


def test_confusions():
    assert scans.confusion_steps("dcja", "deja") == 1 and scans.confusion_steps("adrriite", "admite") is not None
    assert scans.confusion_steps("casa", "mesa") is None and scans.confusion_steps("p0r", "por") == 1


def scanned(spark):
    """Three pages of one file with a running line, page numbers, breaks and misread words."""
    head, body = "Expte. 8536/2023 Cuerpo I", "la oficina central remite el informe completo de la obra con carácter urgente"
    words, readings, pages = [], [], []

    def put(reading: int, y: float, text: str, x: float = 60.0) -> None:
        for w in text.split(" "):
            n = len(words) + 1
            words.append((n, reading, n, w, x, y))
            x += 6.0 * len(w)

    for p in range(1, 7):
        readings.append((p, p, "ocr_a"))
        pages.append((p, "f", p, None))
        put(p, 50.0, head.replace("8", "B", 1) if p == 2 else head, 60.0 if p % 2 else 380.0)
        put(p, 64.0, f"fs. {p}")
        for k in range(4):
            put(p, 80.0 + 14 * k, body)
    put(1, 140.0, "la oficina remite el 1nforme completo y la docu-")
    put(1, 154.0, "mentación de la obra técnico-")
    put(1, 168.0, "administrativa con cará¬")
    put(1, 182.0, "cter urgente dcl central 20l6 A4")
    pages.append((9, "g", 1, " ".join(["y la documentación del caso"] * 9 + ["obra técnico-administrativa en curso"] * 9 + [body])))
    readings.append((50, 9, "nativo"))
    frames = (
        spark.createDataFrame([*words, words[0], (9000, 50, 1, None, 1.0, 1.0), (9001, 1, 9001, "suelta", None, None)], "word_id bigint, reading_id bigint, ord int, text string, x0 double, y0 double"),
        spark.createDataFrame(readings, "reading_id bigint, page_id bigint, route string"), spark.createDataFrame(pages, "page_id bigint, file_sha string, page_no int, page_text string"),
    )
    return frames, {w[0]: w[3] for w in words}


def test_scan_repairs(spark):
    (words, readings, pages), text = scanned(spark)
    got = scans.scan_repairs(words.withColumn("kind", F.lit("x")).withColumn("line", F.lit(1)), readings, pages).collect()
    assert len({r.word_id for r in got}) == len(got)
    by = defaultdict(Counter)
    for r in got:
        by[r.kind][text[r.word_id]] += 1
    assert sum(by["header"].values()) == 24 and by["header"]["B536/2023"] == 1
    assert sum(by["pageno"].values()) == 12
    assert set(by["hyphen"]) == {"docu-", "cará¬"}
    assert set(by["misread"]) == {"1nforme", "dcl", "20l6"}
    assert {r.correction for r in got if text[r.word_id] == "1nforme"} == {"informe"}


def test_scan_repairs_of_nothing(spark):
    (words, readings, pages), _ = scanned(spark)
    assert scans.scan_repairs(words.where("false"), readings, pages).count() == 0
    assert scans.scan_repairs(words, readings.where("false"), pages).count() == 0


def test_scan_repairs_keep_the_joined_form_and_digits(spark):
    (words, readings, pages), text = scanned(spark)
    got = {text[r.word_id]: r.correction for r in scans.scan_repairs(words, readings, pages).collect()}
    assert got["docu-"] == "documentación" and got["cará¬"] == "carácter" and got["20l6"] == "2016"


def test_scan_paragraphs(spark):
    """Headers and numbers go, broken and misread words are whole, also over the page end."""
    (words, readings, pages), _ = scanned(spark)
    more, n = [], 10_000
    for page, y, line in (
        (1, 216.0, "El 1nforme 20l6 remite la"), (1, 230.0, "obra. INF0RME Central y la docu-"),
        (2, 40.0, "mentación de la oficina."), (2, 54.0, "Obra"), (2, 68.0, "técnico-"), (2, 82.0, "administrativa en curso con la ofi-"), (2, 96.0, "cina centra1"),
    ):
        x = 60.0
        for w in line.split(" "):
            n += 1
            more.append((n, page + 100, n, w, x, y))
            x += 6.0 * len(w)
    words = words.unionByName(spark.createDataFrame(more, words.schema)).withColumn("x1", F.col("x0") + 5 * F.length("text"))
    readings = readings.unionByName(spark.createDataFrame([(101, 101, "ocr_a"), (102, 102, "ocr_a")], readings.schema))
    pages = pages.unionByName(spark.createDataFrame([(101, "h", 1, None), (102, "h", 2, None)], pages.schema))
    got = defaultdict(list)
    for r in scans.scan_paragraphs(words, readings, pages).orderBy("reading_id", "paragraph").collect():
        got[r.reading_id].append(r.text)
        assert r.paragraph == len(got[r.reading_id])
    first = " ".join(got[1])
    assert "Expte." not in first and "fs." not in first and first.endswith("con carácter urgente del central 2016 A4 suelta")
    assert "la documentación de la obra técnico-administrativa con" in first
    assert " ".join(got[101]) == "El informe 2016 remite la obra. INFORME Central y la documentación"
    assert " ".join(got[102]) == "de la oficina. Obra técnico-administrativa en curso con la oficina central"
    assert got[102][0] == "de la oficina."


def test_paragraphs_start_at_gaps_and_after_short_lines(spark):
    at = [(0, 80.0, 500.0), (1, 94.0, 490.0), (2, 120.0, 498.0), (3, 134.0, 100.0), (4, 148.0, 495.0), (5, 162.0, 300.0)]
    flow = spark.createDataFrame(
        [(10 * k + j, "f", 1, k, j, y, x, e) for k, y, end in at for j, (x, e) in enumerate([(60.0, 90.0), (95.0, end)], 1)],
        "word_id bigint, file_sha string, reading_id bigint, line int, place int, y0 double, x0 double, x1 double",
    )
    none = spark.createDataFrame([], "next_id bigint")
    got = scans.paragraph_starts(flow, none).orderBy("line").collect()
    assert [r.paragraph for r in got] == [0, 0, 1, 1, 2, 2]
    inside = spark.createDataFrame([(21,)], "next_id bigint")
    assert scans.paragraph_starts(flow, inside).where("line = 2").first().paragraph == 0


# Packs.


def check_packs(rows_, sizes, capacity):
    fill, parts = Counter(), defaultdict(list)
    spans = defaultdict(list)
    for r in rows_:
        fill[r.pack_no] += r.n_tokens
        parts[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        spans[r.pack_no].append((r.pack_offset, r.pack_offset + r.n_tokens))
    assert max(fill.values()) <= capacity
    for spans_of in spans.values():
        at = 0
        for a, b in sorted(spans_of):
            assert a == at
            at = b
    for doc, n in sizes.items():
        got = sorted(parts[doc])
        assert sum(p[2] for p in got) == n and [p[1] for p in got] == list(itertools.accumulate([0] + [p[2] for p in got[:-1]]))
        assert len(got) == (1 if n <= capacity else -(-n // capacity))
    return sum(fill.values()) / (len(fill) * capacity)


def test_packs_round_trip(spark):
    rng = random.Random(8)
    sizes = {i: min(5000, int(rng.expovariate(1 / 180)) + 1) for i in range(1, 3001)}
    df = spark.createDataFrame([*sizes.items(), (5001, 0)], "doc_id bigint, n_tokens bigint")
    kinds = spark.createDataFrame([(1, 512), (2, 2048), (3, 0)], "pack_id int, capacity_tokens int")
    for shards in (10**9, 200_000):
        out = packing.pack_documents(df, kinds, shard_tokens=shards)
        for kind, capacity in ((1, 512), (2, 2048)):
            used = check_packs(out.where(F.col("pack_id") == kind).collect(), sizes, capacity)
            assert used > 0.93
        again = packing.pack_documents(df.repartition(7), kinds, shard_tokens=shards)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    report = {r.pack_id: r for r in packing.pack_report(out).collect()}
    assert report[1].documents == 3000 and report[1].tokens == sum(sizes.values())
    assert packing.pack_documents(df.where("false"), kinds).count() == 0


def test_best_fit_takes_the_least_space_and_closes_the_fullest():
    p = packing.OpenPacks(10, 2)
    assert [p.add(6), p.add(7)] == [(0, 0), (1, 0)]
    assert p.add(3) == (1, 7)  # three are free there, four in the other
    assert p.add(8) == (2, 0) and p.add(9) == (3, 0)  # the fullest, 2, was closed
    assert p.add(2) == (0, 6)


# Mix.


def test_pfair_stays_within_a_block():
    shares = {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    order = mixing.pfair_order(shares, 500)
    assert [s for s, _, _ in order] == list(range(500))
    seen = Counter()
    for slot, source, k in order:
        assert k == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - w * (slot + 1)) < 1 for s, w in shares.items())


def test_mix_reaches_shares_without_overuse(spark):
    rng = random.Random(9)
    docs = [(i, s, rng.randint(20, 200)) for s, n, base in (("big", 4000, 0), ("mid", 600, 10_000), ("small", 90, 20_000)) for i in range(base, base + n)]
    df = spark.createDataFrame([*docs, docs[0], (99_999, "other", 50), (99_998, None, 50), (99_997, "big", 0)], "doc_id bigint, source string, n_tokens bigint").dropDuplicates(["doc_id"])
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.25, 2), ("small", 0.15, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix_sources(df, targets)
    rows_ = out.collect()
    uses = Counter(r.doc_id for r in rows_)
    most = {"big": 1, "mid": 2, "small": 4}
    assert all(uses[r.doc_id] <= most[r.source] and r.repeat_no <= most[r.source] for r in rows_)
    assert len({(r.doc_id, r.repeat_no) for r in rows_}) == len(rows_)
    got = Counter()
    for r in rows_:
        got[r.source] += r.n_tokens
    total = sum(got.values())
    assert all(abs(got[s] / total - w) < 0.004 for s, w in (("big", 0.6), ("mid", 0.25), ("small", 0.15)))
    # One source is used up to its bound, so the mix couldn't be larger.
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    assert max(got[s] / (have[s] * most[s]) for s in most) > 0.99
    assert worst_gap(rows_, {"big": 0.6, "mid": 0.25, "small": 0.15})[0] < block_of(200, {"big": 0.6, "mid": 0.25, "small": 0.15})
    assert mixing.mix_sources(df.where("false"), targets).count() == 0
    report = {r.source: r for r in mixing.mix_report(out, targets).collect()}
    assert report["none"].tokens == 0 and report["small"].repeats == 4


def worst_gap(rows_, shares) -> tuple[float, int]:
    """Largest distance of a source from its share after any document of the mix, and the longest document."""
    part, whole, worst = Counter(), 0, 0.0
    for r in sorted(rows_, key=lambda r: (r.slot, r.place)):
        part[r.source] += r.n_tokens
        whole += r.n_tokens
        worst = max(worst, *(abs(part[s] - w * whole) for s, w in shares.items()))
    return worst, max(r.n_tokens for r in rows_)


def block_of(longest: int, shares: dict[str, float]) -> int:
    return 2 * mixing.step_length(longest, mixing.whole_weights(shares))


def test_mix_prefixes(spark):
    docs = [(i, "ab"[i % 2], 100) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 1)], "source string, target_share double, max_repeats int")
    for step in (None, 3000):
        rows_ = mixing.mix_sources(df, targets, step=step, bucket_docs=500).collect()
        gap, _ = worst_gap(rows_, {"a": 2 / 3, "b": 1 / 3})
        assert gap < (2 * step if step else block_of(100, {"a": 0.5, "b": 0.25}))


def test_mix_of_unequal_documents_and_a_tiny_share(spark):
    rng = random.Random(4)
    docs = [(i, f"s{i % 7}", int(rng.paretovariate(0.9)) % 5000 + 1) for i in range(6000)] + [(10_000 + i, "tiny", 40) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    shares = {f"s{i}": w for i, w in enumerate((0.3, 0.2, 0.2, 0.1, 0.1, 0.05, 0.0497))} | {"tiny": 0.0003}
    targets = spark.createDataFrame([(s, w, 50) for s, w in shares.items()], "source string, target_share double, max_repeats int")
    rows_ = mixing.mix_sources(df, targets).collect()
    gap, longest = worst_gap(rows_, shares)
    assert gap < block_of(longest, shares) and any(r.source == "tiny" for r in rows_)


@needs_tables
@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabulary files")
def test_mix_of_the_documents_stays_within_a_block(spark):
    from folioscope.llm.queries import p7_mix

    targets = {r.source: r.target_share for r in spark.read.parquet(f"{FOLDER}/mix_targets.parquet").collect()}
    rows_ = p7_mix(spark, FOLDER).collect()
    shares = {s: w for s, w in targets.items() if any(r.source == s for r in rows_)}
    gap, longest = worst_gap(rows_, {s: w / sum(shares.values()) for s, w in shares.items()})
    assert gap < block_of(longest, shares)


def test_weights_keep_small_sources():
    assert mixing.whole_weights({"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 5, "b": 3, "c": 2}
    assert min(mixing.whole_weights({"a": 1.0, "b": 1e-9}).values()) == 1


def test_tokens(spark):
    if not Path(tokens.TOKENIZERS).exists():
        pytest.skip("no vocabulary files")
    path = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
    assert tokens.count_tokens(None, path) == 0 and tokens.count_tokens("", path) == 0
    text = "La mora habilitará una multa diaria. "
    enc = tokens.encoder(path)
    assert enc.decode(enc.encode_ordinary(text)) == text
    # Whole texts, and the way around long white space, give what the encoder gives.
    assert tokens.count_tokens(text * 9000, path) == len(enc.encode_ordinary(text * 9000))
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice([" ", "  ", "\n", "\u00a0", "a", "ñu", "3", "."]) for _ in range(rng.randint(0, 40)))
        assert tokens.count_tokens(t, path, blanks=2) == len(enc.encode_ordinary(t)), repr(t)
    assert tokens.count_tokens("a" + " " * 1_000_000 + "b", path) > 2 and tokens.count_tokens("ab" * 200_000, path) == len(enc.encode_ordinary("ab" * 200_000))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "b"), (None, "x", "c")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.source, r.n_tokens > 0) for r in tokens.with_tokens(df, "source").collect()) == [(1, "a", True), (2, "b", False)]


# Subjects.

WORDS = {1: "hospital vacuna médico enfermera dosis", 2: "camino puente asfalto bache ruta", 3: "servidor red programa disco clave"}
FILL = "la oficina remite el informe a la dirección de compras para su registro".split()


def corpus(seed: int, n: int):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        topics = rng.sample(sorted(WORDS), rng.randint(0, 2))
        parts = [" ".join(rng.choice(FILL) for _ in range(20)) + " " + rng.choice(rng.choice(list(WORDS.values())).split())]
        parts += [" ".join(rng.choice(WORDS[t].split() if rng.random() < 0.6 else FILL) for _ in range(20)) for t in topics]
        rng.shuffle(parts)
        docs.append((seed * 100_000 + i, "\n\n".join(parts)))
        truth[docs[-1][0]] = set(topics)
    return docs, truth


def test_subjects_held_out(spark):
    train, truth = corpus(1, 400)
    test, want = corpus(2, 300)
    docs = spark.createDataFrame([*train, *test, (7, None), (8, ""), (9, " \n\n "), (10, "ruta " * 50_000), train[0]], "doc_id bigint, text string").selectExpr("*", "1 as truth", "2 as shard")
    labels = spark.createDataFrame([(d, t) for d, ts in truth.items() for t in ts] + [(424242, 1)], "doc_id bigint, subject_id int")
    listed = spark.createDataFrame([(1,), (2,), (3,)], "subject_id int")
    s = subjects.Settings(buckets=1 << 13)
    found = defaultdict(set)
    out = subjects.classify_subjects(docs, labels, listed, s).collect()
    assert len(out) == len(set(out))
    for r in out:
        found[r.doc_id].add(r.subject_id)
    hits = sum(len(found[d] & t) for d, t in want.items())
    assert hits / sum(len(t) for t in want.values()) > 0.9 and hits / sum(len(found[d]) for d in want) > 0.9
    assert found[10] == {2} and not (found[7] | found[8] | found[9])
    assert subjects.classify_subjects(docs, labels.where("false"), listed, s).count() == 0
    assert subjects.classify_subjects(docs.where("false"), labels, listed, s).count() == 0


def examples(texts, truths, s):
    return subjects.Examples.read(texts, truths, {1: 0, 2: 1}, s)


def test_gradients_are_those_of_the_loss():
    s = subjects.Settings(buckets=97, dim=3)
    texts, truths = ["ruta camino puente\n\nhospital dosis", "red disco", "", "ruta ruta ruta"], [[1], [2], [1], []]
    m = subjects.Model.fresh(s, 2)
    m.bias[:] = -0.5
    e = examples(texts, truths, s)

    def loss() -> float:
        n = np.bincount(e.of_flat)[:, None]
        p = m.outputs(subjects.summed(m.embed, e.flat, e.of_flat, len(e.document)).astype(np.float64) / n)
        total = 0.0
        for d in set(e.document):
            none = np.prod(1 - p[e.document == d], axis=0)
            total -= float(np.sum(np.where(e.truth[d] > 0, np.log(1 - none), np.log(none))))
        return total

    rows_, embed, weight, bias = e.gradient(m)
    for held, got in ((m.weight, weight), (m.bias, bias)):
        for at in np.ndindex(held.shape):
            kept = held[at]
            held[at] = kept + 0.01
            up = loss()
            held[at] = kept - 0.01
            assert abs((up - loss()) / 0.02 - got[at]) < 1e-2
            held[at] = kept
    for i in (0, len(rows_) // 2, len(rows_) - 1):
        kept = m.embed[rows_[i], 1]
        m.embed[rows_[i], 1] = kept + 0.01
        up = loss()
        m.embed[rows_[i], 1] = kept - 0.01
        assert abs((up - loss()) / 0.02 - embed[i, 1]) < 1e-2
        m.embed[rows_[i], 1] = kept


def test_gradients_of_parts_sum_to_that_of_the_whole():
    s = subjects.Settings(buckets=211, dim=4)
    train, truth = corpus(5, 40)
    texts, truths = [t for _, t in train], [sorted(truth[d] & {1, 2}) for d, _ in train]
    m = subjects.Model.fresh(s, 2)
    whole, parts = examples(texts, truths, s).gradient(m), [examples(texts[i : i + 10], truths[i : i + 10], s).gradient(m) for i in range(0, 40, 10)]
    dense = np.zeros((211, 4))
    for rows_, embed, *_ in parts:
        dense[rows_] += embed
    assert np.allclose(dense[whole[0]], whole[1], atol=1e-4) and all(np.allclose(sum(p[k] for p in parts), whole[k], atol=1e-3) for k in (2, 3))


def test_scores_are_averages_whatever_the_slices(monkeypatch):
    s = subjects.Settings(buckets=211, dim=4)
    texts = [t for _, t in corpus(6, 20)[0]] + ["", "ruta " * 300]
    m = subjects.Model.fresh(s, 3)
    document, p = subjects.Scorer(m, s).scores(texts)
    e = subjects.Examples.read(texts, [[] for _ in texts], {}, s)
    mean = np.stack([m.embed[e.flat[e.of_flat == k]].mean(axis=0) for k in range(len(e.document))])
    assert (document == e.document).all() and np.allclose(p, m.outputs(mean), atol=1e-4)
    monkeypatch.setattr(subjects, "_SLICE", 7)
    assert np.allclose(subjects.Scorer(m, s).scores(texts)[1], p, atol=1e-4)
    scorer = subjects.Scorer(m, s)
    scorer.known.trim = lambda: subjects.Words.trim(scorer.known, 0)
    assert all(np.allclose(scorer.scores(texts)[1], p, atol=1e-4) for _ in range(2))


@needs_tables
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p6_packs", "p7_shares", "p8_found"])
def test_queries_return_distinct_rows(spark, name):
    from folioscope.llm.queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows_ = df.collect()
    assert len(rows_) == len(set(rows_))


@needs_tables
@pytest.mark.parametrize("name", ["p1_found", "p6_invariants", "p7_invariants"])
def test_queries_equal_their_sql(spark, name):
    import oracle
    from folioscope.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    assert oracle.rows_of_spark(QUERIES[name](spark, folder)) == oracle.rows_of_sql(oracle.connect(folder), ORACLES[name])


@needs_tables
def test_misses_are_reported(spark):
    from folioscope.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    lines = {r.line_id: r.description for r in spark.read.parquet(f"{folder}/price_lines.parquet").select("line_id", "description").collect()}
    want = Counter(lines[r.line_id] for r in QUERIES["p5_found"](spark, folder).where("item_id = 0").collect() if lines[r.line_id] is not None)
    assert {r.description: r.lines for r in QUERIES["p5_misses"](spark, folder).collect()} == want and want
