"""Core operators on small literal tables."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import decisions, fuzzy, graph, identity, intervals, ordered, pages, pipeline, relational, search, statistics, views
from folioscope.sources import files

D = dt.date.fromisoformat


def test_firm_view_keeps_pieces_without_firm_fields(spark, rows):
    schema = "field_id bigint, case_id string, piece_id bigint, file_sha string, field_name string, literal string, null_reason string, page_no int, confidence double, state string"
    f = spark.createDataFrame(
        [
            (1, "c", 1, "s", "nombre", "Ana", None, 1, 0.9, "automatico_alta"), (1, "c", 1, "s", "nombre", "Ana", None, 1, 0.9, "automatico_alta"),
            (2, "c", 1, "s", "monto", "$ 10,00", None, 1, 0.5, "pendiente_baja"), (3, "c", 2, "s", "nombre", None, "ilegible", None, None, "no_revisado"), (4, "c", 2, "s", "monto", "$ 5", None, 1, 0.9, None),
        ],
        schema,
    )
    assert rows(views.wide_facts(f), "piece_id", "nombre", "monto", "human_fields") == [(1, "Ana", None, 0), (2, None, None, 0)]
    assert rows(views.wide_facts(f, gated=False), "piece_id", "monto", "monto_state") == [(1, "$ 10,00", "pendiente_baja"), (2, "$ 5", None)]
    assert rows(views.contracts(f), "piece_id", "person")[0] == (1, "doc:#s#1")


def test_interval_join_finds_each_pair_once(spark, rows):
    data = [(1, "p", D("2019-12-01"), D("2021-02-01")), (2, "p", D("2020-12-31"), D("2022-01-01")), (3, "p", D("2022-01-01"), D("2022-01-05")), (4, "q", D("2020-01-01"), D("2020-01-01")),
            (5, "p", None, D("2020-01-01")), (6, "p", D("2021-01-01"), D("2020-01-01")), (7, None, D("2020-01-01"), D("2020-02-01"))]
    df = spark.createDataFrame(data, "id bigint, person string, s date, e date")
    got = intervals.interval_self_join(df, ["person"], "id", "s", "e")
    assert rows(got, "id_a", "id_b", "days") == [(1, 2, 33), (2, 3, 1)]


def test_follow_ups(spark, rows):
    df = spark.createDataFrame([(1, "p", D("2020-01-01"), D("2020-01-31")), (2, "p", D("2020-02-01"), D("2020-02-10")), (3, "p", D("2020-04-01"), D("2020-04-10"))], "id bigint, person string, s date, e date")
    assert rows(intervals.follow_ups(df, ["person"], "id", "s", "e"), "id_a", "id_b", "gap_days") == [(1, 2, 1)]


def test_latest_before(spark, rows):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, None, 5), (4, "k", None), (5, "k", 9)], "id int, k string, t int")
    right = spark.createDataFrame([("k", 3, "a"), ("k", 5, "b"), ("k", 5, "c"), ("k", None, "z"), ("j", 1, "y")], "k string, since int, v string")
    assert rows(intervals.latest_before(left, right, ["k"], "t", "since", ["v"]), "id", "v") == [(1, "c"), (2, None), (3, None), (4, None), (5, "c")]


def test_only_match_and_absent_pairs(spark, rows):
    right = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), (None, 3)], "k string, v int")
    left = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert rows(relational.join_only_match(left, right, ["k"], "v")) == [("a", 1), ("b", None), ("c", None), (None, None)]
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, s string")
    assert rows(relational.absent_pairs(left.where("k is not null"), ["x", "y"], have, "k", "s")) == [("a", "y"), ("b", "x"), ("c", "x"), ("c", "y")]


def test_paging_needs_a_sane_limit(spark, rows):
    df = spark.range(10)
    assert rows(relational.page_of(df, [F.desc("id")], 2, 3)) == [(5,), (6,), (7,)]
    with pytest.raises(ValueError):
        relational.page_of(df, [F.col("id")], 0, 501)


def test_statistics_golden(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("one", 7), ("none", None)], "k string, v int")
    got = {r.k: r for r in statistics.exact_statistics(df, ["k"], "v").collect()}
    assert (got["g"].mean, got["g"].median, got["g"].sd, got["g"].iqr) == (2.5, 2.5, 1.29, 1.5)
    assert got["one"].sd is None and got["one"].iqr == 0 and "none" not in got


def test_quantiles_match_interpolation(spark):
    import random
    import statistics as st

    random.seed(4)
    data = [(k, round(random.uniform(1, 99), 2)) for k in range(20) for _ in range(random.randint(2, 30))]
    got = {r.k: r.median for r in statistics.exact_statistics(spark.createDataFrame(data, "k int, v double"), ["k"], "v").collect()}
    by = defaultdict(list)
    for k, v in data:
        by[k].append(v)
    assert all(abs(got[k] - st.median(v)) <= 0.005001 for k, v in by.items())


def test_complete_total(spark, rows):
    df = spark.createDataFrame([(1, 5, "A"), (1, 6, "A"), (2, 5, "A"), (2, None, "A"), (3, 1, "A"), (3, 1, "B")], "d int, v int, c string")
    assert rows(df.groupBy("d").agg(statistics.complete_total(F.col("v"), F.col("c")).alias("t"))) == [(1, 11), (2, None), (3, None)]


def test_confusion(spark, rows):
    p = spark.createDataFrame([(1, "f", "a", False), (2, "f", "x", True), (3, "f", "x", False), (4, "f", None, False), (5, "f", None, False)], "i int, f string, v string, d boolean")
    t = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", "b"), (4, "f", "b"), (5, "f", None), (6, "f", "q")], "i int, f string, v string")
    assert rows(statistics.confusion(p, t, ["i", "f"], "v", F.col("d")), "outcome", "n") == sorted(
        [("hit", 1), ("flagged_error", 1), ("silent_error", 1), ("omission", 1), ("correct_null", 1), ("not_found", 1)]
    )


def test_sequence_breaks_and_runs(spark, rows):
    df = spark.createDataFrame([("f", 1, 1), ("f", 2, 2), ("f", 3, 5), ("f", 4, 5), ("f", 5, 3), ("f", 6, None)], "k string, o int, n int")
    assert rows(ordered.sequence_breaks(df, ["k"], "o", "n"), "o", "kind") == [(3, "jump"), (4, "repeated"), (5, "goes_back")]
    r = spark.createDataFrame([("f", 1, "a"), ("f", 2, "a"), ("f", 3, None), ("f", 4, None), ("f", 5, "a")], "k string, o int, v string")
    assert rows(ordered.runs(r, ["k"], "o", "v"), "v", "first", "last") == [("a", 1, 2), ("a", 5, 5), (None, 3, 4)]


def test_segments_cross_blank_pages_only_before_a_continuation(spark, rows):
    data = [("f", 1, "nota", False, False), ("f", 2, None, True, False), ("f", 3, None, False, True), ("f", 4, None, True, False), ("f", 5, "pase", False, False), ("f", 6, "pase", False, False)]
    df = spark.createDataFrame(data, "f string, p int, c string, b boolean, k boolean")
    got = ordered.page_segments(df, "f", "p", "c", F.col("b"), F.col("k"), ["pase"])
    assert rows(got, "type", "page_from", "page_to") == [("nota", 1, 3), ("pase", 5, 5), ("pase", 6, 6)]


def test_chain_heads_survive_cycles(spark, rows):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "n bigint, up bigint")
    assert rows(ordered.follow_chain(links, "n", "up")) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "n bigint, up bigint")
    assert ordered.follow_chain(cycle, "n", "up").count() == 2
    three = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 6), (6, 5)], "n bigint, up bigint")
    assert {n: h if n > 4 else h in (1, 2, 3) for n, h in rows(ordered.follow_chain(three, "n", "up"))} == {1: True, 2: True, 3: True, 5: 5, 6: 5, 7: 5}


def test_components_against_union_find(spark):
    import random

    random.seed(2)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(30)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {n: find(n) for n in root}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_constrained_groups_never_mix_labels(spark, rows):
    e = spark.createDataFrame([("c", 1, 2, 1, "x", None), ("c", 2, 3, 2, None, "y"), ("c", 3, 4, 3, "y", None), ("d", 1, 2, 1, None, None)], "c string, a bigint, b bigint, o int, la string, lb string")
    got = graph.constrained_groups(e, "c", "a", "b", "o", "la", "lb")
    assert rows(got) == [("c", 1, 1), ("c", 2, 1), ("c", 3, 3), ("c", 4, 3), ("d", 1, 1), ("d", 2, 1)]


def test_search(spark, rows):
    df = spark.createDataFrame([(1, "La Resolución aprueba la multa"), (2, "multas y más multas diarias"), (3, None), (4, "")], "p bigint, t string")
    assert rows(df.where(search.matches(F.col("t"), 'resol "aprueba la"')), "p") == [(1,)]
    index = search.inverted_index(df, "p", "t")
    got = rows(search.rank_bm25(index, "multa"), "page", "score")
    assert [g[0] for g in sorted(got, key=lambda g: -g[1])] == [2, 1]
    assert search.compile_query('a "dos  Tres" Niño') == (["dos tres"], ["a", "nino"])
    variants = {r.w: r.v for r in spark.createDataFrame([("Moto",), ("o" * 20,), ("il",), (None,), ("llama",)], "w string").select("w", search.variants_of(F.col("w")).alias("v")).collect()}
    assert variants["Moto"][0] == "m0t0" and len(variants["llama"]) <= 6 and "1iama" not in variants["llama"] and "11ama" in variants["llama"] and variants["il"] == []


def test_fuzzy():
    assert fuzzy.token_dice(["a"], ["a"]) == 1.0 and fuzzy.token_dice([], []) == 0.0
    assert fuzzy.token_dice(["cemento", "50"], ["cementos", "50"]) == 1.0
    assert fuzzy.token_dice(["x1"], ["x2"]) == 0.0
    assert fuzzy.name_likeness("PEREZ, JUAN", "Juan Pérez") == 1.0
    assert fuzzy.name_likeness("J. Perez", "Juan Perez") == 0.93
    assert fuzzy.holds_phrase("esto es una fact ura de venta", "factura") and not fuzzy.holds_phrase("nada", "factura")
    assert not fuzzy.holds_phrase("orden de cornpra", "orden de compra")
    assert fuzzy.holds_phrase("la orden dc compra", "orden de compra")


def test_identity(spark, rows):
    schema = "case_id string, piece_id bigint, file_sha string, nombre string, strong_key string"
    c = spark.createDataFrame([("c", 1, "s", "Juan Pérez", "DNI:1"), ("c", 2, "s", "Perez Juan", None), ("c", 3, "s", "Juan Pérez", "DNI:1"), ("c", 4, "s", "Juan Perez", "DNI:2"), ("d", 5, "s", None, None)], schema)
    persons = identity.resolve_persons(c)
    assert rows(persons, "stable_id", "contracts") == [("clave:DNI:1", 2), ("clave:DNI:2", 1), ("doc:s#2", 1), ("doc:s#5", 1)]
    pairs = identity.merge_proposals(persons)
    assert rows(pairs, "id_a", "id_b") == [("clave:DNI:1", "doc:s#2"), ("clave:DNI:2", "doc:s#2")]
    decided = spark.createDataFrame([("c", "clave:DNI:2", "doc:s#2")], "case_id string, id_a string, id_b string")
    left = identity.merge_proposals(persons, decided)
    assert rows(identity.apply_merges(persons, left), "stable_id", "merged_id") == [("clave:DNI:1", "clave:DNI:1"), ("clave:DNI:2", "clave:DNI:2"), ("doc:s#2", "clave:DNI:1"), ("doc:s#5", "doc:s#5")]


def test_overlay_and_upsert(spark, rows):
    facts = spark.createDataFrame([(1, "a", "pendiente_baja"), (2, "b", "automatico_alta"), (3, "c", "conflicto")], "f int, literal string, state string")
    log = spark.createDataFrame([(1, 1, "verify", None), (1, 2, "correct", "A"), (2, 3, "absent", None), (2, 4, "revert", None)], "f int, decision_id int, action string, value string")
    assert rows(decisions.overlay(facts, log, ["f"])) == [(1, "A", "corregido"), (2, "b", "automatico_alta"), (3, "c", "conflicto")]
    old = spark.createDataFrame([("k1", 1, "seen"), ("k2", 2, "ok")], "key string, v int, review string")
    new = spark.createDataFrame([("k1", 9), ("k3", 3)], "key string, v int")
    assert rows(decisions.upsert(old, new, "key")) == [("k1", 9, "seen", False), ("k2", 2, "ok", True), ("k3", 3, "new", False)]


def test_reanchor(spark, rows):
    d = spark.createDataFrame([(1, "s", 1, "m", 0.0), (2, "s", 1, "n", 5.0), (3, "s", 2, "m", 0.0), (4, "s", 1, "n", 5.0)], "decision_id int, file_sha string, page_no int, field_name string, xd double")
    f = spark.createDataFrame([(10, "s", 1, "m", 0.0), (11, "s", 1, "m", 50.0), (12, "s", 1, "n", 5.0)], "field_id int, file_sha string, page_no int, field_name string, xf double")
    near = F.when(F.abs(F.col("xd") - F.col("xf")) < 1, 1.0).otherwise(0.0)
    assert rows(decisions.reanchor(d, f, near)) == [(1, 10, "applied"), (2, 12, "collides"), (3, None, "not_found"), (4, 12, "collides")]


def test_stable_keys_tell_null_from_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a")], "x string, y string")
    a, b = [r[0] for r in df.select(decisions.stable_key(F.col("x"), F.col("y"))).collect()]
    assert a != b and len(a) == 64


def test_pipeline_states(spark, rows):
    reg = pipeline.Registry([pipeline.Stage("read", "page"), pipeline.Stage("class", "page", ("read",)), pipeline.Stage("ident", "case", ("class",))])
    units = spark.createDataFrame([("read", 1), ("read", 2), ("class", 1), ("class", 2), ("ident", 7)], "stage string, unit bigint")
    sig = {n: s.signature for n, s in reg.stages.items()}
    seals = spark.createDataFrame(
        [("read", 1, sig["read"], "done", 1), ("read", 2, "0:old", "done", 1), ("class", 1, sig["class"], "done", 1), ("class", 2, sig["class"], "done", 1), ("ident", 7, sig["ident"], "done", 1)],
        "stage string, unit bigint, signature string, state string, sealed_at int",
    )
    states = pipeline.unit_states(units, seals, reg)
    assert rows(states) == [("class", 1, "current"), ("class", 2, "stale"), ("ident", 7, "stale"), ("read", 1, "current"), ("read", 2, "stale")]
    assert reg.downstream({"class"}) == ["class", "ident"]
    seen = []

    def fail(_units):
        raise RuntimeError

    sealed = pipeline.run_stale(states, reg, {"read": lambda u: seen.append(rows(u)), "class": fail, "ident": fail}, "now")
    assert seen == [[(2,)]] and [s[::2] for s in sealed] == [("read", "done"), ("class", "failed")]
    with pytest.raises(ValueError):
        pipeline.Registry([pipeline.Stage("b", "page", ("a",))])


def test_lines_and_tables(spark, rows):
    words = []
    for r in range(4):
        for c, text in enumerate(("item", "cant", "precio")):
            words.append((len(words) + 1, 1, len(words), f"{text}{r}", 50.0 + 120 * c, 100.0 + 14 * r, 80.0 + 120 * c, 110.0 + 14 * r, 0.9))
    words.append((99, 1, 99, "párrafo", 50.0, 200.0, 90.0, 210.0, None))
    words += [words[0], (100, 2, 0, None, 0.0, 0.0, 1.0, 1.0, None), (101, 2, 1, "sola", None, None, None, None, None)]
    df = spark.createDataFrame(words, "word_id bigint, reading_id bigint, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    lines = pages.reading_lines(df)
    assert rows(lines, "line_no", "text")[0] == (1, "item0 cant0 precio0") and lines.count() == 5
    numbered = df.where("reading_id = 1").distinct().selectExpr("reading_id", "cast((y0 - 100) / 14 as int) as line_no", "x0", "x1", "text")
    t = pages.find_tables(numbered)
    assert t.count() == 12 and rows(t.where("line_no = 2 and column_no = 3"), "text") == [("precio2",)]


def test_classify_page(spark, rows):
    df = spark.createDataFrame([(1, "FACTURA B N° 1 importe total del servicio prestado"), (2, "Remito N° 3. Documento no válido como factura"), (3, None), (4, "texto cualquiera sin marcas especiales")], "p int, t string")
    assert rows(df.select("p", pages.classify_page(F.col("t")))) == [(1, "factura"), (2, "remito"), (3, "blank"), (4, "desconocido")]


def test_sources(spark, rows, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    for name, body in (("x.pdf", b"%PDF-1 one"), ("a/y.pdf", b"%PDF-1 one"), ("z.pdf", b"text"), ("e.pdf", b""), ("n.txt", b"%PDF")):
        (tmp_path / "in" / name).write_bytes(body)
    found = files.scan_files(spark, str(tmp_path / "in"))
    known = spark.createDataFrame([], "sha256 string")
    fresh, again, bad = files.ingest(found, known)
    assert (fresh.count(), again.count(), bad.count()) == (1, 1, 1)
    assert files.ingest(found, fresh)[0].count() == 0
    df = spark.createDataFrame([(1, "ñ;a"), (2, None)], "id int, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.startswith("﻿id;t") and '"ñ;a"' in text
    files.snapshot({"t": df}, str(tmp_path / "snap"))
    assert files.inspect_snapshot(spark, str(tmp_path / "snap")) == {"t": 2}
    assert rows(files.restore(spark, str(tmp_path / "snap"))["t"]) == rows(df)
    with pytest.raises(FileExistsError):
        files.write_staged(df, str(tmp_path / "snap" / "t"))
    assert files.upgrade(df, {"t": "string", "extra": "int"}).columns == ["id", "t", "extra"]


def test_profiles(spark, rows, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a", "any": ["contrato"], "fields": {"monto": "monto ([0-9]+)", "nombre": "don ([a-z]+)"}}')
    (tmp_path / "b.json").write_text('{"name": "b", "any": ["contrato"], "none": ["borrador"], "fields": {"monto": "suma ([0-9]+)"}}')
    ps = files.load_profiles(str(tmp_path))
    df = spark.createDataFrame([(1, "contrato de don juan monto 5"), (2, "contrato suma 7"), (3, "carta"), (4, None)], "id int, t string")
    got = files.choose_profile(df, "t", "id", ps, {"monto"})
    assert rows(got, "id", "profile") == [(1, "a"), (2, "b")]


def test_streams(spark, rows, tmp_path):
    from folioscope.streaming import live

    e = spark.createDataFrame([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:10:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(str(tmp_path / "e"))
    s = live.windowed_counts(live.stream_table(spark, str(tmp_path), "e"), "ts", "k")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("counts"), "k", "n") == [("a", 2), ("b", 1)]
    d = live.first_sightings(live.stream_table(spark, str(tmp_path), "e"), "ts", "k")
    q = d.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]


def test_live_folio_breaks(spark, rows, tmp_path):
    pytest.importorskip("google.protobuf")
    from folioscope.streaming import live

    spark.createDataFrame([("f", 1), ("f", 2), ("f", 5), ("f", 5), ("g", 3)], "file_sha string, number int").coalesce(1).write.parquet(str(tmp_path / "p"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = live.folio_breaks(live.stream_table(spark, str(tmp_path), "p")).writeStream.format("memory").queryName("breaks").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset(key)
    assert rows(spark.table("breaks"), "file_sha", "number", "kind") == [("f", 5, "jump"), ("f", 5, "repeated")]
