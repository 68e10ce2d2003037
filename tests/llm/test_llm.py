import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import language, leak, mix, neardup, pairs, sample, sentences, topn

EN = ["The old kiln reduces the energy use after the audit.", "The seed bank limits the traffic volume in most districts.", "The court registry delays the delivery window once the contract ends."]
DE = ["Der alte Brennofen senkt den Energieverbrauch nach der Prüfung.", "Die Saatgutbank begrenzt das Verkehrsaufkommen in den meisten Bezirken.", "Das Register verzögert das Lieferfenster seit dem Ende des Vertrags."]


def _passages(spark, rows):
    return spark.createDataFrame(rows, "passage_id string, title string, sentences array<string>")


def test_top_n_against_brute_force_with_a_hot_group(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.5 else f"q{r.randrange(40)}", f"f{r.randrange(300)}", r.choice([0.0, -0.0, 0.5, 1.5, None, float("nan")])) for _ in range(6000)]
    d = spark.createDataFrame([(*x, "c", 1) for x in rows] + [(None, "f", 1.0, "c", 1), ("q1", None, 9.0, "c", 1)], "query_id string, fact_id string, score double, source string, __salt int")
    got = {(x.query_id, x.item_id) for x in topn.best_facts(d).collect()}
    best = {}
    for q, f, s in rows:
        if s is not None and s == s:
            best.setdefault(q, {})[f] = max(s, best.get(q, {}).get(f, -9.0))
    want = {(q, f) for q, m in best.items() for f, _ in sorted(m.items(), key=lambda x: (-x[1], x[0]))[:5]}
    assert got == want


def test_top_n_of_an_empty_table(spark):
    assert topn.best_facts(spark.createDataFrame([], "query_id string, fact_id string, score double, source string")).count() == 0


def _jaccard(a, b):
    x, y = set(neardup._elements(a).tolist()), set(neardup._elements(b).tolist())
    return len(x & y) / len(x | y) if x | y else 0.0


def _near(spark, rows, least=0.7, records=None):
    """Members and pairs of classes as p3_found has them; ``records``: as if there were so many."""
    each = neardup.classes(neardup.passage_text(_passages(spark, rows)), "passage_id", "text").cache()
    found = each.select("class_id", "elements").dropDuplicates(["class_id"])
    light = neardup.anchored(found, *neardup.plan(records or len(rows), least)).cache()
    return neardup.members_of(each, "passage_id"), neardup.class_pairs(found, neardup.candidates(light, least), least)


def _pairs_of(texts, least=0.7):
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if _jaccard(texts[i], texts[j]) >= least}


@pytest.mark.parametrize("records", [None, 2_000_000])
def test_near_duplicates_against_brute_force(spark, records):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = r.choices(words, k=40)
        texts.append(base)
        for _ in range(2):
            other = [w if r.random() > 0.06 else r.choice(words) for w in base]
            r.shuffle(other)
            texts.append(other)
    flat = [" ".join(t) for t in [*texts, texts[0], []]]
    rows = [(f"p{i:03}", None, [t, None]) for i, t in enumerate(flat)]
    members, pairs = _near(spark, rows, records=records)
    got = {(x.a, x.b) for x in neardup.member_pairs(members, pairs, "passage_id").collect()}
    want = {(rows[i][0], rows[j][0]) for i, j in _pairs_of(flat)}
    assert got <= want and len(got) >= 0.95 * len(want) and ("p000", "p120") in got


@pytest.mark.parametrize("records", [None, 200_000])
def test_pairs_just_above_the_threshold_are_found(spark, records):
    r = random.Random(11)
    texts = []
    for k in range(500):  # 35 words in common of 35 + 2 n in all: similarity 0.7 to 0.745
        n, common = r.choice([6, 7]), [f"c{k}x{i}" for i in range(35)]
        texts += [" ".join(common + [f"{side}{k}x{i}" for i in range(n + (side == "a" and n == 7))]) for side in "ab"]
    want = {(f"p{i:04}", f"p{j:04}") for i, j in ((2 * k, 2 * k + 1) for k in range(500)) if 0.7 <= _jaccard(texts[i], texts[j]) < 0.75}
    members, pairs = _near(spark, [(f"p{i:04}", None, [t]) for i, t in enumerate(texts)], records=records)
    got = {(x.a, x.b) for x in neardup.member_pairs(members, pairs, "passage_id").collect()}
    assert len(want) > 200 and got <= want and len(got) >= 0.95 * len(want)


def test_near_duplicate_joins_broadcast_nothing(spark):
    members, pairs = _near(spark, [(f"p{i}", "t", [f"w{i} x y z"]) for i in range(20)])
    d = neardup.member_pairs(members, pairs, "passage_id")
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_min_hashes_of_slices_equal_those_of_the_whole():
    r = np.random.default_rng(3)
    sizes = [1, 9000, 3, 4096, 5]
    e = r.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    a, b, uses = neardup._pool(2, 8)
    starts = np.cumsum(sizes) - sizes
    got = neardup.min_hashes(e, starts, a, b)
    for k, (s, n) in enumerate(zip(starts, sizes)):
        assert (got[k] == neardup.min_hashes(e[s : s + n], np.zeros(1, int), a, b)[0]).all()
    assert len({x for use in uses for x in use}) == uses.size


def test_large_classes_keep_every_pair_of_different_texts(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.sample(base, 40)) for _ in range(70)] + [" ".join(r.sample([*base[1:], "x"], 40)) for _ in range(70)] + [" ".join(base)] * 80
    assert len(set(texts)) == 141
    rows = [(f"p{i:03}", None, [t]) for i, t in enumerate(texts)]
    members, _ = _near(spark, rows)
    a, b = sorted(x.class_id for x in members.select("class_id").distinct().collect())
    pairs = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    got = [(x.a, x.b) for x in neardup.member_pairs(members, pairs, "passage_id").collect()]
    want = {(f"p{i:03}", f"p{j:03}") for i in range(220) for j in range(i + 1, 220) if texts[i] != texts[j]}
    assert len(got) == len(set(got)) and set(got) == want | {("p140", f"p{j:03}") for j in range(141, 220)}
    assert {(x.passage_id, x.copy_of) for x in neardup.copies(members, "passage_id").collect()} == {(f"p{j:03}", "p140") for j in range(140, 220)}


def test_near_duplicates_of_nulls_and_empty_tables(spark):
    members, pairs = _near(spark, [(None, "a", ["b"]), ("p", None, None), ("q", "", [None, " "]), ("r", "one", None), ("r", "one", None), ("s", "ONE.", [])])
    assert [(x.a, x.b) for x in neardup.member_pairs(members, pairs, "passage_id").collect()] == [("r", "s")]
    members, pairs = _near(spark, [])
    assert neardup.member_pairs(members, pairs, "passage_id").count() == 0


def test_anchors_cover_the_words():
    own, away = neardup._code()
    w = np.arange(128)
    assert len(set(own.tolist())) == 16 and np.bitwise_count(own ^ w).max() <= 1
    assert set(np.bitwise_count((away ^ w[:, None])[away >= 0]).tolist()) == {2}
    for x in w:  # whatever differs in one bit meets
        for y in (int(x) ^ 1 << i for i in range(7)):
            assert own[x] in (own[y], *away[y])


def test_sample_quotas_and_report(spark):
    docs = spark.createDataFrame([(i, "Big Cat" if i < 80 else "big-cat" if i < 90 else "rare" if i < 93 else None, "s") for i in range(100)] + [(0, "Big Cat", "s")], "id bigint, c string, s string")
    rec = sample.records_of(docs, "id", "t.c", F.col("c"), F.col("s")).cache()
    leaves = rec.groupBy("field_name", "category", "leaf").agg(F.count(F.lit(1)).alias("n"))
    pool = rec.groupBy("field_name").agg(F.count(F.lit(1)).alias("pool"))
    goal = spark.createDataFrame([("t.c", "big_cat", 0.5, 0), ("t.c", "rare", 0.1, 6)], "field_name string, category string, target_share double, min_rows bigint")
    need = sample.needs(leaves, goal, pool).cache()
    filled = sample.fill(leaves, need).cache()
    categories = sample.unmet(need, filled).cache()
    parts = sample.allocate(filled, categories).cache()
    q = {r.category: r for r in sample.report(categories, parts).collect()}
    assert (q["rare"].need, q["rare"].unmet, q["big_cat"].need, q["big_cat"].unmet) == (6, 3, 10, 0)
    drawn = sample.draw(rec, parts).groupBy("category").count().collect()
    assert {r.category: r["count"] for r in drawn} == {"rare": 3, "big_cat": q["big_cat"].quota}
    assert q["big_cat"].quota + 3 == 20 and q[None].quota == 0


def test_unmet_quota_goes_to_siblings_before_cousins(spark):
    # a needs 60: an even part of 20 for each leaf; x lacks 15, which its siblings fill. b needs 30 and lacks 20: cousins fill it
    rows = [("f", "a", "x", 5), ("f", "a", "y", 200), ("f", "a", "z", 40), ("f", "b", "x", 10), ("f", "c", "x", 245)]
    leaves = spark.createDataFrame(rows, "field_name string, category string, leaf string, n bigint")
    goal = spark.createDataFrame([("f", "a", 0.6, 0), ("f", "b", 0.3, 0), ("f", "none", 0.1, 3)], "field_name string, category string, target_share double, min_rows bigint")
    need = sample.needs(leaves, goal, spark.createDataFrame([("f", 500)], "field_name string, pool bigint")).cache()
    filled = sample.fill(leaves, need).cache()
    own = {(r.category, r.leaf): r.own for r in filled.collect()}
    assert own["a", "x"] == 5 and own["a", "y"] + own["a", "z"] == 55 and own["a", "y"] > own["a", "z"] >= 20 and own["b", "x"] == 10 and own["c", "x"] == 0
    categories = sample.unmet(need, filled).cache()
    assert {r.category: r.unmet for r in categories.collect()} == {"a": 0, "b": 20, "c": 0, "none": 10}
    take = {(r.category, r.leaf): r.take for r in sample.allocate(filled, categories).collect()}
    assert sum(take.values()) == 100 and take["c", "x"] == 0 and take["a", "x"] == 5 and take["a", "y"] + take["a", "z"] == 85


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Lee rose by 3.5 points. It fell.", ["Dr. Lee rose by 3.5 points.", "It fell."]),
        ('He said “Stop! Now.” and left. Then (so it is) he ran.', ['He said “Stop! Now.” and left.', "Then (so it is) he ran."]),
        ("第一句。第二句！", ["第一句。", "第二句！"]),
        ("- one item\n- two items\nNext line.", ["- one item", "- two items", "Next line."]),
        ("- one item\n  goes on\n  - inner item\n    more\n  back in one\nOut.", ["- one item\n  goes on", "- inner item\n    more", "back in one", "Out."]),
        ("* Done.\n  Next sentence here.", ["* Done.", "Next sentence here."]),
        ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]),
        ("", []), (None, []), (" \n", []),
    ],
)
def test_sentences(text, want):
    got = [text[a:b] for a, b in sentences.split(text)]
    assert got == want


def test_units_leave_out_nothing_but_whitespace(spark):
    text = "One. Two (three. four) five?\n\n* six\n“Seven.” Eight " + "long text. " * 5000
    at = 0
    for a, b in sentences.split(text):
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def _leaks(d, items, **how):
    return {x.doc_id: x for x in leak.find_leaks(d, leak.weighted(items).cache(), **how).collect()}


def test_leaks_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    item = [f"v{i}" for i in range(60)]
    docs = []
    for i in range(30):
        n = r.randrange(8, 16)
        s = r.randrange(0, 60 - n)
        docs.append((i, " ".join(r.choices([f"z{k}" for k in range(50)], k=20)) + "\n**" + "_".join(item[s : s + n]).upper() + "** end", n >= 12))
    docs += [(98, None, False), (99, "", False)]
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (7, " ".join(item)), (None, "x"), (9, "")], "item_id bigint, text string")
    got = {i for i, x in _leaks(d, items, least=1.0).items() if x.holds_run and x.similarity == pytest.approx(1)}
    assert got == {i for i, _, yes in docs if yes}
    monkeypatch.setattr(leak, "BROADCAST_ROWS", 0)
    assert set(_leaks(d, items, least=1.0)) == got
    assert not _leaks(d, items.where("item_id = 8")) and not _leaks(d.where("doc_id > 90"), items)


def test_edited_leaks_of_the_size_of_an_item(spark):
    r = random.Random(3)
    texts = [[f"i{k}w{i}" for i in range(80)] for k in range(40)]
    docs = []
    for k, t in enumerate(texts):
        at = r.randrange(80)
        docs.append((k, " ".join([*t[:at], "edited", *t[at + 1 :]])))
        docs.append((100 + k, " ".join(r.sample(t, 80))))
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id bigint, text string")
    got = _leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items, sizes=leak.ITEM, radius=2)
    assert all(i < 100 and x.item_id == i and 0.8 <= x.similarity <= 1 for i, x in got.items()) and len(got) >= 28


def test_similarity_of_windows_by_hand(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e x y z")], "item_id int, text string")
    weights = {r.item_id: r.weights for r in leak.weighted(items).collect()}
    assert weights[1] == [0.5] + [1.0] * 7 and weights[2] == [0.5, 1.0, 1.0, 1.0]
    (row,) = _leaks(spark.createDataFrame([("d", "a b c d e f g h i j k zz")], "doc_id string, text string"), items, radius=31, least=0.5).values()
    assert row.similarity == pytest.approx(6.5 / 8.5) and not row.holds_run and row.windows == 1


def test_mix_shares_and_repeats(spark):
    sized = spark.createDataFrame([(i, "a" if i < 90 else "b", 10) for i in range(100)] + [(200, None, 50), (201, "a", 0)], "doc_id bigint, source_key string, tokens bigint")
    targets = mix.target_table(spark.createDataFrame([("A", 1.0, 1), ("B", 1.0, 3)], "source string, target_weight double, max_repeats int"))
    rows = {r.source: r for r in mix.shares(sized, targets, 1000).collect()}
    assert rows["B"].short and not rows["A"].short is None and rows["B"].tokens_used == 300
    kept = mix.truncate(mix.queue(sized, targets), 400).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    assert sum(r.n for r in kept) <= 400 and {r.source for r in kept} == {"A", "B"} and abs(kept[0].n - kept[1].n) <= 20


@pytest.fixture(scope="module")
def model():
    pool = [("en", " ".join(EN) + f" {i}") for i in range(6)] + [("de", " ".join(DE) + f" {i}") for i in range(6)]
    return language.Compression.fit(pool), language.Bayes().fit(pool)


def test_segments_of_mixed_text(model):
    text = EN[0] + " " + EN[1] + "\n\n" + DE[0] + " " + DE[1]
    assert [(g, text[a:b][:3]) for a, b, g, _ in language.segment(text, model[0])] == [("en", "The"), ("de", "Der")]
    assert language.segment("TE-3840 1 2 3", model[0]) == [] and language.segment(None, model[0]) == []


def test_sizes_are_those_of_level_6(model):
    import zstandard

    text = " ".join(EN + DE)
    for raw, got in zip(model[0].raw, model[0].sizes(text)):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 64 else None
        if d:
            d.precompute_compress(level=6)
        z = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False)
        assert got == len(z.compress(text.lower().encode()))
    assert language.Compression.LEVEL == 6


def test_labels_of_any_notation(spark):
    d = spark.createDataFrame([("EN-gb",), (" german",), ("fra",), ("und",), ("",), (None,), ("mul",)], "l string")
    assert [r[0] for r in d.select(language.label(F.col("l"))).collect()] == ["en", "de", "fr", None, None, None, None]


def test_doubtful_documents(spark, model):
    rows = [(1, "en", EN[0] + " " + EN[1]), (2, "de", EN[0] + " " + EN[1]), (3, None, DE[0] + " " + DE[2]), (4, "en", EN[0] + " " + DE[0] + " " + DE[1]), (5, None, None), (6, "", " ")]
    d = language.segments(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), model[0], {})
    got = sorted((r.doc_id, r.segment_no, r.language) for r in language.doubtful(d).collect())
    assert got == [(2, 1, "en"), (3, 1, "de"), (4, 1, "en"), (4, 2, "de")]


def test_defects(spark, model):
    q = "How does the old kiln affect the energy use?"
    cases = [(None, "empty"), ("[fact_1] …", "empty"), ("N/A", "empty"), ("Q: " + q, "echo"), ("I'm sorry, but I cannot answer.", "refusal"), (DE[1], "language"), (EN[0][:-1], None), (EN[2], None), ("The seed bank limits the", "truncated"), ("yes", None), ('{"answer": "N/A"}', "empty"), ('```json\n{"answer": "The seed bank lim', "truncated")]
    body = [("result", f"b{i}", q, EN[i % 3] if i % 7 else EN[i % 3][:-1]) for i in range(90)] + [("result", f"g{i}", "Was sagt das Register über die Prüfung der Saatgutbank?", DE[i % 3]) for i in range(30)]
    d = spark.createDataFrame(body + [("result", str(i), q, a) for i, (a, _) in enumerate(cases)], "kind string, record_id string, question string, answer string")
    got = {r.record_id: r.defect for r in pairs.defects(d, model[1], pairs.word_counts(d).cache()).collect()}
    assert [got.get(str(i)) for i in range(len(cases))] == [w for _, w in cases]
    assert not [k for k in got if not k.isdigit()]


def _word_by_word(texts, common):
    """Counts of ends and occurrences of every context, from _context_hashes alone."""
    want = {}
    for t in texts:
        words = pairs._shape(pairs._tokens(t), common)
        for i, w in enumerate(words):
            if w[0] in pairs._STOP:
                continue
            marked, end = i + 1 < len(words) and words[i + 1][0] in pairs._STOP, i + 1 == len(words)
            for c, own in pairs._context_hashes(words, [pairs._word_hash(x) for x in words], i, pairs._is_open(words[: i + 1])):
                if own or not end:
                    c -= (c >> 63) << 64
                    e, n = want.get(c, (0, 0))
                    want[c] = e + (marked or end), n + 1
    return want


def test_contexts_are_counted_apart_however_many(spark):
    r = random.Random(4)
    texts = [" ".join(chr(0x2200 + r.randrange(200)) for _ in range(r.randrange(5))) for _ in range(3000)]
    texts += ["", "Yes", "The cache is warm. It holds", "缓存命中率很高。命中后返回", "... 1998, ok? no", "สวัสดี ok แล้ว", "a (b {c d) e} f (g", "is it (ok) the"]
    d = spark.createDataFrame([(t,) for t in texts], "answer string")
    common = frozenset(["the", "is", "it", "ok"])
    got = {r.context: (r.e, r.n) for r in pairs.end_counts(d, common).collect()}
    assert got == _word_by_word(texts, common)


def test_words_cut_short_end_less_often_than_they_begin(spark):
    d = spark.createDataFrame([("evaporation",)] * 9 + [("evapor x",), ("zephyr",), (None,), ("x" * 100_000,)], "answer string")
    words = pairs.word_counts(d).cache()
    got = {r.word: (r.ends, r.begins) for r in pairs.word_ends(words).collect()}
    assert got == {"evaporation": (9, 9), "evapor": (1, 10), "x": (1, 1), "zephyr": (1, 1)}
    assert pairs.common_words(words, 13) == {"evaporation"}


def test_language_path_is_the_cheapest():
    from itertools import product

    rng = np.random.default_rng(5)
    for _ in range(30):
        cost = rng.integers(0, 12, (5, 3)).astype(float)
        price = lambda p: sum(cost[i, g] for i, g in enumerate(p)) + 4.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert price(language._cheapest(cost, 4.0)) == min(map(price, product(range(3), repeat=5)))


def test_languages_by_script(model):
    names = lambda t: {language.LANGS[i] for i in language.written_in(t)}
    latin = {"en", "de", "fr", "es", "pt", "it"}
    assert names("Ein Satz.") == latin == names("Prüfung") and names("это текст") == {"ru"} and names("实验实验 ab") == {"zh", "ja"}
    assert names("สวัสดี") == {"th"} and names("यह है") == {"hi"} and names("هذا نص") == {"ar"} and len(names("12 !")) == 12
    assert names("the kiln и это") == latin | {"ru"}
    whole, some = model[0].table(EN + DE), model[0].tables([(EN + DE, language.written_in(EN[0])), ([], [3])])
    assert (whole[:, :6] == some[0][:, :6]).all() and some[1].shape == (0, 12) and (some[0][:, 6:] > whole[:, :6].min(axis=1, keepdims=True)).all()


@pytest.mark.parametrize("unit", ["« a » b » ", "( a. ", '" x. ', "word 12. ", "a.b.c.", "“a. "])
def test_split_takes_time_in_proportion(unit):
    import time

    text, began = unit * 16_000, time.thread_time()
    got = sentences.split(text)
    assert time.thread_time() - began < 3 and "".join(text[a:b] for a, b in got).split() == text.split() or got


def test_first_of_one_group_with_nearly_all_rows(spark):
    d = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") % 997).alias("o"), F.col("id").alias("i"))
    got = topn.top_n_per_group(d, ["g"], ["o"], "i", 3)
    assert [r.i for r in got.where("g = 'hot'").sort("o", "i").collect()] == [997, 1994, 2991] and got.count() == 2003
    assert topn.top_n_per_group(d.limit(0), ["g"], ["o"], "i", 3).count() == 0


def test_mix_ends_where_the_budget_does(spark):
    r = random.Random(1)
    rows = [(i, "s", r.randrange(3), r.randrange(1, 9), 1.0, float(r.randrange(40))) for i in range(400)]
    q = spark.createDataFrame(rows, "doc_id bigint, source string, round int, tokens bigint, weight double, finish double").repartition(5)
    want, used = [], 0
    for x in sorted(rows, key=lambda x: (x[5], x[1], x[0], x[2])):
        used += x[3]
        if used > 700:
            break
        want.append(x[0])
    d = mix.truncate(q, 700)
    assert sorted(x.doc_id for x in d.collect()) == sorted(want) and "SinglePartition" not in d._jdf.queryExecution().toString()
    assert mix.truncate(q, 10**9).count() == 400 and mix.truncate(q, 0).count() == 0 and mix.truncate(q.limit(0), 5).count() == 0
