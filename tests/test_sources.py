import json

import pytest
from pyspark.sql import functions as F

from factweave.operators import adapters, extraction, facts
from factweave.sinks import report
from factweave.sources import records


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def _raw(spark, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.parse_json("v").alias("raw"))


def test_records_of_all_forms(spark, tmp_path):
    odd = {"a": "x y", "n": 1}
    paths = [
        _write(tmp_path / "a.jsonl", json.dumps(odd, ensure_ascii=False) + "\n\n" + json.dumps({"a": "z"}) + "\n"),
        _write(tmp_path / "b.json", json.dumps([odd, {"a": "z"}], indent=1)),
        _write(tmp_path / "c.json", json.dumps({"rows": [{"row": odd}, {"row": {"a": "z"}}]}, indent=1)),
        _write(tmp_path / "d.json", json.dumps(odd, ensure_ascii=False) + "\n" + json.dumps({"a": "z"}) + "\n"),
    ]
    for p in paths:
        got = records.read_records(spark, p).select(F.expr("variant_get(raw, '$.a', 'string')")).collect()
        assert sorted(r[0] for r in got) == ["x y", "z"], p


def test_results_with_a_manifest(spark, tmp_path):
    rows, manifest = records.read_results(spark, _write(tmp_path / "r.json", json.dumps({"results": [{"a": 1}, {"a": 2}], "manifest": {"n": 2}}, indent=1)))
    assert rows.count() == 2 and manifest.select(F.expr("variant_get(raw, '$.n', 'int')")).first()[0] == 2
    rows, manifest = records.read_results(spark, _write(tmp_path / "r.jsonl", '{"a": 1}\n'))
    assert (rows.count(), manifest.count()) == (1, 0)


def test_documents_and_sections(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _write(tmp_path / "in" / "Results.md", "intro\n# Results\nA request cache.\n# Next\nx")
    d = records.read_sections(spark, str(tmp_path / "in")).orderBy("section_no").collect()
    assert [(r.title, r.text, r.start_char) for r in d] == [("Document", "intro", 0), ("Results", "A request cache.", 6), ("Next", "x", 23)] and d[0].document_id.startswith("doc_")
    _write(tmp_path / "in" / "x.pdf", "%PDF")
    with pytest.raises(Exception, match="unsupported document"):
        records.read_documents(spark, str(tmp_path / "in")).collect()


def test_corpus_and_report_go_round(spark, tmp_path):
    t = {"documents": spark.createDataFrame([("d", None, ["a"])], "document_id string, title string, authors array<string>")}
    report.save_corpus(t, str(tmp_path / "c"))
    assert records.load_corpus(spark, str(tmp_path / "c"), {"documents": "document_id string, title string, authors array<string>"})["documents"].collect() == t["documents"].collect()
    s = spark.createDataFrame([("b", "f1", 9, 0.5, 0.25, 0.75), ("a", "f1", 0, None, None, None)], "system string, metric string, n bigint, mean double, ci95_low double, ci95_high double")
    report.write_report(s, s, str(tmp_path / "r"), "Report", {"Answers": ["f1", "em"]})
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/report.md")).collect()]
    assert "| a | N/A | N/A |" in lines and "| b | 0.5000 [0.2500, 0.7500] (n=9) | N/A |" in lines
    assert {r.run for r in report.summarize_runs(spark, str(tmp_path / "*/summary/*.json")).collect()} == {"r"}
    spark.createDataFrame([('x "y", z', "1")], "ent string, did string").write.csv(str(tmp_path / "p"), header=True, escape='"')
    assert [tuple(r) for r in records.read_pairs(spark, str(tmp_path / "p"), "ent", "did").collect()] == [('x "y", z', "1")]


def test_canonical_rows_leave_blank_facts_out(spark):
    p = spark.createDataFrame([("e", "p", "T", ["One two.", " ", "Three."])], "example_id string, passage_id string, title string, sentences array<string>")
    e = spark.createDataFrame([("e", "q?", ["a", "b"], [("p", 2), ("p", 1), ("p", 0)])], "example_id string, question string, answer array<string>, supporting_facts array<struct<passage_id:string,sentence_index:int>>")
    f = facts.sentence_facts(p)
    (r,) = report.canonical_rows(e, f, p, "d", 42).collect()
    ids = {x.sentence_index: x.fact_id for x in f.collect()}
    assert r.gold_fact_ids == [ids[2], ids[0]] and [x.text for x in r.facts] == ["One two.", "Three."] and (r.answer, r.answer_aliases) == ("a", ["b"])
    a, b = report.manifest(e, "example_id").first(), report.manifest(e.unionByName(e.withColumn("example_id", F.lit("z"))), "example_id").first()
    assert (a["rows"], b["rows"]) == (1, 2) and a.ids_sha256 != b.ids_sha256


HOTPOT = {"_id": "h 1", "question": "q?", "answer": "yes", "type": "bridge", "level": "hard", "context": [["A", ["a0", "a1"]], ["B", ["b0"]], ["C", ["c0"]]], "supporting_facts": [["A", 1], ["B", 0], ["gone", 0]]}


def test_hotpot_in_both_forms(spark):
    columns = HOTPOT | {"context": {"title": ["A", "B", "C"], "sentences": [["a0", "a1"], ["b0"], ["c0"]]}, "supporting_facts": {"title": ["A", "B", "gone"], "sent_id": [1, 0, 0]}}
    for raw in (HOTPOT, columns):
        (r,) = adapters.hotpot(_raw(spark, raw)).collect()
        assert (r.example_id, r.answer, r.bridge_entities, r.gold_path, r.hop_count, r.query_type) == ("h 1", ["yes"], ["A"], ["h_1_p0", "h_1_p1"], 2, "bridge")
        assert [(s.passage_id, s.sentence_index) for s in r.supporting_facts] == [("h_1_p0", 1), ("h_1_p1", 0)] and r.passages[0].sentences == ["a0", "a1"] and "unspecified" in r.metadata
    with pytest.raises(Exception, match="no valid supporting facts"):
        adapters.hotpot(_raw(spark, HOTPOT | {"supporting_facts": [["gone", 0]]})).collect()


def test_two_wiki_repairs_supports_out_of_range(spark):
    row = HOTPOT | {"context": [["Anna Bell", ["born", "She married Carl Dane.", "Carl Dane died."]], ["B", ["b0"]]], "supporting_facts": [["Anna Bell", 7], ["B", 0]], "evidences": [["Anna Bell", "spouse", "Carl Dane"]], "answer_aliases": ["y", "yes"]}
    (r,) = adapters.two_wiki(_raw(spark, row)).collect()
    assert [s.sentence_index for s in r.supporting_facts] == [2, 0] and r.answer == ["yes", "y"] and '"repairs":1' in r.metadata
    named = row | {"evidences": [["Anna M. Bell", "spouse", "Carl Dane"]], "supporting_facts": [["Anna Bell", 0], ["Anna Bell", -1]]}
    assert [s.sentence_index for s in adapters.two_wiki(_raw(spark, named)).first().supporting_facts] == [0, 2]
    with pytest.raises(Exception, match="out of range"):
        adapters.two_wiki(_raw(spark, row | {"evidences": []})).collect()


def test_musique_and_ultra_domain_and_mix(spark):
    m = {"id": "m", "question": "q", "answer": "a", "answer_aliases": ["b"], "paragraphs": [{"title": "T", "paragraph_text": "One. Two.", "is_supporting": True}, {"paragraph_text": "x"}], "question_decomposition": [{"question": "s1", "answer": "u"}, {"question": "s2", "answer": "v"}]}
    (r,) = adapters.musique(_raw(spark, m)).collect()
    assert [(s.passage_id, s.sentence_index) for s in r.supporting_facts] == [("m_p0", 0), ("m_p0", 1)] and (r.answer, r.bridge_entities, r.gold_path, r.hop_count, r.query_type) == (["a", "b"], ["u"], ["s1", "s2"], 2, "2-hop")
    assert r.passages[1].title == "Paragraph 1"
    u = {"_id": "u", "input": " what? ", "answers": ["x", "y"], "context": "One. Two.\nThree", "domain": "law"}
    (r,) = adapters.ultra_domain(_raw(spark, u)).collect()
    assert (r.question, r.answer, r.query_type, r.passages[0].title, r.passages[0].sentences, r.supporting_facts) == ("what?", ["x", "y"], "domain_law", "Domain_law", ["One.", "Two.", "Three"], [])
    (r,) = adapters.ultra_domain(_raw(spark, u | {"context": [{"title": "T", "text": "A. B."}, "plain"]})).collect()
    assert [(p.title, p.sentences) for p in r.passages] == [("T", ["A.", "B."]), ("Passage_1", ["plain"])]
    got = adapters.mix(_raw(spark, HOTPOT | {"dataset": "HotpotQA"}, m | {"dataset": "musique"})).collect()
    assert sorted((r.dataset, r.original_dataset, r.example_id) for r in got) == [("mix", "hotpotqa", "h 1"), ("mix", "musique", "m")]
    with pytest.raises(Exception, match="unsupported data set"):
        adapters.mix(_raw(spark, {"dataset": "zzz"})).collect()


def test_extraction_keeps_what_is_grounded(spark):
    chunks = spark.createDataFrame([("c1", "A request cache reduces\n backend load."), ("c2", "The cache helps.")], "chunk_id string, text string")
    ents = {"entities": [{"name": "Request  Cache", "type": "System", "description": ""}, {"name": "backend load", "type": "metric"}, {"name": " "}]}
    more = {"entities": [{"name": "request cache", "type": "system", "description": "keeps answers"}]}
    asked = []

    def client(prompts):
        return ["```json\n" + json.dumps(ents if "reduces" in p else more) + "\n```" for p in prompts]

    answers = extraction.completed(chunks.unionByName(chunks), "text", client).select("chunk_id", "answer").distinct()
    e = extraction.entities(chunks, answers).cache()
    got = {(r.entity, r.entity_type): r for r in e.collect()}
    assert set(got) == {("request cache", "system"), ("backend load", "metric")} and got["request cache", "system"].description == "keeps answers" and got["request cache", "system"].canonical_name == "Request Cache"
    a, b = (got[k].entity_id for k in (("request cache", "system"), ("backend load", "metric")))
    fact = lambda quote, *ids, c=0.9: {"predicate": "reduces", "evidence": quote, "confidence": c, "arguments": [{"role": f"R {i}", "entity_id": x} for i, x in enumerate(ids)]}
    said = {"facts": [fact("cache reduces backend load", a, b), fact("cache reduces backend load", a, b, c=0.95), fact("cache reduces backend load", a, "unknown"), fact("not there", a, b)]}
    answers = spark.createDataFrame([("c1", json.dumps(said)), ("c2", "no json")], "chunk_id string, answer string")
    (f,) = extraction.facts(chunks, answers, e).collect()
    assert f.evidence == "cache reduces\n backend load" and f.confidence == 0.95 and [x.role for x in f.arguments] == ["r_0", "r_1"] and not asked


def test_coverage_needs_one_fact_with_all_names(spark):
    want = spark.createDataFrame([("k", 1, "Cache"), ("k", 1, "load"), ("k", 2, "Cache"), ("k", 2, "disk"), ("none", 1, "x")], "case string, fact int, name string")
    found = spark.createDataFrame([("k", "f1", ["request cache", "Load"]), ("k", "f2", ["disk"])], "case string, fact_id string, names array<string>")
    assert {r.case: (r.expected, r.covered) for r in extraction.coverage(want, found).collect()} == {"k": (2, 1), "none": (1, 0)}


def test_suite_rows_read_back(spark):
    doc = "array<struct<document_id:string,title:string,text:string>>"
    fact = "array<struct<document_id:string,sentence_index:int,fact_id:string,text:string>>"
    rows = [
        ("e", "q?", "a", ["b"], [("p1", "T", ""), ("p2", "U", "")], [("p1", 0, "f0", "One."), ("p1", 1, "f1", " "), ("p1", 2, "f2", "Three."), ("p2", 0, "f3", "Other.")], ["f2", "f3", "gone", "f1"]),
        ("n", "q", None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, f"example_id string, question string, answer string, answer_aliases array<string>, documents {doc}, facts {fact}, gold_fact_ids array<string>")
    got = {r.example_id: r for r in report.examples_of(d).collect()}
    e = got["e"]
    assert e.answer == ["a", "b"] and [(p.passage_id, p.sentences) for p in e.passages] == [("p1", ["One.", "Three."]), ("p2", ["Other."])]
    assert [(s.passage_id, s.sentence_index) for s in e.supporting_facts] == [("p1", 1), ("p2", 0)] and (got["n"].answer, got["n"].passages, got["n"].supporting_facts) == ([], [], [])
