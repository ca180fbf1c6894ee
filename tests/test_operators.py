"""Small cases against brute force, and the intended behaviour where it is easy to get wrong."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliotab.functions.text import edit_ratio
from foliotab.operators import alignment, documents, extraction, model_objects, outputs, reconcile, relational, runs, schedules, scoring, vectors
from foliotab.operators.sqlrun import read_only, transform_sql


def greedy(rows):
    """Plain first-fit merge of dicts field -> value."""
    while True:
        kept = []
        for r in rows:
            for i, k in enumerate(kept):
                if all(k.get(f) is None or r.get(f) is None or k[f] == r[f] for f in r):
                    kept[i] = {f: k[f] if k[f] is not None else r[f] for f in r}
                    break
            else:
                kept.append(r)
        if len(kept) == len(rows):
            return kept
        rows = kept


def test_merge_compatible_equals_plain_greedy(spark):
    rnd = random.Random(5)
    data, cells = {}, []
    for doc in range(12):
        for seq in range(rnd.randrange(1, 12)):
            row = {"a": rnd.choice("xy"), "b": rnd.choice(["1", "2", None]), "c": rnd.choice(["p", None, None])}
            data.setdefault(doc, []).append(row)
            cells += [("t", doc, 0, seq, f, v, [f"{f}{v}"] if v else None, "r" * rnd.randrange(3), bool(rnd.randrange(2))) for f, v in row.items()]
    df = spark.createDataFrame(cells, "table_name string, doc_id long, chunk_id long, row_seq long, field string, value string, quote array<string>, rationale string, is_explicit boolean")
    got = {}
    for r in extraction.merge_compatible(df).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.row_seq, {})[r.field] = r.value
    key = lambda rows: sorted(str(sorted(r.items(), key=str)) for r in rows)
    assert {d: key(v.values()) for d, v in got.items()} == {d: key(greedy(v)) for d, v in data.items()}


def test_flatten_skips_what_is_no_cell(spark):
    text = '{"tables":[{"name":"t","rows":[{"fields":{"a":{"value":1,"quote":["q"],"rationale":"r","is_explicit":true},"extraction_plan":{"value":2},"b":"text"}}]}]}'
    got = extraction.flatten(spark.createDataFrame([(1, 2, text)], "doc_id long, chunk_id long, output string")).collect()
    assert [(r.field, r.value, r.quote) for r in got] == [("a", "1", ["q"])]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_statuses(spark):
    docs = spark.createDataFrame([(1, "Net sales rose to $5 million in 2020. Costs fell.")], "doc_id long, text string")
    q = spark.createDataFrame([(1, 1, "sales ROSE to $5"), (1, 2, "sale rises to $5 million"), (1, 3, "unrelated words here now"), (1, 4, "Costs fell sharply")], "doc_id long, quote_id int, quote string")
    exact = {r.quote_id: r for r in alignment.align_exact(q, docs, accept_lesser=True).collect()}
    assert exact[1].status == "MATCH_EXACT" and exact[1].span_text == "sales rose to $5"
    assert exact[4].status == "MATCH_LESSER" and exact[4].span_text == "Costs fell" and exact[3].status is None
    fuzzy = {r.quote_id: r for r in alignment.align_fuzzy(q, docs).collect()}
    assert fuzzy[2].status == "MATCH_FUZZY" and 3 not in fuzzy
    cells = spark.createDataFrame([(1, "f", ["Costs fell.", "sale rises to $5 million", "nope nope"]), (1, "g", None)], "doc_id long, field string, quote array<string>")
    assert sorted(str(r.status) for r in alignment.annotate_alignment(cells, docs).collect()) == ["MATCH_EXACT", "MATCH_FUZZY", "None", "None"]


def test_sentences_keep_abbreviations(spark):
    d = alignment.tokenize(spark.createDataFrame([(1, "Mr. Smith left. He is at 3.5\nNow and/or later")], "doc_id long, text string"))
    s = alignment.sentences(d)
    got = [r.text for r in s.orderBy("sentence").collect()]
    assert got == ["Mr. Smith left.", "He is at 3.", "5", "Now and/or later"]


def pack(text, size, overlap):
    """The documented packing rule, straight."""
    cut = lambda s, sep: [p for p in s.replace(sep, "\x01" + sep).split("\x01") if p]
    out = []

    def merge(ps):
        cur, done = [], []
        for p in ps:
            if cur and sum(map(len, cur)) + len(p) > size:
                done.append("".join(cur).strip())
                while sum(map(len, cur)) > overlap or (cur and sum(map(len, cur)) + len(p) > size):
                    cur = cur[1:]
            cur.append(p)
        return [c for c in [*done, "".join(cur).strip()] if c]

    def level(s, seps):
        good, res = [], []
        for p in cut(s, seps[0]):
            if len(p) < size:
                good.append(p)
                continue
            res += merge(good) if good else []
            good = []
            res += level(p, seps[1:]) if seps[1:] else [p]
        return res + (merge(good) if good else [])

    out = level(text, ["\n\n", ".\n"] if "\n\n" in text else [".\n"]) if len(text) >= size or "\n\n" in text else merge(cut(text, ".\n"))
    return out


@pytest.mark.parametrize("overlap", [0, 12])
def test_split_recursive(spark, overlap):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["abc ", "de", ".\n", "\n\n", "long words here "]) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in documents.split_recursive(df, "text", 40, overlap).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: p for i, t in enumerate(texts) if (p := pack(t, 40, overlap))}


def test_tables_round_trip(spark):
    text = "x\n| a | b |\n|---|---|\n| 1 | 2 |\nmid | c | d |\n| e | f |\nend | no\n| last | row |"
    t = documents.tag_tables(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = t.head()
    assert row.tagged == "x\n<table id='0'>\nmid <table id='1'>\nend | no\n| last | row |"
    back = t.withColumn("tables", F.transform("tables", lambda x: F.struct(F.concat(x["tag"], F.lit("\n")).alias("tag"), x["table_text"].alias("table_text"))))
    assert documents.untag(back, "tagged").head().tagged == text


def test_pages_lines_titles(spark):
    df = spark.createDataFrame([("",), ("abcdefghij",)], "t string")
    got = documents.paginate(df, "t", 1).collect()
    assert [(r.page, r.start, r.content) for r in got] == [(0, 0, ""), (0, 0, "abcd"), (1, 4, "efgh"), (2, 8, "ij")]
    assert [r.content for r in documents.paginate(df, "t", 0).collect()] == ["", "abcdefghij"]
    one = spark.createDataFrame([("a\n\nb\n",)], "t string").select(documents.number_lines(F.col("t")).alias("n"), documents.doc_title(F.col("t"), F.lit("x/y.md")).alias("d")).head()
    assert one.n == "1 a\n2\n3 b\n" and one.d == "y.md"


def test_knn_blocks_agree(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    key = lambda d: sorted((r.query_id, r.vec_id, r.rank) for r in d.collect())
    assert key(vectors.knn(df, df, 4, block=9)) == key(vectors.knn(df, df, 4, block=1000))


def test_sql_errors_are_data(spark):
    df = spark.range(3)
    assert transform_sql(spark, "select sum(id) s from v", {"v": df}).frame.head().s == 3
    assert "nope" in transform_sql(spark, "select nope from v", {"v": df}).error
    assert read_only("drop table x") and read_only("select 1; select 2")
    assert transform_sql(spark, "with a as (select 1) insert into t select * from a", {}).error
    assert read_only("select ';drop' as x -- delete\n") is None


def test_row_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 1.0), (3, None, float("nan"))], "id int, s string, x double")
    ids = lambda rules: [r.id for r in relational.drop_row_if(df, rules).orderBy("id").collect()]
    assert ids({"drop_row_if": [{"missing_any_of": ["s"]}]}) == [1]
    assert ids({"drop_row_if": [{"missing_all_of": ["s", "x"]}]}) == [1, 2]
    assert ids({"requirements": [{"any_of": [{"all_of": ["s"]}, {"all_of": ["x"]}]}], "primary_keys": ["id"]}) == [1, 2]
    broken, why = relational.filter_text(df, "no_such = 1")
    assert broken.count() == 3 and why


def test_resolve_entities_is_all_or_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, c string")
    spec = lambda rows: spark.createDataFrame(rows, "seq int, row_ids array<long>, column string, value string")
    ok = reconcile.resolve_entities(df, spec([(0, [1, 2], "c", "x"), (1, [2], "c", "y")]), ["c"])
    assert {r.row_id: r.c for r in ok.frame.collect()} == {1: "x", 2: "y"}
    bad = reconcile.resolve_entities(df, spec([(0, [1, 9], "c", "x")]), ["c"])
    assert {r.row_id: r.c for r in bad.frame.collect()} == {1: "a", 2: "b"} and bad.errors.count() == 1


def test_run_plan_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "row_id long, c string")
    steps = {"clear_nan": reconcile.clear_nan, "deduplication": reconcile.drop_full_duplicates, "aggregation": lambda x: x.select("row_id")}
    run = reconcile.run_plan(df, steps)
    assert run.frame.count() == 1 and [a["step"] for a in run.audit] == ["clear_nan", "deduplication"]
    lost = reconcile.run_plan(df, {"aggregation": steps["aggregation"]})
    assert lost.frame.columns == df.columns and lost.audit[0]["success"] is False
    assert not reconcile.run_plan(df, steps, table_name="AdditionalInformation_1").audit
    again = reconcile.drop_full_duplicates(reconcile.drop_full_duplicates(df))
    assert again.count() == 2
    objective = reconcile.run_objectives(df, [("dedupe", reconcile.drop_full_duplicates), ("none", lambda x: x)])
    assert objective.frame.count() == 2 and sum(a["success"] for a in objective.audit) == 1


def test_updates_stop_on_structural_error(spark):
    objs = model_objects.objects_from(spark.range(2), F.lit("m"), "Lights", F.col("id"), {"Name": F.concat(F.lit("L"), F.col("id").cast("string")), model_objects.LIGHTS_RULES.zone_field: F.lit("Z1"), "Lighting_Level": F.lit("5")})
    spec = lambda rows: spark.createDataFrame(rows, "seq int, target string, updates map<string,string>")
    ok = model_objects.apply_updates(objs, spec([(0, "all", {"Lighting_Level": "7"}), (1, "name:l1", {"Lighting_Level": "8", "Fraction_Radiant": "2"})]), model_objects.LIGHTS_RULES)
    levels = {r.obj_idx: r.value for r in ok.objects.filter("field_name = 'Lighting_Level'").collect()}
    assert levels == {0: "7", 1: "8"} and ok.errors.count() == 1
    assert sorted((r.seq, r.old_value, r.new_value) for r in ok.audit.filter("obj_idx = 1").collect()) == [(0, "5", "7"), (1, "7", "8")]
    bad = model_objects.apply_updates(objs, spec([(0, "all", {"Lighting_Level": "7"}), (1, "floor 3", {"Lighting_Level": "8"})]), model_objects.LIGHTS_RULES)
    assert bad.audit.count() == 0 and bad.errors.count() == 1


def test_schedule_round_trip(spark):
    rnd = random.Random(9)
    rows = [(s, h, float(rnd.randrange(3))) for s in range(5) for h in range(24)]
    hours = spark.createDataFrame(rows, "s int, hour int, value double")
    runs_ = schedules.rle_hours(hours, ["s"])
    # a run ends where the next begins: shift to "from" points and expand again
    ends = {}
    for r in runs_.orderBy("s", "seq").collect():
        ends.setdefault(r.s, []).append((int(r.until[:2]) * 60, r.value))
    pts = [(s, a[0], b[1]) for s, e in ends.items() for a, b in zip(e, e[1:])]
    back = schedules.expand_hours(spark.createDataFrame(pts, "s int, minute int, value double"), ["s"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_modify_points_restores(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (1, 480, 2.0), (1, 600, 3.0), (1, 1020, 4.0)], "s int, minute int, value double")
    got = sorted((r.minute, r.value) for r in schedules.modify_points(p, ["s"], "set", 540, 720, 9.0).collect())
    assert got == [(0, 1.0), (480, 2.0), (540, 9.0), (720, 3.0), (1020, 4.0)]


def test_requests_forms_and_levels(spark):
    raw = spark.createDataFrame([("Zone Temp",), ('["Zone Temp","daily"]',), ('{"meter_name":"X","frequency":"weekly"}',)], "spec string")
    n = outputs.normalize_requests(raw)
    assert [(r.name, r.frequency) for r in n.collect()] == [("Zone Temp", "hourly"), ("Zone Temp", "daily"), ("X", "weekly")]
    cat = spark.createDataFrame([("zone temp",)], "name string")
    count = lambda **k: outputs.validate_requests(n, cat, **k).filter("verdict = 'valid'").count()
    assert count() == 2 and count(level="strict") == 2
    other = spark.createDataFrame([("nothing",)], "name string")
    valid = lambda level, meters: outputs.validate_requests(n, other, level, meters).filter("verdict = 'valid'").count()
    assert [valid("lenient", False), valid("moderate", False), valid("moderate", True), valid("strict", True)] == [2, 0, 2, 0]


def test_scores(spark):
    files = spark.createDataFrame([(1, '{"hard":{"correct":true,"explanation":"e"},"soft":{"correct":80},"x":{"error":"boom"}}')], "question_id long, evaluation_tools string")
    s = scoring.flatten_scores(files)
    got = {r.tool: (r.correct_bool, r.correct_num, r.error) for r in s.collect()}
    assert got == {"hard": (True, None, None), "soft": (None, 80.0, None), "x": (None, None, "boom")}
    acc = lambda legacy: {r.tool: r.correct for r in scoring.accuracy_by_tool(s, legacy=legacy).collect()}
    assert acc(False) == {"hard": 1, "soft": 0, "x": 0} and acc(True) == {"hard": 1, "soft": 1, "x": 0}


def test_run_timestamp(spark):
    df = spark.createDataFrame([("a/run_20240322_123456.jsonl",), ("b_77.json",), ("plain.json",)], "n string")
    assert [r[0] for r in df.select(runs.run_timestamp(F.col("n"))).collect()] == ["20240322_123456", "77", "plain"]


def test_suggestions_by_brute_force(spark):
    cat = spark.createDataFrame([(x,) for x in ("Zone Air Temperature", "Zone Air Humidity", "Site Wind Speed", "ab")], "name string")
    bad = spark.createDataFrame([("zone air temprature",), ("ac",), ("qqqq",)], "n string")
    key = lambda d: sorted(map(tuple, d.collect()))
    low = cat.select(F.lower("name").alias("suggestion")).distinct()
    pairs = bad.select(F.lower("n").alias("name")).distinct().crossJoin(low).withColumn("s", F.round(edit_ratio(F.col("name"), F.col("suggestion")), 9))
    best = pairs.filter("s >= 0.5").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("s"), "suggestion"))).filter("rank <= 5")
    assert key(outputs.suggestions(bad, "n", cat, cut=0.5)) == key(best.select("name", "suggestion", F.round("s", 6).alias("similarity"), "rank")) != []
