"""Plans and results that hold at sizes the small tables don't show."""

import random
import re

from oracle import compare, connect
from pyspark.sql import functions as F

from waymark.functions import skew
from waymark.functions.skew import kept_here, spread
from waymark.operators import augment, build, checks, dag_checks, facts, graph, pages, replay, replies, riddles
from waymark.plans import catalog
from waymark.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- pages ---------------------------------------------------------------------------------


def test_costly_rows_are_dealt_over_tasks(spark, tmp_path):
    spark.range(100).selectExpr("id k", "concat('n', id) name").coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    dealt = spread(table, "k", rows=9)
    assert (table.rdd.getNumPartitions(), dealt.rdd.getNumPartitions()) == (1, 12)
    text = plan(dealt.withColumn("text", kept_here(F.upper("name"))).where("text <> 'N3'").select("k"))
    # the condition is above the exchange (plans read from the top)
    assert text.index("Filter") < text.index("Exchange")
    assert sorted(r.k for r in dealt.where("k % 2 = 0").collect()) == list(range(0, 100, 2))


# --- joins with unpacked arrays -----------------------------------------------------------------


def _facts(spark):
    rows = [("u1", 0, "the country", " "), ("u1", 1, "the size", "5"), ("u1", 2, "the size of it", "7"), ("u2", 0, "the name", "[1]")]
    return spark.createDataFrame(rows, "url string, pos int, description string, value string").withColumn("value_type", F.lit("text"))


def test_unpacked_facts_are_not_broadcast(spark):
    hints = spark.createDataFrame([(1, "u1", "the size")], "hint_id int, url string, hint string")
    assert "BroadcastHashJoin" not in plan(facts.hint_scores(hints, _facts(spark)))


def test_facts_of_stops_that_share_a_hint(spark):
    hints = spark.createDataFrame(
        [(1, 1, "u1", "the country"), (1, 2, "u1", "the size"), (2, 3, "u1", "the size"), (3, 4, "u2", "the name"), (3, 5, "u1", "size"), (4, 6, "u1", None), (5, 7, "u1", "")],
        "trail_id int, hint_id int, url string, hint string",
    )
    best = {r.hint_id: (r.pos, r.hint) for r in facts.best_facts(hints, _facts(spark)).collect()}
    assert best == {1: (0, "the country"), 2: (1, "the size"), 3: (1, "the size"), 4: (0, "the name"), 5: (1, "size")}
    chosen = facts.choose_facts(hints, _facts(spark))
    # a blank best value gives way to the first usable fact; page u2 has none, so trail 3 is dropped
    assert {r.hint_id: (r.trail_id, r.pos, r.value) for r in chosen.collect()} == {1: (1, 1, "5"), 2: (1, 1, "5"), 3: (2, 1, "5"), 6: (4, 1, "5"), 7: (5, 1, "5")}


def test_links_are_not_broadcast(spark):
    links = spark.createDataFrame([("a", 0, "x", "b"), ("a", 1, "y", "b")], "url string, pos int, text string, target_url string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    texts = graph.link_texts(pairs, links)
    values = graph.links_in_values(spark.createDataFrame([("a", "k", "an X")], "url string, key string, value string"), links)
    assert "BroadcastHashJoin" not in plan(texts) + plan(values)
    assert {(r.src, r.link_text) for r in texts.collect()} == {("a", "x"), ("b", None)}
    assert [r.pos for r in values.collect()] == [0]


def test_documents_that_only_begin_with_json(spark):
    good = ["{}", "[1]", " 12 ", '"a"', "null", '{"a": 1, "b": [2, {"c": "d"}]}', "-1.5e3", "true"]
    bad = [None, "", " ", "12 monkeys", "1],[2", '1,"b":0', '1,"a":2', '1}{"a":2', "[1] x", '"a" b', "{", "true story", '{"a": 1} {"b": 2}']
    d = spark.createDataFrame(list(enumerate(good + bad)), "trail_id int, text string")
    assert sorted(r.trail_id for r in checks.invalid_documents(d).collect()) == list(range(len(good), len(good) + len(bad)))


def test_values_of_pages_with_long_numbers(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    con = connect(small)
    part = spark.read.parquet(f"{small}/part.parquet").withColumn("p_partkey", F.col("p_partkey") % 16 + 3990).dropDuplicates(["p_partkey"])
    part.write.parquet(str(tmp_path / "part.parquet"))
    con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert compare(spark, con, catalog.QUERIES["verified_values"], catalog.SQL["verified_values"], str(tmp_path))[0] == ""


def test_stored_documents_are_packed(spark, tmp_path):
    documents = spark.range(100).selectExpr("'easy' level", """concat('{"stops":[],"trail_id":"', id, '","difficulty":{"level":"easy"}}') value""")
    writers.write_trails(documents, str(tmp_path / "d"))
    assert {p.suffix for p in (tmp_path / "d").rglob("part-*")} == {".gz"}
    assert {r.sample_id for r in readers.read_document_lines(spark, str(tmp_path / "d")).collect()} == {f"easy/{i}" for i in range(100)}


def test_a_crawl_keeps_its_budget_over_levels(spark):
    links = spark.createDataFrame([(f"https://en.wikipedia.org/wiki/P{i}", 0, f"https://en.wikipedia.org/wiki/P{i + 1}") for i in range(6)], "url string, pos int, target_url string")
    links = links.withColumn("section", F.lit("Body"))
    known = spark.range(7).select(F.concat(F.lit("https://en.wikipedia.org/wiki/P"), F.col("id").cast("string")).alias("url"), (F.col("id") == 1).alias("cached"))
    seeds = known.where("endswith(url, 'P0')").select(F.lit(1).alias("graph_id"), "url")
    out = graph.crawl(links, known, seeds, max_depth=5, max_pages=3)
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.url[-2:], r.depth, r.fetched) for r in out.collect()) == [("P0", 0, True), ("P1", 1, False), ("P2", 2, True), ("P3", 3, True)]


def test_pages_cross_in_small_batches(spark):
    p = spark.range(3).selectExpr("id page_id", "'<p>a</p>' html", "'t' title")
    pages.pages_to_markdown(p)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_trial_files_are_opened_once(spark, tmp_path):
    for k in range(3):
        for name, text in (("result.json", "{}"), ("verifier/reward.json", '{"status": "correct"}'), ("agent/trajectory.json", '{"steps": [{"source": "agent"}]}')):
            file = tmp_path / f"easy-{k}__x" / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
    parts = readers.read_trials(spark, str(tmp_path))
    assert all(str(tmp_path) not in f for p in parts for f in p.inputFiles())
    assert [p.count() for p in parts] == [3, 3, 3, 0]
    assert readers.read_job_config(spark, str(tmp_path)).count() == 0


def test_reply_documents_are_dealt_over_tasks(spark, tmp_path):
    spark.range(10_001).selectExpr("id c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    values = catalog.QUERIES["reply_values"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in plan(values)
    assert values.groupBy("case_id").count().where("count = 10001").count() == 19


def test_chains_of_stops_are_written_packed_and_not_broadcast(spark):
    stops = spark.createDataFrame([(1, 0), (1, 1)], "trail_id bigint, stop_index bigint")
    steps = spark.createDataFrame([(1, 1, 0, "countries_area", {"country": "France"})], "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>")
    chained = augment.attach_chains(stops, steps)
    assert "BroadcastHashJoin" not in plan(chained)
    replies = spark.createDataFrame([("countries_area", {"country": "France"}, '{"area_km2": 5.5}', None)], "tool_name string, args map<string,string>, output string, error string")
    got = augment._values(chained.where("chain IS NOT NULL"), replies, ["trail_id", "stop_index"])
    assert [(r.stop_index, r.value) for r in got.collect()] == [(1, "5.5")]
    assert any(f.endswith(".zstd.parquet") for f in got.inputFiles())


def test_equal_chains_are_replayed_once(spark, monkeypatch):
    seen = []
    once = replies._replayed
    monkeypatch.setattr(replies, "_replayed", lambda chains, *a: (seen.append(chains.count()), once(chains, *a))[1])
    steps = spark.range(50).selectExpr("id trail_id", "id % 3 stop_index", "0 step", "'countries_area' tool_name", "map('country', if(id % 2 = 0, 'France', 'Peru')) args", "string(null) output_key")
    known = spark.createDataFrame([("countries_area", {"country": "France"}, '{"area_km2": 5.5}', None)], "tool_name string, args map<string,string>, output string, error string")
    got = replies.replay_chains(steps, known, max_steps=1).collect()
    assert seen == [2]
    assert sorted((r.trail_id, r.value) for r in got) == [(i, "5.5" if i % 2 == 0 else None) for i in range(50)]


def _dated(spark):
    stops = spark.createDataFrame([(1, 0, "u1"), (1, 4, "u1"), (2, 3, "u1"), (2, 5, "u3")], "trail_id bigint, stop_index bigint, url string")
    days = spark.createDataFrame([(1, i % 4, f"2020-01-{i + 1:02}") for i in range(9)] + [(2, 3, "2021-01-01"), (2, 1, "2021-01-02")], "trail_id bigint, stop_index bigint, day string")
    return stops, days.withColumn("day", F.col("day").cast("date"))


def test_days_of_trails_with_many_of_them(spark, monkeypatch):
    stops, days = _dated(spark)
    # a page that no stop names is not read
    box = F.when(F.col("url") == "u2", F.raise_error(F.lit("read"))).otherwise(F.array(F.struct(F.lit("Founded").alias("key"), F.lit("4 May 1901").alias("value"))))
    info = spark.createDataFrame([("u1", "In 2012."), ("u2", ""), ("u3", None)], "url string, first_paragraph string").withColumn("infobox", box)
    arrays = sorted(facts.tool_dates(stops, info, days).collect())
    assert {(r.trail_id, r.stop_index): r.candidates for r in arrays if r.template == "date_computation"} == {(1, 0): 1, (1, 4): 10, (2, 3): 2, (2, 5): 3}
    for rows in (0, 5):
        monkeypatch.setattr(facts, "ARRAY_ROWS", rows)
        assert sorted(facts.tool_dates(stops, info, days).collect()) == arrays


def test_drawn_values_of_trails_with_many_of_them(spark, monkeypatch):
    stops, days = _dated(spark)
    values = days.select("trail_id", "stop_index", F.col("day").cast("string").alias("value"))
    arrays = sorted(build.draw_earlier(stops, values, "drawn", extra=F.col("url")).collect())
    assert [r.drawn is not None for r in arrays] == [True] * 4 and arrays[0].drawn == "u1"
    for rows in (0, 5):
        monkeypatch.setattr(build, "ARRAY_ROWS", rows)
        assert sorted(build.draw_earlier(stops, values, "drawn", extra=F.col("url")).collect()) == arrays


def test_entities_of_pages_are_broadcast_only_when_counted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(skew, "HELD_ROWS", 0)
    cut = build.cut_lineage
    monkeypatch.setattr(build, "cut_lineage", lambda df: (seen.append(plan(df)), cut(df))[1])
    planned = spark.createDataFrame([(1, 0, "page", None, "u1"), (1, 1, "tool", "place_rating", "u1")], "trail_id bigint, stop_index bigint, type string, tool_type string, url string")
    chosen = spark.createDataFrame([(1, 0, "d", "infobox", "5", "number")], "trail_id bigint, stop_index bigint, description string, section string, value string, value_type string")
    info = spark.createDataFrame([("u1", "Lake City", []), ("u2", "Peru", [])], "url string, title string, infobox array<struct<key string, value string, numeric_value double>>")
    dates = spark.createDataFrame([], "trail_id bigint, stop_index bigint, template string, day date")
    out = build.stops_from_plan(planned, chosen, info, dates).collect()
    assert [(r.stop_index, r.stop_type, r.template) for r in out] == [(0, "page", None), (1, "tool", "place_rating")]
    assert len(seen) == 2 and "BroadcastHashJoin" not in "".join(seen)


def test_small_trails_are_walked_in_their_row(spark, monkeypatch):
    rnd = random.Random(5)
    nodes, edges, expected = [], [], set()
    for t in range(40):
        n = rnd.choice([1, 3, 6, 20, 62])
        mine = [i for i in range(n) if i == n - 1 or rnd.random() < 0.9]
        links = [(i, rnd.choice([None, -1, n + 3, *range(n)])) for i in range(n + 1) for _ in range(rnd.choice([0, 1, 1, 2]))]
        nodes += [(t, i) for i in mine]
        edges += [(t, i, d) for i, d in links]
        bears = {i for i, _ in links}
        if not any(all(d is None or not 0 <= d < i for k, d in links if k == i) for i in bears):
            continue
        known = set(mine) | {i for i, d in links if d is not None}
        seen = (set(mine) - bears) or ({0} & known)
        while True:
            more = {i for i, d in links if d in seen} - seen
            if not more:
                break
            seen |= more
        expected |= {(t, i) for i in mine if i not in seen}
    stops = spark.createDataFrame(nodes, "trail_id bigint, stop_index bigint")
    deps = spark.createDataFrame(edges, "trail_id bigint, stop_index bigint, dep bigint")
    # rounds are for larger trails only
    monkeypatch.setattr(dag_checks, "_walked", None)
    lost = dag_checks.unreachable_stops(stops, deps)
    assert sorted((r.trail_id, r.stop_index) for r in lost.collect()) == sorted(expected)
    assert expected


def test_replies_of_plans_are_parsed_once(spark):
    replies = [(1, '```json\n[{"page_or_topic": "Lake", "what_to_find": "HEIGHT above sea", "tool_or_method": "Formula"}]\n```'), (2, "none"), (3, "[]"), (4, '[{"what_to_find": "mo", "tool_or_method": "d"}]')]
    plans = spark.createDataFrame(replies, "trail_id bigint, reply string")
    assert plan(riddles.plan_steps(plans)).count("try_parse_json") <= 1
    stops = spark.createDataFrame([(t, 0, k, "x/wiki/Lake") for t, k in ((1, "compute"), (2, "page"), (3, "page"), (4, "reason"))], "trail_id bigint, stop_index bigint, stop_type string, page_url string")
    chain = spark.createDataFrame([], "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>, output_key string")
    got = riddles.alignment(stops, chain, plans)
    assert "parse_json" not in plan(got)
    # trail 4: step count alone; "mo" and "d" of two fields are no formula word
    assert {r.trail_id: r.alignment for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.25}
    assert sorted((r.trail_id, r.kind) for r in riddles.step_tool_types(riddles.plan_steps(plans)).collect()) == [(1, "computation"), (1, "elevation")]


def test_reasons_are_drawn_once(spark, monkeypatch):
    seen = []
    store = build.written
    monkeypatch.setattr(build, "written", lambda df, name: (seen.append(name), store(df, name))[1])
    stops = spark.createDataFrame([(1, i, "page", f"u{i}", str(1000 + 7 * i), "number") for i in range(9)], "trail_id bigint, stop_index bigint, stop_type string, page_url string, value_str string, value_type string")
    trails = spark.createDataFrame([(1, "easy")], "trail_id bigint, level string")
    out = build.insert_reasons(stops, trails)
    assert seen == ["reason-sources", "reasons"] and "array_sort" not in plan(out.where("reason_transform IS NOT NULL")).split("reason_transform")[0]
    assert sorted(r.stop_index for r in out.collect()) == list(range(out.count()))


def test_contexts_do_not_gather_stops_of_a_page(spark):
    stops = spark.createDataFrame([(1, 0, "page", "u1", "number", "search_query", "q", None, None), (1, 1, "page", "u2", "text", "search_query", "", None, None)], "trail_id bigint, stop_index bigint, stop_type string, page_url string, value_type string, bridge_type string, search_query string, expression string, reason_source_stop bigint")
    pages_of = spark.createDataFrame([("u1", "A", "first"), ("u2", "B", "second"), ("u3", "C", "third")], "url string, title string, first_paragraph string")
    links = spark.createDataFrame([("u1", 1, "link", "u2")], "url string, pos bigint, text string, target_url string")
    chain = spark.createDataFrame([], "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>")
    deps = spark.createDataFrame([], "trail_id bigint, stop_index bigint, dep bigint")
    out = riddles.stop_contexts(stops, pages_of, links, chain, deps)
    assert not re.search(r"SortMergeJoin \[(page|next)_url", plan(out))
    assert {r.stop_index: r.context.count("\n") for r in out.collect()} == {0: 6, 1: 3}


def test_texts_of_pages_are_not_broadcast(spark, tmp_path):
    stops = spark.createDataFrame(
        [(1, 0, "u1", "number", "1012"), (1, 1, "u1", "text", " Harbour"), (1, 2, "u2", "url", "none"), (1, 3, "u3", "text", "lost"), (1, 4, None, "text", "x"), (1, 5, "u1", "text", None)],
        "trail_id int, stop_index int, page_url string, value_type string, value_str string",
    )
    pages_of = spark.createDataFrame([("u1", "The harbour of 1,010 ships"), ("u2", "an x"), ("u4", None)], "url string, markdown string")
    stops.withColumn("extraction_section", F.lit(None).cast("string")).write.parquet(str(tmp_path / "stops"))
    pages_of.write.parquet(str(tmp_path / "pages"))
    out = facts.verify_values(spark.read.parquet(str(tmp_path / "stops")), spark.read.parquet(str(tmp_path / "pages")))
    # left are the urls of pages and the places of many values, both counted; texts, their numbers and what is found are shuffled
    assert plan(out).count("BroadcastHashJoin") <= 2
    assert {r.stop_index: r.found for r in out.collect()} == {0: "1010", 1: "Harbour", 2: None, 5: None}


def test_places_of_inserted_stops_are_not_broadcast(spark, tmp_path):
    spark.sql("SELECT id DIV 4 trail_id, id % 4 stop_index, 'page' stop_type FROM range(12)").write.parquet(str(tmp_path / "stops"))
    spark.sql("SELECT id trail_id, 1L after, 0 seq, 'tool' stop_type FROM range(2)").write.parquet(str(tmp_path / "new"))
    out = build.insert_stops(spark.read.parquet(str(tmp_path / "stops")), spark.read.parquet(str(tmp_path / "new")))
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r.trail_id, r.stop_index) for r in out.collect()) == [(t, i) for t in range(3) for i in range(5 if t < 2 else 4)]
    assert {(r.trail_id, r.stop_index) for r in out.collect() if r.stop_type == "tool"} == {(0, 2), (1, 2)}


def test_trial_files_are_read_as_they_are_and_packed(spark, tmp_path):
    rows = [("a__x/result.json", '{"agent_result": {"n_input_tokens": 5}}'), ("a__x/verifier/reward.txt", " 1.0\n"), ("a__x/agent/trajectory.json", '{"steps": [{"source": "agent"}]}'), ("a__x/other.json", "{}"), ("a__x/result.json.old", "{}")]
    files = spark.createDataFrame(rows, "rel_path string, content string")
    plain = F.replace("rel_path", F.lit("a__x"), F.lit("b__x"))
    writers.pack_files(files, str(tmp_path))
    writers.write_files(files.withColumn("rel_path", plain), str(tmp_path))
    # many small files take one file per task
    assert len(list((tmp_path / "_packed").glob("part-*"))) <= files.rdd.getNumPartitions()
    got = [[tuple(r) for r in part.orderBy("trial").collect()] for part in readers.read_trials(spark, str(tmp_path))]
    assert [(r[0], r[2]) for r in got[0]] == [("a__x", 5), ("b__x", 5)]
    assert got[1:] == [[], [("a__x", "agent"), ("b__x", "agent")], [("a__x", "1.0"), ("b__x", "1.0")]]


def test_a_refresh_makes_no_copy_of_a_part(spark, tmp_path, monkeypatch):
    trails = spark.range(8).selectExpr("id trail_id", "'easy' level", "id passcode")
    stops = trails.selectExpr("trail_id", "0L stop_index", "'tool' stop_type", "string(trail_id) value_str", "double(trail_id) value_num")
    replay.write_store(trails, stops, str(tmp_path), parts=2)
    asides, store = {}, replay.written
    monkeypatch.setattr(replay, "written", lambda df, name: asides.setdefault(name, store(df, name)))
    monkeypatch.setattr("waymark.session.cut_lineage", lambda df: 1 / 0)
    monkeypatch.setattr(replay, "cut_lineage", lambda df: 1 / 0, raising=False)
    replayed = stops.selectExpr("trail_id", "stop_index", "stop_type", "value_str expected", "if(trail_id = 3, '5', value_str) actual", "true match", "string(null) error")
    assert len(replay.refresh_store(spark, str(tmp_path), replayed)) == 1
    # written aside are the replayed rows and of the values those that differ
    assert {k: v.count() for k, v in asides.items()} == {"replayed": 8, "good": 8, "new": 1}
    assert {r.trail_id: (r.value_str, r.value_num) for r in spark.read.parquet(str(tmp_path / "stops")).collect()} == {t: ("5", 5.0) if t == 3 else (str(t), float(t)) for t in range(8)}


def test_documents_are_not_parsed_while_they_are_built(spark, tmp_path):
    trails = spark.createDataFrame([(1, "easy", 3), (2, "hard", None)], "trail_id bigint, level string, passcode bigint")
    stops = spark.createDataFrame([(1, 0, 0, "tool", "string", 'a "}]', "text"), (1, 1, 1, "page", "int", "7", "number")], "trail_id bigint, stop_index bigint, stored_index bigint, stop_type string, value_kind string, value_str string, value_type string")
    chain = spark.createDataFrame([(1, 0, 1, "t1", {"b": "}"}), (1, 0, 0, "t0", {"a": "]}"})], "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>")
    deps = spark.createDataFrame([(1, 1, 0)], "trail_id bigint, stop_index bigint, dep bigint")
    out = writers.trail_documents(trails, stops, chain, deps)
    # left are the value of a stop and the metadata of a trail
    assert len(re.findall("parse_?json", plan(out), re.I)) <= 3
    writers.write_trails(out, str(tmp_path / "d"))
    back = readers.read_document_lines(spark, str(tmp_path / "d"))
    assert len(re.findall("parse_?json", plan(back), re.I)) == 1
    assert sorted((r.trail_id, r.passcode) for r in readers.trails(back).collect()) == [("1", 3), ("2", -1)]
    assert [(r.stop_index, r.value_str, r.value_kind) for r in readers.stops(back).orderBy("stop_index").collect()] == [(0, 'a "}]', "string"), (1, "7", "int")]
    assert [(r.step, r.tool_name, r.args) for r in readers.chain(back).orderBy("step").collect()] == [(0, "t0", {"a": "]}"}), (1, "t1", {"b": "}"})]
    assert [(r.stop_index, r.dep) for r in readers.deps(back).collect()] == [(1, 0)]
