"""Jobs on small fixtures, most of them against brute force."""

import collections
import itertools
import json
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import numbers as nums
from waymark.functions import values as vals
from waymark.functions.skew import dense_index, first_upto, numbered, running_sum
from waymark.operators import augment, build, dag_checks, facts, graph, pages, quality, replay, replies, reports, riddles, scoring
from waymark.session import scratch_path
from waymark.sources import file_tree, readers, writers
from waymark.streaming import tool_log


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


# --- skew helpers --------------------------------------------------------------------------


def test_dense_index_on_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{i % 7}", rnd.randrange(10_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    got = {(r.k, r.a, r.b): (r.i, r.n) for r in dense_index(df, ["k"], [F.col("a"), F.col("b")], F.floor(F.col("a") / 500), "i", "n").collect()}
    for k in {r[0] for r in rows}:
        mine = sorted((a, b) for kk, a, b in rows if kk == k)
        assert [got[(k, a, b)] for a, b in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_numbered_splits_hot_keys(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.5 else f"k{i % 7}", rnd.randrange(10_000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    for limit in (10**6, 400):
        out = numbered(df, ["k"], [F.col("a"), F.col("b")], F.floor(F.col("a") / 500), "i", "n", hot_rows=limit)
        got = {(r.k, r.a, r.b): (r.i, r.n) for r in out.collect()}
        for k in {r[0] for r in rows}:
            mine = sorted((a, b) for kk, a, b in rows if kk == k)
            assert [got[(k, a, b)] for a, b in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_running_sum_and_column_limit(spark):
    df = spark.createDataFrame([("x", i, i % 3) for i in range(200)], "k string, a int, v int")
    got = {r.a: r.s for r in running_sum(df, ["k"], [F.col("a")], F.floor(F.col("a") / 16), F.col("v"), "s").collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(200)}
    cut = first_upto(df.withColumn("m", F.lit(5)), ["k"], [F.col("a")], F.col("m"))
    assert sorted(r.a for r in cut.collect()) == [0, 1, 2, 3, 4]


# --- numbers -------------------------------------------------------------------------------

MESSY = [
    ("$160", 160), ("4,369", 4369), ("0.30 mm", 0.3), ("$40 billion", 40e9), ("92%", 92), ("eleven", 11), ("over 2800", 2800), ("about 90%", 90), ("33⅓ rpm", 33 + 1 / 3),
    ("100–500 acres", 100), ("3,609 (2023)", 3609), ("857,000 speakers", 857000), ("1,300+", 1300), ("1/12", 1 / 12), ("3,990 lb (1,810 kg)", 3990), ("c. 80 million", 80e6),
    ("250 g/m2", 250), ("413.79 g·mol−1", 413.79), ("more than 13,000", 13000), ("no number", None), ("½", 0.5), ("-5", -5),
]


@pytest.mark.parametrize(("text", "want"), MESSY)
def test_parse_number(spark, text, want):
    got = one(spark, vals.parse_number(F.lit(text)))
    assert got == (None if want is None else pytest.approx(want))


DATES = [("on 2001-02-03.", "2001-02-03"), ("12 March 1999", "1999-03-12"), ("March 12, 1999", "1999-03-12"), ("1478–1519", None), ("1960s", None), ("44 BC", None), ("in 1987", "1987-01-01"), ("31 February 1999", "1999-01-01")]


@pytest.mark.parametrize(("text", "want"), DATES)
def test_parse_date(spark, text, want):
    got = one(spark, vals.parse_date(F.lit(text)))
    assert (got.isoformat() if got else None) == want


def test_lone_comma_is_no_number(spark):
    assert one(spark, vals.first_number(F.lit("a, b 5"))) is None
    assert one(spark, vals.first_number(F.lit("[8,849](/wiki/M) m"))) == 8849


def test_integer_transforms(spark):
    def primes(n):
        out, d = [], 2
        while d * d <= n:
            while n % d == 0:
                out.append(d)
                n //= d
            d += 1
        return out + ([n] if n > 1 else [])

    ns = [0, 1, 2, 4, 8, 9, 12, 18, 45, 75, 97, 1053, 1583, 1982, 2000, 3999, 4000, 87146, 2**31 + 11]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    n = F.col("n")
    rows = df.select("n", nums.next_prime(n).alias("np"), nums.num_divisors(n).alias("nd"), nums.sum_prime_factors(n).alias("sp"), nums.largest_prime_factor(n).alias("lp"), nums.roman_length(n).alias("rl")).collect()
    for r in rows:
        fs = primes(r.n)
        if r.n >= 2:
            c = r.n + 1
            while len(primes(c)) > 1:
                c += 1
            assert r.np == c
            assert r.sp == sum(set(fs))
            assert r.lp == (1 if fs.count(max(fs)) > 1 else max(fs))
        if 0 < r.n < 10**5:
            assert r.nd == sum(1 for i in range(1, r.n + 1) if r.n % i == 0)
    assert {r.n: r.rl for r in rows}[3999] == len("MMMCMXCIX")


def test_recompute_rejects_other_code(spark):
    assert one(spark, nums.recompute(F.lit("abs(3 - -4) % 10"))) == 7
    assert one(spark, nums.recompute(F.lit("__import__('os')"))) is None


# --- scoring -------------------------------------------------------------------------------


def brute_right(steps, calls):
    used = set()
    for tool, args in calls:
        for i, (gt, ga) in enumerate(steps):
            if i in used or gt != tool:
                continue
            keys = [k for k in ga if not k.startswith("__") and k in args]
            ok = not ga or (bool(keys) and all(ga[k].lower() in args[k].lower() or args[k].lower() in ga[k].lower() for k in keys))
            if ok:
                used.add(i)
                break
    return len(used)


def test_right_calls_match_brute_force(spark):
    rnd = random.Random(7)
    words = ["a", "ab", "abc", "b", "bc", "x"]
    chain, log, want = [], [], {}
    for trial in range(30):
        steps = [(rnd.choice("TU"), {} if rnd.random() < 0.15 else {"q": rnd.choice(words)} if rnd.random() < 0.9 else {"__from_previous": "z"}) for _ in range(rnd.randrange(1, 7))]
        calls = [(rnd.choice("TU"), {"q": rnd.choice(words)} if rnd.random() < 0.9 else {"r": "1"}) for _ in range(rnd.randrange(0, 10))]
        chain += [(trial, i // 2, i % 2, t, a) for i, (t, a) in enumerate(steps)]
        log += [(trial, i, t, a) for i, (t, a) in enumerate(calls)]
        want[trial] = (brute_right(steps, calls), len(steps))
    c = spark.createDataFrame(chain, "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>")
    l = spark.createDataFrame(log, "trial_id bigint, seq bigint, tool string, args map<string,string>")
    got = {r.trial_id: (r.right_tool_calls, r.golden_chain_length) for r in scoring.right_tool_calls(c, l).collect()}
    assert got == want


@pytest.mark.parametrize("few", [scoring.FEW_FORMS, 3, 0])
def test_intermediate_values_match_joined_text(spark, few):
    rnd = random.Random(3)
    stops, log, want = [], [], {}
    for trial in range(12):
        previews = [" ".join(rnd.choice(["12", "3", "New", "York", "7.50", ""]) for _ in range(rnd.randrange(1, 3))) for _ in range(rnd.randrange(1, 6))]
        values = [rnd.choice(["12 3", "New York", "123", "7.5", "3", "York New York", "1,2", ""]) for _ in range(70 if trial == 0 else 5)]
        text, hits = " ".join(previews), 0
        for v in values:
            forms = [v] if v else []
            try:
                x = float(v.replace(",", ""))
                forms += [str(int(x)), f"{x:.1f}", f"{x:.2f}"]
            except ValueError:
                pass
            hits += any(f in text for f in forms)
        stops += [(trial, i, v) for i, v in enumerate(values)]
        log += [(trial, i, p) for i, p in enumerate(previews)]
        want[trial] = (hits, len(values))
    s = spark.createDataFrame(stops, "trail_id bigint, stop_index bigint, value_str string")
    l = spark.createDataFrame(log, "trial_id bigint, seq bigint, result_preview string")
    got = {r.trial_id: (r.intermediate_correct, r.intermediate_total) for r in scoring.intermediate_values(s, l, few).collect()}
    assert got == want


# --- graph ---------------------------------------------------------------------------------


def test_crawl_keeps_queue_order_and_budget(spark):
    rnd = random.Random(5)
    P = "https://en.wikipedia.org/wiki/"
    names = [f"Page{c}{i}" for c in "ab" for i in range(30)]
    links = {n: [rnd.choice(names + ["Missing", "Physics"]) for _ in range(6)] for n in names}
    cached = {n for n in names if rnd.random() < 0.3}

    def brute(seed, depth, budget):
        from collections import deque

        queue, seen, fetched, out = deque([(seed, 0)]), {seed}, 0, []
        while queue and fetched < budget:
            n, d = queue.popleft()
            if n not in links:
                continue
            if n not in cached:
                fetched += 1
            out.append((n, d))
            if d < depth:
                for t in links[n]:
                    if t not in seen and t != "Physics":
                        seen.add(t)
                        queue.append((t, d + 1))
        return sorted(out)

    l = spark.createDataFrame([(P + n, i, "t", P + t, None) for n, ts in links.items() for i, t in enumerate(ts)], "url string, pos int, text string, target_url string, section string")
    p = spark.createDataFrame([(P + n, n in cached) for n in names], "url string, cached boolean")
    seeds = names[:4]
    s = spark.createDataFrame([(i, P + n) for i, n in enumerate(seeds)], "graph_id int, url string")
    got = graph.crawl(l, p, s, max_depth=3, max_pages=7).collect()
    for i, n in enumerate(seeds):
        assert sorted((r.url[len(P):], r.depth) for r in got if r.graph_id == i) == brute(n, 3, 7)


# --- pages ---------------------------------------------------------------------------------


def test_nested_elements_and_markdown(spark):
    html = "<script>a</script><scr<script>x</script>ipt>b</script><p>ok</p><!-- no --><link rel=x><svg></svg>"
    assert one(spark, pages.sanitize_html(F.lit(html))) == "<p>ok</p><svg></svg>"
    df = spark.createDataFrame([(1, "<h2>Head</h2><p><b>Bold</b> <a href='/wiki/X'>x</a></p><ul><li>one</li></ul><table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table>"), (2, "")], "page_id bigint, html string")
    md = {r.page_id: r.markdown for r in pages.pages_to_markdown(df).collect()}
    assert md[2] == "(No readable content found.)"
    for part in ("## Head", "**Bold**", "[x](/wiki/X)", "* one", "| K | V |", "| a | 1 |"):
        assert part in md[1]


def test_whole_text_or_window(spark):
    md = F.lit("x" * 50 + "\n| Height | 5 m |\n")
    assert len(one(spark, pages.infobox(md))) == 1
    assert len(one(spark, pages.infobox(md, window=20))) == 0


# --- building ------------------------------------------------------------------------------


def test_trim_keeps_pages_before_tools(spark):
    kinds = ["page", "tool", "page", "tool", "page", "page", "tool"]
    s = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "trail_id bigint, stop_index bigint, stop_type string")
    d = spark.createDataFrame([(1, 3, 6)], "trail_id bigint, depth_min int, depth int")
    assert [r.old_index for r in build.trim(s, d).orderBy("stop_index").collect()] == [0, 1, 2, 4, 5]


def test_diamond_dependencies(spark):
    rows = [(1, 0, "page", None, None, None), (1, 1, "tool", "branch", None, None), (1, 2, "tool", "branch", None, None), (1, 3, "tool", "merge", None, None), (1, 4, "reason", None, 3, None), (1, 5, "compute", None, None, [3, 4])]
    s = spark.createDataFrame(rows, "trail_id bigint, stop_index bigint, stop_type string, role string, reason_source_stop bigint, referenced_stops array<bigint>")
    edges = augment.dependencies(s)
    assert sorted((r.stop_index, r.dep) for r in edges.collect()) == [(1, 0), (2, 0), (3, 1), (3, 2), (4, 3), (5, 3), (5, 4)]
    assert dag_checks.unreachable_stops(s, edges).count() == 0
    cut = edges.where("NOT (stop_index = 1)").unionByName(spark.createDataFrame([(1, 1, 5)], "trail_id bigint, stop_index bigint, dep bigint"))
    assert [r.stop_index for r in dag_checks.unreachable_stops(s, cut).collect()] == []


def test_zero_coordinates_count_as_missing(spark):
    r = spark.createDataFrame([("maps_geocode", "c", '{"location":{"lat":0,"lng":5}}'), ("maps_geocode", "c", '{"location":{"lat":1.5,"lng":5}}')], "tool_name string, output_key string, output string")
    got = [x.value for x in replies.reply_values(r).collect()]
    assert got == ['{"location":{"lat":0,"lng":5}}', '{"latitude":"1.5","longitude":"5"}']


def test_adoption_prefers_first_seen_digit(spark):
    rows = [(1, 1, 0, 0.9, 4), (1, 2, 0, 0.8, 5), (1, 3, 0, 0.95, 4), (1, 4, 0, 0.99, 5)]
    a = spark.createDataFrame(rows, "trail_id bigint, attempt int, leaks int, alignment double, implied int")
    t = spark.createDataFrame([(1, 7)], "trail_id bigint, passcode bigint")
    r = riddles.adopt(a, t).first()
    assert (r.attempt, r.digit, r.outcome) == (3, 4, "adopted")


def test_section_search_is_optional(spark):
    s = spark.createDataFrame([(1, 0, "u", "text", "far", "Near")], "trail_id bigint, stop_index bigint, page_url string, value_type string, value_str string, extraction_section string")
    p = spark.createDataFrame([("u", "# Near\nhere\n## Other\nfar\n")], "url string, markdown string")
    assert facts.verify_values(s, p).first().found == "far"
    assert facts.verify_values(s, p, strict=True).first().found is None


# --- files ---------------------------------------------------------------------------------


def test_corpus_layouts(spark, tmp_path):
    doc = {"trail_id": "t", "riddle": "r", "passcode": 3, "difficulty": {"level": "hard"}, "stops": [{"index": 0, "extracted_value": 20.0, "depends_on": [1, "x"]}, {"extracted_value": None}]}
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.json").write_text(json.dumps(doc))
    (tmp_path / "flat" / "_skip.json").write_text(json.dumps(doc))
    (tmp_path / "flat" / "bad.json").write_text("{")
    (tmp_path / "deep" / "easy").mkdir(parents=True)
    (tmp_path / "deep" / "easy" / "b.json").write_text(json.dumps(doc))
    (tmp_path / "deep" / "top.json").write_text(json.dumps(doc))
    (tmp_path / "deep" / "easy" / "c.json").write_text(json.dumps({**doc, "riddle": ""}))
    flat = readers.read_documents(spark, str(tmp_path / "flat"))
    assert [r.sample_id for r in flat.collect()] == ["hard/a"]
    assert [r.sample_id for r in readers.read_documents(spark, str(tmp_path / "deep")).collect()] == ["easy/b"]
    assert [r.task_id for r in readers.read_tasks(spark, str(tmp_path / "deep"), "easy", 5).collect()] == ["easy-b"]
    s = readers.stops(flat).orderBy("stop_index").collect()
    assert (s[0].value_kind, s[0].value_str, s[0].value_num) == ("float", "20.0", 20.0)
    assert (s[1].value_kind, s[1].stop_type, s[1].bridge_type, s[1].value_type) == ("null", "page", "link_follow", "text")
    assert sorted((r.dep is None, r.dep) for r in readers.deps(flat).collect()) == [(False, 1), (True, None)]


def test_trial_folders(spark, tmp_path):
    def put(rel, text):
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("config.json", json.dumps({"agents": [{"name": "a1", "model_name": "m1"}]}))
    put("easy-1__x/result.json", json.dumps({"agent_result": {"n_input_tokens": 3, "n_output_tokens": 4}, "agent_execution": {"started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:00:02.5Z"}}))
    put("easy-1__x/agent/trajectory.json", json.dumps({"steps": [{"source": "agent"}, {"source": "user"}]}))
    put("easy-1__x/verifier/reward.json", json.dumps({"status": "correct", "answered": 1.0, "agent_answer": "3", "total_tool_calls": 2}))
    put("hard-2__y__z/result.json", json.dumps({"exception_info": {"type": "Timeout"}}))
    put("hard-2__y__z/verifier/reward.txt", "0.0\n")
    put("none-3__q/agent/trajectory.json", "{}")
    rows = {r.task_name: r for r in reports.trial_rows(*readers.read_trials(spark, str(tmp_path))).collect()}
    assert set(rows) == {"easy-1", "hard-2__y"}
    a, b = rows["easy-1"], rows["hard-2__y"]
    assert (a.level, a.status, a.n_total_tokens, a.agent_steps, a.wall_clock_sec, a.run_ok, a.answered) == ("easy", "correct", 7, 1, 2.5, True, True)
    assert (b.level, b.status, b.run_ok, b.total_tool_calls) == ("hard", "incorrect", False, 0)
    c = readers.read_job_config(spark, str(tmp_path)).first()
    assert (c.agent, c.model) == ("a1", "m1")


def test_seeds_cache_and_reports(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\n\n https://a \n")
    assert [r.url for r in readers.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["https://a"]
    (tmp_path / "none.txt").write_text("#\n")
    with pytest.raises(ValueError):
        readers.read_seeds(spark, str(tmp_path / "none.txt"))
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "k1.json").write_text(json.dumps({"title": "T", "raw_markdown": "m"}))
    (tmp_path / "index.jsonl").write_text('{"url":"u1","file":"k1.json"}\n{"url":"u2","file":"gone.json"}\n')
    assert [(r.url, r.title) for r in readers.read_page_cache(spark, str(tmp_path / "cache"), str(tmp_path / "index.jsonl")).collect()] == [("u1", "T")]
    r = spark.createDataFrame([("Total Cases", 2.0, 0)], "metric string, Overall double, position int")
    writers.write_report(r, str(tmp_path / "rep"))
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).first().metric == "Total Cases"


def test_sample_numbers(spark):
    f = spark.createDataFrame([("easy", "sample_009.json"), ("easy", "sample_010.json"), ("hard", "odd.json")], "level string, name string")
    assert {r.level: r.next_number for r in writers.next_sample_number(f).collect()} == {"easy": 11, "hard": 1}


def test_insertion_moves_references(spark):
    kinds = ["page", "page", "page", "page", "reason", "reason", "page"]
    s = spark.createDataFrame([(1, i, k, {4: 3, 5: 4}.get(i)) for i, k in enumerate(kinds)], "trail_id bigint, stop_index bigint, stop_type string, reason_source_stop bigint")
    new = spark.createDataFrame([(1, 0, 0, "page"), (1, 3, 0, "reason"), (1, 6, 0, "page")], "trail_id bigint, after bigint, seq int, stop_type string")
    out = build.insert_stops(s, new).orderBy("stop_index").collect()
    assert [r.stop_index for r in out] == list(range(10))
    assert {r.stop_index: r.reason_source_stop for r in out if r.stop_type == "reason"} == {5: 4, 6: 4, 7: 6}


# --- no caps -------------------------------------------------------------------------------


def test_primes_beyond_ten_to_the_twelve(spark):
    ns = [10**12 + 7, 10**12 + 39, 2**61 - 1, 2**63 - 1, (10**9 + 7) * (10**9 + 9), 999983**3, 9223372036854775783]
    n = F.col("n")
    df = spark.createDataFrame([(x,) for x in [*ns, None, -3]], "n bigint")
    got = {r.n: r for r in df.select("n", nums.next_prime(n).alias("np"), nums.num_divisors(n).alias("nd"), nums.sum_prime_factors(n).alias("sp"), nums.largest_prime_factor(n).alias("lp"), nums.largest_prime_factor(n, strict=True).alias("st")).collect()}
    assert got[10**12 + 7].sp == 34519 + 28969553
    assert (got[10**12 + 39].nd, got[10**12 + 39].lp, got[10**12 + 7].np) == (2, 10**12 + 39, 10**12 + 39)
    assert (got[2**61 - 1].nd, got[2**61 - 1].sp) == (2, 2**61 - 1)
    assert (got[2**63 - 1].nd, got[2**63 - 1].lp) == (96, 649657)
    assert got[(10**9 + 7) * (10**9 + 9)].sp == 2 * 10**9 + 16
    assert (got[999983**3].nd, got[999983**3].lp, got[999983**3].st) == (4, 1, 999983)
    assert got[9223372036854775783].np is None
    assert (got[None].np, got[None].nd, got[-3].np, got[-3].nd, got[-3].sp, got[-3].lp) == (None, None, 2, None, 0, -3)


def test_trim_keeps_what_the_depth_says(spark):
    stops = spark.createDataFrame([(1, i, "page" if i % 2 else "tool") for i in range(60)], "trail_id bigint, stop_index bigint, stop_type string")
    depths = spark.createDataFrame([(1, 3, 40)], "trail_id bigint, depth_min int, depth int")
    kept = build.trim(stops, depths).collect()
    assert len(kept) == 39
    assert sorted(r.stop_index for r in kept) == list(range(39))


def test_twelve_reasons_are_drawn(spark):
    stops = spark.createDataFrame([(1, i, "page", f"u{i}", str(1000 + 7 * i), "number") for i in range(40)], "trail_id bigint, stop_index bigint, stop_type string, page_url string, value_str string, value_type string")
    targets = spark.createDataFrame([(1, 12)], "trail_id bigint, target int")
    assert build.draw_reasons(stops, targets).count() == 12


def test_nested_elements_leave_to_the_last(spark):
    deep = "<script>z</script>"
    for _ in range(60):  # each removal joins the parts of another tag
        deep = f"<scr{deep}ipt>z</script>"
    assert one(spark, pages.sanitize_html(F.lit(f"a{deep}b"))) == "ab"


def test_a_long_chain_is_walked(spark):
    n = 1500
    stops = spark.range(n).select(F.lit(1).cast("bigint").alias("trail_id"), F.col("id").alias("stop_index"))
    # stop i leans on i - 1, but stop 700 on a later one; without a root, stop 0 is the root
    deps = spark.createDataFrame([(1, i, i - 1) for i in range(1, n) if i != 700] + [(1, 0, 700), (1, 700, 1400)], "trail_id bigint, stop_index bigint, dep bigint")
    lost = dag_checks.unreachable_stops(stops, deps)
    assert sorted(r.stop_index for r in lost.collect()) == list(range(700, n))


@pytest.mark.parametrize("few", [scoring.FEW_FORMS, 0])
def test_values_across_previews_and_a_hot_trial(spark, few):
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(words[100:400])
    stops = [(1, 0, long), (1, 1, "w250"), (1, 2, "w9 w10 w11"), (1, 3, "absent words"), (1, 4, "w2999"), (2, 0, "w5 w6"), *[(1, 100 + i, f"w{i * 7}") for i in range(150)]]
    s = spark.createDataFrame(stops, "trail_id bigint, stop_index bigint, value_str string")
    log = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)] + [(2, 0, "x w5"), (2, 1, None), (2, 2, "w6")], "trial_id bigint, seq bigint, result_preview string")
    got = {r.trial_id: (r.intermediate_correct, r.intermediate_total) for r in scoring.intermediate_values(s, log, few).collect()}
    assert got == {1: (154, 155), 2: (0, 1)}


def test_repeated_replies_do_not_repeat_stops(spark):
    chain = spark.createDataFrame([(1, 0, 0, "maps_elevation", {"address": "x"}, "result")], "trail_id bigint, stop_index bigint, step int, tool_name string, args map<string,string>, output_key string")
    reply = ("maps_elevation", {"address": "x"}, '{"elevation": 12}', None)
    df = spark.createDataFrame([reply, reply, ("maps_elevation", {"address": "x"}, '{"elevation": 13}', None)], "tool_name string, args map<string,string>, output string, error string")
    assert replies.replay_chains(chain, df).count() == 1


def test_right_calls_of_a_hot_trial(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("1L trail_id", "id stop_index", "0 step", "'T' tool_name", "map('q', if(id % 2 = 0, 'a', 'ab')) args")
    log = spark.range(n + 7).selectExpr("1L trial_id", "id seq", "'T' tool", "map('q', if(id % 3 = 0, 'ab', 'abc')) args")
    assert [tuple(r) for r in scoring.right_tool_calls(chain, log).collect()] == [(1, n, n)]


# --- streams -------------------------------------------------------------------------------


LOG_LINE = "trial_id bigint, seq bigint, tool string, success boolean, ts double, url string"


def lines(spark, path, rows):
    spark.createDataFrame(rows, LOG_LINE).write.mode("append").json(path)
    return tool_log.read_log_stream(spark, path)


def test_running_visits_equal_the_batch_rate_after_every_round(spark):
    pages = [(1, i, "page", f"https://x/{i}") for i in range(200)] + [(1, 200, "page", "https://x/7"), (2, 0, "page", "https://x/0"), (3, 0, "page", ""), (4, 0, "tool", "https://x/0")]
    stops = spark.createDataFrame(pages, "trail_id bigint, stop_index bigint, stop_type string, page_url string")
    bits = tool_log.golden_bits(stops)
    assert bits.count() == 201
    assert bits.groupBy("trial_id", "word", "bit").count().where("count > 1").isEmpty()
    path, target, state = (scratch_path(spark, x) for x in ("log", "visits", "state"))
    rows = []
    for r, ts in enumerate((1e9, 1e3, 2e9)):  # the second round is far too late, the third repeats the first
        new = [(1, 1000 * r + i, "fetch_webpage", True, ts + i, f"https://x/{i * (r % 2 + 1)}/") for i in range(0, 150, 2)]
        new += [(2, 1000 * r, "t", True, ts, "https://x/0" if r else None), (9, 1, "t", True, ts, "https://x/0")]
        rows += new
        tool_log.keep_visits(lines(spark, path, new), bits, target, state)
        words = spark.read.schema("trial_id bigint, word int, visited bigint, batch bigint").parquet(target)
        want = scoring.page_visit_rate(stops, spark.createDataFrame(rows, LOG_LINE))
        assert sorted(map(tuple, tool_log.visit_rates(words, bits).collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, tool_log.visit_rates(tool_log.visit_words(spark.createDataFrame(rows, LOG_LINE), bits), bits).collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_kept_and_a_repeated_batch_splits_the_same_way(spark):
    path, target, state = (scratch_path(spark, x) for x in ("log", "late", "state"))
    heard = tool_log.Arrivals("arrivals")
    spark.streams.addListener(heard)
    try:
        for ts in (10_000.0, 9_000.0, 20_000.0, 9_500.0):
            stream = lines(spark, path, [(1, i, "t", True, ts + i * 300, None) for i in range(3)] + [(1, 9, "t", True, None, None)])
            tool_log.split_late(stream, target, state)
        kept = tool_log.read_split(spark, target, stream.schema)
        late = sorted((r.batch, r.seq) for r in kept.where("late").collect())
        # the mark after the first batch is 10,000: what is 600 s behind the latest row
        assert late == [(b, i) for b in (1, 3) for i in range(3)]
        assert kept.count() == 16
        for _ in range(100):  # reports come on another thread
            if len(heard.batches) == 4:
                break
            time.sleep(0.1)
        assert {b: n for b, (n, _latest) in heard.batches.items()} == dict.fromkeys(range(4), 4)
    finally:
        spark.streams.removeListener(heard)


# --- values in pages -----------------------------------------------------------------------


def test_numbers_in_pages_match_brute_force(spark):
    rnd = random.Random(11)
    some = ["0", "-0", "0.009", "0.5", "-0.5", "0.994", "1.0", "1.009", "99", "100", "101", "-100", "1,000", "1e3", "990.5", "12345678", "-3.25", "+7", ",", "5.", "1e400"]
    pages_ = [(f"u{i}", " ".join(rnd.choice(some) + rnd.choice([" km", "", ";", "%"]) for _ in range(rnd.randrange(0, 25)))) for i in range(40)]
    stops = [(i, j, "page", f"u{i % 43}", "number", rnd.choice([*some, "x", None, "inf", "nan"])) for i in range(120) for j in range(3)]
    s = spark.createDataFrame(stops, "trail_id bigint, stop_index bigint, stop_type string, page_url string, value_type string, value_str string")
    p = spark.createDataFrame([*pages_, ("u0", "other 77"), ("u42", None)], "url string, markdown string")
    text = dict(pages_)

    def find(t, want):
        try:
            want = float(want)
        except (TypeError, ValueError):
            return None
        for m in re.findall(r"[-+]?[\d,]+\.?\d*", t):
            try:
                x = float(m.replace(",", ""))
            except ValueError:
                continue
            if x == 0 if want == 0 else abs(x - want) / max(abs(want), 1) < 0.01:
                return x
        return None

    want = {(i, j): find(text[u], v) for i, j, _t, u, _k, v in stops if u in text and u != "u0"}
    got = {(r.trail_id, r.stop_index): None if r.found is None else float(r.found) for r in facts.verify_values(s, p).collect() if r.trail_id % 43}
    assert got == want
    replayed = replay.replay_pages(s, p)
    assert replayed.count() == len(stops)
    assert replayed.where("error = 'page not found'").count() == sum(u in ("u40", "u41", "u42") for _i, _j, _t, u, _k, _v in stops)


# --- page sets -----------------------------------------------------------------------------


@pytest.mark.parametrize("listed", [0, 2, 5, 1000])
def test_exact_jaccard_matches_all_pairs(spark, listed):
    rnd = random.Random(2)
    rows = [(t, f"p{min(rnd.randrange(12), rnd.randrange(40))}") for t in range(40) for _ in range(rnd.randrange(1, 9))]
    rows += [(100, "p0"), (101, "p0"), (102, "lone"), (103, "x1"), (103, "x2"), (104, "x1"), (104, "x2"), (105, ""), (106, None)]
    sets = {}
    for t, p in rows:
        if p:
            sets.setdefault(t, set()).add(p)
    pairs = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets.values(), 2)]
    got = reports.exact_page_jaccard(spark.createDataFrame(rows, "trail_id bigint, page_url string"), listed).first()
    assert got.pairs == len(pairs)
    assert got.mean_jaccard == pytest.approx(sum(pairs) / len(pairs), rel=1e-12)
    assert got.disjoint_share == pytest.approx(sum(x == 0 for x in pairs) / len(pairs), rel=1e-12)


def test_exact_jaccard_of_few_trails(spark):
    one_trail = spark.createDataFrame([(1, "a"), (1, "b")], "trail_id bigint, page_url string")
    assert reports.exact_page_jaccard(one_trail).count() == 0
    assert reports.exact_page_jaccard(one_trail.limit(0)).count() == 0


# --- majority ------------------------------------------------------------------------------


def test_majority_of_hot_and_split_groups(spark):
    rnd = random.Random(8)
    rows = [("hot", "most") for _ in range(5001)] + [("hot", f"x{i}") for i in range(5000)] + [("half", "a"), ("half", "b"), ("null", None), ("null", None), ("null", ""), ("one", "")]
    rows += [(f"g{i}", rnd.choice(["a", "b", None])) for i in range(40) for _ in range(rnd.randrange(1, 6))]
    rnd.shuffle(rows)
    count, size = collections.Counter(rows), collections.Counter(k for k, _v in rows)
    want = sorted((k, n) for (k, _v), n in count.items() if 2 * n > size[k])
    got = quality.majority(spark.createDataFrame(rows, "k string, v string").repartition(7), "k", "v").collect()
    assert sorted(map(tuple, got)) == want


# --- files that appear all or not at all ---------------------------------------------------


def tree(path):
    return {str(p.relative_to(path)): p.read_text() for p in sorted(path.rglob("*")) if p.is_file() and not str(p.relative_to(path)).startswith("_")}


def test_files_of_a_failed_job_never_appear(spark, tmp_path):
    files = spark.range(40).selectExpr("concat('a', id % 4, '/', id, '.txt') rel_path", "concat('old ', id) content").repartition(4)
    writers.write_files(files, str(tmp_path))
    before = tree(tmp_path)
    assert len(before) == 40
    assert not list((tmp_path / "_staged").iterdir())

    broken = files.selectExpr("rel_path", "if(rel_path = 'a3/7.txt', raise_error('lost'), concat('new ', content)) content")
    with pytest.raises(Exception, match="lost"):
        writers.write_files(broken, str(tmp_path))
    assert tree(tmp_path) == before

    writers.write_files(files.selectExpr("rel_path", "cast(null as string) content").where("rel_path like 'a1/%'"), str(tmp_path))
    assert tree(tmp_path) == {k: "" if k.startswith("a1/") else v for k, v in before.items()}
    writers.write_files(files.limit(0), str(tmp_path))


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    sink = file_tree.FileTreeWriter(str(tmp_path), "job")
    rows = [pa.RecordBatch.from_pydict({"rel_path": [f"t/{i}" for i in range(k, k + 3)], "content": [f"{k}"] * 3}) for k in (0, 10)]
    lost = sink.write(iter(rows[:1]))  # its executor is gone before the driver hears of it
    again, other = sink.write(iter(rows[:1])), sink.write(iter(rows[1:]))
    sink.commit([again, None, other])
    assert {m["attempt"] for m in file_tree.manifest(str(tmp_path), "job")} == {again.name, other.name}
    assert tree(tmp_path) == {}
    # a first publishing stops half-way
    (tmp_path / "t").mkdir()
    (tmp_path / "_staged" / "job" / again.name / "t" / "0").rename(tmp_path / "t" / "0")
    for _ in range(2):
        file_tree.publish(spark, str(tmp_path), "job")
        assert tree(tmp_path) == {f"t/{i}": f"{k}" for k in (0, 10) for i in range(k, k + 3)}
    assert not (tmp_path / "_staged" / "job").exists()
    assert lost.files == 3


def test_a_refresh_writes_changed_parts_only(spark, tmp_path):
    trails = spark.range(40).selectExpr("id trail_id", "'easy' level", "id % 10 passcode")
    stops = trails.selectExpr("trail_id", "explode(array(0L, 1L)) stop_index", "'tool' stop_type").selectExpr("*", "string(trail_id) value_str", "double(trail_id) value_num")
    replay.write_store(trails, stops, str(tmp_path), parts=16)
    files = lambda: {p: p.stat().st_mtime_ns for n in ("trails", "stops") for p in (tmp_path / n).rglob("*.parquet")}
    rows = [(t, i, "tool", str(t), "77" if (t, i) == (3, 0) else "9" if (t, i) == (5, 1) else str(t), t != 7, None) for t in range(40) for i in range(2)]
    rows[14] = (7, 0, "page", "7", "700", False, "page not found")
    replayed = spark.createDataFrame(rows, "trail_id bigint, stop_index bigint, stop_type string, expected string, actual string, match boolean, error string")
    before = files()
    touched = replay.refresh_store(spark, str(tmp_path), replayed)
    part = {r.trail_id: r.part for r in spark.read.parquet(str(tmp_path / "trails")).collect()}
    assert set(touched) == {part[3], part[5]}
    same = {p for p, t in files().items() if before.get(p) == t}
    assert all(p in same for p in before if int(p.parent.name.split("=")[1]) not in touched)
    got = {(r.trail_id, r.stop_index): r.value_str for r in spark.read.parquet(str(tmp_path / "stops")).collect()}
    assert got == {(t, i): "77" if (t, i) == (3, 0) else "9" if (t, i) == (5, 1) else str(t) for t in range(40) for i in range(2)}
    codes = {r.trail_id: r.passcode for r in spark.read.parquet(str(tmp_path / "trails")).collect()}
    assert codes == {t: 9 if t == 5 else t % 10 for t in range(40)}
    assert replay.refresh_store(spark, str(tmp_path), replayed) == []
