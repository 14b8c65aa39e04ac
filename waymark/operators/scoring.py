"""Scoring of tool-call logs against golden trails: one reward row per trial.

Contracts: ``trails(trail_id, level, passcode)``, ``stops(trail_id, stop_index, stop_type, page_url,
value_str, value_num, ...)``, ``chain(trail_id, stop_index, step, tool_name, args)``,
``log(trial_id, seq, tool, args, success, url, result_preview)``, ``answers(trial_id, answer)``.
A trial id is the id of its trail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.skew import first_upto, running_sum
from waymark.functions.text import strip, visit_url
from waymark.functions.values import fixed_point, let, parse_number, round_even, share, to_float, whole
from waymark.session import cut_lineage


def trial_status(trails: DataFrame, answers: DataFrame) -> DataFrame:
    """Status, its reason and whether the trial was answered."""
    t = trails.select(F.col("trail_id").alias("trial_id"), "level", F.col("passcode").cast("string").alias("expected_answer"))
    a = F.col("answer")
    digit = F.rlike(a, F.lit(r"^\d\n?$"))
    right = a == F.col("expected_answer")
    return t.join(answers.select("trial_id", "answer"), "trial_id", "left").select(
        "trial_id",
        "level",
        a.alias("agent_answer"),
        "expected_answer",
        F.when(a.isNull() | (a == "") | ~digit, "unknown").when(right, "correct").otherwise("incorrect").alias("status"),
        F.when(a.isNull(), "no answer given")
        .when(a == "", "empty answer")
        .when(~digit, F.concat(F.lit("not a single digit: "), a))
        .otherwise("")
        .alias("status_reason"),
        F.when(a.isNotNull() & (a != ""), 1.0).otherwise(0.0).alias("answered"),
        F.when(digit & right, 1.0).otherwise(0.0).alias("reward"),
    )


def _items(stops: DataFrame, chain: DataFrame, log: DataFrame) -> DataFrame:
    """Golden and seen pages and tools as one tagged row set.

    One union and two partial aggregations replace four distinct joins. Rows of a trial
    are spread by (trial, kind, item), and combined before each shuffle.
    """

    def rows(df: DataFrame, trial: str, kind: str, item: Column, golden: int, **sums: Column) -> DataFrame:
        names = ("stops", "page_stops", "tool_stops", "reason_stops", "golden_steps", "calls", "valid_calls")
        zero = F.lit(0).cast("bigint")
        return df.select(
            F.col(trial).alias("trial_id"),
            F.lit(kind).alias("kind"),
            item.alias("item"),
            F.lit(golden).alias("golden"),
            F.lit(1 - golden).alias("seen"),
            *[sums.get(n, zero).cast("bigint").alias(n) for n in names],
        )

    kind = F.col("stop_type")
    is_page, is_tool = kind == "page", kind.isin("tool", "compute")
    page_item = F.when(is_page & (F.col("page_url") != ""), visit_url(F.col("page_url")))
    s = rows(
        stops, "trail_id", "page", page_item, 1,
        stops=F.lit(1), page_stops=is_page, tool_stops=is_tool, reason_stops=kind == "reason",
    )
    c = rows(chain, "trail_id", "tool", F.nullif(F.col("tool_name"), F.lit("")), 1, golden_steps=F.lit(1))
    calls = rows(
        log, "trial_id", "tool", F.col("tool"), 0,
        calls=F.lit(1), valid_calls=F.coalesce(F.col("success"), F.lit(False)),
    )
    urls = rows(log.where("url <> ''"), "trial_id", "page", visit_url(F.col("url")), 0)
    merged = s.unionByName(c).unionByName(calls).unionByName(urls)
    sums = [n for n in merged.columns if n not in ("trial_id", "kind", "item", "golden", "seen")]
    return merged.groupBy("trial_id", "kind", "item").agg(
        F.max("golden").alias("golden"), F.max("seen").alias("seen"), *[F.sum(n).alias(n) for n in sums]
    )


def coverage(stops: DataFrame, chain: DataFrame, log: DataFrame) -> DataFrame:
    """Counts of stops and calls, distinct golden pages visited and distinct golden tools used."""
    items = _items(stops, chain, log)
    named = F.col("item").isNotNull() & (F.col("golden") == 1)

    def count(kind: str, hit: bool) -> Column:
        cond = named & (F.col("kind") == kind)
        return F.count_if(cond & (F.col("seen") == 1) if hit else cond)

    out = items.groupBy("trial_id").agg(
        *[
            F.sum(n).alias(n)
            for n in ("stops", "page_stops", "tool_stops", "reason_stops", "golden_steps", "calls", "valid_calls")
        ],
        count("page", False).alias("golden_pages"),
        count("page", True).alias("seen_pages"),
        count("tool", False).alias("golden_tools"),
        count("tool", True).alias("seen_tools"),
    )
    return out.where("stops > 0 OR calls > 0")


def page_visit_rate(stops: DataFrame, log: DataFrame) -> DataFrame:
    """Distinct golden pages and how many of them were fetched, per trail with page stops."""
    golden = stops.where("stop_type = 'page' AND page_url <> ''").select(
        F.col("trail_id").alias("trial_id"), visit_url(F.col("page_url")).alias("url"), F.lit(1).alias("golden"), F.lit(0).alias("seen")
    )
    fetched = log.where("url <> ''").select("trial_id", visit_url(F.col("url")).alias("url"), F.lit(0).alias("golden"), F.lit(1).alias("seen"))
    return _rate(golden.unionByName(fetched), "url", "pages", "pages_visited")


def tool_use_rate(stops: DataFrame, chain: DataFrame, log: DataFrame) -> DataFrame:
    """Distinct golden tools and how many of them were called, per trail with tools."""
    kinds = stops.where("stop_type IN ('tool', 'compute')").select("trail_id", "stop_index")
    golden = chain.where("tool_name <> ''").join(kinds, ["trail_id", "stop_index"], "left_semi").select(
        F.col("trail_id").alias("trial_id"), "tool_name", F.lit(1).alias("golden"), F.lit(0).alias("seen")
    )
    called = log.select("trial_id", F.col("tool").alias("tool_name"), F.lit(0).alias("golden"), F.lit(1).alias("seen"))
    return _rate(golden.unionByName(called), "tool_name", "tools", "tools_used")


def _rate(tagged: DataFrame, item: str, total: str, rate: str) -> DataFrame:
    per_item = tagged.groupBy("trial_id", item).agg(F.max("golden").alias("golden"), F.max("seen").alias("seen"))
    return (
        per_item.where("golden = 1")
        .groupBy("trial_id")
        .agg(F.count(F.lit(1)).alias(total), F.sum("seen").alias("hits"))
        .select("trial_id", total, F.col("hits").cast("bigint").alias("hits"), share(F.col("hits"), F.col(total)).alias(rate))
    )


def call_counts(stops: DataFrame, log: DataFrame) -> DataFrame:
    """Calls and valid calls per trial, next to the golden stop counts."""
    s = stops.groupBy(F.col("trail_id").alias("trial_id")).agg(
        F.count(F.lit(1)).alias("stops_total"),
        F.count_if(F.col("stop_type") == "page").alias("page_stops"),
        F.count_if(F.col("stop_type").isin("tool", "compute")).alias("tool_stops"),
        F.count_if(F.col("stop_type") == "reason").alias("reason_stops"),
    )
    c = log.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("total_tool_calls"), F.count_if(F.col("success")).alias("valid_tool_calls")
    )
    return s.join(c, "trial_id", "left").fillna(0, ["total_tool_calls", "valid_tool_calls"])


def seen_names(log: DataFrame) -> DataFrame:
    """Distinct fetched URLs and called tools, one row each (sorted when shown)."""
    urls = log.where("url <> ''").select("trial_id", F.lit("url").alias("kind"), F.col("url").alias("name"))
    tools = log.select("trial_id", F.lit("tool").alias("kind"), F.col("tool").alias("name"))
    return urls.unionByName(tools).distinct()


# --- right calls ---------------------------------------------------------------------------


def args_match(golden: Column, agent: Column) -> Column:
    """Golden arguments against the arguments of a call.

    Empty golden arguments match. Keys starting with ``__`` and keys the call lacks are
    passed over; every other key must agree (one text contains the other, or numbers within
    1 %), and at least one key must have been compared.
    """
    named = F.filter(F.map_keys(golden), lambda k: ~F.startswith(k, F.lit("__")) & F.get(F.map_values(F.map_filter(agent, lambda a, _v: a == k)), 0).isNotNull())

    def agree(k: Column) -> Column:
        pair = F.struct(
            strip(F.lower(F.try_element_at(golden, k))).alias("g"), strip(F.lower(F.try_element_at(agent, k))).alias("a")
        )

        def judge(p: Column) -> Column:
            g, a = p["g"], p["a"]
            gn, an = (to_float(F.replace(x, F.lit(","), F.lit(""))) for x in (g, a))
            near = F.when(gn == 0, an == 0).otherwise(F.abs(gn - an) / F.abs(gn) < 0.01)
            inside = (g != "") & (a != "") & (F.contains(a, g) | F.contains(g, a))
            return inside | F.coalesce(near, F.lit(False))

        return let(pair, judge)

    empty = golden.isNull() | (F.size(golden) == 0)
    return empty | let(named, lambda ks: (F.size(ks) > 0) & F.forall(ks, agree))


def _args_key(args: Column) -> Column:
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))), F.lit("{}"))


def right_tool_calls(chain: DataFrame, log: DataFrame) -> DataFrame:
    """Golden steps claimed by calls: each call, in log order, takes the first free golden step
    with its tool and matching arguments.

    Steps and calls with equal tool and arguments are interchangeable, so both sides are first
    counted per (trial, tool, arguments). A golden class whose calls fit no other class is settled
    by ``least(steps, calls)``; only classes that compete for calls are walked in order, with
    the calls of a class cut to the number of golden steps they could ever claim.
    """
    key = ["trial_id", "tool"]
    g = chain.select(F.col("trail_id").alias("trial_id"), F.col("tool_name").alias("tool"), "stop_index", "step", _args_key(F.col("args")).alias("g_key"), "args")
    g_class = g.groupBy(*key, "g_key").agg(F.first("args").alias("g_args"), F.count(F.lit(1)).alias("steps"))
    l = log.select(*key, "seq", _args_key(F.col("args")).alias("c_key"), "args")
    l = l.join(g.select(*key).distinct(), key, "left_semi")
    c_class = l.groupBy(*key, "c_key").agg(F.first("args").alias("c_args"), F.count(F.lit(1)).alias("calls"))
    fits = g_class.join(c_class, key).where(args_match(F.col("g_args"), F.col("c_args"))).drop("g_args", "c_args")

    rivals = fits.groupBy(*key, "c_key").agg(F.count(F.lit(1)).alias("rivals"))
    marked = fits.join(rivals, [*key, "c_key"])
    per_class = marked.groupBy(*key, "g_key").agg(
        F.max("rivals").alias("rivals"), F.first("steps").alias("steps"), F.sum("calls").alias("calls")
    )
    alone = per_class.where("rivals = 1").select(*key, F.least("steps", "calls").alias("right"))
    contested = per_class.where("rivals > 1").select(*key, "g_key")

    # contested classes: calls that fit the same golden classes are interchangeable, so each such group keeps as many calls,
    # in log order, as there are contested steps; what is left is walked in one row per (trial, tool)
    g_rows = g.join(contested, [*key, "g_key"], "left_semi").select(*key, "g_key", F.struct("stop_index", "step").alias("at"))
    classes = g_rows.groupBy(*key, "g_key").agg(F.array_sort(F.collect_list("at")).alias("at"))
    sets = fits.join(classes.select(*key, "g_key", F.get("at", F.lit(0)).alias("first")), [*key, "g_key"])
    sets = sets.groupBy(*key, "c_key").agg(F.array_sort(F.collect_list("first")).alias("fit"))
    steps = classes.groupBy(*key).agg(F.array_sort(F.collect_list("at")).alias("classes"))  # by their first step
    bound = F.aggregate("classes", F.lit(0), lambda n, c: n + F.size(c))
    c_rows = l.select(*key, "c_key", "seq").join(sets, [*key, "c_key"]).join(steps.select(*key, bound.alias("bound")), key)
    c_rows = first_upto(c_rows.drop("c_key"), [*key, "fit"], [F.col("seq")], F.col("bound")).drop("bound")
    calls = c_rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "fit"))).alias("calls"))
    walked = calls.join(steps, key).select(*key, _greedy(F.col("calls"), F.col("classes")).alias("right"))
    found = alone.unionByName(walked).groupBy("trial_id").agg(F.sum("right").alias("right"))
    golden = g.groupBy("trial_id").agg(F.count(F.lit(1)).alias("golden_chain_length"))
    return golden.join(found, "trial_id", "left").select(
        "trial_id", F.coalesce("right", F.lit(0)).cast("bigint").alias("right_tool_calls"), "golden_chain_length"
    )


def _greedy(calls: Column, classes: Column) -> Column:
    """Number of steps that are taken when each call, in order, takes the first free step of a class it fits.

    ``classes`` are the steps of each class in order, by their first steps; a call names those it fits by these. The steps of a class are
    taken in order, so one counter per class says what is free: a call compares the next steps of its classes and moves one counter.
    """
    numbers = F.transform(classes, lambda c: F.get(c, F.lit(0)))
    fits = F.transform(calls, lambda call: F.transform(call["fit"], lambda f: (F.array_position(numbers, f) - 1).cast("int")))
    start = F.struct(F.transform(classes, lambda _c: F.lit(0)).alias("next"), F.lit(0).cast("bigint").alias("taken"))

    def take(state: Column, fit: Column) -> Column:
        free = F.filter(fit, lambda c: F.get(state["next"], c) < F.size(F.get(classes, c)))
        first = F.array_min(F.transform(free, lambda c: F.struct(F.get(F.get(classes, c), F.get(state["next"], c)).alias("at"), c.alias("cls"))))

        def moved(pick: Column) -> Column:
            ahead = F.transform(state["next"], lambda n, c: F.when(c == pick["cls"], n + 1).otherwise(n))
            return F.when(pick.isNull(), state).otherwise(F.struct(ahead.alias("next"), (state["taken"] + 1).alias("taken")))

        return let(first, moved)

    return let(F.struct(fits.alias("fits")), lambda x: F.aggregate(x["fits"], start, take)["taken"])


# --- intermediate values -------------------------------------------------------------------

# Least length of a window over a trial's joined previews, windows per salt, sought texts of a trial that are searched for one by one, and length of a gram.
WINDOW = 2048
WINDOWS_PER_SALT = 16
FEW_FORMS = 256
GRAM = 4


def value_forms(value: Column) -> Column:
    """Texts that count as a hit for a value: itself, and whole, one- and two-decimal forms."""
    num = to_float(F.replace(value, F.lit(","), F.lit("")))

    def forms(n: Column) -> Column:
        return F.array_compact(F.array(value, whole(n).cast("string"), fixed_point(n, 1), fixed_point(n, 2)))

    return F.when(value == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(let(F.when(F.abs(num) < F.lit(9.2e18), num), forms))
    )


def _windows(log: DataFrame, reach: DataFrame) -> DataFrame:
    """Windows (trial_id, block, text) over each trial's previews joined by blanks; neighbours share ``reach - 1`` characters.

    Any text of up to ``reach(trial_id, reach)`` characters that occurs in the joined previews lies inside a window. A
    window is at least as long as what it shares, so previews are copied twice at most.
    """
    previews = log.select("trial_id", "seq", F.concat(F.coalesce("result_preview", F.lit("")), F.lit(" ")).alias("text"))
    placed = running_sum(previews.join(reach, "trial_id"), ["trial_id"], [F.col("seq")], F.floor(F.col("seq") / 4096), F.length("text"), "start")
    size, shared = F.greatest(F.lit(WINDOW), F.col("reach")).cast("bigint"), F.col("reach").cast("bigint") - 1
    end = F.col("start") + F.length("text")
    sized = placed.withColumns({"size": size, "shared": shared, "end": end})
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("start") - F.col("size") - F.col("shared")) / F.col("size")) + 1)
    pieces = sized.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / F.col("size")))))
    low = F.greatest(F.col("start"), F.col("block") * F.col("size"))
    high = F.least(F.col("end"), (F.col("block") + 1) * F.col("size") + F.col("shared"))
    cut = pieces.select("trial_id", "block", "start", F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("part")).where("part <> ''")
    return cut.groupBy("trial_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("text"))


def _grams(text: Column) -> Column:
    """Distinct runs of 1 to ``GRAM`` characters of a text, found in one pass per length."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array(*runs)))


def _by_grams(forms: DataFrame, windows: DataFrame) -> DataFrame:
    """(trial, form) pairs that occur, by an index of grams: work grows with texts and windows, not with their product.

    A sought text is represented by the one of its grams that the fewest other texts of the trial have (a short text by itself). It meets
    the windows that have this gram in an equi-join on the gram's hash, and is looked for in these alone.
    """
    long_ones = F.filter(_grams(F.col("form")), lambda x: F.length(x) == F.least(F.length("form"), F.lit(GRAM)))
    each = forms.select("trial_id", "form", F.explode(long_ones).alias("text")).withColumn("gram", F.xxhash64("text"))
    shared = each.groupBy("trial_id", "gram").agg(F.count(F.lit(1)).alias("others"))
    probes = each.join(shared, ["trial_id", "gram"]).groupBy("trial_id", "form").agg(F.min_by("gram", F.struct("others", "gram")).alias("gram"))
    indexed = windows.select("trial_id", "block", F.explode(F.transform(_grams(F.col("text")), lambda x: F.xxhash64(x))).alias("gram"))
    met = indexed.join(probes, ["trial_id", "gram"]).groupBy("trial_id", "block").agg(F.collect_set("form").alias("forms"))
    found = windows.join(met, ["trial_id", "block"])
    return found.select("trial_id", F.explode(F.filter("forms", lambda f: F.contains(F.col("text"), f))).alias("form"))


def _found_forms(wanted: DataFrame, log: DataFrame, few: int) -> DataFrame:
    """(trial, form) pairs where the form occurs in the trial's previews joined by blanks.

    The windows of a trial that seeks ``few`` texts at most are searched for each of them, which takes less than a microsecond a text; those
    of a long log are dealt over salts, and the texts go to each of them. Trials that seek more go through an index of grams.
    """
    forms = wanted.select("trial_id", "form").distinct()
    sizes = forms.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("form")).alias("reach"))
    chars = log.groupBy("trial_id").agg(F.sum(F.length(F.coalesce("result_preview", F.lit(""))) + 1).alias("chars"))
    salts = chars.select("trial_id", F.ceil(F.col("chars") / (WINDOW * WINDOWS_PER_SALT)).cast("int").alias("salts"))
    windows = _windows(log, sizes.select("trial_id", "reach"))
    salted = windows.join(salts, "trial_id").withColumn("salt", F.pmod(F.col("block"), F.col("salts")).cast("int"))
    arrays = forms.join(sizes.where(F.col("n") <= few).select("trial_id"), "trial_id", "left_semi").groupBy("trial_id").agg(F.collect_list("form").alias("forms"))
    arrays = arrays.join(salts, "trial_id").select("trial_id", "forms", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    one_by_one = salted.select("trial_id", "salt", "text").join(arrays, ["trial_id", "salt"]).select("trial_id", F.explode(F.filter("forms", lambda f: F.contains(F.col("text"), f))).alias("form"))
    many = sizes.where(F.col("n") > few).select("trial_id")
    indexed = _by_grams(forms.join(many, "trial_id", "left_semi"), windows.join(many, "trial_id", "left_semi"))
    return one_by_one.unionByName(indexed).distinct()


def intermediate_values(stops: DataFrame, log: DataFrame, few: int = FEW_FORMS) -> DataFrame:
    """Golden values per trail, and how many of them occur in the trial's tool results. ``few`` changes the plan only (see :func:`_found_forms`)."""
    golden = stops.where("value_str IS NOT NULL").select(
        F.col("trail_id").alias("trial_id"), "stop_index", value_forms(strip(F.col("value_str"))).alias("forms")
    )
    golden = cut_lineage(golden)  # read for totals, sizes, arrays, probes and hits
    wanted = golden.join(log.select("trial_id").distinct(), "trial_id", "left_semi").select(
        "trial_id", "stop_index", F.explode("forms").alias("form")
    )
    hits = (
        wanted.join(_found_forms(wanted, log, few), ["trial_id", "form"], "left_semi")
        .select("trial_id", "stop_index")
        .distinct()
        .groupBy("trial_id")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    totals = golden.groupBy("trial_id").agg(F.count(F.lit(1)).alias("intermediate_total"))
    hit = F.coalesce("hits", F.lit(0))
    return totals.join(hits, "trial_id", "left").select(
        "trial_id",
        hit.alias("intermediate_correct"),
        "intermediate_total",
        share(hit, F.col("intermediate_total")).alias("intermediate_rate"),
    )


# --- reward row ----------------------------------------------------------------------------


def reward_rows(trails: DataFrame, stops: DataFrame, chain: DataFrame, log: DataFrame, answers: DataFrame) -> DataFrame:
    """The full reward row of every trial."""
    status = trial_status(trails, answers)
    cover = coverage(stops, chain, log)
    right = right_tool_calls(chain, log)
    values = intermediate_values(stops, log)
    zero = ["stops_total", "page_stops", "tool_stops", "reason_stops", "total_tool_calls", "valid_tool_calls",
            "right_tool_calls", "golden_chain_length", "intermediate_correct", "intermediate_total"]
    return (
        status.join(cover, "trial_id", "left")
        .join(right, "trial_id", "left")
        .join(values, "trial_id", "left")
        .select(
            "trial_id", "level", "reward", "status", "status_reason", "answered", "agent_answer", "expected_answer",
            F.col("stops").alias("stops_total"), "page_stops", "tool_stops", "reason_stops",
            F.col("calls").alias("total_tool_calls"), F.col("valid_calls").alias("valid_tool_calls"),
            "right_tool_calls", "golden_chain_length",
            share(F.col("seen_pages"), F.col("golden_pages")).alias("pages_visited"),
            share(F.col("seen_tools"), F.col("golden_tools")).alias("tools_used"),
            "intermediate_correct", "intermediate_total", "intermediate_rate",
        )
        .fillna(0, zero)
        .withColumn("ground_truth_steps", F.col("stops_total"))
    )


def score_by_level(trails: DataFrame, stops: DataFrame, chain: DataFrame, log: DataFrame, answers: DataFrame) -> DataFrame:
    """Trials, accuracy, visit rate, tool-use rate and mean calls per level."""
    rows = trial_status(trails, answers).join(coverage(stops, chain, log), "trial_id", "left")
    visited = F.when(F.col("golden_pages") > 0, F.col("seen_pages") / F.col("golden_pages"))
    used = F.when(F.col("golden_tools") > 0, F.col("seen_tools") / F.col("golden_tools"))
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("trials"),
        F.round(F.avg("reward") * 100, 4).alias("accuracy"),
        F.round(F.avg(visited) * 100, 4).alias("visit_rate"),
        F.round(F.avg(used) * 100, 4).alias("tool_use_rate"),
        F.round(F.avg(F.coalesce("calls", F.lit(0))), 4).alias("mean_calls"),
    )


# --- transcripts and agent runs ------------------------------------------------------------


def final_answers(messages: DataFrame) -> DataFrame:
    """Digit of the first ``Final Answer: d`` in an assistant message of each conversation."""
    digit = F.regexp_extract("text", r"(?Ui)Final\s+Answer\s*:\s*(\d)", 1)
    found = messages.where("role = 'assistant'").withColumn("digit", digit).where("digit <> ''")
    return found.groupBy("conv_id").agg(F.min_by(F.col("digit").cast("int"), F.col("turn")).alias("answer"))


def shape_calls(calls: DataFrame, text: str = "text", limit: int = 8000, preview: int = 500) -> DataFrame:
    """Tool results as kept in a run: long results marked as cut, plus a short preview."""
    t = F.col(text)
    shown = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n... (truncated)"))).otherwise(t)
    return calls.withColumn("result", shown).withColumn("result_preview", F.substring(t, 1, preview))


def log_rows(calls: DataFrame) -> DataFrame:
    """Tool-call log row: preview of 2,000 characters, full length, URL lifted out of the arguments."""
    return calls.select(
        "trial_id", "seq", "ts", "tool", "args", "success",
        F.substring("result", 1, 2000).alias("result_preview"),
        F.length("result").alias("result_len"),
        F.nullif(F.try_element_at("args", F.lit("url")), F.lit("")).alias("url"),
    )


def reply_success(replies: DataFrame, text: str = "result") -> DataFrame:
    """A reply failed when it is a short ``Error: `` text."""
    t = F.col(text)
    return replies.withColumn("success", ~(F.startswith(t, F.lit("Error: ")) & (F.length(t) < 200)))


def trail_metrics(stops: DataFrame, chain: DataFrame, calls: DataFrame) -> DataFrame:
    """Per trail: page stops whose exact URL was fetched, tool stops whose whole chain was called."""
    k = ["trail_id", "stop_index"]
    c = calls.withColumnRenamed("trial_id", "trail_id")
    urls = c.where("tool = 'fetch_webpage' AND url <> ''").select("trail_id", F.col("url").alias("page_url")).distinct()
    tools = c.select("trail_id", F.col("tool").alias("tool_name")).distinct()
    pages = stops.where("stop_type = 'page'").select(*k, "page_url").join(urls.withColumn("hit", F.lit(1)), ["trail_id", "page_url"], "left")
    page_sums = pages.groupBy("trail_id").agg(F.count(F.lit(1)).alias("total_page_stops"), F.count("hit").alias("pages_visited"))
    steps = chain.select(*k, "tool_name").join(tools.withColumn("hit", F.lit(1)), ["trail_id", "tool_name"], "left")
    done = steps.groupBy(*k).agg((F.count("hit") == F.count(F.lit(1))).alias("done"))
    tool_sums = stops.where("stop_type = 'tool'").select(*k).join(done, k, "left").groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("total_tool_stops"), F.count_if("done").alias("tools_completed")
    )
    base = stops.groupBy("trail_id").agg(F.count_if(F.col("stop_type") == "reason").alias("total_reason_stops"))
    n_calls = c.groupBy("trail_id").agg(F.count(F.lit(1)).alias("agent_tool_calls"))
    out = base.join(page_sums, "trail_id", "left").join(tool_sums, "trail_id", "left").join(n_calls, "trail_id", "left")
    out = out.fillna(0, ["total_page_stops", "pages_visited", "total_tool_stops", "tools_completed", "agent_tool_calls"])
    return out.withColumn(
        "page_visit_rate", F.when(F.col("total_page_stops") > 0, F.col("pages_visited") / F.col("total_page_stops"))
    ).withColumn(
        "tool_completion_rate", F.when(F.col("total_tool_stops") > 0, F.col("tools_completed") / F.col("total_tool_stops"))
    )


def compare_values(golden: Column, agent: Column, tolerance: float = 0.01) -> Column:
    """Struct (match, method) of the hybrid compare of two texts."""
    pair = F.struct(F.coalesce(strip(golden), F.lit("")).alias("g"), F.coalesce(strip(agent), F.lit("")).alias("a"))

    def judge(p: Column) -> Column:
        nums = F.struct(parse_number(p["g"]).alias("x"), parse_number(p["a"]).alias("y"))

        def by_number(n: Column) -> Column:
            x, y = n["x"], n["y"]
            near = F.when(x == 0, F.abs(y) <= tolerance).otherwise(F.abs(x - y) / F.abs(x) <= tolerance)
            both = x.isNotNull() & y.isNotNull()
            same = F.lower(p["g"]) == F.lower(p["a"])
            method = (
                F.when((p["g"] != "") & (p["g"] == p["a"]), "exact_match")
                .when(both & near, "numeric_match")
                .when(both, "numeric_mismatch")
                .when(same, "normalized_match")
                .otherwise("needs_llm_judge")
            )
            return F.struct(method.isin("exact_match", "numeric_match", "normalized_match").alias("match"), method.alias("method"))

        return let(nums, by_number)

    return let(pair, judge)


def per_stop_values(stops: DataFrame, chain: DataFrame, calls: DataFrame, result: str = "result_preview") -> DataFrame:
    """Agent value of each golden stop and how it compares.

    Tool stop: last result of the last tool of its chain; page stop: first result of fetching
    its URL; other stops have no agent value. Stops without a golden value are left out.
    """
    k = ["trail_id", "stop_index"]
    c = calls.select(F.col("trial_id").alias("trail_id"), "seq", "tool", "url", F.col(result).alias("agent_value"))
    last_tool = chain.groupBy(*k).agg(F.max_by("tool_name", "step").alias("tool"))
    by_tool = c.where("agent_value IS NOT NULL AND tool <> ''").groupBy("trail_id", "tool").agg(F.max_by("agent_value", "seq").alias("tool_value"))
    by_url = c.where("tool = 'fetch_webpage'").groupBy("trail_id", F.col("url").alias("page_url")).agg(F.min_by("agent_value", "seq").alias("page_value"))
    s = stops.where("value_str IS NOT NULL").select(*k, "stop_type", "page_url", F.col("value_str").alias("golden_value"))
    joined = s.join(last_tool, k, "left").join(by_tool, ["trail_id", "tool"], "left").join(by_url, ["trail_id", "page_url"], "left")
    value = F.when(F.col("stop_type") == "tool", F.col("tool_value")).when(F.col("stop_type") == "page", F.col("page_value"))
    verdict = F.when(F.col("agent_value").isNotNull(), compare_values(F.col("golden_value"), F.col("agent_value")))
    return joined.select(*k, "stop_type", "golden_value", value.alias("agent_value")).withColumn("verdict", verdict).select(
        *k, "stop_type", "golden_value", "agent_value",
        F.coalesce("verdict.match", F.lit(False)).alias("match"),
        F.coalesce("verdict.method", F.lit("no_agent_value")).alias("method"),
    )


def value_accuracy(per_stop: DataFrame) -> DataFrame:
    return per_stop.groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("stops_evaluated"),
        F.count_if("match").alias("stops_matched"),
        F.avg(F.col("match").cast("int")).alias("value_accuracy"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row over all runs: totals, accuracy, mean rates, mean steps (one digit, ties to even), step-limit hits.

    Rates are summed as decimals, so no order of the rows changes a mean.
    """

    def mean(rate: str) -> Column:
        return (F.sum(F.col(rate).cast("decimal(28,18)")).cast("double") / F.count(rate)).alias(f"avg_{rate}")

    runs = F.count(F.lit(1))
    return results.agg(
        F.count(F.lit(1)).alias("total_puzzles"),
        F.count_if("correct").alias("correct"),
        F.when(runs > 0, F.coalesce(F.sum(F.col("correct").cast("int")), F.lit(0)) / runs).otherwise(0.0).alias("accuracy"),
        F.when(F.count("page_visit_rate") > 0, mean("page_visit_rate")).alias("avg_page_visit_rate"),
        F.when(F.count("tool_completion_rate") > 0, mean("tool_completion_rate")).alias("avg_tool_completion_rate"),
        F.when(runs > 0, round_even(F.coalesce(F.sum(F.col("steps").cast("bigint")), F.lit(0)) / runs, 1)).otherwise(0.0).alias("avg_steps"),
        F.count_if("hit_step_limit").alias("step_limit_hits"),
    )


def accuracy_by_level(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("level", F.lit("unknown")).alias("level")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def prompt_table(trails: DataFrame, stops: DataFrame) -> DataFrame:
    """Prompt inputs per trail: text sections, expected digit, counts and step limit."""
    counts = stops.groupBy("trail_id").agg(
        F.count(F.lit(1)).alias("num_stops"), F.count_if(F.col("stop_type") == "tool").alias("num_tool_stops")
    )
    sections = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Start at: "), F.col("seed_url")),
        F.concat(F.lit("Clues:\n"), F.col("riddle")),
        F.lit("Answer with one digit."),
    )
    return trails.join(counts, "trail_id", "left").fillna(0, ["num_stops", "num_tool_stops"]).select(
        "trail_id", "level", sections.alias("prompt"), F.col("passcode").alias("expected_passcode"),
        "num_stops", "num_tool_stops", F.greatest(F.lit(10), 3 * F.col("num_stops")).cast("int").alias("step_limit"),
    )
