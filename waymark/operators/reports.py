"""Reports over trial rows, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark import fixed
from waymark.functions.skew import draw_order, first_per_key
from waymark.operators.dims import level_order, texts
from waymark.session import cut_lineage

OVERALL = "Overall"
METRICS = [
    "Total Cases", "Run OK", "Correct", "Incorrect", "Unknown", "Accuracy (%)", "Answered (%)", "Avg Tool Calls",
    "Avg Valid Tool Calls", "Avg Right Tool Calls", "Avg Golden Chain Len", "Avg Pages Visited (%)", "Avg Tools Used (%)",
    "Avg Intermediate Value Rate (%)", "Avg Iterations (agent steps)", "Avg Tokens (total)", "Avg Ground Truth Steps",
    "Avg Wall Clock (sec)",
]


def trial_rows(results: DataFrame, rewards: DataFrame, steps: DataFrame, reward_texts: DataFrame) -> DataFrame:
    """One row per trial from its parts, all keyed by ``trial``.

    ``results(trial, exception_info, n_input_tokens, n_output_tokens, started_at, finished_at)`` is
    required for a trial to count; ``rewards`` holds reward rows, ``steps(trial, source)`` agent turns,
    ``reward_texts(trial, text)`` the plain reward used when no reward row exists.
    """
    turns = steps.where(F.col("source").isin("agent", "assistant")).groupBy("trial").agg(F.count(F.lit(1)).alias("agent_steps"))
    task = F.regexp_replace("trial", r"^(.*)__.*?$", "$1")
    level = F.coalesce(*[F.when(F.startswith(task, F.lit(x)), x) for x in fixed.LEVELS], F.lit("unknown"))
    seconds = (
        F.unix_micros(F.try_to_timestamp("finished_at")) - F.unix_micros(F.try_to_timestamp("started_at"))
    ) / 1e6
    text = F.col("text").try_cast("double")
    has_row = F.col("has_row").isNotNull()
    status = F.when(has_row, F.coalesce("status", F.lit("unknown"))).otherwise(
        F.coalesce(F.when(text == 1.0, "correct").when(text.isNotNull(), "incorrect"), F.lit("unknown"))
    )
    tokens_in, tokens_out = F.coalesce("n_input_tokens", F.lit(0)), F.coalesce("n_output_tokens", F.lit(0))
    counts = ["total_tool_calls", "valid_tool_calls", "right_tool_calls", "golden_chain_length", "intermediate_correct",
              "intermediate_total", "ground_truth_steps"]
    joined = (
        results.join(rewards.withColumn("has_row", F.lit(True)), "trial", "left")
        .join(turns, "trial", "left")
        .join(reward_texts, "trial", "left")
    )
    return joined.select(
        "trial",
        task.alias("task_name"),
        level.alias("level"),
        (F.coalesce("exception_info", F.lit("")) == "").alias("run_ok"),
        F.nullif(F.substring("exception_info", 1, 200), F.lit("")).alias("exception"),
        status.alias("status"),
        F.coalesce("status_reason", F.lit("")).alias("status_reason"),
        F.coalesce(F.col("answered") == 1.0, F.lit(False)).alias("answered"),
        "agent_answer",
        F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        "pages_visited", "tools_used", "intermediate_rate",
        tokens_in.alias("n_input_tokens"),
        tokens_out.alias("n_output_tokens"),
        (tokens_in + tokens_out).alias("n_total_tokens"),
        F.coalesce("agent_steps", F.lit(0)).alias("agent_steps"),
        F.coalesce(seconds, F.lit(0.0)).alias("wall_clock_sec"),
    )


def _summary() -> list[Column]:
    n = F.count(F.lit(1))

    # sums are of integers, so no order of the rows changes an average

    def even(total: Column, count: Column, digits: int) -> Column:
        """total / count in units of the last digit, ties to even."""
        rest = F.pmod(total, count)
        whole = ((total - rest).cast("decimal(38,0)") / count.cast("decimal(19,0)")).cast("bigint")
        up = (rest * 2 > count) | ((rest * 2 == count) & (F.pmod(whole, F.lit(2)) == 1))
        return (whole + up.cast("bigint")) / F.lit(10**digits)

    def mean(c: str) -> Column:
        return even(F.sum(F.col(c).cast("bigint")) * 100, n, 2)

    def seconds(c: str) -> Column:
        """Averages of microseconds."""
        return even(F.sum(F.round(F.col(c) * 1_000_000).cast("bigint")), n * 10_000, 2)

    def pct(cond: Column) -> Column:
        return even(F.count_if(cond) * 1000, n, 1)

    def rate(c: str) -> Column:
        """Averages of rates that have three digits."""
        return even(F.sum(F.round(F.col(c) * 1000).cast("bigint")), F.count(c), 1)
    status = F.col("status")
    values = [
        n, F.count_if("run_ok"), F.count_if(status == "correct"), F.count_if(status == "incorrect"),
        F.count_if(~status.isin("correct", "incorrect")), pct(status == "correct"), pct(F.col("answered")),
        mean("total_tool_calls"), mean("valid_tool_calls"), mean("right_tool_calls"), mean("golden_chain_length"),
        F.when(F.count("pages_visited") > 0, rate("pages_visited")), F.when(F.count("tools_used") > 0, rate("tools_used")),
        F.when(F.count("intermediate_rate") > 0, rate("intermediate_rate")), mean("agent_steps"), mean("n_total_tokens"),
        mean("ground_truth_steps"), seconds("wall_clock_sec"),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, METRICS)]


def group_report(trials: DataFrame) -> DataFrame:
    """18 metrics overall and per known level; averages are over all trials of a group."""
    known = F.when(F.col("level").isin(fixed.LEVELS), F.col("level"))
    t = trials.withColumn("level", F.coalesce(known, F.lit("unknown")))
    g = t.groupingSets([[], ["level"]], "level").agg(F.grouping("level").alias("__all"), *_summary())
    label = F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("level"))
    return g.withColumn("label", label).where("label <> 'unknown'").select("label", *METRICS)


def report_order(label: Column) -> Column:
    return F.when(label == OVERALL, -1).otherwise(level_order(label))


def report_long(report: DataFrame) -> DataFrame:
    """Metric rows by group columns."""
    long = report.unpivot("label", METRICS, "metric", "value")
    labels = [OVERALL, *fixed.LEVELS]
    return long.groupBy("metric").pivot("label", labels).agg(F.first("value")).withColumn(
        "position", F.array_position(texts(METRICS), F.col("metric")).cast("int")
    )


def per_trial(trials: DataFrame) -> DataFrame:
    """Display columns of every trial, by task name."""
    shown = F.when(
        F.col("intermediate_total") > 0,
        F.concat_ws("/", F.col("intermediate_correct").cast("string"), F.col("intermediate_total").cast("string")),
    ).otherwise("n/a")
    return trials.select(
        "task_name", "status", F.coalesce(F.nullif("agent_answer", F.lit("")), F.lit("-")).alias("answer"), "expected_answer",
        "total_tool_calls", "valid_tool_calls", "right_tool_calls", shown.alias("values_found"), "agent_steps", "wall_clock_sec",
    ).orderBy("task_name")


def unknown_reasons(trials: DataFrame, shown: int = 20) -> DataFrame:
    """First reasons per group in task order, and how many more there are."""
    t = trials.where("status NOT IN ('correct', 'incorrect') AND status_reason <> ''")
    reason = F.concat_ws(": ", F.col("task_name"), F.col("status_reason"))
    groups = F.array_compact(F.array(F.lit(OVERALL), F.when(F.col("level").isin(fixed.LEVELS), F.col("level"))))
    rows = t.select(F.explode(groups).alias("label"), "task_name", reason.alias("reason"))
    first = first_per_key(rows, ["label"], [F.col("task_name"), F.col("reason")], shown)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("task_name", "reason")))
    more = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shown)
    rest = more.select(
        "label", F.concat(F.lit("... and "), (F.col("n") - shown).cast("string"), F.lit(" more")).alias("reason"), F.lit(shown + 1).alias("rank")
    )
    return ranked.select("label", "rank", "reason").unionByName(rest)


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("level").agg(F.count(F.lit(1)).alias("tasks"))


def build_statistics(outcomes: DataFrame) -> DataFrame:
    """Build attempts by outcome (generated, build failed, golden failed, seed failed), plus the total."""
    return outcomes.rollup("outcome").agg(F.count(F.lit(1)).alias("times")).fillna("attempted", ["outcome"])


# --- corpus statistics ---------------------------------------------------------------------


def page_jaccard(stops: DataFrame, pairs: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean Jaccard index and share of disjoint pairs over sampled pairs of trails.

    Two md5 orders of the trails give the left and right ends; the k-th smallest of each form pair
    k. Only the sampled trails' pages are joined, so neither trail pairs nor pages shared by many
    trails are ever multiplied out.
    """
    sets = stops.where("page_url <> ''").select("trail_id", "page_url").distinct()
    ids = sets.select("trail_id").distinct()

    def end(salt: str, name: str) -> DataFrame:
        drawn = ids.select(F.col("trail_id").alias(name), draw_order(seed, salt, "trail_id").alias("draw")).orderBy("draw", name).limit(pairs)
        in_order = drawn.agg(F.array_sort(F.collect_list(F.struct("draw", name))).alias("drawn"))  # `pairs` ends at most
        return in_order.select(F.posexplode("drawn").alias("pair", "end")).select("pair", F.col(f"end.{name}").alias(name))

    sample = end("left", "a").join(end("right", "b"), "pair").where("a <> b")
    # both ends at most `pairs` rows, by the limits above
    ends = F.broadcast(sample.select("pair", F.inline(F.array(F.struct(F.col("a").alias("trail_id")), F.struct(F.col("b").alias("trail_id"))))))
    per_page = sets.join(ends, "trail_id").groupBy("pair", "page_url").agg(F.count(F.lit(1)).alias("n"))
    per_pair = per_page.groupBy("pair").agg(F.count_if(F.col("n") == 2).alias("both"), F.count(F.lit(1)).alias("either"))
    return per_pair.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col("both") / F.col("either")).alias("mean_jaccard"),
        F.avg((F.col("both") == 0).cast("int")).alias("disjoint_share"),
    )


#: Trails up to which the pairs that share a page are listed; the pages of more trails are counted.
LISTED = 100


def exact_page_jaccard(stops: DataFrame, listed: int = LISTED) -> DataFrame:
    """Mean Jaccard index and share of disjoint pairs over all pairs of trails, without going through the pairs.

    Pairs that share none of their pages add nothing. Pages of more than ``listed`` trails (popular ones) are handled by counting: let N(S, a)
    be the number of trails of ``a`` pages that have all popular pages in S. The sum of N(S, a) N(S, b) over all S of k pages counts each
    pair once for every k of its common popular pages, so inclusion and exclusion over k give the number of pairs for each (a, b, common
    pages). Pairs that meet on another page are listed (fewer than ``listed`` per row), and what counting took for them is corrected.
    Work grows with the rows times ``listed``, and with two to the number of popular pages in one trail.
    """
    sets = cut_lineage(stops.where("page_url <> ''").select("trail_id", F.col("page_url").alias("page")).distinct())
    popular = sets.groupBy("page").agg((F.count(F.lit(1)) > listed).alias("popular"))
    marked = sets.join(popular, "page")
    trails = cut_lineage(
        marked.groupBy("trail_id").agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list(F.when(F.col("popular"), F.col("page")))).alias("shared"))
    )

    # pairs by (a, b, common popular pages)
    classes = trails.where(F.size("shared") > 0).groupBy("pages", "shared").agg(F.count(F.lit(1)).alias("n"))
    masks = F.sequence(F.lit(1).cast("bigint"), F.expr("shiftleft(1L, size(shared)) - 1"))
    subset = F.filter("shared", lambda _p, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1)
    having = classes.withColumn("mask", F.explode(masks)).select(subset.alias("subset"), "pages", "n")
    sizes = having.groupBy("subset", "pages").agg(F.sum("n").alias("n")).groupBy(F.col("subset")).agg(F.array_sort(F.collect_list(F.struct("pages", "n"))).alias("by_size"))
    one = sizes.select(F.size("subset").alias("k"), F.posexplode("by_size").alias("at", "x"), "by_size")
    two = one.select("k", "x", F.explode(F.slice("by_size", F.col("at") + 1, F.size("by_size"))).alias("y"))
    x, y = F.col("x.n").cast("decimal(38,0)"), F.col("y.n").cast("decimal(38,0)")
    product = F.when(F.col("x.pages") == F.col("y.pages"), F.expr("CAST(x.n AS DECIMAL(20,0)) * (x.n - 1) / 2")).otherwise(x * y).cast("decimal(38,0)")
    counted = two.groupBy("k", F.col("x.pages").alias("a"), F.col("y.pages").alias("b")).agg(F.sum(product).alias("times"))
    signed = counted.withColumn("common", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("ways", F.expr("factorial(k) / factorial(common) / factorial(k - common) * if((k - common) % 2 = 0, 1, -1)"))
    cells = signed.groupBy("a", "b", "common").agg(F.sum(F.col("ways").cast("decimal(20,0)") * F.col("times")).cast("double").alias("n"))
    by_count = cells.select("n", (F.col("common") / (F.col("a") + F.col("b") - F.col("common"))).alias("jaccard"), F.col("n").alias("meeting"))

    # pairs that meet on another page
    rare = marked.where("NOT popular").select("page", "trail_id")
    met = rare.select("page", F.col("trail_id").alias("t")).join(rare.select("page", F.col("trail_id").alias("u")), "page").where("t < u")
    met = met.groupBy("t", "u").agg(F.count(F.lit(1)).alias("rare"))
    both = met.join(trails.toDF("t", "a", "s"), "t").join(trails.toDF("u", "b", "r"), "u").withColumn("common", F.size(F.array_intersect("s", "r")))
    listed_cells = both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "rare").agg(F.count(F.lit(1)).cast("double").alias("n"))
    every, total = F.col("common") + F.col("rare"), F.col("a") + F.col("b")
    gain = every / (total - every) - F.col("common") / (total - F.col("common"))
    by_list = listed_cells.select("n", gain.alias("jaccard"), F.when(F.col("common") == 0, F.col("n")).otherwise(0.0).alias("meeting"))

    sums = by_count.unionByName(by_list).agg(F.coalesce(F.sum(F.col("n") * F.col("jaccard")), F.lit(0.0)).alias("jaccard"), F.coalesce(F.sum("meeting"), F.lit(0.0)).alias("meeting"))
    pairs = trails.agg(F.count(F.lit(1)).alias("n")).select((F.col("n").cast("decimal(20,0)") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    # one row each
    return pairs.join(F.broadcast(sums), how="cross").where("pairs > 0").select(
        "pairs", (F.col("jaccard") / F.col("pairs")).alias("mean_jaccard"), (1 - F.col("meeting") / F.col("pairs")).alias("disjoint_share")
    )


def corpus_mix(stops: DataFrame, chain: DataFrame, deps: DataFrame) -> DataFrame:
    """Trails, mean stops and mean tool calls by variant (``dag`` when any stop has dependencies)."""
    n = stops.groupBy("trail_id").agg(F.count(F.lit(1)).alias("n"))
    calls = chain.groupBy("trail_id").agg(F.count(F.lit(1)).alias("calls"))
    dag = deps.select("trail_id").distinct().withColumn("dag", F.lit(True))
    t = n.join(calls, "trail_id", "left").join(dag, "trail_id", "left")
    variant = F.when(F.col("dag"), "dag").otherwise("linear")
    return t.groupBy(variant.alias("variant")).agg(
        F.count(F.lit(1)).alias("trails"), F.avg("n").alias("mean_stops"), F.avg(F.coalesce("calls", F.lit(0))).alias("mean_tool_calls")
    )


def distributions(stops: DataFrame, chain: DataFrame) -> DataFrame:
    """Rows per stop type, bridge type, value type and tool, and of reason stops per transform."""
    fields = ["stop_type", "bridge_type", "value_type"]
    found = [F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields]
    if "reason_transform" in stops.columns:
        found.append(F.when(F.col("stop_type") == "reason", F.struct(F.lit("reason_transform").alias("field"), F.col("reason_transform").alias("item"))))
    tagged = F.inline(F.array_compact(F.array(*found)))
    rows = stops.select(tagged).unionByName(chain.select(F.lit("tool").alias("field"), F.col("tool_name").alias("item")))
    return rows.groupBy("field", "item").agg(F.count(F.lit(1)).alias("times"))


def variant_delta(rates: DataFrame) -> DataFrame:
    """Rate change from linear to DAG trails in percentage points: ``rates(configuration, variant, rate)``."""
    wide = rates.groupBy("configuration").pivot("variant", ["linear", "dag"]).agg(F.avg("rate") * 100)
    return wide.withColumn("delta", F.col("dag") - F.col("linear"))
