"""Usage patterns as rows: validation, selection, assertions, budgets, summaries.

A pattern is a row (id, shard, category, agents, ...), an assertion a row
(id, key, expected) with the expected value as JSON text, and what a run
measured a row (id and the columns of ``MEASURED``). Patterns and assertions are
joined to runs, so a check of many patterns is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What patterns may say.
CATEGORIES = ["single_fetch", "repeat_visits", "host_transfer", "passthrough", "compositional", "error_handling", "large_page", "code_heavy_query"]
LIVE_MODES = ["required", "optional", "never"]
OPERATIONS = ["fetch_page", "profile_page"]
#: Assertion keys by the shape of their expected value.
ASSERTION_SHAPES = {
    "chunks_contain_all": "strings", "chunks_contain_any": "strings", "chunks_contain_pattern": "string", "n_chunks_returned": "comparison", "profile_used": "bool", "path": "string", "fetcher_used": "string", "error_is_none": "bool",
    "error_contains": "string", "suggest_profile": "bool", "content_type": "string", "truncated": "bool", "excerpts_min_count": "comparison", "outbound_links_contain_any": "strings", "page_entities_contain_any": "strings",
    "chain_hints_has_key": "string", "cache_hit": "bool",
}
BUDGETS = ["total_ms_p95", "output_chars_max", "n_chunks_max"]

#: What a run leaves: the columns that assertions and budgets read.
MEASURED = [
    ("chunks", "array<struct<heading:string,text:string>>"), ("path", "string"), ("fetcher_used", "string"), ("error", "string"), ("content_type", "string"), ("profile_used", "boolean"), ("suggest_profile", "boolean"), ("truncated", "boolean"),
    ("cache_hit", "boolean"), ("excerpts", "array<string>"), ("outbound_links", "array<struct<url:string,anchor_text:string>>"), ("page_entities", "array<string>"), ("chain_hints", "map<string,string>"), ("output_chars", "bigint"),
]


def measured(rows: DataFrame) -> DataFrame:
    """rows with every column of MEASURED, null where they lack it."""
    return rows.withColumns({name: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind) for name, kind in MEASURED})


def selected(patterns: DataFrame, shard: str | None = None, only: str | None = None, category: str | None = None, agent: str | None = None, limit: int | None = None) -> DataFrame:
    """Patterns of a shard, an id, a category, an agent; the first few by id."""
    out = patterns
    for column, wanted in (("shard", shard), ("id", only), ("category", category)):
        out = out.where(F.col(column) == wanted) if wanted else out
    out = out.where(F.array_contains("agents", agent)) if agent else out
    return out.orderBy("id").limit(limit) if limit else out


def violations(patterns: DataFrame, known_agents: list[str]) -> DataFrame:
    """(id, problem) for every rule that a pattern breaks. patterns: id,
    agents, category, description, live, url, query, steps (array of struct of
    op, url, query, ref)."""
    has_steps, has_single = F.coalesce(F.size("steps"), F.lit(0)) > 0, F.col("url").isNotNull() | F.col("query").isNotNull()
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    step = lambda bad: F.exists("steps", bad)
    rules = {
        "id": blank("id"),
        "agents": F.coalesce(F.size("agents"), F.lit(0)) <= 0,
        "unknown agent": F.size(F.array_except(F.coalesce("agents", F.array().cast("array<string>")), F.array(*map(F.lit, known_agents)))) > 0,
        "category": ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)),
        "description": blank("description"),
        "live": ~F.coalesce("live", F.lit("required")).isin(LIVE_MODES),
        "both forms": has_steps & has_single,
        "no form": ~has_steps & ~has_single,
        "url": ~has_steps & has_single & (F.coalesce("url", F.lit("")) == ""),
        "step op": step(lambda s: ~F.coalesce(s["op"].isin(OPERATIONS), F.lit(False))),
        "step ref": F.exists(F.transform("steps", lambda s, i: s["ref"].isNotNull() & ((s["ref"] < 0) | (s["ref"] >= i))), lambda x: x),
        "step ref and url": step(lambda s: s["ref"].isNotNull() & (s["url"].isNotNull() | s["query"].isNotNull())),
        "step url": step(lambda s: s["ref"].isNull() & s["url"].isNull()),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    repeated = patterns.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return patterns.select("id", F.explode(found).alias("problem")).union(repeated)


def _comparison(actual: Column, spec: Column) -> Column:
    """A comparison such as '>= 3' or a bare number, in a column of text."""
    op = F.regexp_extract(spec, r"^\s*(>=|<=|==|!=|>|<)?\s*(-?\d+)\s*$", 1)
    n = F.try_to_number(F.regexp_extract(spec, r"^\s*(>=|<=|==|!=|>|<)?\s*(-?\d+)\s*$", 2), F.lit("S999999999")).cast("long")
    return F.when(op == ">=", actual >= n).when(op == "<=", actual <= n).when(op == "!=", actual != n).when(op == ">", actual > n).when(op == "<", actual < n).otherwise(actual == n)


def bad_assertions(assertions: DataFrame) -> DataFrame:
    """(id, key, problem) of assertions of an unknown key or a wrong shape.
    assertions: id, key, expected (JSON)."""
    shape = F.try_element_at(F.create_map(*(F.lit(x) for kv in ASSERTION_SHAPES.items() for x in kv)), F.col("key"))
    strings = F.from_json("expected", "array<string>")
    text = F.from_json(F.concat(F.lit('{"v":'), "expected", F.lit("}")), "v string")["v"]
    quoted = F.startswith(F.trim("expected"), F.lit('"'))
    comparison = F.rlike(F.when(quoted, text).otherwise(F.col("expected")), F.lit(r"^\s*(>=|<=|==|!=|>|<)?\s*-?\d+\s*$"))
    good = (
        F.when(shape == "strings", F.startswith(F.trim("expected"), F.lit("[")) & (F.size(strings) > 0))
        .when(shape == "bool", F.col("expected").isin("true", "false"))
        .when(shape == "string", quoted & (F.col("key") != "chain_hints_has_key") | (F.length(text) > 0) & quoted)
        .when(shape == "comparison", comparison)
    )
    problem = F.when(shape.isNull(), "unknown key").when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("not "), shape))
    return assertions.select("id", "key", problem.alias("problem")).where("problem is not null")


def assertion_failures(runs: DataFrame, assertions: DataFrame) -> DataFrame:
    """(id, key, expected) of the assertions that a run does not meet.

    runs: id and columns of MEASURED; assertions: id, key, expected (JSON).
    Chunks are searched as their headings and texts together, so an expected
    string may not span two chunks' gap by accident only.
    """
    joined = measured(runs).join(assertions, "id")
    blob = F.array_join(F.transform(F.coalesce("chunks", F.array()), lambda c: F.concat(F.coalesce(c["heading"], F.lit("")), F.lit("\n"), F.coalesce(c["text"], F.lit("")))), "\n\n")
    links = F.array_join(F.transform(F.coalesce("outbound_links", F.array()), lambda x: F.concat(F.coalesce(x["url"], F.lit("")), F.lit("\n"), F.coalesce(x["anchor_text"], F.lit("")))), "\n")
    names = F.array_join(F.coalesce("page_entities", F.array().cast("array<string>")), "\n")
    wanted = F.from_json("expected", "array<string>")
    text = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), "expected", F.lit("}")), "v string")["v"], F.col("expected"))
    flag = F.col("expected") == "true"
    key = F.col("key")
    any_in = lambda hay: F.exists(wanted, lambda s: F.contains(hay, s))
    truth = lambda c: F.coalesce(F.col(c), F.lit(False)) == flag
    same = lambda c: F.col(c).eqNullSafe(text)
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    at_least = F.when(F.rlike(text, F.lit(r"^\s*-?\d+\s*$")), F.concat(F.lit(">= "), F.trim(text))).otherwise(text)
    met = (
        F.when(key == "chunks_contain_all", F.forall(wanted, lambda s: F.contains(blob, s)))
        .when(key == "chunks_contain_any", any_in(blob))
        .when(key == "chunks_contain_pattern", F.rlike(blob, text))
        .when(key == "n_chunks_returned", _comparison(count("chunks"), text))
        .when(key.isin("profile_used", "suggest_profile", "truncated", "cache_hit"), F.when(key == "profile_used", truth("profile_used")).when(key == "suggest_profile", truth("suggest_profile")).when(key == "truncated", truth("truncated")).otherwise(truth("cache_hit")))
        .when(key.isin("path", "fetcher_used", "content_type"), F.when(key == "path", same("path")).when(key == "fetcher_used", same("fetcher_used")).otherwise(same("content_type")))
        .when(key == "error_is_none", F.col("error").isNull() == flag)
        .when(key == "error_contains", F.contains(F.coalesce("error", F.lit("")), text))
        .when(key == "excerpts_min_count", _comparison(count("excerpts"), at_least))
        .when(key == "outbound_links_contain_any", any_in(links))
        .when(key == "page_entities_contain_any", any_in(names))
        .when(key == "chain_hints_has_key", F.coalesce(F.map_contains_key(F.col("chain_hints"), text), F.lit(False)))
    )
    return joined.where(~F.coalesce(met, F.lit(False))).select("id", "key", "expected")


def budget_failures(runs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(id, budget, actual, cap) of budgets that a run exceeds. runs: id,
    total_ms_p95 and columns of MEASURED; budgets: id, budget, cap."""
    actual = F.when(F.col("budget") == "total_ms_p95", F.col("total_ms_p95")).when(F.col("budget") == "output_chars_max", F.coalesce("output_chars", F.lit(0))).when(F.col("budget") == "n_chunks_max", F.greatest(F.coalesce(F.size("chunks"), F.lit(0)), F.lit(0)))
    joined = measured(runs).join(budgets, "id").withColumn("actual", actual.cast("double"))
    return joined.where(F.col("actual") > F.col("cap")).select("id", "budget", "actual", "cap")


def shard_summary(outcomes: DataFrame) -> DataFrame:
    """(shard, passed, total) of each shard and, with a null shard, of all.
    outcomes: shard, passed."""
    return outcomes.groupingSets([[F.col("shard")], []], "shard").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def p95_of_p95s(runs: DataFrame, group: list[str], case: str, value: str) -> DataFrame:
    """The 95th percentile over cases of each case's 95th percentile."""
    each = runs.groupBy(*group, case).agg(F.percentile(F.col(value), F.lit(0.95)).alias("_p"))
    return each.groupBy(*group).agg(F.count("*").alias("cases"), F.percentile("_p", F.lit(0.95)).alias("p95"))


def mode_averages(runs: DataFrame) -> DataFrame:
    """(mode, n, tokens, ms, passed, wins): means of each mode, how many runs
    passed, and in how many cases a mode used the fewest tokens (ties go to the
    mode that sorts first). runs: case_id, mode, tokens, ms, ok."""
    means = runs.groupBy("mode").agg(F.count("*").alias("n"), F.avg("tokens").alias("tokens"), F.avg("ms").alias("ms"), F.count_if("ok").alias("passed"))
    each = runs.groupBy("case_id", "mode").agg(F.sum("tokens").alias("t"))
    wins = each.groupBy("case_id").agg(F.min(F.struct("t", "mode"))["mode"].alias("mode")).groupBy("mode").agg(F.count("*").alias("wins"))
    return means.join(wins, "mode", "left").na.fill(0, ["wins"])


def error_gate(rows: DataFrame, failed: Column, most: float = 0.05) -> DataFrame:
    """(n, n_err, exit_code): the exit code is 1 if so large a share failed, or
    if there is no row."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(failed).alias("n_err"))
    return out.withColumn("exit_code", F.when((F.col("n") == 0) | (F.col("n_err") >= most * F.col("n")), 1).otherwise(0))


def error_lists(rows: DataFrame, id_col: str, failed: dict[str, Column]) -> DataFrame:
    """(id, extractor): a row for each row and extractor that failed on it."""
    each = F.explode(F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in failed.items())), lambda x: x.isNotNull())).alias("extractor")
    return rows.select(F.col(id_col), each)


def gate_candidate(sweep: DataFrame) -> DataFrame:
    """The one row to adopt: the largest gain, then the fewest regressions, then
    the least setting. sweep: setting, gain, regressions."""
    best = F.min(F.struct((-F.col("gain")).alias("g"), F.col("regressions"), F.col("setting"))).alias("b")
    return sweep.agg(best).where("b is not null").select("b.setting", (-F.col("b.g")).alias("gain"), "b.regressions")


def element_catalogue(nodes: DataFrame, key: str) -> DataFrame:
    """(tag, n_elements, n_pages, first_page): every element name, most frequent
    first, then by pages, then by name."""
    out = nodes.groupBy("tag").agg(F.count("*").alias("n_elements"), F.count_distinct(key).alias("n_pages"), F.min(key).alias("first_page"))
    return out.orderBy(F.desc("n_elements"), F.desc("n_pages"), "tag")


def summary_markdown(outcomes: DataFrame) -> DataFrame:
    """(shard, md): a table of each shard's patterns. outcomes: shard, id,
    category, passed, total_ms_p95."""
    line = F.concat(F.lit("| `"), "id", F.lit("` | "), "category", F.lit(" | "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" | "), F.col("total_ms_p95").cast("string"), F.lit("ms |"))
    head = F.concat(F.lit("## "), "shard", F.lit(" — "), F.count_if("passed").cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit("\n\n| pattern | category | result | total_p95 |\n|---|---|---|---|\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("l")))), lambda x: x["l"]), "\n")
    return outcomes.groupBy("shard").agg(F.concat(head, lines).alias("md"))


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """The last outcome of each pattern (a later iteration replaces)."""
    w = Window.partitionBy("id").orderBy(F.desc("iteration"))
    return outcomes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
