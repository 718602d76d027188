import pytest
from pyspark.sql import functions as F

from cellwright.config import CleanConfig
from cellwright.operators import evaluate as ev
from cellwright.operators.browse import filter_actions, filter_findings, page, page_info, preview, search_sort, table_diff
from cellwright.operators.drift import ks_p_value, ks_test
from cellwright.operators.counts import cell_counts
from cellwright.operators.patterns import PATTERN_SCHEMA, add_patterns, apply_template, learn_patterns, list_patterns, match_patterns, record_outcomes
from cellwright.operators.repair import apply_fixes, normalize_all, repair
from cellwright.operators.schema import facts_of
from cellwright.operators.scoring import apply_review, audit_log, audit_summary, review_queue, tier
from cellwright.plans.clean import clean

PEOPLE = [
    ("Ann Lee", "ann@x.com", "28", "$52000"), ("Bo Ray", " BO@X.COM ", "35", "$63,500"), ("Cy Day", "cy@x.com", "", "75000"),
    (None, "not-mail", "29", "n/a"), ("Di Fox", "di@x.com", "31", "$48000"), ("Ann Lee", "ed@x.com", "33", "$51000"),
    ("Flo Gem", "flo@x.com", "30", "$50000"), ("Gus Hay", "gus@x.com", "27", "$49000"), ("Hal Ivy", "hal@x.com", "32", "$51000"),
    ("Ida Joy", "ida@x.com", "999", "$47000"), ("Kit Low", "kit@x.com", "29", "$52000"), ("Lou May", "lou@x.com", "30", "$50000"),
]


@pytest.fixture
def people(table):
    return table(["name", "email", "age", "salary"], PEOPLE)


def cells_of(actions):
    return {(r["row"], r["column"]): (r["new_value"], r["rule"]) for r in actions.collect()}


def test_repair_fills_and_fixes(people):
    out = repair(people, facts_of(people))
    got = cells_of(out.actions)
    assert got[(2, "age")] == ("30.0", "rule:median_impute")
    assert got[(3, "name")] == ("Ann Lee", "rule:mode_impute")
    assert got[(1, "salary")] == ("63500", "rule:numeric_coerce")
    # a valid address in capitals is never flagged
    assert (1, "email") not in got
    open_cells = {(r["row"], r["column"]) for r in out.unresolved.collect()}
    assert open_cells == {(3, "email"), (3, "salary"), (9, "age")}
    assert out.cleaned.where("_row = 2").first()["age"] == "30.0"


def test_strict_nulls_leave_null_cells_open(people):
    out = repair(people, facts_of(people, config=CleanConfig(strict_nulls=True)), config=CleanConfig(strict_nulls=True))
    got = cells_of(out.actions)
    assert (3, "name") not in got and got[(2, "age")][1] == "rule:median_impute"


def test_patterns_and_proposals_in_turn(spark, people):
    patterns = spark.createDataFrame(
        [(1, ".*mail.*", "not-.*", "none@x.com", "generic", 5, 0), (2, "mail", ".*", "never", "generic", 9, 0), (3, ".*", "(", "bad", "generic", 99, 0)],
        PATTERN_SCHEMA,
    )
    proposals = spark.createDataFrame(
        [(9, "age", "39", 0.9, "typo", "m1"), (3, "salary", "0", 0.4, "guess", "m1"), (0, "age", "1", 1.0, "not open", "m1")],
        "row bigint, column string, corrected_value string, confidence double, reasoning string, model string",
    )
    facts = facts_of(people)
    out = repair(people, facts, patterns, proposals)
    got = cells_of(out.actions)
    assert got[(3, "email")] == ("none@x.com", "pattern:.*mail.*")
    assert got[(9, "age")] == ("39", "llm:m1") and got[(3, "salary")] == ("0", "llm:m1")
    assert (0, "age") not in got
    assert {r["_row"]: r["age"] for r in out.cleaned.collect()}[9] == "39"
    lessons = learn_patterns(out.actions)
    assert [(r["column_pattern"], r["value_pattern"], r["fix_template"]) for r in lessons.collect()] == [(".*age.*", "999", "39")]
    grown = add_patterns(patterns, lessons)
    assert [r["id"] for r in list_patterns(grown).collect()] == [3, 2, 1, 4]
    assert list_patterns(grown, "other").count() == 0
    tried = spark.createDataFrame([(1, False), (1, True)], "id bigint, success boolean")
    first = record_outcomes(patterns, tried).where("id = 1").first()
    assert (first["success_count"], first["fail_count"]) == (6, 1)
    hits = match_patterns(spark.createDataFrame([("user_email", "NOT-x")], "column string, value string"), patterns, ["user_email"])
    assert hits.first()["pattern_id"] == 1


def test_templates(spark):
    one = spark.range(1)
    cases = {"{value}": "ab Cd", "{value}.upper()": "AB CD", "{value}.title()": "Ab Cd", "{value}.lower()": "ab cd", "x": "x"}
    for template, want in cases.items():
        assert one.select(apply_template(F.lit(template), F.lit("ab Cd"))).first()[0] == want


def test_apply_fixes_writes_null(spark, people):
    fixes = spark.createDataFrame([(0, "name", None), (0, "age", "1"), (5, "nope", "x")], "row bigint, column string, new_value string")
    r = apply_fixes(people, fixes).where("_row = 0").first()
    assert r["name"] is None and r["age"] == "1"


def test_normalize_all_touches_every_cell(table):
    t = table(["mail", "flag"], [(" A@B.COM ", "Yes"), ("x", "maybe")])
    assert [tuple(r)[1:] for r in normalize_all(t).orderBy("_row").collect()] == [("a@b.com", "true"), ("x", "maybe")]


def test_clean_runs_until_drift_is_gone_or_passes_end(people):
    result = clean(people, row_col="_row", dataset_id="people")
    report = result.report.first()
    assert (report["total_rows"], report["total_columns"], report["validation_passed"]) == (12, 4, True)
    assert report["issues_fixed"] == result.actions.count() == sum(report["fix_breakdown"].values())
    assert result.audit.count() == report["issues_fixed"]
    assert {r["stage"] for r in result.pipeline_stages.collect()} >= {"ingest", "cleaning", "validation"}
    assert result.chunk_results.first()["fixes"] == report["issues_fixed"]
    # with every change counted as drift, later passes find nothing new unless findings are replayed
    again = clean(people, row_col="_row", config=CleanConfig(drift_alpha=1.1))
    assert again.iterations == 2 and again.actions.count() == report["issues_fixed"] and not again.validation_passed
    replay = clean(people, row_col="_row", config=CleanConfig(drift_alpha=1.1, replay=True))
    found = repair(people, facts_of(people)).actions.where("issue_type <> 'missing'").count()
    assert replay.iterations == 3 and replay.actions.count() == report["issues_fixed"] + 2 * found


def test_ks(table):
    a, b = table(["v"], [(str(i),) for i in range(100)]), table(["v"], [(str(i + 30),) for i in range(100)])
    r = ks_test(cell_counts(a), cell_counts(b)).first()
    assert r["ks_statistic"] == 0.3 and r["significant_drift"]
    same = ks_test(cell_counts(a), cell_counts(a)).first()
    assert same["ks_statistic"] == 0.0 and same["p_value"] == 1.0 and not same["significant_drift"]
    # published value of the exact two-sided test for n = m = 10
    assert ks_p_value(0.5, 10, 10, "exact") == pytest.approx(0.16782134274394334, abs=1e-9)
    assert ks_p_value(0.5, 10, 10) == ks_p_value(0.5, 10, 10, "exact")
    assert ks_p_value(0.1, 400, 500, "series") == pytest.approx(ks_p_value(0.1, 400, 500, "exact"), rel=0.05)


def test_ks_with_numbers_on_one_side(table):
    a = table(["v", "few", "gone"], [(str(i), "1" if i == 0 else "x", str(i)) for i in range(30)])
    b = table(["v", "few", "gone"], [(str(i), "1" if i == 0 else "x", "true") for i in range(30)])
    got = {r["column"]: r for r in ks_test(cell_counts(a), cell_counts(b)).collect()}
    assert got["v"]["p_value"] == 1.0 and got["v"]["error"] is None
    assert got["few"]["error"] and got["gone"]["error"] and got["gone"]["ks_statistic"] is None
    # stray flags become words, and no number is left to compare
    mails = table(["mail"], [(f"user{i}@example.com",) for i in range(40)] + [("1",)] * 12)
    assert clean(mails, row_col="_row").validation_passed


def fixes_frame(spark, rows, value):
    return spark.createDataFrame(rows, f"row bigint, column string, {value} string")


def test_measures(spark):
    truth = fixes_frame(spark, [(0, "a", "fixed_a"), (1, "b", "fixed_b"), (2, "c", "fixed_c")], "expected_value")
    one = fixes_frame(spark, [(0, "a", "fixed_a")], "new_value")
    assert ev.recall(one, truth) == 1 / 3 and ev.precision(one, truth) == 1.0 and ev.f1_score(one, truth) == 0.5
    mixed = fixes_frame(spark, [(0, "a", "fixed_a"), (5, "z", "wrong"), (0, "a", "fixed_a"), (1, "b", None)], "new_value")
    r = ev.evaluate(mixed, truth).first()
    assert (r["precision"], r["recall"], r["false_positive_rate"], r["coverage"]) == (0.5, 0.3333, 0.25, 0.6667)
    assert (r["total_applied"], r["total_ground_truth"]) == (4, 3)
    empty = ev.evaluate(one.where("false"), truth.where("false")).first()
    assert (empty["precision"], empty["recall"], empty["f1_score"], empty["total_applied"]) == (0.0, 0.0, 0.0, 0)
    nulls = ev.evaluate(fixes_frame(spark, [(0, "a", None)], "new_value"), fixes_frame(spark, [(0, "a", "None")], "expected_value"))
    assert nulls.first()["precision"] == 1.0


def test_review(spark, people):
    actions = spark.createDataFrame(
        [(1, "name", "Bo Ray", "Bob", "llm:x", 0.5), (0, "age", "28", "82", "llm:x", 0.6), (2, "age", "", "30", "rule:m", 0.9), (4, "age", None, "9", "other", 0.1)],
        "row bigint, column string, old_value string, new_value string, rule string, confidence double",
    ).withColumns({"reasoning": F.lit(""), "issue_type": F.lit("t")})
    assert [r["tier"] for r in audit_log(actions).orderBy("row_index").collect()] == ["tier3_llm", "tier3_llm", "tier1_deterministic", "unknown"]
    queue = review_queue(actions)
    assert [(r["id"], r["row"]) for r in queue.orderBy("id").collect()] == [("review-0", 0), ("review-1", 1), ("review-2", 4)]
    decisions = spark.createDataFrame(
        [("review-0", "edit", "29"), ("review-1", "accept", None), ("review-2", "reject", None)], "id string, action string, new_value string"
    )
    cleaned, done, audit = apply_review(people, queue, decisions)
    by_row = {r["_row"]: r for r in cleaned.collect()}
    assert by_row[0]["age"] == "29" and by_row[1]["name"] == "Bo Ray" and by_row[4]["age"] is None
    assert {r["id"]: r["status"] for r in done.collect()} == {"review-0": "edited", "review-1": "accepted", "review-2": "rejected"}
    assert {r["fix_method"] for r in audit.collect()} == {"review:edit", "review:accept", "review:reject"}
    twice = decisions.unionByName(spark.createDataFrame([("review-0", "edit", "31")], "id string, action string, new_value string"))
    ordered = twice.withColumn("order", F.when(F.col("new_value") == "31", 2).otherwise(1))
    assert {r["_row"]: r["age"] for r in apply_review(people, queue, ordered)[0].collect()}[0] == "31"
    repeated = queue.unionByName(queue.where("id = 'review-0'").withColumn("id", F.lit("review-7")))
    second = spark.createDataFrame([("review-0", "edit", "29"), ("review-7", "reject", None)], "id string, action string, new_value string")
    assert {r["_row"]: r["age"] for r in apply_review(people, repeated, second)[0].collect()}[0] == "28"
    summary = audit_summary(audit_log(actions.withColumn("issue_type", F.when(F.col("row") > 0, "t")))).first()
    assert summary["by_issue_type"] == {"t": 3, "unknown": 1} and summary["total_fixes"] == 4
    bad = decisions.where("id = 'review-0'").withColumn("new_value", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="new_value is required"):
        apply_review(people, queue, bad)[0].collect()


def test_browse(people):
    assert [r["_row"] for r in page(people, 2, 5).collect()] == [5, 6, 7, 8, 9]
    info = page_info(people, 0, 500).first()
    assert (info["page"], info["page_size"], info["total_rows"], info["total_pages"]) == (1, 500, 12, 1)
    rows, shown = preview(people, 3)
    assert rows.count() == 3 and shown.first()["truncated"] and shown.first()["row_count"] == 12
    assert [r["_row"] for r in search_sort(people, "ann", "email", True).collect()] == [5, 0]
    assert [r["_row"] for r in search_sort(people, "—").collect()] == [2, 3]
    changed = people.withColumn("age", F.when(F.col("_row") == 2, "1").otherwise(F.col("age")))
    assert [tuple(r) for r in table_diff(people, changed).collect()] == [(2, "age", "", "1")]
    facts = facts_of(people)
    actions = repair(people, facts).actions
    assert filter_actions(actions, "rule:med").count() == 1


def test_any_column_name_survives(spark):
    rows = [(i, str(i % 7), f"user{i}@x.com" if i else " A@X.com ", "v" if i % 9 else "") for i in range(60)]
    t = spark.createDataFrame(rows, "id bigint, `_id` string, `a.b` string, `c d` string")
    out = clean(t, row_col="id")
    assert out.cleaned.columns == ["_row", "_id", "a.b", "c d"] and out.profile.count() == 3
    first = out.cleaned.where("_row = 0").first()
    assert first["a.b"] == " A@X.com " and first["c d"] == "v"
    assert {r["column"] for r in duplicate_rows_of(t)} == set()
    with pytest.raises(ValueError, match="reserved"):
        clean(t.withColumnRenamed("_id", "_flags"), row_col="id")


def duplicate_rows_of(t):
    from cellwright.operators.profile import duplicate_count

    assert duplicate_count(t, ["a.b", "_id"], "id").first()["duplicate_count"] == 0
    return []


def test_patterns_use_one_dialect(spark, table):
    t = table(["code"], [(f"c{i}",) for i in range(30)] + [("٣٤",), ("77x",)])
    facts = facts_of(t)
    patterns = spark.createDataFrame([(1, "CODE", r"(?P<n>\d+)$", "digits", "generic", 0, 0)], PATTERN_SCHEMA)
    found = repair(t.withColumn("code", F.when(F.col("_row") == 31, "").otherwise(F.col("code"))), facts, patterns)
    assert found.external.count() == 0
    from cellwright.operators.patterns import match_patterns

    hits = match_patterns(spark.createDataFrame([("code", "٣٤"), ("code", "77x"), ("code", "5")], "column string, value string"), patterns, ["code"])
    assert {r["value"] for r in hits.collect()} == {"٣٤", "5"}


def test_patterns_of_any_spelling(spark):
    r"""Names with underscores, back references and \Z work, what the dialect can't compile is skipped, and nothing fails the job."""
    from cellwright.operators.patterns import PATTERN_SCHEMA, match_patterns

    spelled = [r"(?P<a_b>x)\d", r"(?P<_c>y+)-(?P=_c)\Z", r"(?P<ab>q)(?P<a_b>r)", r"(open", r"[", r"z{,3}w", r"(?(1)a|b)", r"v\\Z", r"é+\Z"]
    patterns = spark.createDataFrame([(i, ".*", p, "{value}.upper()", "generic", 0, 0) for i, p in enumerate(spelled)], PATTERN_SCHEMA)
    patterns = patterns.union(spark.createDataFrame([(90, "c(", "x", "no", "generic", 9, 0)], PATTERN_SCHEMA))
    texts = ["x1", "yy-yy", "yy-yyy", "qr", "open", "zzw", "a", "v\\Z", "ÉÉ"]
    got = match_patterns(spark.createDataFrame([("col", t) for t in texts], "column string, value string"), patterns, ["col"])
    assert {r.value: r.pattern_id for r in got.collect()} == {"x1": 0, "yy-yy": 1, "qr": 2, "v\\Z": 7, "ÉÉ": 8}


def test_any_number_of_rare_values(spark, table):
    """Sixty rare values: none is reported under the limit, all without it, in the findings as in the repair of the whole run."""
    from cellwright.operators.anomalies import detect
    from cellwright.operators.schema import facts_with_rare
    from cellwright.plans.clean import clean

    rows = [("common",)] * 6000 + [(f"  rare  {i}",) for i in range(60)]
    t = table(["kind"], rows)
    found = {}
    for most in (50, None):
        config = CleanConfig(rare_max_values=most)
        marked, facts = facts_with_rare(t, config=config)
        found[most] = detect(marked, facts, config).where("anomaly_type = 'rare_category'").count()
        result = clean(t, config=config, row_col="_row")
        assert result.cleaned.columns == ["_row", "kind"]
        assert result.actions.count() == found[most] == result.anomalies.count()
    assert found == {50: 0, None: 60}


def test_later_passes_stop_at_columns_that_stay(spark, table):
    """Readings drift when a third is filled in: the loop goes on, changes what the first pass uncovered, and ends at its fixed point."""
    from cellwright.plans.clean import clean

    rows = [("" if i % 3 == 0 else f"  ${i}.5" if i % 40 == 1 else f"{i}.25", "x") for i in range(1200)]
    result = clean(table(["reading", "kind"], rows), row_col="_row")
    assert (result.iterations, result.validation_passed) == (3, False)
    assert result.cleaned.where("reading rlike '[^0-9.]'").count() == 0
    assert result.actions.where("issue_type = 'type_mismatch'").count() == sum(i % 3 != 0 and i % 40 == 1 for i in range(1200))
    assert clean(table(["reading", "kind"], rows), row_col="_row", config=CleanConfig(max_passes=1)).iterations == 1


def test_literals_of_patterns():
    from cellwright.operators.patterns import required_literal

    sure = {
        "ABC": (True, "abc"), "^abc$": (True, "abc"), r"NOT\-x": (True, "not-x"), r"\s*Cust\#01\s+x": (False, "cust#01"), "(a)bcde": (False, "bcde"),
        "ab?cdef": (False, "cdef"), "ab{0,2}cd": (False, "cd"), "ab{2}cd": (True, "ab"), r"a\.b\.com": (True, "a.b.com"), r".*@ex\.com$": (False, "@ex.com"),
        "(?:a|b)cde": (False, "cde"), "[a-c]xyz": (False, "xyz"), "(?P<a_b>x)def": (False, "def"), "straße": (True, "stra"), r"(a(b\)[)]c)d)efg": (False, "efg"),
    }
    assert {p: required_literal(p) for p in sure} == sure
    for unsure in ["a|b", r"\Qa\E", "(?i)abc", "[]a]xyz", "[a[b]c]xyz", "[^]x]yz", "^$", "", r"\x41bc", "9*", r"\d+", "(abc", r"(\Q)\Eabc)x", "a**"]:
        assert not required_literal(unsure)[1], unsure


def test_pattern_index_loses_no_match(spark):
    """The keys of texts and literals against every pattern beside every value."""
    import random

    from cellwright.operators.patterns import PATTERN_SCHEMA, _expression, _valid, match_patterns, pattern_candidates

    rng = random.Random(3)
    atoms = ["a", "B", "ss", "k", "i", "é", r"\.", ".", r"\d", "[ab]", "(ab)", "(?:a|k)", "x?", "k*", "a+", "b{2}", "k{0,1}", "^", "$", r"\s", "9", "-", "(?=a)", "İ"]
    texts = {"".join(rng.choice("aAbBkKſsıİiéE9-. xKß") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"STRASSE", "straße", "abcabcabc"}
    exprs = {"".join(rng.choice(atoms) for _ in range(rng.randint(1, 6))) for _ in range(400)} | {"stra", ".*rass", "abcabc", "a|b", r"\Qab\E", "(?i)AB"}
    patterns = spark.createDataFrame([(i, "c", e, "{value}", "generic", i % 5, 1) for i, e in enumerate(sorted(exprs))], PATTERN_SCHEMA)
    values = spark.createDataFrame([("c", t) for t in sorted(texts)], "column string, value string")
    live = patterns.where(_valid("value_pattern")).withColumn("column", F.lit("c"))
    test = F.rlike(F.col("value"), _expression("value_pattern"))
    want = {(r["id"], r["value"]) for r in live.join(values, "column").where(test).select("id", "value").collect()}
    met = pattern_candidates(values, live.drop("domain")).where(test).select("id", "value").collect()
    assert len(want) > 1000 and len(met) == len(want) and {tuple(r) for r in met} == want
    # ten thousand exact lessons: each value meets its own
    many = spark.range(10_000).selectExpr(
        "id", "'c' AS column_pattern", "concat('Item no ', id, ' of 9') AS value_pattern", "'{value}' AS fix_template", "'generic' AS domain",
        "1L AS success_count", "0L AS fail_count",
    )
    items = spark.range(2_000).selectExpr("'c' AS column", "concat('item NO ', id * 5, ' of 9 ', id) AS value")
    assert pattern_candidates(items, many.withColumn("column", F.lit("c"))).count() == 2_000
    assert match_patterns(items, many, ["c"]).where("pattern_id = cast(split(value, ' ')[2] AS bigint)").count() == 2_000


def test_pattern_pieces_grow_with_the_literal(spark):
    """Few letters: short pieces are held by many patterns, and each value would meet all of those."""
    from cellwright.operators import patterns as pt

    told = spark.range(3_000).selectExpr("id", "'c' AS column", "concat('\\\\s+no', lpad(bin(id), 14, '0')) AS value_pattern", "1L AS success_count", "0L AS fail_count")
    values = spark.range(3_000).selectExpr("'c' AS column", "concat(' no', lpad(bin(id), 14, '0')) AS value")
    met = pt.pattern_candidates(values, told)
    assert met.where("value_pattern = concat('\\\\s+', trim(value))").count() == 3_000
    assert met.count() == 3_000


def test_crowded_keys_are_dealt_out(spark, monkeypatch):
    from cellwright.operators import patterns as pt

    monkeypatch.setattr(pt, "PART", 10)
    told = spark.createDataFrame([(1, "c", ".*", 1, 0), (2, "c", ".*7", 1, 0), (3, "c", r"\s*abc", 1, 0), (None, "c", "x", 1, 0)],
                                 "id bigint, column string, value_pattern string, success_count bigint, fail_count bigint")
    values = spark.range(200).selectExpr("'c' AS column", "concat('abc', id) AS value")
    got = {r["id"]: r["count"] for r in pt.pattern_candidates(values, told).groupBy("id").count().collect()}
    assert got == {1: 200, 2: sum("7" in str(i) for i in range(200)), 3: 200}


def test_rules_run_once_for_a_cell(spark, table):
    """A filter under the log would run all rules once more, outside of generated code."""
    from cellwright.functions.rules import format_fix
    from cellwright.operators.repair import repair
    from cellwright.operators.schema import facts_of
    from cellwright.plans.registry import _rule_rows

    t = table(["a", "b"], [(" x ", "" if i % 2 else str(i)) for i in range(30)])
    done = repair(t, facts_of(t))
    cells = t.selectExpr("_row AS row", "'a' AS column", "a AS value")
    for log in (done.actions, done.unresolved, _rule_rows(cells, format_fix(F.col("value"), F.col("column")))):
        plan = log._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    assert done.actions.where("column = 'b' and rule = 'rule:median_impute'").count() == 15
    assert _rule_rows(cells, format_fix(F.col("value"), F.col("column"))).where("new_value = 'x'").count() == 30


def test_rows_are_dealt_out(spark):
    from cellwright.operators.rows import spread

    t = spark.range(1_000, numPartitions=1).selectExpr("nullif(id % 3, 0) AS k", "'x' AS v")
    dealt = spread(t, 100)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.columns == ["k", "v"]
    assert sorted(map(str, dealt.collect())) == sorted(map(str, t.collect()))
    assert max(len(p) for p in dealt.rdd.glom().collect()) < 200
    assert spread(t, 1_000).rdd.getNumPartitions() == 1
