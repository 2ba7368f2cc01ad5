import pytest
from pyspark.sql import functions as F

from meterstone.operators import guardrail, scoring
from meterstone.sources import catalog


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "q string").select(expr(F.col("q"))).first()[0]


@pytest.mark.parametrize(
    "text",
    ["Show me all user EMAIL addresses", "phone numbers: phone", "the full-name list", "fullname", "SSN", "my password",
     "credit card", "creditcard", "ip address", "IP_address?"],
)
def test_protected_data_is_found(spark, text):
    assert one(spark, guardrail.pii_reason, text) is not None


@pytest.mark.parametrize("text", ["What is MRR by plan?", "emails per day", "passwords", "telephone booth", ""])
def test_other_text_is_clean(spark, text):
    assert one(spark, guardrail.pii_reason, text) is None


def test_first_pattern_gives_the_reason(spark):
    got = one(spark, guardrail.pii_reason, "address and email")
    assert got == "Query references PII data: matched pattern '\\bemail\\b'"


@pytest.mark.parametrize(
    "text",
    ["drop table x", "DELETE from t", "truncate t", "alter t", "insert into", "update t", "exec x", "execute x", "a -- b",
     "/* x", "1 union all select 2", "; select", "' or '", "1 = 1", "Union\tx Select"],
)
def test_injection_is_found(spark, text):
    assert one(spark, guardrail.injection_reason, text) is not None


@pytest.mark.parametrize("text", ["dropped users", "updates per day", "selection", "union\nselect", "a - b", "; sel"])
def test_harmless_text_is_not_injection(spark, text):
    assert one(spark, guardrail.injection_reason, text) is None


@pytest.mark.parametrize(
    ("text", "metric"),
    [
        ("what was DAU last week?", "daily_active_users"),
        ("monthly active users please", "daily_active_users"),  # "active users" is listed first
        ("monthly_active_users", "monthly_active_users"),
        ("LTV:CAC ratio", "customer_lifetime_value"),
        ("show me churn", "churn_rate"),
        ("Show  trend for Enterprise", "monthly_recurring_revenue"),  # three words of an example
        ("what is the weather?", None),
        ("", None),
    ],
)
def test_metric_resolution(spark, text, metric):
    assert one(spark, guardrail.resolved_metric, text) == metric


def verdict(spark, question, intent):
    log = spark.createDataFrame([(question, intent)], "question string, intent string")
    return guardrail.with_verdict(log).first().guardrail


def test_out_of_scope_passes_but_is_marked(spark):
    v = verdict(spark, "weather tomorrow", "out_of_scope")
    assert v.passed and v.metric_check and v.out_of_scope


def test_unknown_metric_gives_the_catalog_message(spark):
    v = verdict(spark, "what is our NPS", "metric_query")
    assert not v.passed and not v.metric_check and v.rejection_reason == catalog.REJECTION_MESSAGE


def test_failed_text_check_skips_the_metric_check(spark):
    v = verdict(spark, "email of everyone", "metric_query")
    assert not v.passed and v.metric_check and not v.pii_check


def test_rejection_classes(spark):
    rows = [
        ("Query references PII data: matched pattern 'x'", "metric_query", "pii"),
        ("Potential SQL injection detected: '--'", "metric_query", "injection"),
        ("not in scope", "metric_query", "out_of_scope"),
        (None, "out_of_scope", "out_of_scope"),
        (catalog.REJECTION_MESSAGE, "metric_query", "metric_allowlist"),
    ]
    df = spark.createDataFrame(rows, "reason string, intent string, want string")
    out = df.select(guardrail.rejection_class(F.col("reason"), F.col("intent")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


def test_catalog_is_complete():
    assert len(catalog.METRICS) == 6 and catalog.is_protected("EMAIL") and not catalog.is_protected("mrr")
    assert dict(catalog.aliases())["dau"] == "daily_active_users"
    assert all(n in catalog.REJECTION_MESSAGE for n in catalog.METRIC_NAMES)


def test_table_refs(spark):
    sql = "SELECT a FROM Marts.mart_x m JOIN mart_y y ON 1=1"
    assert set(one(spark, scoring.table_refs, sql)) == {"marts.mart_x", "mart_x", "mart_y"}
    assert one(spark, scoring.table_refs, "what about (mart_z);") == ["mart_z"]


def test_score_checks(spark):
    golden = spark.createDataFrame(
        [(1, "c", "marts.mart_a", ["x", "y"], False), (2, "r", None, [], True), (3, "c", None, [], False)],
        "position bigint, category string, expected_table string, expected_columns array<string>, should_reject boolean",
    )
    answers = spark.createDataFrame(
        [
            (1, "select x from mart_a", "metric_query", (True,)),
            (1, "select x from mart_b", "metric_query", (True,)),
            (1, "select z from mart_a", "metric_query", (True,)),
            (1, "select x from mart_a", "out_of_scope", (True,)),
            (2, "select 1", "metric_query", (False,)),
            (2, "select 1", "metric_query", (True,)),
            (3, None, "metric_query", (True,)),
        ],
        "position bigint, sql string, intent string, guardrail struct<passed:boolean>",
    )
    got = scoring.score(answers, golden).select("sql", "intent", "position", "overall_pass").collect()
    assert sorted(r.overall_pass for r in got) == [False] * 5 + [True] * 2
    report = {r.category: r for r in scoring.accuracy_report(scoring.score(answers, golden), min_accuracy=0.5).collect()}
    assert (report["r"].total, report["r"].passed, report["r"].gate_passed, report["r"].marked) == (2, 1, True, False)
    assert report[None].total == 7 and not report[None].gate_passed


def test_shorter_keyword_list_labels_fewer_reasons(spark):
    df = spark.createDataFrame([("phone found", "x"), ("drop found", "x"), ("email found", "x")], "reason string, intent string")
    reason, intent = F.col("reason"), F.col("intent")
    got = df.select(guardrail.rejection_class(reason, intent), guardrail.rejection_class(reason, intent, few_words=True))
    assert [tuple(r) for r in got.collect()] == [
        ("pii", "metric_allowlist"),
        ("injection", "metric_allowlist"),
        ("pii", "pii"),
    ]


# Expected reasons and metrics stated one by one, not taken from the code.
REASONS = [
    ("Send me the email field", r"\bemail\b"), ("Which phone is on file?", r"\bphone\b"), ("Home address of buyers", r"\baddress\b"),
    ("Full name of the top users", r"\bfull.?name\b"), ("Look up the ssn of this account", r"\bssn\b"), ("Reset the password", r"\bpassword\b"),
    ("Which credit card is on file?", r"\bcredit.?card\b"), ("List every ip_address of a session", r"\bip.?address\b"),
]
INJECTIONS = [
    ("Please drop the mart", r"\bDROP\b"), ("Delete the old rows", r"\bDELETE\b"), ("Truncate it", r"\bTRUNCATE\b"), ("Alter the schema", r"\bALTER\b"),
    ("Insert a row", r"\bINSERT\b"), ("Update the rows", r"\bUPDATE\b"), ("Exec the job", r"\bEXEC\b"), ("Execute the job", r"\bEXECUTE\b"), ("MRR -- all", "--"),
    ("MRR /* all", r"/\*"), ("MRR union everything, select all", r"\bUNION\b.*\bSELECT\b"), ("MRR; select 1", r";\s*SELECT"), ("plan ' or ' plan", r"'\s*OR\s*'"),
    ("Trend where 1 = 1", r"1\s*=\s*1"),
]
ALIASES = {
    "DAU": "daily_active_users", "active users": "daily_active_users", "MAU": "monthly_active_users", "retention rate": "thirty_day_retention_rate",
    "MRR": "monthly_recurring_revenue", "recurring revenue": "monthly_recurring_revenue", "revenue": "monthly_recurring_revenue",
    "LTV": "customer_lifetime_value", "lifetime value": "customer_lifetime_value", "CLV": "customer_lifetime_value",
    "churn": "churn_rate", "cancellation rate": "churn_rate",
}


def test_every_pattern_gives_its_own_reason(spark):
    from meterstone.sources.query_log import QUESTIONS

    rows = spark.createDataFrame([(t,) for t, _ in REASONS + INJECTIONS], "q string")
    got = rows.select("q", guardrail.pii_reason(F.col("q")).alias("p"), guardrail.injection_reason(F.col("q")).alias("i")).collect()
    by = {r.q: r for r in got}
    for text, pattern in REASONS:
        assert by[text].p == f"Query references PII data: matched pattern '{pattern}'"
    for text, pattern in INJECTIONS:
        assert by[text].i == f"Potential SQL injection detected: '{pattern}'"
    assert {t for t, _ in REASONS + INJECTIONS} <= set(QUESTIONS)


def test_aliases_name_their_metric(spark):
    rows = spark.createDataFrame([(f"Give me the {a} for June", m) for a, m in ALIASES.items()], "q string, want string")
    got = rows.select("q", "want", guardrail.resolved_metric(F.col("q")).alias("got")).collect()
    assert [(r.q, r.got) for r in got] == [(r.q, r.want) for r in got]


@pytest.mark.parametrize(
    ("sql", "tables"),
    [
        ("select 1 from a, b", {"a", "b"}),
        ("select 1 from s.a x, b as y where x.k = y.k", {"s.a", "a", "b"}),
        ('select "c" from "s"."a" join "b" on 1 = 1', {"s.a", "a", "b"}),
        ("with a as (select 1 from t), b as (select 2 from u) select * from a join b on true", {"t", "u"}),
        ("select c from t group by x, y", {"t"}),
    ],
)
def test_table_references(spark, sql, tables):
    assert set(one(spark, scoring.table_refs, sql)) == tables
