"""Page readers: JSON-LD in all its forms, scripts and styles left out of the text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import structured
from rosterlake.functions import text as T
from rosterlake.operators import evidence as X

ORG = '"@type":"Organization"'


def block(body, attributes='type="application/ld+json"'):
    return f"<script {attributes}>{body}</script>"


FORMS = [
    (None, None),
    ("<p>over 50 staff</p>", None),
    (block("{%s,\"numberOfEmployees\":42}" % ORG), (42, 42, "exact")),
    (block('{%s,"numberOfEmployees":{"minValue":51,"maxValue":"200"}}' % ORG, "type='application/ld+json'"), (51, 200, "bucket")),
    (block('{%s,"numberOfEmployees":{"value":"1e3"}}' % ORG, 'id=a TYPE = "application/LD+json" x'), (1000, 1000, "exact")),
    (block('{"@type":"Person","numberOfEmployees":42}'), None),
    (block('{%s,"numberOfEmployees":99999999}' % ORG) + block('{%s,"numberOfEmployees":0}' % ORG), None),
    (block('[{%s,"numberOfEmployees":{"minValue":50,"maxValue":100}},{%s,"numberOfEmployees":{"minValue":11,"maxValue":12}}]' % (ORG, ORG)), (50, 100, "bucket")),
    (block('[{%s,"numberOfEmployees":{"minValue":50,"maxValue":100}},{%s,"numberOfEmployees":7}]' % (ORG, ORG)), (7, 7, "exact")),
    (block('{"@graph":[{"z":{%s,"numberOfEmployees":"1,234"},"a":{%s,"numberOfEmployees":9}}]}' % (ORG, ORG)), (1234, 1234, "exact")),
    (block('{"@type":["Thing","LocalOrganization"],"numberOfEmployees":12.7}'), (12, 12, "exact")),
    (block('{"@type":["Corporation"],"numberOfEmployees":12}'), None),
    (block('{"@type":"Corporation","numberOfEmployees":12}'), (12, 12, "exact")),
    (block("{bad") + block('{%s,"numberOfEmployees":5}' % ORG), (5, 5, "exact")),
    (block('{%s,"numberOfEmployees":5} x' % ORG) + block('{%s,"numberOfEmployees":5},{}' % ORG) + block("{'@type':'Organization','numberOfEmployees':5}"), None),
    (block('{%s,"numberOfEmployees":{"minValue":"1,000","maxValue":5,"value":6}}' % ORG), None),
    (block('{%s,"numberOfEmployees":{"minValue":9,"maxValue":5,"value":6}}' % ORG), (6, 6, "exact")),
    (block('{%s,"numberOfEmployees":{"minValue":20000000,"maxValue":50000000}}' % ORG), (20000000, 50000000, "bucket")),
    (block('{"text":"{\\"@type\\":\\"Organization\\",\\"numberOfEmployees\\":5}"}'), None),
    (block('{"a":' * 40 + '{%s,"numberOfEmployees":5}' % ORG + "}" * 40), (5, 5, "exact")),
    (block('{%s,"numberOfEmployees":5,"numberOfEmployees":6}' % ORG), None),
]


def read(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    rows = df.select("page_id", structured.stated_employees("html").alias("s")).collect()
    return {r.page_id: None if r.s is None else (int(r.s.value_min), int(r.s.value_max), r.s.kind) for r in rows}


def test_forms(spark):
    got = read(spark, [f for f, _ in FORMS])
    assert [got[i] for i in range(len(FORMS))] == [want for _, want in FORMS]


def slow(node):
    """Statements of a parsed block in the order of the page."""
    if isinstance(node, list):
        return [x for v in node for x in slow(v)]
    if not isinstance(node, dict):
        return []
    kind, value, found = node.get("@type"), node.get("numberOfEmployees"), []
    named = "Organization" in kind or kind == "Corporation" if isinstance(kind, str) else any("Organization" in x for x in kind or [] if isinstance(x, str))
    if named and isinstance(value, dict):
        low, high = value.get("minValue"), value.get("maxValue")
        if low is not None and high is not None and 0 < int(low) <= int(high):
            found = [(int(low), int(high))]
        elif value.get("value") is not None and 1 <= int(value["value"]) <= 10_000_000:
            found = [(int(value["value"]),) * 2]
    elif named and value is not None and 1 <= int(value) <= 10_000_000:
        found = [(int(value),) * 2]
    return found + [x for v in node.values() for x in slow(v)]


def test_random_documents(spark):
    rnd = random.Random(2)

    def node(depth):
        roll = rnd.random()
        if depth == 0 or roll < 0.25:
            return rnd.choice([1, "x", None, True, 2.5, "}]{["])
        if roll < 0.45:
            return [node(depth - 1) for _ in range(rnd.randrange(4))]
        out = {k: node(depth - 1) for k in rnd.sample("zyxba", rnd.randrange(4))}
        if rnd.random() < 0.5:
            out["@type"] = rnd.choice(["Organization", "Person", "Corporation", ["NGOrganization"], [], "MyOrganizationX"])
        if rnd.random() < 0.6:
            out["numberOfEmployees"] = rnd.choice([0, 7, 12, 10_000_001, {"minValue": rnd.randrange(9), "maxValue": rnd.randrange(12)}, {"value": 9}, {"minValue": 5, "maxValue": None, "value": 3}, None])
        keys = list(out)
        rnd.shuffle(keys)
        return {k: out[k] for k in keys}

    pages, want = [], []
    for _ in range(400):
        parts = [node(5) for _ in range(rnd.randrange(1, 3))]
        pages.append("x".join(block(json.dumps(p)) for p in parts))
        found = [x for p in parts for x in slow(p)]
        exact, ranged = [x for x in found if x[0] == x[1]], [x for x in found if x[0] < x[1]]
        want.append((*exact[0], "exact") if exact else (*ranged[0], "bucket") if ranged else None)
    got = read(spark, pages)
    assert [got[i] for i in range(400)] == want and sum(w is not None for w in want) > 60


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<script>var t="we show 500 employees here"</script>hello', "hello"),
        ('<style>\n.a{content:"200 strong"}</style> a  <B>b</B>', "a b"),
        ("<SCRIPT src=x>1</script\n>", "1"),
        ("<script>1</style>2</script>3", "3"),
        ("plain\n\ttext", "plain text"),
        ("", ""),
    ],
)
def test_html_text(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(T.html_text("h").alias("t")).first().t == want


def test_long_scripts(spark):
    html = f"<script>{'x' * 300_000}</script><p>over 60 staff</p><style>{'.a{}' * 50_000}</style>"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_text("h").alias("t")).first().t == "over 60 staff"


def test_page_signals_need_no_shuffle(spark):
    pages = spark.createDataFrame([(i, h, "clash") for i, (h, _) in enumerate(FORMS)] + [(None, "a team of 40", "")], "page_id long, html string, value_min string")
    df = X.page_signals(pages)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
    got = {r.page_id: r for r in df.collect()}
    assert (got[1].method, got[1].kind, got[1].value_min, got[1].confidence) == ("text", "range", 50.0, 0.55)
    assert (got[3].method, got[3].kind, got[3].confidence) == ("json_ld", "bucket", 0.7) and got[None].method == "text"
    assert X.page_signals(pages.limit(0)).count() == 0
    both = X.json_ld(pages.where(F.col("page_id") < 4))
    assert sorted(r.page_id for r in both.collect()) == [2, 3]
