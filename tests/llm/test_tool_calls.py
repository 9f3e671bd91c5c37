import json

from pyspark.sql import functions as F

from basketlore.llm.catalog import ORACLE_SQL, QUERIES
from basketlore.llm.tool_calls import Parameter, link_conversations, link_tool_calls
from tools.compare import oracle_connection, rows

MESSAGES = (
    "conv_id bigint, turn bigint, kind string, call_id string, parent_id string, name string, "
    "arguments string, content string"
)
SCHEMAS = {
    "search": {"q": Parameter("string"), "n": Parameter("integer", required=False, minimum=1, maximum=10)},
    "plot": {"at": Parameter("array"), "opts": Parameter("object", required=False), "scale": Parameter("number", required=False)},
    "now": {},
}


def call(turn, call_id, parent=None, name="search", arguments='{"q":"x"}'):
    return (1, turn, "call", call_id, parent, name, arguments, None)


def result(turn, call_id, content="ok"):
    return (1, turn, "result", call_id, None, None, None, content)


def link(spark, messages):
    found = link_tool_calls(spark.createDataFrame(messages, MESSAGES).withColumn("level", F.lit("mine")), SCHEMAS)
    return found.orderBy("turn", "kind").collect()


def test_links_and_levels(spark):
    found = link(
        spark,
        [
            call(0, "a"), result(1, "a"), result(9, "a", "late"),
            call(2, "b", "a"), result(3, "b"), call(4, "c", "b"),
            call(5, "a", None), call(6, "d", "c"), result(7, "nobody"),
            call(10, "x", "y"), result(11, "x"), call(12, "y", "x"), result(13, "y"), call(14, "z", "y"),
            call(15, None), result(16, None), (1, 17, "user", None, None, None, None, 'say "hi"\n'),
            call(18, "me", "me"), result(19, "me"),
        ],
    )
    got = {r["turn"]: (r["status"], r["level"]) for r in found}
    assert got == {
        0: ("linked", 0), 1: ("linked", 1), 9: ("extra", 1), 2: ("linked", 2), 3: ("linked", 3), 4: ("open", 4),
        5: ("duplicate", 0), 6: ("open", 0), 7: ("orphan", None), 10: ("cycle", None), 11: ("cycle", None),
        12: ("cycle", None), 13: ("cycle", None), 14: ("cycle", None), 15: ("no_id", None), 16: ("orphan", None),
        17: ("plain", None), 18: ("cycle", None), 19: ("cycle", None),
    }
    assert {r["turn"]: r["json"] for r in found}[17] == '{"content":"say \\"hi\\"\\n","type":"user"}'


def test_long_chain(spark):
    n = 70
    messages = [call(2 * i, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)]
    messages += [result(2 * i + 1, f"c{i}") for i in range(n)]
    assert [r["level"] for r in link(spark, messages)] == list(range(2 * n))


def test_arguments(spark):
    cases = {
        '{"q": "ü", "n": 3}': ("search", ""),
        '{"n": 3}': ("search", "q: missing"),
        '{"q": 5, "n": 30, "more": null, "a": 1}': ("search", "q: not string; n: above 10; a: unknown; more: unknown"),
        '{"n": "1", "q": "x"}': ("search", "n: not integer"),
        '{"n": 0, "q": "x"}': ("search", "n: below 1"),
        '{"n": 1.5, "q": "x"}': ("search", "n: not integer"),
        "[1]": ("search", "arguments: not an object"),
        "{broken": ("search", "arguments: not an object"),
        '{"scale": 1.5, "opts": {"b": 1, "a": [true, null]}, "at": [1, "x"]}': ("plot", ""),
        "{}": ("now", ""),
        '{"q": 1}': ("shout", "name: unknown tool"),
    }
    messages = [call(i, str(i), None, name, text) for i, (text, (name, _)) in enumerate(cases.items())]
    found = link(spark, [*messages, call(98, "98", None, "now", None)])
    assert [r["errors"] for r in found] == [*(e for _, e in cases.values()), "arguments: not an object"]
    for r, (text, (name, error)) in zip(found, cases.items(), strict=False):
        if "not an object" not in error:
            want = {"arguments": json.loads(text), "id": r["call_id"], "name": name, "type": "call"}
            assert r["json"] == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_query_equals_sql(spark, folder):
    df = QUERIES["op7_tool_calls"](spark, folder)
    answer = oracle_connection(folder).execute(ORACLE_SQL["op7_tool_calls"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in answer.description], answer.fetchall())


def test_odd_conversations(spark):
    schema = "conv_id bigint, turn int, role string, text string"
    odd = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, "user", "x" * 100_000), (1, 3, "assistant", "y" * 9_000),
           (1, 1, "assistant", ""), (None, 0, "user", "a"), (2, None, "assistant", "b"), (3, 0, None, "c"), (3, 1, "tool", "d")]
    found = link_conversations(spark.createDataFrame(odd, schema).withColumn("kind", F.lit(1))).collect()
    assert len(found) == len(odd)
    status = {(r["conv_id"], r["turn"], r["kind"]): (r["status"], r["errors"]) for r in found}
    assert status[1, 1, "call"] == ("linked", "chars: below 1")
    assert status[1, 3, "call"] == ("open", "chars: above 1500")
    assert status[2, None, "call"][0] == "no_id" and status[3, 0, "unknown"][0] == "plain"
    assert link_conversations(spark.createDataFrame([], schema)).collect() == []
