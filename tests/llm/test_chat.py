import hashlib

from pyspark.sql import functions as F

from cuelake.llm import chat, registry

ODD = ["", " ", "\\", "\\\\", "### ", "\\### Assistant: </turn> ok", "</turn>", "</turn>\n", "<\\/turn>", "<\\\\/turn>", "<next>", "<<next>>", "#\\## ", "#### ", "a:\nb", "é\U0001f600 </turn", "\n\n", "<next></turn>\n### user:\n", "x\\", "<"]
SCHEMA = "conv_id long, turn long, role string, text string"


def read(df):
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return {r["conv_id"]: r for r in df.select("*", turns.alias("turns"), loss.alias("loss")).collect()}


def test_every_text_and_role_is_read_back(spark):
    roles = ["user", "assistant", "assistant", "tool:\n</turn>", "a:\n\\b", ""]
    rows = [(c, k, roles[(c + k * k) % len(roles)], ODD[(c * 7 + k) % len(ODD)]) for c in range(40) for k in range(c)]
    got = read(chat.format_conversations(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(x for x in rows if x[0] == c)
        assert [tuple(t) for t in r["turns"]] == [(role, text) for _, _, role, text in own]
        assert r["loss"] == "".join(text for _, _, role, text in own if role == "assistant")
        # blocks: one for each stretch of one role, closed by a marker that no text holds
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        assert r["formatted"].count("</turn>\n") == r["formatted"].count("</turn>") == blocks
        spans = [(s["start"], s["length"]) for s in r["loss_spans"]]
        assert len(spans) == sum(x[2] == "assistant" for x in own)
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_nulls_ties_repeats_and_order(spark):
    rows = [(1, 2, "user", "b"), (1, None, None, None), (1, 2, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "a"), (None, 0, "assistant", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash")).withColumn("LOSS_SPANS", F.lit(1)).withColumn("conv", F.lit(0))
    got = read(chat.format_conversations(docs))
    assert [tuple(t) for t in got[1]["turns"]] == [("", ""), ("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[1]["loss"] == "" and len(got[1]["loss_spans"]) == 1
    assert got[None]["loss"] == "x" and got[None]["formatted"] == "### assistant:\nx</turn>\n"
    assert chat.format_conversations(docs.limit(0)).collect() == []


def test_long_conversations(spark):
    """More turns than a group of the running sums holds, and a very long text."""
    n = 2_000
    turns = spark.range(n).selectExpr("5L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('</turn>', id) as text")
    long = spark.range(1).selectExpr("6L as conv_id", "0L as turn", "'assistant' as role", "repeat('<next> é', 300000) as text")
    got = read(chat.format_conversations(turns.union(long)))
    assert [t["text"] for t in got[5]["turns"]] == [f"</turn>{i}" for i in range(n)]
    assert got[5]["loss"] == "".join(f"</turn>{i}" for i in range(n) if i % 3)
    assert got[6]["loss"] == "<next> é" * 300_000


def test_other_trained_roles(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "tool", "t"), (1, 2, "assistant", "a")]
    got = read(chat.format_conversations(spark.createDataFrame(rows, SCHEMA), trained=("user", "tool")))
    assert got[1]["loss"] == "ut"


def test_query_has_the_planted_conversation(spark, sf_dir):
    got = {r["conv_id"]: r for r in registry.op12_chat(spark, sf_dir).collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(text)
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_plan_has_no_python(spark, sf_dir):
    plan = registry.op12_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
