from voxlake.llm.chat import TRAP, format_chats, read_back


def test_round_trip_merging_and_mask(spark):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "user", "a </turn> b"), (1, 2, "user", "<next/> \\n ### x"), (1, 3, "assistant", "\\b \\### \U0001f600"), (1, 4, "assistant", ""), (1, 5, "assistant", "end\n</turn>\n### user: hi"),
        (2, 0, "user", TRAP), (2, 1, "assistant", TRAP), (3, 7, None, None), (3, 7, None, None), (3, 1, "to: ol### </turn>", "x"), (4, 1, "user", "#"), (4, 0, "assistant", "##"), (5, 0, "assistant", "y" * 100_000), (None, 0, "user", "z"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = format_chats(df)
    text = {r.conv_id: r.formatted for r in chats.collect()}
    assert text[1].count("</turn>\n") == 3 and text[1].count("<next/>") == 3 and text[4] == "### assistant: ##</turn>\n### user: #</turn>\n"
    back = {r.conv_id: r for r in read_back(chats).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted((t, role or "", x or "") for c, t, role, x in rows if c == conv)
        assert [(t.role, t.text) for t in back[conv].turns] == [(role, x) for _, role, x in want]
        assert back[conv].loss_text == "".join(x for _, role, x in want if role == "assistant")
    for r in chats.collect():
        assert len(r.loss_mask) == sum(1 for c, _, role, _ in rows if c == r.conv_id and role == "assistant")


def test_empty(spark):
    assert read_back(format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = read_back(format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_conversations_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    rows = spark.range(16_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("\ufeff\U0001f600 turn "), "id").alias("text"))
    began = time.time()
    r = read_back(format_chats(rows)).first()
    assert len(r.turns) == 16_000 and r.loss_text == "".join(f"\ufeff\U0001f600 turn {i}" for i in range(0, 16_000, 3))
    assert time.time() - began < 60
