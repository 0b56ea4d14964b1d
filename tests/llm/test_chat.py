from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def read_back(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    out = done.select("conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("back"), chat.read_learned(F.col("segments")).alias("learned"))
    return {r.conv_id: r for r in out.collect()}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="#\\<>/turn e: h\nAé日", max_size=30), min_size=1, max_size=30))
def test_texts_come_back(spark, texts):
    rows = [(i % 3, i, ["user", "assistant", "odd: \\###"][i % 3], t) for i, t in enumerate(texts)]
    got = read_back(spark, rows)
    for c in got:
        own = [r for r in rows if r[0] == c]
        assert [(x.role, x.text) for x in got[c].back] == [(r[2], r[3]) for r in own]
        assert got[c].learned == "".join(r[3] for r in own if r[2] == "assistant")


def test_orders_nulls_and_repeats(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
        (2, 0, "assistant", "a"), (3, 1, "assistant", None), (3, 0, "user", "### System: "),
        (None, 0, "user", "x"), (4, 0, None, "y"), (5, 0, "user", "u"), (5, 0, "user", "u"),
    ]
    got = read_back(spark, rows)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: True, None: False, 4: False, 5: False}
    assert [(x.role, x.text) for x in got[3].back] == [("user", "### System: "), ("assistant", "")]
    assert len(got[5].back) == 2
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_extra_columns_do_no_harm(spark):
    d = spark.createDataFrame([(1, 0, "user", "u", "z")], TURNS + ", turns string")
    assert chat.format_conversations(d).first().n_turns == 1
