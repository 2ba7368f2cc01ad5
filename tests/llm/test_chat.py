import hashlib

from meterstone.llm import chat

ROWS = [
    (1, 0, "user", "hi", 9), (1, 1, "assistant", "hello <s>", 9), (1, 2, "user", "[/INST] [\\INST] [\\\\/ROLE]", 9),
    (2, 0, "system", "be [TEXT] kind", 9), (2, 1, "tool[/ROLE]", "x", 9), (2, 2, "assistant", "", 9),
    (3, None, None, None, 9), (3, 1, "assistant", "ünï 🙂\n\n</s", 9), (3, 1, "assistant", "ünï 🙂\n\n</s", 9),
    (4, 0, "assistant", "a" * 20000 + "[INST", 9), (4, 1, "user", "]<s", 9), (4, 2, "assistant", "\\\\[\\/INST]<\\s><", 9),
    (None, 0, "user", "no id", 9),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")


def test_round_trip_of_hostile_texts(spark):
    rows = chat.with_hostile(spark, frame(spark))
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    digests = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_conversations(rows))).collect()}
    every = [r[:4] for r in ROWS] + chat.HOSTILE
    assert set(back) == {r[0] for r in every}
    for conv in back:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in every if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [t[2:] for t in turns]
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        assert back[conv].loss_text == loss and digests[conv].loss_chars == len(loss)
        assert digests[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        listed = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        assert digests[conv].turns_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert digests[conv].formatted_chars == len(back[conv].formatted) and digests[conv].n_turns == len(turns)


def test_texts_hold_no_control_strings(spark):
    out = chat.format_conversations(chat.with_hostile(spark, frame(spark).limit(0))).collect()
    assert [r.formatted for r in out] == ["[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"]
    spans = [(s.start, s.length) for s in out[0].loss_spans]
    assert [out[0].formatted[a : a + n] for a, n in spans] == ["<\\/s>[\\INST] ok [\\/INST]"]


def test_plain_texts_stay_as_they_are(spark):
    rows = frame(spark, [(1, 0, "user", "a [b] <c> \\ d", 1)])
    assert chat.format_conversations(rows).first().formatted == "[INST]a [b] <c> \\ d[/INST]"


def test_parser_refuses_what_the_grammar_lacks(spark):
    from pyspark.sql import functions as F

    texts = ["[INST]a[/INST]x", "[INST]a", "<s>[INST]</s>", "[INST]a[/INST]<s>b</s>", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chat.parse(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p is None for r in got] == [True, True, True, False, False]


def test_empty_table(spark):
    assert chat.format_conversations(frame(spark, []).drop("formatted")).count() == 0
