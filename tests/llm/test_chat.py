import random

from seqloom.llm import chat
from seqloom.llm.queries import SHOUT

SCHEMA = "conv_id long, turn long, role string, text string, n int, written string"
PARTS = ["### ", "</turn>", "\n", "\\", "<", "/", ": ", "#", "assistant", "### assistant: ", "</turn>\n", "é😀", "<\\/turn>", "\\###", " "]


def rows():
    r = random.Random(3)
    out = [(-7, 0, "user", SHOUT), (-7, 1, "assistant", SHOUT)]
    for conv in range(60):
        for turn in range(r.randrange(1, 6)):
            text = None if r.random() < 0.1 else "".join(r.choice(PARTS) for _ in range(r.randrange(12)))
            role = r.choice(["user", "assistant", "system", "assistant", None, "odd: role\n", "###", "\\x41"])
            out.append((conv, turn, role, text))
    out += [(None, 1, "user", "no id"), (None, None, "assistant", "no turn"), (200, 1, "user", "tie b"), (200, 1, "assistant", "tie a")]
    out += [(201, 1, "user", "twice"), (201, 1, "user", "twice"), (202, 0, "assistant", "long " * 50_000)]
    return out


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*x, 1, "w") for x in data], SCHEMA)
    got = {r.conv_id: r for r in chat.format_turns(df).collect()}
    want = {}
    order = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
    for conv, _, role, text in order:
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        r = got[conv]
        assert r.identical
        assert [(t.role, t.text) for t in r.parsed] == turns
        assert r.formatted.count(chat.END) == len(turns)
        shown = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(shown) == sum(role == "assistant" for role, _ in turns)
        for written, text in zip(shown, [t for role, t in turns if role == "assistant"]):
            assert chat.STOP not in written
            assert written == text or "\\" in written


def test_plain_turns_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi \\ there", 1, "w"), (1, 1, "assistant", "yes", 1, "w")], SCHEMA)
    assert chat.format_turns(df).first().formatted == "### user: hi \\ there</turn>\n### assistant: yes</turn>\n"


def test_empty(spark):
    assert chat.format_turns(spark.createDataFrame([], SCHEMA)).count() == 0
