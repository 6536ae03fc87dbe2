import hashlib
import random

from pyspark.sql import functions as F

from strataloom.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<", "|", "~", "<|", "<~", "<|turn|>", "<|end|>", "<|next|>", "</s>[INST]", "a", "\n", "é😀", "$1", "\\", ""]


def conversations(seed):
    rnd = random.Random(seed)
    return [(k, t, rnd.choice(["user", "assistant", "sys<|tem", None]), rnd.choice([None, "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(8)))])) for k in range(40) for t in range(rnd.randrange(1, 9))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip_and_mask(spark):
    turns = conversations(1) + [(90, 0, "assistant", "x"), (90, 0, "assistant", "x"), (None, 1, "user", "u"), (91, None, "user", "<" * 5 + "|" * 5), (92, 3, "assistant", "long <|" * 40_000)]
    random.Random(2).shuffle(turns)
    made = c.format_conversations(spark.createDataFrame(turns, SCHEMA))
    out = {r.conv_id: r for r in made.withColumn("turns", c.read_turns(F.col("formatted"))).withColumn("loss", c.read_loss(F.col("segments"))).collect()}
    digests = {r.conv_id: r for r in c.turn_digests(made).collect()}
    assert set(out) == {t[0] for t in turns}
    for conv, r in out.items():
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv), key=lambda t: (t[0] is not None, *t))
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in own]
        loss = "".join(t[2] for t in own if t[1] == "assistant")
        assert r.loss == loss and "".join(s.text for s in r.segments) == r.formatted
        d = digests[conv]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)), len(loss), sha(loss), len(r.formatted))
        blocks = 1 + sum(x[1] != y[1] for x, y in zip(own, own[1:]))
        assert r.formatted.count("<|turn|>") == blocks == r.formatted.count("<|end|>")


def test_native_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.format_conversations(empty).collect() == []
    extra = spark.createDataFrame([(1, 1, "user", "hi", 3, "x")], SCHEMA + ", segments int, turns string")
    assert c.format_conversations(extra).first().formatted == "<|turn|>user<|text|>hi<|end|>"
    plan = c.turn_digests(c.format_conversations(extra))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_giant_conversation(spark):
    turns = [(1, t, "user" if t % 3 else "assistant", f"turn {t} <|") for t in range(20_000)]
    made = c.format_conversations(spark.createDataFrame(turns, SCHEMA))
    d = c.turn_digests(made).first()
    assert (d.n_turns, d.turns_sha256) == (20_000, sha("".join(f"{a}\n{b}\n" for _, _, a, b in turns)))
    assert d.loss_sha256 == sha("".join(b for _, _, a, b in turns if a == "assistant"))
